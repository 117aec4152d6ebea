"""False-positive rules on ``(entity, chunk)``; every rule is true when the span must go.

``chunk`` is the matched text without surrounding white space.
"""

from pyspark.sql import Column, functions as F

from sladd.functions.text import holds, in_words, is_upper, let, spelled_out, symbol_tree
from sladd.rules.words import COMPOUND_SUFFIXES, DATE_PREPOSITIONS, NAME_PARTICLES

# The endings, spelled out and reversed: one anchored look at the reversed word instead of a search in the word.
_REVERSED = r"\A" + symbol_tree(v[::-1] for ending in COMPOUND_SUFFIXES for v in spelled_out(ending))
DATE_LEAD = r"(?iU)^(?:[A-Za-zÆØÅæøå]+\s+)?(?:" + "|".join(DATE_PREPOSITIONS) + r")\b"

PERSON_LIKE = ("PERSON", "NRP")
# No rule speaks of any other entity.
JUDGED = (*PERSON_LIKE, "LOCATION", "NO_ADDRESS", "DATE_TIME")


def has_suffix(word: Column) -> Column:
    return holds(F.reverse(F.lower(word)), _REVERSED)


def name_token(token: Column) -> Column:
    """Starts with a capital or is a particle."""
    return is_upper(F.substring(token, 1, 1)) | in_words(F.lower(token), NAME_PARTICLES)


def facts(entity: Column, chunk: Column, lexicon) -> Column:
    """What the rules ask about a chunk, looked up once.

    ``words`` holds the chunk, the chunk without trailing punctuation and each token without punctuation, with
    flags in the same order; ``tokens`` holds the tokens as they are.
    """
    tail_free = F.regexp_replace(chunk, r"[.,;:!?\-]+$", "")

    def build(tokens):
        words = F.concat(
            F.array(chunk, tail_free), F.transform(tokens, lambda t: F.regexp_replace(t, r"(?U)[^\w]", ""))
        )
        return F.struct(
            entity.alias("entity"), chunk.alias("chunk"), tokens.alias("tokens"),
            chunk.contains(" ").alias("multi"), tail_free.contains(" ").alias("multi_tail_free"),
            F.transform(tokens, name_token).alias("name_like"),
            F.transform(words, lambda w: in_words(F.lower(w), lexicon.denied)).alias("denied"),
            F.transform(words, lambda w: has_suffix(w)).alias("suffix"),
            F.transform(words, lexicon.known or (lambda w: in_words(w, lexicon.names))).alias("known"),
            is_upper(chunk).alias("upper"), F.length(chunk).alias("size"),
            entity.isin(*PERSON_LIKE).alias("person"), (entity == "LOCATION").alias("location"),
        )

    return let(F.split(chunk, r"(?U)\s+"), build)


def _tokens_of(flags: Column) -> Column:
    return F.slice(flags, F.lit(3), F.size(flags))


def _any(flags: Column) -> Column:
    return F.array_contains(flags, True)


def _all_names(f: Column) -> Column:
    return ~F.array_contains(f["name_like"], False)


def year(f):
    return f["entity"].isin("LOCATION", "NO_ADDRESS") & f["chunk"].rlike(r"(?U)^(?:19|20)\d{2}$")


def year_start(f):
    return (f["entity"] == "NO_ADDRESS") & f["chunk"].rlike(r"(?U)^(?:19|20)\d{2}\b")


def id_code(f):
    return (f["person"] | f["location"]) & f["chunk"].rlike(r"^[A-Za-z]{1,4}[-/][0-9]{1,6}[A-Za-z]?$")


def all_caps(f):
    return f["person"] & (f["size"] >= 2) & f["upper"]


def denylist(f):
    return f["person"] & f["denied"][0]


def short_token(f):
    return f["person"] & ~f["multi"] & (f["size"] <= 4) & ~f["known"][0]


def compound_noun(f):
    return f["person"] & ~f["multi"] & f["suffix"][0]


def not_capitalised(f):
    return f["person"] & f["multi"] & ~_all_names(f)


def denied_token(f):
    return f["person"] & f["multi"] & (_any(_tokens_of(f["denied"])) | _any(_tokens_of(f["suffix"])))


def latin_ext_b(f):
    return f["location"] & f["chunk"].rlike(r"[\x{0180}-\x{024F}]")


def private_use(f):
    return f["location"] & f["chunk"].rlike(r"[\x{E000}-\x{F8FF}]")


def location_newline(f):
    return f["location"] & f["chunk"].contains("\n")


def location_caps(f):
    return f["location"] & (f["size"] <= 4) & f["upper"]


def location_denylist(f):
    return f["location"] & f["denied"][1]


def location_suffix(f):
    return f["location"] & ~f["multi_tail_free"] & f["suffix"][1]


def location_lower(f):
    return f["location"] & f["multi"] & ~_all_names(f)


def address_newline(f):
    return (f["entity"] == "NO_ADDRESS") & f["chunk"].contains("\n")


def date_preposition(f):
    return (f["entity"] == "DATE_TIME") & f["chunk"].rlike(DATE_LEAD)


# Rules that drop a span whatever else holds.
EARLY_RULES = {
    "year": year,
    "year_start": year_start,
    "id_code": id_code,
    "all_caps": all_caps,
    "denylist": denylist,
    "short_token": short_token,
    "compound_noun": compound_noun,
}
# Rules not asked once a prefix is salvaged.
LATE_RULES = {
    "denied_token": denied_token,
    "latin_ext_b": latin_ext_b,
    "private_use": private_use,
    "location_newline": location_newline,
    "location_caps": location_caps,
    "location_denylist": location_denylist,
    "location_suffix": location_suffix,
    "location_lower": location_lower,
    "address_newline": address_newline,
    "date_preposition": date_preposition,
}
RULES = {**EARLY_RULES, "not_capitalised": not_capitalised, **LATE_RULES}


def salvage_length(f: Column) -> Column:
    """Length of the leading run of name tokens, or null if it holds no known name or a denied word."""
    bad = F.array_position(f["name_like"], False).cast("int")
    run = F.when(bad == 0, F.size(f["tokens"])).otherwise(bad - 1)

    def measure(n):
        def head(flags):
            return F.slice(flags, F.lit(3), n)

        # Each token is the next non-space text, so locating it from the last end finds the token itself.
        end = F.aggregate(
            F.slice(f["tokens"], F.lit(1), n), F.lit(0),
            lambda at, w: F.call_function("locate", w, f["chunk"], at + 1) - 1 + F.length(w),
        )
        good = _any(head(f["known"])) & ~_any(head(f["denied"])) & ~_any(head(f["suffix"]))
        return F.when((n > 0) & good, end)

    return let(run, measure)


def _fires(rules, f: Column) -> Column:
    out = F.lit(False)
    for rule in rules.values():
        out = out | rule(f)
    return out


def kept_length(entity: Column, chunk: Column, lexicon) -> Column:
    """Null to drop the span, the full length to keep it, less when only a prefix is salvaged."""

    def judge(f):
        return (
            F.when(_fires(EARLY_RULES, f), F.lit(None).cast("int"))
            .when(not_capitalised(f), salvage_length(f))
            .when(~_fires(LATE_RULES, f), f["size"])
        )

    return F.when(~entity.isin(*JUDGED), F.length(chunk)).otherwise(let(facts(entity, chunk, lexicon), judge))


def fires(name: str, entity: Column, chunk: Column, lexicon) -> Column:
    """One rule on its own."""
    return let(facts(entity, chunk, lexicon), lambda f: RULES[name](f))
