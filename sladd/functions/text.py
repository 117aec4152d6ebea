"""Small text helpers that follow Unicode rules."""

import re

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, also inside lambdas."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def exploded(df: DataFrame, keep, array: Column, name: str) -> DataFrame:
    """One row per array element, as ``explode`` gives.

    ``explode`` makes the optimizer filter on the size of the array first, which repeats the expression behind
    it; the outer form with a filter on the element does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def is_upper(text: Column) -> Column:
    """At least one cased character and none in lower case."""
    return (text == F.upper(text)) & (text != F.lower(text))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def in_words(word: Column, words) -> Column:
    """Exact membership in a word set, by its hash: inside lambdas a literal pattern would be decoded anew for every word."""
    return word.isin(sorted(words)) if words else F.lit(False)


def holds(text: Column, pattern: str) -> Column:
    """As ``rlike``, which inside lambdas decodes its pattern anew for every text; for long patterns."""
    return F.regexp_instr(text, F.lit(pattern)) > 0


def escape_regex(word: str) -> str:
    return re.sub(r"([\\.\[\](){}*+?^$|])", r"\\\1", word)


def any_of(words) -> str:
    return "|".join(escape_regex(w) for w in words)


def symbol_tree(sequences) -> str:
    """An alternation of symbol sequences that shares prefixes, so its cost follows their length, not their number.

    A symbol is an escaped character or a small pattern of its own. Longer sequences are preferred.
    """
    tree: dict = {}
    for sequence in sequences:
        node = tree
        for symbol in sequence:
            node = node.setdefault(symbol, {})
        node[""] = {}

    def render(node):
        branches = [symbol + render(child) for symbol, child in sorted(node.items()) if symbol]
        if not branches:
            return ""
        if len(branches) == 1 and "" not in node:
            return branches[0]
        return "(?:" + "|".join(branches) + ")" + ("?" if "" in node else "")

    return render(tree)


def prefix_tree(words) -> str:
    """:func:`symbol_tree` of plain words."""
    return symbol_tree([escape_regex(c) for c in word] for word in words)


def spelled_out(term: str):
    """The finite variants of a term as sequences of letters and gap patterns."""

    def variants(i):
        out, current = [], [()]
        while i < len(term) and term[i] != ")":
            if term[i] == "|":
                out, current, i = out + current, [()], i + 1
                continue
            if term.startswith("(?:", i):
                options, i = variants(i + 3)
                i += 1
            elif term[i] == "[":
                end = term.index("]", i) + 1
                body = term[i:end]
                options = [(body,)] if "\\" in body else [(c,) for c in body[1:-1]]
                i = end
            elif term.startswith(r"\s+", i):
                options, i = [(r"\s+",)], i + 3
            else:
                options, i = [(escape_regex(term[i]),)], i + 1
            if i < len(term) and term[i] == "?":
                options, i = [*options, ()], i + 1
            current = [a + b for a in current for b in options]
        return out + current, i

    return variants(0)[0]


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values, sql_type: str) -> Column:
    """A literal array in one step; building it element by element costs a driver round trip each."""
    items = ", ".join(sql_text(v) if isinstance(v, str) else str(v) for v in values)
    return F.expr(f"cast(array({items}) as array<{sql_type}>)")
