"""Word lists of any length: looked up inside the row while their checked size allows, else filtered and joined.

A listed name is one word or a run of words with what stands between them. Every word that some name holds is its vocabulary.
A text is first cut to the words of the vocabulary that occur in it; texts without any are done. Only the others are searched,
for these words alone, so offsets are running sums over a few pieces rather than over all words of the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sladd.functions import spans as S
from sladd.functions.text import let
from sladd.operators import joins

# Bits of the filter for longer lists: 16 a word, and at most 2 MB.
BITS_PER_WORD = 16
MOST_BITS = 1 << 24
# With more known words than this in a text, all words are marked: the pattern then no longer grows with them.
MANY_WORDS = 64
RUN_TYPE = "struct<start:int,chunk:string>"


def _power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def hashed_words(words: DataFrame) -> Callable[[Column], Column]:
    """Exact membership in a short one-column table, as one literal: a word's hash names the only cell that can hold it.

    The cells are one string that the optimizer splits once, so a list of 100,000 words is one node of the plan.
    """
    word = F.col(words.columns[0])
    clean = words.where(word.isNotNull() & ~word.contains(S.MARK) & ~word.contains(S.GAP)).select(word.alias("w")).distinct()
    cells = _power(clean.count())
    rows = clean.groupBy(F.pmod(F.xxhash64("w"), F.lit(cells)).alias("cell")).agg(F.array_join(F.array_sort(F.collect_list("w")), S.GAP).alias("words"))
    held = [""] * cells
    for row in rows.collect():  # at most joins.BROADCAST_WORDS words, which is_short has counted
        held[row.cell] = f"{S.GAP}{row.words}{S.GAP}"
    table = F.split(F.lit(S.MARK.join(held)), S.MARK, -1)

    def has(value: Column) -> Column:
        cell = F.element_at(table, (F.pmod(F.xxhash64(value), F.lit(cells)) + 1).cast("int"))
        return (cell != "") & cell.contains(F.concat(F.lit(S.GAP), value, F.lit(S.GAP)))

    return has


class WordFilter:
    """True for every listed word, and for a few others: a bit set of hashes, built by Spark, of at most ``MOST_BITS`` bits.

    The bits are a broadcast variable of 2 MB at most that one Arrow call a batch looks into, so the plan holds no list.
    """

    def __init__(self, words: DataFrame, bits: int | None = None):
        self.bits = bits or enough_bits(words)
        # the built-in bitmaps count from 1, in buckets of 32,768 bits
        at = words.select((self.places(F.col(words.columns[0])) + 1).alias("p"))
        rows = at.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        held = bytearray(self.bits >> 3)
        for row in rows.toLocalIterator():  # at most MOST_BITS / 8 bytes
            held[(row.bucket - 1) * 4096 : row.bucket * 4096] = row.bits
        self._look = _bit_reader(words.sparkSession.sparkContext.broadcast(bytes(held)))

    def places(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.bits))

    def each(self, words: Column) -> Column:
        """A flag for each word of an array."""
        return self._look(F.transform(words, self.places))

    def __call__(self, value: Column) -> Column:
        return self.each(F.array(value))[0]


def _bit_reader(held):
    @F.arrow_udf("array<boolean>")
    def look(places: pa.Array) -> pa.Array:
        bits, at = np.frombuffer(held.value, np.uint8), places.flatten().to_numpy(zero_copy_only=False)
        flags = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        sizes = pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flags), mask=pc.is_null(places))

    return look


def enough_bits(words: DataFrame) -> int:
    return min(MOST_BITS, max(1 << 15, _power(BITS_PER_WORD * words.count())))


def word_filter(words: DataFrame) -> WordFilter:
    return WordFilter(words)


def vocabulary(names: DataFrame, column: str = "name") -> DataFrame:
    """Every word of the listed names, in lower case: ``word``."""
    found = F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"(?U)\w+"), 0)
    return names.select(F.explode(found).alias("word")).distinct()


def longest_run(names: DataFrame, column: str = "name") -> int:
    """Words of the longest listed name."""
    return names.agg(F.max(F.regexp_count(F.col(column), F.lit(r"(?U)\w+")))).first()[0] or 1


def text_words(text: Column) -> Column:
    """The different words of a text; an empty one where it starts or ends otherwise."""
    return F.array_distinct(F.split(S.guard(text), r"(?U)\W+"))


def word_runs(text: Column, known: Column, longest: int, wanted=None) -> Column:
    """All runs of 1 to ``longest`` words of ``known``: ``array<struct<start, chunk>>``; ``wanted`` picks by the lower-cased run.

    Runs may overlap. A text without such words gives an empty array before anything is searched.
    """
    clean = S.guard(text)

    def search(present):
        few = F.concat(F.lit(r"(?U)(?<!\w)(?:"), F.array_join(present, "|"), F.lit(r")(?!\w)"))
        pattern = F.when(F.size(present) <= MANY_WORDS, few).otherwise(F.lit(r"(?U)\w+"))
        pieces = F.split(F.regexp_replace(clean, pattern, F.lit(f"{S.MARK}$0{S.MARK}")), S.MARK, -1)
        return F.when(F.size(present) > 0, let(pieces, runs)).otherwise(S.empty(RUN_TYPE))

    def runs(pieces):
        def with_starts(starts):
            def of_length(n):
                def run(i):
                    parts = [F.get(pieces, i + k) for k in range(2 * n - 1)]
                    return F.struct(starts[i].alias("start"), F.concat(*parts).alias("chunk"))

                each = F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), run)
                return F.filter(each, lambda r: r["chunk"].isNotNull() & (wanted(F.lower(r["chunk"])) if wanted else F.lit(True)))

            return F.concat(*[of_length(n) for n in range(1, longest + 1)])

        offsets = S.running(F.transform(pieces, lambda p: F.length(p)), lambda a, b: a + b)
        return F.when(F.size(pieces) > 1, let(offsets, with_starts)).otherwise(S.empty(RUN_TYPE))

    return let(known, search)


def leftmost_longest(runs: Column) -> Column:
    """Runs that don't overlap: from the left, the longest at each place, as one alternation would match them."""

    def as_span(r):
        return F.struct(
            F.lit("").alias("entity"), r["start"].alias("start"), (r["start"] + F.length(r["chunk"])).alias("end"),
            F.lit(1.0).alias("score"), F.lit(0).alias("src"), r["chunk"].alias("chunk"),
        )

    picked = S.resolve(F.transform(runs, as_span), S.RICH_TYPE)
    return F.transform(picked, lambda s: F.struct(s["start"].alias("start"), s["chunk"].alias("chunk")))


def _joined(runs: DataFrame, keys: DataFrame, by, salts: int = 16) -> DataFrame:
    """Runs (with ``key``) that are listed; ``salts`` spreads frequent names over that many copies of the names that occur."""
    copies = keys.join(runs.select("key").distinct(), "key", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return runs.withColumn("salt", F.pmod(F.xxhash64(by, "start"), F.lit(salts)).cast("int")).join(copies, ["key", "salt"]).drop("salt")


def name_hits(df: DataFrame, names: DataFrame, unit: str = "unit_id", text: str = "text", longest: int | None = None, salts: int = 16) -> DataFrame:
    """Words and word runs that are listed names, for lists of any length: ``unit, start, end, chunk``.

    Up to the checked size, all of it happens inside the row. For a longer list a bit set picks the words that may be listed,
    and only their runs, short rows, are joined.
    """
    table = NameTable(names, longest=longest)
    found = table.runs(df.select(unit, text), text, "_found")
    rows = found.select(unit, F.explode_outer("_found").alias("g")).where("g is not null").select(unit, "g.start", "g.chunk")
    hits = rows if table.short else _joined(rows.withColumn("key", F.lower("chunk")), table.keys, unit, salts)
    return hits.select(unit, "start", (F.col("start") + F.length("chunk")).alias("end"), "chunk")


class NameTable:
    """A table of names (column ``name``) for the whole analysis, whatever its length.

    ``attach`` adds what the analysis needs to know about the names in each text.
    """

    LISTED, EXACT = "_listed", "_listed_exact"

    def __init__(self, names: DataFrame, longest: int | None = None):
        self.names = names.select("name").where("name is not null")
        self.keys = self.names.select(F.lower("name").alias("key")).distinct()
        words = vocabulary(self.names)
        self.short = joins.is_short(self.names) and joins.is_short(words)
        self.longest = longest or longest_run(self.names)
        self._word = hashed_words(words) if self.short else None
        self._words, self._bits = words, None if self.short else enough_bits(words)
        self._key, self._name = (hashed_words(self.keys), hashed_words(self.names)) if self.short else (None, None)

    def runs(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """Add ``out``, the listed runs of a text; for a list beyond the checked size, runs that may be listed.

        The bits of a long list are those of its words that occur in the texts, so that a list of any length leaves them sparse.
        """
        c = F.col(f"`{text}`")
        if self.short:
            known = F.filter(text_words(c), lambda w: (w != "") & self._word(F.lower(w)))
            return df.withColumn(out, word_runs(c, known, self.longest, self._key))
        present = df.select(F.explode(text_words(c)).alias("word")).select(F.lower("word").alias("word")).distinct()
        may_have = WordFilter(self._words.join(present, "word", "left_semi"), self._bits)
        flags = may_have.each(F.transform(text_words(c), lambda w: F.lower(w)))
        known = F.array_compact(F.zip_with(text_words(c), F.col("_flags"), lambda w, f: F.when((w != "") & f, w)))
        return df.withColumn("_flags", flags).withColumn(out, word_runs(c, known, self.longest)).drop("_flags")

    def attach(self, df: DataFrame, text: str) -> DataFrame:
        """Add ``LISTED``, the listed runs of each text, leftmost and longest, as ``array<struct<start, chunk>>``.

        A list beyond the checked size is joined: only texts with words that may be listed move, and their hits come back as one
        array a text, by two hashes of the text, so that no key is asked of the caller. ``EXACT`` then holds the runs that are
        listed in the same case.
        """
        c = F.col(f"`{text}`")
        # As a generated column it is computed once a row, where the rows lie: a filter on it would move below a repartition.
        found = self.runs(df, text, "_found").withColumn("_found", F.explode_outer(F.array(F.coalesce("_found", S.empty(RUN_TYPE)))))
        if self.short:
            return found.withColumn(self.LISTED, leftmost_longest(F.col("_found"))).drop("_found")
        some = found.where(F.size("_found") > 0).withColumn("_text", F.struct(F.xxhash64(c).alias("a"), F.md5(c).alias("b")))
        rest = found.where(F.size("_found") == 0).drop("_found")
        rest = rest.withColumn(self.LISTED, S.empty(RUN_TYPE)).withColumn(self.EXACT, F.expr("cast(array() as array<string>)"))
        # equal texts ask once
        runs = some.select("_text", F.explode("_found").alias("g")).select("_text", "g.start", "g.chunk").distinct()
        cased = self.names.select(F.lower("name").alias("key"), "name").distinct()
        hits = _joined(runs.withColumn("key", F.lower("chunk")), cased, "_text")
        listed = hits.groupBy("_text").agg(
            F.collect_set(F.struct("start", "chunk")).alias("_runs"),
            F.collect_set(F.when(F.col("chunk") == F.col("name"), F.col("chunk"))).alias("_same"))
        # The analysis follows in these tasks, so there are as many as before: by bytes alone short texts would be put together.
        parts = max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
        back = some.drop("_found").repartition(parts, "_text").join(listed, "_text", "left").drop("_text")
        back = back.withColumn(self.LISTED, leftmost_longest(F.coalesce(F.col("_runs"), S.empty(RUN_TYPE))))
        back = back.withColumn(self.EXACT, F.coalesce(F.col("_same"), F.expr("cast(array() as array<string>)"))).drop("_runs", "_same")
        return back.unionByName(rest)

    def known(self, word: Column) -> Column:
        """Whether a word is listed in this case; with a joined list, whether it is one of the text's runs."""
        return self._name(word) if self.short else F.array_contains(F.col(self.EXACT), word)

    def lexicon(self, lexicon):
        """The same lexicon with these names instead of its own."""
        return replace(lexicon, names=frozenset(), known=self.known)
