"""Each operator against a plain version, with nulls, empty tables, repeated rows, ties, long texts and clashing column names."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from brute import repeated_bytes, similarity
from pyspark.sql import functions as F

from sladd.llm import bpe, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, licenses, line_dedup, suffix_dedup, url_filter
from sladd.llm.common import packed, unpacked, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, rest int, digest string, key string, doc int, node string"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with columns whose names the operators use themselves."""

    def build(rows):
        return spark.createDataFrame([(k, t, None, None, None, "x", 1, "y", "z", 2, None) for k, t in rows], DOCS)

    return build


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_words():
    low, starts, ends, hashes, first = words([b"The the\xc3\xa9 x", b"", b"x the"])
    assert [bytes(low[a:b]) for a, b in zip(starts, ends)] == [b"the", b"the\xc3\xa9", b"x", b"x", b"the"]
    assert first.tolist() == [0, 3, 3, 5] and hashes[0] == hashes[4] and hashes[2] == hashes[3] and len(set(hashes.tolist())) == 3


def test_packed():
    for values in ([], [0], [5, 70_000, 3], list(range(300))):
        assert unpacked(packed(np.array(values, np.int64))).tolist() == values


class TestExactDedup:
    ROWS = [(1, "Same"), (2, "same"), (5, "SAME"), (5, "same"), (3, None), (4, ""), (None, "same"), (7, "É"), (8, "é"), (9, "x" * 100_000), (10, "X" * 100_000)]

    @pytest.mark.parametrize("counters", [1, 2, 1024])
    def test_winners(self, docs, counters):
        out = exact_dedup.deduplicate(docs(self.ROWS), counters=counters)
        want = [(1, 5, 5, False), (2, 5, 5, False), (5, 5, 5, True), (5, 5, 5, True), (None, 5, 5, False), (3, 4, 2, False), (4, 4, 2, True),
                (7, 7, 1, True), (8, 8, 1, True), (9, 10, 2, False), (10, 10, 2, True)]
        assert rows_of(out, "doc_id", "keep_id", "group_size", "kept") == sorted(want, key=repr)

    def test_empty(self, docs):
        assert exact_dedup.deduplicate(docs([])).count() == 0

    def test_frequent_digests_are_named(self, spark):
        rng = random.Random(3)
        texts = [bytes([rng.choice((1, 1, 1, 2, 2, rng.randint(3, 255)))]) * 32 for _ in range(3000)]
        found = exact_dedup.frequent(spark.createDataFrame([(t,) for t in texts], "digest binary").repartition(7), 8)
        names = {bytes(r[0]) for r in found.collect()}
        assert {b"\x01" * 32, b"\x02" * 32} <= names and len(names) <= 32


class TestLineDedup:
    def plain(self, rows, min_chars=20, min_docs=3):
        def key(line):
            k = line.strip(" \t\n\x0b\x0c\r")
            return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k) if len(k) >= min_chars else None

        holders = {}
        for doc, text in rows:
            for line in (text or "").split("\n"):
                if key(line) is not None:
                    holders.setdefault(key(line), set()).add(doc)
        out = []
        for doc, text in rows:
            lines = (text or "").split("\n")
            keep = [x for x in lines if not (key(x) is not None and len(holders[key(x)]) >= min_docs and doc != max(holders[key(x)]))]
            out.append((doc, len(lines), len(lines) - len(keep), "\n".join(keep)))
        return sorted(out, key=repr)

    @pytest.mark.parametrize("partitions", [1, 9])
    def test_random(self, docs, partitions):
        rng = random.Random(partitions)
        pool = ["a line of twenty chars!", "A LINE OF TWENTY CHARS! ", "éééééééééééééééééééé", "short", "", "\t another line that is long enough", "hot line in every document of all"]
        rows = [(i * 7, "\n".join([pool[6]] * (i % 3 > 0) + rng.choices(pool, k=rng.randint(0, 5)))) for i in range(60)] + [(1000, None), (1001, ""), (1002, "\n" * 5000)]
        out = line_dedup.drop_lines(docs(rows).repartition(partitions))
        assert rows_of(out, "rest.doc_id", "n_lines", "n_dropped", "text") == self.plain(rows)

    def test_hot_line_over_partitions(self, spark, docs):
        rows = [(i, "the same long line everywhere\nown line number %d of it all" % i) for i in range(500)]
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        try:
            out = line_dedup.drop_lines(docs(rows))
            assert rows_of(out.filter("n_dropped = 0"), "rest.doc_id") == [(499,)]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    def test_bitmaps_repeated_rows_and_empty(self, docs):
        rows = [(1, "a line of twenty chars!"), (1, "a line of twenty chars!"), (2, "a line of twenty chars!"), (3, "x\na line of twenty chars!\nx")]
        maps = {r.doc_id: r for r in line_dedup.keep_bitmaps(docs(rows)).collect()}
        assert set(maps) == {1, 2} and maps[1].n_dropped == 1
        assert np.unpackbits(np.frombuffer(zlib.decompress(maps[1].keep), np.uint8), count=1).tolist() == [0]
        assert line_dedup.drop_lines(docs(rows)).count() == 4
        assert line_dedup.drop_lines(docs([])).count() == 0


class TestBpe:
    TEXTS = ["Ａb c <|endoftext|> x<|startoftext|>y ΣΑΣ ǅ é e\u0301 İ İx\x1cq\x85z \u00a0 it's don'T 12３", None, "", " \n\t", "the the", "a" * 3000 + " " + "é" * 500,
             "\u2003", "x\u2028y", "𝔘𝔫 👍🏽 ©®", "tab\tsep\r\nline\x0bfeed\x0c."]

    @pytest.mark.parametrize("chunk", [20, 1 << 20])
    def test_library(self, docs, chunk):
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(bpe.default_vocabulary())
        plain.no_padding()
        plain.no_truncation()
        rows = list(enumerate(self.TEXTS)) + [(4, "the the"), (None, "null id")]
        out = bpe.encode_decode(docs(rows), chunk_bytes=chunk)
        want = []
        for key, text in rows:
            ids = plain.encode(text or "", add_special_tokens=False).ids
            want.append((key, ids, plain.decode(ids, skip_special_tokens=False)))
        got = [(r[0], list(struct.unpack(f"<{len(r[1]) // 4}I", r[1])), r[2]) for r in out.select("doc_id", "ids", "decoded").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)

    def test_empty(self, docs):
        assert bpe.encode_decode(docs([])).count() == 0


class TestDecontaminate:
    def plain(self, rows, items, window=10):
        out = []
        for doc, text in rows:
            own, hit, names = decontaminate.tokens((text or "").encode()), set(), set()
            for item, t in items:
                seq = decontaminate.tokens((t or "").encode())
                n = min(window, len(seq))
                wins = {tuple(seq[i : i + n]) for i in range(len(seq) - n + 1)} if n else set()
                for i in range(len(own) - n + 1):
                    if n and tuple(own[i : i + n]) in wins:
                        hit.update(range(i, i + n))
                        names.add(str(item))
            out.append((doc, len(own), len(hit), sorted(names)))
        return sorted(out, key=repr)

    @pytest.mark.parametrize("block", [60, 1 << 20])
    def test_random(self, spark, docs, block):
        rng = random.Random(7)
        vocab = ["a", "b", "c", "the", "é", "x1"]
        items = [(i, " ".join(rng.choices(vocab, k=rng.choice((0, 3, 9, 10, 14, 25))))) for i in range(12)] + [(50, None), (51, "a b, C!"), (52, "a b c")]
        rows = []
        for i in range(80):
            text = rng.choices(vocab + ["zz"], k=rng.randint(0, 30))
            if rng.random() < 0.6:
                seq = (rng.choice(items)[1] or "").split()
                a = rng.randint(0, 10)
                text += seq[a : a + rng.randint(5, 25)]
            rows.append((i, rng.choice((" ", ", ", "\n")).join(text).upper() if i % 3 else " ".join(text)))
        rows += [(200, None), (201, ""), (202, " ".join(["zz"] * 50_000) + " A b c"), (3, rows[3][1])]
        bench = spark.createDataFrame(items, "item_id long, text string").withColumn("t", F.lit("extra"))
        out = decontaminate.find_contamination(docs(rows), bench, ["doc_id"], block_bytes=block)
        hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x - a)
        got = sorted(((r[0], r[1], r[2], sorted(r[3])) for r in out.select("rest.doc_id", "n_words", hit, "items").collect()), key=repr)
        assert got == self.plain(rows, items)

    def test_cuts(self, spark, docs):
        item = "one two three four five six seven eight nine ten eleven"
        bench = spark.createDataFrame([(1, item), (None, "alone")], "item_id long, text string")
        rows = [(1, f"Before it é, {item.upper()}! After it there are some more words of which none is known here."), (2, item), (3, "clean"), (4, None), (5, "alone")]
        out = {r.doc_id: r.text for r in decontaminate.remove_contamination(docs(rows), bench).select("doc_id", "text").collect()}
        assert out == {1: "Before it é, ! After it there are some more words of which none is known here.", 3: "clean", 4: ""}
        names = {r[0]: r[1] for r in decontaminate.find_contamination(docs(rows), bench, ["doc_id"]).select("rest.doc_id", "items").collect()}
        assert names[2] == ["1"] and names[5] == [None]
        assert decontaminate.remove_contamination(docs(rows), bench.limit(0)).count() == 5
        assert decontaminate.remove_contamination(docs([]), bench).columns == docs([]).columns


    @pytest.mark.parametrize("block", [100, 1 << 20])
    def test_items_without_id_and_equal_items(self, spark, docs, block):
        item = "one two three four five six seven eight nine ten eleven"
        items = [(None, item), (None, "other words"), *((i, "yes") for i in range(300))]
        rows = [(1, f"x {item} y"), (2, "yes, " * 500), (3, "other words and yes"), (4, "no")]
        out = decontaminate.find_contamination(docs(rows), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], block_bytes=block)
        found = {r[0]: (sum(b - a for a, b in zip(r[1][::2], r[1][1::2])), len(r[2]), None in r[2]) for r in out.select("rest.doc_id", "spans", "items").collect()}
        assert found == {1: (11, 1, True), 2: (500, 300, False), 3: (3, 301, True), 4: (0, 0, False)}


class TestLanguage:
    def test_held_out_accuracy(self, spark):
        rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        model = language_id.train(rows.filter(~language_id.held_out()))
        out = language_id.identify(rows, model, ["doc_id", "lang"]).filter(language_id.held_out("rest.doc_id"))
        right, n, bad = out.agg(F.avg((F.col("rest.lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
        assert n > 300 and right > 0.97 and bad <= 2

    def test_cases(self, spark, docs):
        train = spark.createDataFrame([(i, t, lang) for i in range(40) for t, lang in (("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "de"), ("the", None))],
                                      "doc_id long, text string, lang string")
        model = language_id.train(train)
        rows = [(1, "the dog"), (2, "le chien"), (3, None), (4, "123 !!"), (5, ""), (6, "the cat " * 20_000), (7, "漢字")]
        out = {r[0]: (r[1], r[2], r[3]) for r in language_id.identify(docs(rows), model, ["doc_id"]).select("rest.doc_id", "lang_pred", "score", "rejected").collect()}
        assert [out[k][0] for k in (1, 2, 3, 4, 5, 6)] == ["en", "fr", "und", "und", "und", "en"] and out[7][0] in ("en", "fr") and out[7][2]
        assert all(0 <= v[1] <= 1 for v in out.values()) and out[3][1:] == (0.0, True)
        none = language_id.train(train.limit(0))
        assert {r[0] for r in language_id.identify(docs(rows), none, ["doc_id"]).select("lang_pred").collect()} == {"und"}


    @pytest.mark.parametrize("left_out", ["de", "en"])
    def test_left_out_language_and_junk(self, spark, docs, left_out):
        rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        model = language_id.train(rows.filter(~language_id.held_out() & (F.col("lang") != left_out)))
        out = language_id.identify(rows.filter(language_id.held_out()), model, ["doc_id", "lang"])
        other, own = out.agg(F.avg(F.when(F.col("rest.lang") == left_out, F.col("rejected").cast("int"))), F.avg(F.when(F.col("rest.lang") != left_out, F.col("rejected").cast("int")))).first()
        assert other > 0.9 and own < 0.03
        rng = random.Random(3)
        junk = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.choice((5, 10, 30, 100, 300))))) for i in range(200)]
        assert language_id.identify(docs(junk), model, ["doc_id"]).agg(F.avg(F.col("rejected").cast("int"))).first()[0] > 0.95


class TestUrls:
    def test_addresses_and_list(self, spark):
        urls = [None, "", "no scheme.org/x", "http://WWW.Example.org/en/12?x=http://a.com/de/", "ftp://example.org", "https://xexample.org/es/", "s://a.com/de/x#y", "s://com/fr/", "s://a.com?/de/",
                "http://example.org/es/", "http://a\nb.org/x"]
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("extra"))
        labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect()}
        assert got == {
            0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("www.example.org", "/en/12", "example.org/en/1", "block"),
            4: ("example.org", "", None, "allow"), 5: ("xexample.org", "/es/", "org/", "allow"), 6: ("a.com", "/de/x", "com/de/", "block"),
            7: ("com", "/fr/", "com/fr/", "allow"), 8: ("a.com", "", None, "allow"), 9: ("example.org", "/es/", "example.org/es/", "block"), 10: ("a\nb.org", "/x", "org/", "allow")}
        assert url_filter.judge(pages.limit(0), labels).count() == 0

    def test_mined_rules(self, spark):
        pages = [(i, f"http://{'bad' if i % 3 == 0 else 'good'}.net/{'x' if i % 2 else 'y'}/{i}") for i in range(60)] + [(100, "http://bad.net/x/new"), (100, "http://bad.net/x/new"), (101, "http://good.net/x")]
        labels = [(i, 1, int(i % 6 == 3)) for i in range(60)] + [(3, None, None), (None, 0, 1)]
        out = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), confidence=0.9)
        verdicts = {r.page_id: r.verdict for r in out.collect()}
        assert {k for k, v in verdicts.items() if v == "block"} == {i for i in range(60) if i % 6 == 3} | {100} and out.count() == 63


class TestLicenses:
    def plain(self, text):
        """Dice with every template of every line, paragraph and the whole."""
        import re

        norm, found = re.sub(r"[^\w\n]+|_", " ", (text or "")).lower(), {}
        for unit in {" ".join(u.split()) for u in [*norm.split("\n"), *re.split(r"\n ?(?:\n ?)+", norm), norm]}:
            own = set(licenses.bigrams(unit))
            for at, (name, body) in enumerate(licenses.TEMPLATES):
                other = set(licenses.bigrams(body))
                dice = 2 * len(own & other) / (len(own) + len(other))
                if dice >= 0.8:
                    found[unit] = max(found.get(unit, (0, 0, "")), (dice, -at, name))
        return (max(found.values())[2] if found else None), len(found)

    def test_texts(self, docs):
        full = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
        rows = [(1, "foo\nReleased under the MIT license\nbar"), (2, full.replace(" to ", "\nto ") + "\n\nunrelated paragraph of some words"), (3, None), (4, ""), (5, "MIT"),
                (6, "licensed under the apache license version two"), (7, "nothing here " * 20_000), (8, full.replace("Software", "Code", 2)), (1, "foo\nReleased under the MIT license\nbar"),
                (9, "x " * 50 + "\nLicensed under CC BY-NC 4.0.\n" + "y " * 50 + "\nLicensed under CC BY-SA 4.0.")]
        got = rows_of(licenses.scan(docs(rows)), "doc_id", "license", "n_units")
        assert got == sorted([(k, *self.plain(t)) for k, t in rows], key=repr) and ("MIT" in {g[1] for g in got})
        assert licenses.scan(docs([])).count() == 0

    def test_notices_inside_and_over_units(self, docs):
        full = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
        a, b = full.index("The above copyright"), full.index("THE SOFTWARE IS PROVIDED")
        mit = full[:a] + "\n\n" + full[a:b] + "\n\n" + full[b:]
        gpl = "Here is a sentence before the notice of it. This work is licensed under the GNU General Public License, version 3."
        other = "\n\n" + " ".join("word%d" % i for i in range(600)) + " "
        rows = [(1, other + mit + other), (2, gpl), (2, gpl), (3, gpl + other), (4, "Read me.\nLicensed under the\nApache License, Version 2.0. And more of it here."), (5, other),
                (None, "See the end: " + gpl), (6, gpl + " " + gpl), (7, "there are some more words before it, released under the MIT License.\nLicensed under CC BY 4.0.")]
        got = {r[0]: r[1:] for r in rows_of(licenses.scan(docs(rows)), "doc_id", "license", "dice", "n_units")}
        assert {k: v[0] for k, v in got.items()} == {1: "MIT", 2: "GPL-3.0", 3: "GPL-3.0", 4: "Apache-2.0", 5: None, None: "GPL-3.0", 6: "GPL-3.0", 7: "MIT"}
        assert {k: v[1] for k, v in got.items()} == {k: None if k == 5 else 1.0 for k in got} and got[7][2] == 2 and licenses.scan(docs(rows)).count() == len(rows)

    def test_versions_of_a_family(self, docs):
        """Notices as they stand in files, with words around them and a changed word, for every version."""
        title = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
        rows, wanted = [], {}
        for name, version in (("GPL-2.0", "2"), ("GPL-3.0", "3"), ("LGPL-2.1", "2.1"), ("LGPL-3.0", "3"), ("AGPL-3.0", "3")):
            full = title[name.split("-")[0]]
            later = (f"Foo is free software; you can redistribute it and/or modify it under the terms of the {full} as published by the Free "
                     f"Software Foundation; either version {version} of the License, or (at your option) any later version.")
            only = f"This library is free software; you can redistribute it and/or modify it under the terms of the {full}, version {version}, as published by the Free Software Foundation."
            for text in (later, only, f"This work is licensed under the {full}, version {version}.", "Some words first. " * 9 + later + " And others behind." * 9,
                         "\n".join(f" * {later[i:i + 60]}" if later[i - 1:i] in ("", " ") else later[i:i + 60] for i in range(0, len(later), 60))):
                rows.append((len(rows), text))
                wanted[len(rows) - 1] = name
        got = {k: v for k, v in rows_of(licenses.scan(docs(rows)), "doc_id", "license")}
        broken = set(range(4, 25, 5))  # words cut by line ends lower the coefficient; a version that is found must be right
        assert {k: v for k, v in got.items() if k not in broken} == {k: v for k, v in wanted.items() if k not in broken}
        assert all(got[k] in (None, wanted[k]) for k in broken)

    def test_templates_out_of_a_table(self, spark, docs):
        body = "You may copy this poem for your friends but never sell it to them."
        held = licenses.template_table(spark.createDataFrame([("Poem", body), ("Poem", body), (None, "x y"), ("Empty", ""), ("None", None), ("Other", "Keep it at home.")], "license string, body string"))
        assert held == (("Other", "Keep it at home."), ("Poem", body))
        got = rows_of(licenses.scan(docs([(1, "first\n" + body), (2, "Released under the MIT License."), (3, None)]), templates=held), "doc_id", "license")
        assert got == [(1, "Poem"), (2, None), (3, None)]

    def test_markers_lose_nothing(self):
        for _, text in licenses.TEMPLATES:
            grams = licenses.bigrams(text)
            left = [g for g in grams if not set(g.split()) & licenses.markers(text, 0.8)]
            assert len(left) < 0.8 * len(grams) / 1.2


class TestHtml:
    def text(self, page, gone=()):
        return "\n\n".join(html_extract.blocks(page, frozenset(gone)))

    def test_blocks(self):
        page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
        <nav><ul><li><a href="/">Home</a><li>More</ul></nav><!-- <p>no</p> --><div class="ad banner">Buy</div><div id=cookie-notice>Cookies</div><aside>Side</aside>
        <article><header><h1>Head&amp;line</h1></header><p><b>Bold.<br><p>Two\n words&nbsp;and <i>x</i>y &lt;b&gt;</p><ul><li>one<li>two</ul><form>f</form>
        <div class="share">Share</div><section class="comments"><article class="comment"><p>me too</p></article></section></article><footer>&copy;</footer></body></html>"""
        assert self.text(page) == "Head&line\n\nBold.\n\nTwo words and xy <b>\n\none\n\ntwo"

    def test_odd_markup(self):
        assert self.text("") == "" and self.text("plain & simple < 3") == "plain & simple < 3"
        assert self.text("<nav>menu<article><p>kept</article>") == "kept"
        assert self.text("<body class='no-sidebar'><div class='content-sidebar-wrap'><main><p>kept</main><div class=sidebar>gone</div></div>") == "kept"
        assert self.text("<div class='has-sidebar'><p>kept</p><div class='site-footer'>gone</div></div>") == "kept"
        assert self.text("<article>kept<div id=comments><article>gone</article></div></article><div class=related><article>gone</article></div>") == "kept"
        assert self.text("<p title='a>b'>x</p><p>y") == "x\n\ny" and self.text("<script>never closed <p>x") == ""
        assert self.text("<div><p>" + "w " * 100_000 + "</div>") == ("w " * 100_000).strip()

    def test_beside_articles(self):
        assert self.text("<main><h1>Title</h1><p>body</p><article>related card</article></main>") == "Title\n\nbody\n\nrelated card"
        assert self.text("<div class=content><p>body</p></div><article>teaser</article><nav>menu</nav>") == "body\n\nteaser"
        assert self.text("<div class=content><p>body</p></div><main>more</main><div class=top>same</div>", ["/div.top"]) == "body\n\nmore"

    def test_hidden(self):
        for kept in ('class="overflow-hidden"', 'style="overflow:hidden"', "class='x hidden-xs'", 'hidden="false"', 'aria-hidden="false"', 'data-x="a hidden b"', "style='border:none'"):
            assert self.text(f"<div {kept}><article>kept</article></div>") == "kept", kept
        for gone in ("hidden", "class=x HIDDEN", 'hidden=""', 'aria-hidden="true"', "aria-hidden=true", 'style="display: none"', 'style="color:red;visibility:hidden;"', "style=DISPLAY:NONE"):
            assert self.text(f"<div {gone}><p>gone</p></div><p>kept</p>") == "kept", gone

    def test_site_style_tree(self, spark):
        page = "<html><body><div class='top'>Always the same</div><div class='text'><p>Own text %d</p></div></body></html>"
        rows = [(i, "http://one.net/%d" % i, page % i) for i in range(8)] + [(20, "http://alone.net/", page % 20), (21, None, None), (22, "x", "<article>a</article>"), (0, "http://one.net/0", page % 0)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("extra")).withColumn("text", F.lit("extra"))
        got = rows_of(html_extract.extract(pages, ["page_id", "url"]), "rest.page_id", "text")
        want = [(i, "Own text %d" % i) for i in range(8)] + [(20, "Always the same\n\nOwn text 20"), (21, ""), (22, "a"), (0, "Own text 0")]
        assert got == sorted(want, key=repr)
        assert html_extract.extract(pages.limit(0), ["page_id"]).count() == 0

    def extracted(self, spark, rows):
        pages = spark.createDataFrame([(i, "http://one.net/%d" % i, h) for i, h in enumerate(rows)], "page_id long, url string, html string").repartition(5)
        return [r.text for r in html_extract.extract(pages, ["page_id"]).orderBy("rest.page_id").select("text").collect()]

    @pytest.mark.parametrize("groups, copies", [(1, 3), (1, 40), (2, 60), (5, 60)])
    def test_copies_are_one_page(self, spark, groups, copies):
        page = "<html><body><div class=text><p>Own text %d</p></div><article class=post><p>Article %d</p></article><script>var nonce=%d</script></body></html>"
        rows = [page % (g, g, c) for g in range(groups) for c in range(copies)]
        texts = self.extracted(spark, rows)
        assert all("Own text %d" % g in texts[g * copies + c] or "Article %d" % g in texts[g * copies + c] for g in range(groups) for c in range(copies))
        rows = ["<html><body><div class=text><p>Own text %d</p></div></body></html>" % (i // copies) for i in range(groups * copies)]
        assert self.extracted(spark, rows) == ["Own text %d" % (i // copies) for i in range(groups * copies)]

    def test_branches_of_articles(self, spark):
        page = "<body><article><h1>Head %d</h1><p>Own %d</p><ul><li>Always the same</li></ul></article></body>"
        rows = [page % (i, i) for i in range(6)] + ["<body><article><ul><li>Always the same</li></ul></article></body>"]
        assert self.extracted(spark, rows) == ["Head %d\n\nOwn %d" % (i, i) for i in range(6)] + ["Always the same"]

    def test_generated_pages(self, spark):
        import html
        import re

        pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
        want = {}
        for r in pages.collect():
            body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
            parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
            want[r.page_id] = "\n\n".join(b for b in parts if b)
        assert {r[0]: r[1] for r in html_extract.extract(pages, ["page_id"]).select("rest.page_id", "text").collect()} == want


class TestJaccard:
    def test_limits(self):
        for n, least in jaccard_join.least_agreements():
            assert 0 < least < 0.8 * n

    @pytest.mark.parametrize("block", [3, 1024])
    def test_near_copies(self, docs, block):
        rng = random.Random(11)
        base = [[f"w{rng.randint(0, 10**6)}" for _ in range(80)] for _ in range(4)]
        rows = []
        for i in range(90):
            own = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 9))):
                own[rng.randint(0, 79)] = f"v{rng.randint(0, 50)}"
            rows.append((i * 2 - 9, " ".join(own)))
        rows += [(500, None), (501, ""), (502, "!!"), (503, "one two"), (504, "One, two"), (505, "two one"), (506, "a b c d e"), (507, "A B C D E")]
        got = {r[0]: (r[1], r[2]) for r in jaccard_join.similarity_classes(docs(rows).repartition(5), block=block).select("doc_id", "class_id", "n_links").collect()}
        assert got == similarity(rows)

    def test_repeated_and_empty(self, docs):
        got = rows_of(jaccard_join.similarity_classes(docs([(1, "a b"), (1, "a b"), (None, "a b"), (2, "x" * 100_000)])), "doc_id", "class_id", "n_links")
        assert got == sorted([(1, 1, 2), (1, 1, 2), (None, 1, 2), (2, 2, 0)], key=repr)
        assert jaccard_join.similarity_classes(docs([])).count() == 0


class TestSuffixes:
    @pytest.mark.parametrize("group", [4, 20_000])
    def test_random(self, docs, group):
        rng = random.Random(5)
        base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
        rows = []
        for i in range(120):
            text = ""
            for _ in range(rng.randint(0, 6)):
                a = rng.randint(0, 300)
                text += rng.choice(base)[a : a + rng.randint(20, 300)] + "".join(rng.choice("xyz é") for _ in range(rng.randint(0, 30)))
            if i % 11 == 0:
                text = rng.choice("ab") * rng.randint(50, 400)
            if i % 17 == 0:
                text = "ab\x00" * rng.randint(20, 80) + "\x00" * rng.randint(0, 150)
            rows.append((i * 3 + 1, text if i % 29 else None))
        rows += [(None, base[0][:200]), (-7, base[1])]
        got = {r[0]: (r[1], bytes(r[2])) for r in suffix_dedup.deduplicate(docs(rows).repartition(5), group=group).select("doc_id", "spans", "kept").collect()}
        assert got == repeated_bytes([(k, (t or "").encode()) for k, t in rows])

    def test_long_repeated_and_empty(self, docs):
        rng = random.Random(2)
        big = "".join(rng.choice("abcdefgh ") for _ in range(2_300_000))
        rows = [(1, big), (2, big[2_090_000:2_110_000] + "zz"), (3, "q" + big[-150:]), (4, big[:99]), (4, big[:99])]
        out = suffix_dedup.deduplicate(docs(rows))
        assert rows_of(out, "doc_id", "n_bytes", F.to_json("spans")) == sorted(
            [(1, 2_300_000, "[]"), (2, 20_002, "[0,20000]"), (3, 151, "[1,151]"), (4, 99, "[]"), (4, 99, "[]")], key=repr)
        assert suffix_dedup.deduplicate(docs([])).count() == 0

    def test_quicksort(self):
        rng = random.Random(4)
        strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 20))) for _ in range(300)]
        order, common = suffix_dedup.multikey_quicksort(strings, 20)
        listed = [strings[i].ljust(24, b"\x00") for i in order]
        assert listed == sorted(listed) and sorted(order.tolist()) == list(range(300))
        for k in range(1, 300):
            a, b = strings[order[k - 1]], strings[order[k]]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_digest_is_sha256(docs):
    row = exact_dedup.text_digests(docs([(1, "ABC")])).first()
    assert bytes(row.digest) == hashlib.sha256(b"abc").digest()


class TestLongUrls:
    def plain(self, pages, labels, least=5, support=0.002, confidence=0.5):
        """Whether some frequent set of tokens implies blocking; sets are grown one token at a time."""
        marks = {}
        for key, quality, toxic in labels:
            marks[key] = marks.get(key, False) or toxic == 1 or quality == 0
        tokens = {k: frozenset(self.tokens(u)) for k, u in pages}
        seen = [(tokens[k], marks[k]) for k, _ in pages if k in marks]
        rows, rules, level = max(least, -(-len(seen) * 2 // 1000)), set(), {frozenset()}
        while level:
            grown = {s | {t} for s in level for ts, _ in seen if s <= ts for t in ts - s}
            level = set()
            for g in grown:
                hold = [b for ts, b in seen if g <= ts]
                if sum(hold) >= rows:
                    (rules if sum(hold) >= confidence * len(hold) else level).add(g)
        return {k: any(r <= tokens[k] for r in rules) for k, _ in pages}

    def tokens(self, url):
        host, _, path = url.split("://", 1)[1].partition("/")
        return ["h:" + t for t in host.lower().split(".") if t] + ["p:" + t for t in "".join(c if c.isalnum() else " " for c in path.lower()).split()]

    def test_equal_long_urls_end(self, spark):
        """Six equal URLs of 40 tokens: all subsets are frequent."""
        long = "http://w.example.net/" + "/".join(f"t{i}" for i in range(40))
        rows = [(i, long) for i in range(6)] + [(10, "http://x.net/t3/other"), (11, "http://x.net/none"), (12, None)]
        pages = spark.createDataFrame(rows, "page_id long, url string")
        labels = spark.createDataFrame([(i, 0, 1) for i in range(6)] + [(11, 1, 0), (12, None, None)], "doc_id long, quality int, toxic int")
        out = {r.page_id: r.verdict for r in url_filter.judge(pages, labels).collect()}
        assert out == {**{i: "block" for i in range(6)}, 10: "block", 11: "block" if self.plain(rows[:-1], [(i, 0, 1) for i in range(6)] + [(11, 1, 0)])[11] else "allow", 12: "allow"}

    def test_against_plain(self, spark):
        rng = random.Random(9)
        rows = [(i, "http://" + rng.choice(("a.net", "b.a.net", "c.io")) + "/" + "/".join(rng.choices(["x", "y", "z", "u v", "w"], k=rng.randint(0, 4)))) for i in range(150)]
        rows += [(200 + i, "http://a.net/one/two/three/four/five") for i in range(8)]
        labels = [(i, rng.choice((0, 1, 1, None)), rng.choice((0, 0, 0, 1, None))) for i in range(0, 150, 2)] + [(200 + i, 0, 0) for i in range(7)]
        out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rules=())
        assert {r.page_id: r.verdict == "block" for r in out.collect()} == self.plain(rows, labels)
