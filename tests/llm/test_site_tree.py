"""The site style tree against a plain version that keeps whole paths, and pages that nest deeply."""

import math
import re
import time
from collections import Counter, defaultdict

import pytest

from sladd.llm import html_extract

HEAD = "<ul class=top><li><a href=/a>News</a><li><a href=/b>Sport</a><li><a href=/c%d>Mark %d</a></ul>"
BODY = "<div class=text><p>Own text %d of a <a href=/x>page</a> and <b>Note:</b> more</p><p>Another own text %d here</p></div>"
FOOT = "<div class=end><p>All rights reserved by the site</p><p>Tel. %d</p></div>"


def site(n):
    return [f"<html><body>{HEAD % (i, i)}{BODY % (i, i)}{FOOT % (i % 2)}</body></html>" for i in range(n)]


def frame(spark, pages, host="one.net"):
    return spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(5)


def plain_importance(pages):
    """By path and page, for pages whose leaves are ``li`` and ``p`` and whose open ``li`` end at the next one."""
    texts, styles, links, sizes = defaultdict(Counter), defaultdict(Counter), Counter(), Counter()
    for page in set(pages):
        seen, style = defaultdict(set), defaultdict(list)
        for outer, name, inner in re.findall(r"<(ul|div) class=(\w+)>(.*?)</\1>", page):
            for leaf in re.split("<(?:li|p)>", inner)[1:]:
                path = f"/html/body/{outer}.{name}/" + ("li" if outer == "ul" else "p")
                seen[path].add(re.sub("<[^>]*>", "", leaf))
                style[path].append(",".join(re.findall(r"<(a|b)\b", leaf)))
                sizes[path] += sum(len(t.strip()) for t in re.split("<[^>]*>", leaf))
                links[path] += sum(map(len, re.findall(r"<a[^>]*>(.*?)</a>", leaf)))
        for path in seen:
            texts[path].update(seen[path])
            styles[path]["|".join(style[path])] += 1
    out = {}
    for path, counts in texts.items():
        pages_of = sum(styles[path].values())
        entropy = -sum(c / pages_of * math.log(c / pages_of, pages_of) for c in styles[path].values())
        repeat = sum(c * math.log(c, pages_of) for c in counts.values()) / sum(counts.values())
        out[html_extract.path_of(path)] = (0.1 * entropy + 0.9 * (1 - repeat)) * (1 - 0.8 * links[path] / sizes[path])
    return out


@pytest.mark.parametrize("n", [3, 8, 30])
def test_importance_equals_plain_version(spark, n):
    pages = site(n) + site(n)[:2]
    got = {r.node: r.importance for r in html_extract.importance(frame(spark, pages)).collect()}
    want = plain_importance(pages)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_branches_go_with_their_leaves(spark):
    texts = [r.text for r in html_extract.extract(frame(spark, site(8)), ["page_id"]).orderBy("rest.page_id").collect()]
    # the menu goes with its one own link, the foot with its two telephones; links and repeated words in sentences stay
    assert texts == [f"Own text {i} of a page and Note: more\n\nAnother own text {i} here" for i in range(8)]


def test_lists_of_links_stay_in_articles_and_on_few_pages(spark):
    pages = ["<body><article><p>Own %d</p><ul><li><a>Source %d</a></li></ul></article></body>" % (i, i) for i in range(5)]
    assert all(f"Source {i}" in r.text for i, r in enumerate(html_extract.extract(frame(spark, pages), ["page_id"]).orderBy("rest.page_id").collect()))
    pages = ["<body><p>Own %d</p><ul><li><a>Link %d</a></li></ul></body>" % (i, i) for i in range(2)]
    assert all(f"Link {i}" in r.text for i, r in enumerate(html_extract.extract(frame(spark, pages), ["page_id"]).orderBy("rest.page_id").collect()))


def test_salted_join_gives_the_same(spark, monkeypatch):
    want = sorted(r.text for r in html_extract.extract(frame(spark, site(8)), ["page_id"]).collect())
    monkeypatch.setattr(html_extract, "MOST_NODES", 0)
    assert sorted(r.text for r in html_extract.extract(frame(spark, site(8)), ["page_id"]).collect()) == want


@pytest.mark.parametrize("page, blocks", [("<p>x" + "<font>a b " * 50_000, 1), ("<ul>" + "<font>x" * 25_000 + "<li>y</li>" * 25_000, 25_001),
                                          ("<div>" * 50_000 + "t" + "</span>" * 50_000, 1), ("<p>" + "<b>x<p>" * 20_000, 20_000)])
def test_deep_pages_cost_their_length(page, blocks):
    start = time.time()
    html_extract.leaves(page)
    assert len(html_extract.main_text(page, {1: 0.0})) == blocks
    assert time.time() - start < 20


def test_names_are_only_a_prior(spark, monkeypatch):
    """Without its names, the tree itself drops the menus of the given pages' larger sites and keeps every article."""
    monkeypatch.setattr(html_extract, "NOISE_TAGS", frozenset(["form"]))
    monkeypatch.setattr(html_extract, "NOISE_NAMES", frozenset())
    monkeypatch.setattr(html_extract, "FIRM_NAMES", frozenset())
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html").collect()
    sites = defaultdict(list)
    for r in rows:
        sites[r.url.split("/")[2].lower()].append(r.html)
    host, pages = max(sites.items(), key=lambda s: len(set(s[1])))
    values = {r.node: r.importance for r in html_extract.importance(frame(spark, pages, host)).collect()}
    for page in pages:
        text = "\n\n".join(html_extract.main_text(page, values))
        for item in re.findall(r"<li><a[^>]*>(.*?)</a></li>", page):
            assert f"\n\n{item}\n\n" not in f"\n\n{text}\n\n"
        for title in re.findall(r"<h1>(.*?)</h1>", page):
            assert title.split("&")[0] in text


def test_a_local_warehouse_will_not_do_on_a_cluster():
    from sladd.llm.common import shared_folder

    class Session:
        def __init__(self, **values):
            self.conf = {k.replace("_", "."): v for k, v in values.items()}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master="yarn", spark_sql_warehouse_dir="file:/tmp/w"))
    assert shared_folder(Session(spark_master="yarn", spark_checkpoint_dir="hdfs:/c/", spark_sql_warehouse_dir="file:/w")).startswith("hdfs:/c/sladd-")
