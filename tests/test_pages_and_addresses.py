"""Pages read as a reader sees them, and IPv6 addresses by their groups."""

import ipaddress
import random

import pytest

from sladd.operators import markup
from sladd.plans.analyze import anonymize, with_spans
from sladd.rules.detectors import BY_KEY


@pytest.mark.parametrize(("html", "want"), [
    ("<p>Ka<b>ri</b> Olsen</p>", "<p>[NAME]<b></b> [NAME]</p>"),
    ('<a title="Kari Olsen" href="mailto:x@y.no">skriv</a>', '<a title="Kari Olsen" href="mailto:x@y.no">skriv</a>'),
    ("<td>tlf 912<i>34</i>567</td>", "<td>tlf [PHONE]<i></i></td>"),
    ("<p>0155</p><p>Oslo</p>", "<p>0155</p><p>Oslo</p>"),
    ("<p>1 < 2 og Kari > Ola</p>", "<p>1 < 2 og [NAME] > [NAME]</p>"),
    ('<p title="a > b">Kari</p>', '<p title="a > b">[NAME]</p>'),
    ("<script>var x = 'Kari Olsen'</script>Kari", "<script>var x = 'Kari Olsen'</script>[NAME]"),
    ("", ""), ("<b></b>", "<b></b>"), (None, None), ("uten treff <i>her</i>", "uten treff <i>her</i>"),
])
def test_pages(spark, html, want):
    row = markup.anonymize_page(spark.createDataFrame([(1, html)], "page_id int, html string")).first()
    assert row.redacted == want


def test_many_pieces(spark):
    """Blocks of pieces give the same as one piece at a time."""
    html = "".join(f"<p>rad {i} K<i>a</i>ri, a{i}@<b>x</b>.no</p>" for i in range(400))
    want = "".join(f"<p>rad {i} [NAME]<i></i>, [EMAIL]<b></b></p>" for i in range(400))
    assert markup.anonymize_page(spark.createDataFrame([(1, html)], "page_id int, html string")).first().redacted == want


ADDRESSES = {
    "::1": True, "fe80::": True, "::ffff:10.0.0.1": True, "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:7:8:9": False, "2001:db8::7": True,
    "a::b::c": False, "::": False, ":::": False, "12:30:45": False, "aa:bb:cc:dd:ee:ff": False, "std::x": False, "1:2:3:4:5:6:7::": True,
    "::1:2:3:4:5:6:7": True, "1:2:3:4:5:6:1.2.3.4": True, "1::2:3:4:5:6:7:8": False, "12345::1": False, "::300.1.1.1": False, ":1:2": False,
}


def test_ipv6(texts):
    some = [f"vert {a}, ja" for a in ADDRESSES] + [f"({a})." for a in ADDRESSES]
    rows = anonymize(texts(*some), detectors=[BY_KEY["ip6"]]).orderBy("unit_id").collect()
    assert [r.n == 1 for r in rows] == [*ADDRESSES.values()] * 2
    assert all(r.redacted.endswith(", ja") and r.redacted.startswith("vert ") for r in rows[: len(ADDRESSES)])


def test_ipv6_against_the_standard_library(texts):
    rng, some = random.Random(4), []
    for _ in range(400):
        groups = [f"{rng.randint(0, 65535):x}" for _ in range(rng.choice((1, 3, 6, 7, 8, 8, 9)))]
        if rng.random() < 0.6:
            groups.insert(rng.randint(0, len(groups)), "")
        some.append(("::" if groups[0] == "" else "") + ":".join(g for g in groups).strip(":") + ("::" if groups[-1] == "" and len(groups) > 1 else ""))

    def valid(a):
        try:
            ipaddress.IPv6Address(a)
        except ValueError:
            return False
        return a != "::"

    rows = with_spans(texts(*some), detectors=[BY_KEY["ip6"]], last="resolved").orderBy("unit_id").collect()
    assert [len(r.spans) == 1 for r in rows] == [valid(a) for a in some]


def test_long_tokens_stay_linear(texts):
    df = texts("a" * 200_000 + ":", ":" * 50_000, "a:" * 50_000)
    assert anonymize(df, detectors=[BY_KEY["ip6"]]).count() == 3
