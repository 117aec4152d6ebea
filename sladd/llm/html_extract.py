"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree whose nodes are tag paths with classes and ids. Its leaves are the blocks that hold
text. For each leaf, Spark counts how many pages show it in which style (sequence of child tags), on how many pages each of its
texts stands, and which share of its characters is link text. The importance of a leaf is
``((1 - GAMMA) * style + GAMMA * content) * (1 - LINKED * links)``: style is the entropy of its styles to the base of its pages,
content is one minus the mean entropy of its texts over the pages, so what repeats from page to page is unimportant, and lists
of nothing but links are worth less. On each page a branch is as important as its leaves, weighted by their text, and branches below
``LEAST_IMPORTANCE`` are removed. Inline tags belong to their block, so no link or bold word is cut out of a sentence. Pages of a
host whose leaves have equal styles and texts are copies and count as one page, so a page isn't boilerplate for being copied. Two
priors complete the tree: nodes that markup names as menus, adverts, forms and the like have importance zero on any page, and
``article`` or ``main`` are likely content, so their leaves start from the importance ``PRIOR``. What stands beside them stays too,
unless markup names it or it is unimportant. Where importance would leave nothing of a page, its articles and main stay. Rows
are summed before each shuffle, so a hot host costs a row for each distinct text of a node; copies of a page meet by its digest.

Nodes are known by a hash of their path that is rolled from parent to child, and open tags by their places, so a page costs
time and memory in proportion to its length, however deep its unclosed tags nest.

Cases: null or empty html gives an empty text; a page that is alone on its host, or whose node is on fewer than
``LEAST_PAGES`` distinct pages, loses only what markup names; unclosed tags end with their parent; a null URL has the empty host;
repeated rows are extracted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sladd.llm.common import short_batches, text_bytes, written
from sladd.llm.url_filter import address

GAMMA, LEAST_IMPORTANCE, LEAST_PAGES = 0.9, 0.25, 3
#: The share of importance that a branch of an article or main has before its pages are looked at.
PRIOR = 0.2
#: The share of its importance that a leaf outside articles loses where all its text is in links.
LINKED = 0.8
#: Up to so many nodes of all sites are broadcast (some 30 MB); more are joined with the pages of a host over ``SALTS`` tasks.
MOST_NODES, SALTS = 1_000_000, 32
MARK = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?/][^>]*+>", re.S | re.I)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"hidden|none", re.I)
UNSEEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
#: Element kinds of HTML, and names that markup gives to what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACE = frozenset("br td th option img".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "dl", "table", "select")
NOISE_TAGS = frozenset("nav aside form footer button select datalist dialog menu head object canvas audio video input".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOISE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
                        "notices alert sidebar nav navbar navigation menu breadcrumb breadcrumbs comment comments reply replies disqus footer share sharing "
                        "social related recommended newsletter subscribe signup login popup modal overlay widget toolbar pagination pager skip".split())


#: Names under which even an article is none of the page, and words that turn a name into one of layout, as in ``has-sidebar``.
FIRM_NAMES = frozenset("comment comments reply replies disqus related recommended sponsored ad ads promo".split())
LAYOUT = frozenset("has with no without free layout".split())
#: Kinds of noise: none, by a name that may also be that of a wrapper, for certain.
NONE, NAMED, FIRM = range(3)
MASK = (1 << 64) - 1


class Node:
    __slots__ = ("parent", "tag", "path", "noise", "inside", "kids", "block", "linked", "size", "worth", "gone")

    def __init__(self, parent, tag, path, noise, inside):
        self.parent, self.tag, self.path, self.noise, self.inside, self.kids = parent, tag, path, noise, inside, []
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.linked = tag == "a" or parent is not None and parent.linked
        self.size, self.worth, self.gone = 0, 0.0, False


def step(path: int, label: str) -> int:
    """The path of a child, as a signed 64-bit number; 0 is the page itself."""
    return xxhash.xxh3_64_intdigest(label, seed=path & MASK) - (1 << 63)


def path_of(names: str) -> int:
    """The number of a path given as ``/tag.class/tag``."""
    path = 0
    for label in names.split("/")[1:]:
        path = step(path, label)
    return path


def names_of(attributes: str) -> tuple[list[str], str, int]:
    """Words of class and id, the role, and the kind of noise that they name."""
    found, role, noise = [], "", NONE
    for kind, a, b, c in NAMES.findall(attributes):
        value = (a or b or c).lower()
        if kind.lower() == "role":
            role = value.strip()
            continue
        for name in value.split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            found += words
            if not LAYOUT.intersection(words):
                noise = max(noise, FIRM if FIRM_NAMES.intersection(words) else NAMED if NOISE_NAMES.intersection(words) else NONE)
    return found, role, noise


def hidden(attributes: str) -> bool:
    """Whether the element itself is hidden; the words of class and other attributes decide nothing."""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).strip().lower()
        if name == "hidden" and value != "false" or name == "aria-hidden" and value == "true" or name == "style" and UNSEEN_STYLE.search(value):
            return True
    return False


def parse(page: str) -> tuple[list[tuple[Node | None, str | None]], list[Node]]:
    """The page as a list of events, a text with its node or a node with None at a block's edge, and its nodes, parents first."""
    root = Node(None, "", 0, NONE, None)
    stack, events, nodes, at = [root], [], [root], 0
    places = defaultdict(list)  # of each open tag in the stack

    def text(raw):
        if raw:
            events.append((stack[-1], unescape(raw) if "&" in raw else raw))

    def last(tags):
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def first(tags):
        return min((places[t][0] for t in tags if places[t]), default=0)

    def close_to(index):
        if any(n.tag in BLOCK for n in stack[index:]):
            events.append((stack[index], None))
        for n in stack[index:]:
            places[n.tag].pop()
        del stack[index:]

    for m in MARK.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if places[tag]:
                close_to(places[tag][-1])
            continue
        if tag in BLOCK and last(("p",)) >= max(1, len(stack) - 4):  # a paragraph ends where a block begins
            i = last(("p",))
            if not any(n.tag in BLOCK for n in stack[i + 1 :]):
                close_to(i)
        if tag in CLOSES and last(CLOSES[tag]) > last(LISTS):
            close_to(last(CLOSES[tag]))
        if tag in ("article", "main") and first(("nav", "footer", "header", "form", "head")):  # never a part of a menu or footer left open
            close_to(first(("nav", "footer", "header", "form", "head")))
        if tag == "body" and places["head"]:
            close_to(first(("head",)))
        parent, attributes = stack[-1], m.group(4)
        named, role, noise = names_of(attributes) if "=" in attributes else ([], "", NONE)
        inside = parent.inside or (tag if tag in ("article", "main") else None)
        if tag == "article":
            inside = "article"
        if tag in ("html", "body", "article", "main") and noise == NAMED or tag in ("html", "body"):
            noise = NONE
        if tag in NOISE_TAGS or role in NOISE_ROLES or UNSEEN.search(attributes) and hidden(attributes):
            noise = FIRM
        if not parent.inside and (tag == "header" or "header" in named and tag not in ("html", "body", "article", "main")):
            noise = max(noise, NAMED)
        # a wrapper that is named after a sidebar or menu doesn't make the article in it one
        if not (tag in ("article", "main") and parent.noise == NAMED):
            noise = max(noise, parent.noise)
        node = Node(parent, tag, step(parent.path, tag + ("." + ".".join(named) if named else "")), noise, inside)
        nodes.append(node)
        parent.kids.append(tag)
        if tag in BLOCK:
            events.append((node, None))
        if tag in SPACE:
            events.append((parent, " "))
        if tag not in VOID and not attributes.endswith("/"):
            places[tag].append(len(stack))
            stack.append(node)
    text(page[at:])
    return events, nodes


def runs(events: list) -> list[list[tuple[Node, str]]]:
    """The texts between two edges of blocks, which are one block of the page."""
    out, current = [], []
    for node, text in events:
        if text is not None:
            current.append((node, text))
        elif current:
            out.append(current)
            current = []
    return out + [current] if current else out


def leaves(page: str) -> dict[int, tuple]:
    """Path of each block with text: whether it's in an article, digests of style and texts, characters, those in links."""
    events, nodes = parse(page)
    texts, sizes, styles = defaultdict(dict), defaultdict(lambda: [0, 0]), defaultdict(list)
    inside = {}
    for run in runs(events):
        content = " ".join("".join(t for _, t in run).split())
        block = run[0][0].block
        if content and block.path:
            texts[block.path][xxhash.xxh3_64_intdigest(content) - (1 << 63)] = None
            size = sizes[block.path]
            for node, text in run:
                n = len(text.strip())
                size[0] += n
                size[1] += n * node.linked
            inside[block.path] = block.inside is not None
    for node in nodes:
        if node.path in texts:
            styles[node.path].append(",".join(node.kids))
    return {p: (inside[p], xxhash.xxh3_64_intdigest("|".join(styles[p])) - (1 << 63), list(texts[p]), *sizes[p]) for p in sorted(texts)}


#: A row of a page: a leaf with its style (kind 0) or one of its texts (kind 1).
LEAF = pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("digest", pa.int64()), ("inside", pa.bool_()), ("size", pa.int64()), ("links", pa.int64())])


def _pages(batches):
    """Host, digest and leaves of each page; copies in a batch are one row."""
    for batch in batches:
        out = {}
        for host, page in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            rows = []
            for path, (inside, style, texts, size, links) in leaves(page.decode()).items():
                rows.append((path, 0, style, inside, size, links))
                rows += ((path, 1, text, inside, 0, 0) for text in texts)
            if rows:
                out[host, xxhash.xxh3_128_digest(repr([r[:3] for r in rows]))] = rows
        lists = [[dict(zip(("node", "kind", "digest", "inside", "size", "links"), r)) for r in rows] for rows in out.values()]
        yield pa.record_batch([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.binary()), pa.array(lists, pa.list_(LEAF))],
                              names=["host", "page", "leaves"])


def importance(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, node, pages, importance`` of the leaves of the site style trees; ``pages`` are distinct ones."""
    each = short_batches(pages).select(address(F.col(url))[0].alias("host"), F.col(html)).mapInArrow(
        _pages, "host string, page binary, leaves array<struct<node long, kind int, digest long, inside boolean, size long, links long>>")
    rows = each.dropDuplicates(["host", "page"]).select("host", F.inline("leaves"))
    counts = rows.groupBy("host", "node", "kind", "digest").agg(F.count("*").alias("c"), F.max("inside").alias("inside"), F.sum("size").alias("size"), F.sum("links").alias("links"))
    style, text = F.col("kind") == 0, F.col("kind") == 1
    many = F.col("c") * F.log(F.col("c").cast("double"))
    nodes = counts.groupBy("host", "node").agg(
        F.max("inside").alias("inside"),
        F.sum(F.when(style, F.col("c"))).alias("pages"),
        F.sum(F.when(style, many)).alias("spread"),
        (F.sum(F.when(text, many)) / F.sum(F.when(text, F.col("c")))).alias("repeat"),
        (F.sum("links") / F.sum("size")).alias("linked"))
    base = F.log(F.col("pages").cast("double"))
    value = (1 - GAMMA) * (base - F.col("spread") / F.col("pages")) / base + GAMMA * (1 - F.col("repeat") / base)
    value = F.when(F.col("inside"), PRIOR + (1 - PRIOR) * value).otherwise(value * (1 - LINKED * F.col("linked")))
    return nodes.select("host", "node", "pages", F.when(F.col("pages") > 1, value).otherwise(1.0).alias("importance"))


def blocks(page: str, unimportant: frozenset[str] = frozenset()) -> list[str]:
    """Blocks of the main text; ``unimportant`` has the paths to remove with all below them."""
    return main_text(page, {path_of(p): 0.0 for p in unimportant})


def main_text(page: str, values: dict[int, float], least: float = LEAST_IMPORTANCE) -> list[str]:
    """Blocks of the page without branches whose leaves have less than the least importance; a leaf without a value has 1."""
    events, nodes = parse(page)
    found = runs(events)
    if values:
        for run in found:
            size = sum(len(t.strip()) for _, t in run)
            block = run[0][0].block
            block.size += size
            block.worth += size * values.get(block.path, 1.0)
        for node in reversed(nodes):
            parent = node.parent
            if parent is not None and parent.inside == node.inside:  # what stands above an article decides nothing in it
                parent.size += node.size
                parent.worth += node.worth
        for node in nodes[1:]:
            parent = node.parent
            node.gone = parent.gone and parent.inside == node.inside or node.size > 0 and node.worth < least * node.size
    return joined(found, lambda n: not n.gone) or (joined(found, lambda n: n.inside) if values else [])


def joined(found: list, stays) -> list[str]:
    texts = (" ".join("".join(t for node, t in run if not node.noise and stays(node.block)).split()) for run in found)
    return [t for t in texts if t]


def _extract(least: float):
    def run(batches):
        for batch in batches:
            sites = (dict(zip(n or (), v or ())) for n, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            texts = ["\n\n".join(main_text(page.decode(), values, least)) for page, values in zip(text_bytes(batch.column(1)), sites)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["rest", "text"])

    return run


def extract(pages: DataFrame, keys: list[str], url: str = "url", html: str = "html", least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``rest`` (struct of ``keys``) and ``text``, blocks joined by two line ends."""
    known = importance(pages, url, html).filter(F.col("pages") >= least_pages)
    # Only sites with a low leaf can lose a branch. The others keep all that markup doesn't name.
    sites = known.groupBy("host").agg(F.min("importance").alias("lowest"), F.collect_list(F.struct("node", "importance")).alias("n")).filter(F.col("lowest") < least)
    sites = written(sites.select("host", F.col("n.node").alias("nodes"), F.col("n.importance").alias("worths")))  # leaves of a site, not of its pages
    base = pages.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("rest"), F.col(html).alias("html"), address(F.col(url))[0].alias("host"))
    kind = base.schema["rest"].dataType.simpleString()
    if (sites.agg(F.sum(F.size("nodes") + 8)).first()[0] or 0) <= MOST_NODES:
        both = base.join(F.broadcast(sites), "host", "left")
    else:  # a hot host is spread by its pages
        both = base.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS))).join(
            sites.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"], "left")
    return both.select("rest", "html", "nodes", "worths").mapInArrow(_extract(least), f"rest {kind}, text string")
