"""Main-text extraction with a site style tree (after Yi, Liu and Li, 2003).

The DOMs of a host's pages are merged: a node is the path of styles (tag with class, id and role) of block
elements from the root. It has two importances over the m pages that hold it, both falling with the
information that the pages share:

* presentation: 1 - (log m - H) / log(m + PRIOR_PAGES), H the entropy of the child sequences it shows;
* content: 1 - mean over its distinct own texts of log k / log(m + PRIOR_PAGES), k the pages with that text.

PRIOR_PAGES stands for pages not seen yet: it is the same formula for every host, and nothing on a host of
one page is judged unimportant. The composite importance of a node on a page is
(1 - g^l) * presentation + g^l * (mean over its texts and children, weighted by their characters), l the
number of child sequences and g = GAMMA; of a node without children, its content. Walking down, a branch
of composite importance below MIN_IMPORTANCE is removed whole, and so is a node's own text of such content.

What markup declares is a prior: branches whose tag or role names a menu, header, footer, form and the like,
or whose class or id does, have importance 0; a main or article branch, and elements in it without class, id
or role, have importance 1, as copies of an article must not vanish; where a page has such a branch, the
rest has 0. Where that leaves a page without text, classes and ids count no more.

Departures from the paper: nodes are merged by path, not by the ancestors' whole child sequences; a feature
is a block's whole text; the composite follows the page's own child sequence and weighs by characters.

Defined results: null or empty html gives empty text; truncated tags are dropped; a null url or one without
:// has the host ''; repeated rows stay and count as pages; ties cannot occur, as nothing is ranked; texts of
any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .urls import PARTS, lower

PRIOR_PAGES = 8
MIN_IMPORTANCE = 0.2
GAMMA = 0.9
BROADCAST_BYTES = 4 << 20
# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title template iframe svg math select option button canvas audio video object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
NOISE_TAGS = frozenset("nav header footer aside form menu dialog head fieldset search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
# Words of class and id names: a name is a notice, menu, advert and the like if it holds one of the first and no word but of both.
NOISE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar aside widget widgets header footer masthead copyright legal disclaimer share sharing social comment comments commentlist reply replies discussion disqus related recommended teaser toolbar search skip".split())
PLAIN_NAMES = frozenset("box block container wrap wrapper bar section area list item items link links post posts article articles button buttons icon icons form slot unit top bottom left right site page global inner outer content thread user reader left main primary secondary module panel row col js the".split())
MAIN_NAMES = frozenset(("main", "article"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
# a quote opens a value only after an equals sign
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>|\Z))", re.S)
ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
OPEN = re.compile(r"<[a-zA-Z/!?]")
WORD = re.compile(r"[a-z]+")
ENDS_P = BLOCK - {"html", "body", "head"}
# What an element of a list or table ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


class Node:
    """A block element: place of its parent, key of its path, what the markup declares, own texts and child sequence."""

    __slots__ = ("up", "tag", "key", "hard", "soft", "main", "judged", "texts", "shape")

    def __init__(self, up: int, tag: str, key: int, hard: bool, soft: bool, main: bool, judged: bool):
        self.up, self.tag, self.key, self.hard, self.soft, self.main, self.judged = up, tag, key, hard, soft, main, judged
        self.texts: list[str] = []
        self.shape = array("q")


def key_of(what: str | bytes) -> int:
    return xxhash.xxh64_intdigest(what) - (1 << 63)


def names_noise(attrs: dict[str, str]) -> bool:
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        words = set(WORD.findall(name))
        if words & NOISE_NAMES and words <= NOISE_NAMES | PLAIN_NAMES:
            return True
    return False


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """The page's block elements, parents first, and its texts in order with the places of their elements."""
    page = page or ""
    nodes = [Node(-1, "", 0, False, False, False, False)]
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("", 0)]  # open elements with the block that holds their text
    parts: list[str] = []
    at, end = 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                node = nodes[stack[-1][1]]
                node.texts.append(text)
                node.shape.append(0)
                out.append((stack[-1][1], text))

    def closed(tags: tuple[str, ...], through: tuple[str, ...] = ()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in BLOCK and stack[i][0] not in through:
                return

    while at < end:
        m = TAG.search(page, at)
        if not m:
            cut = OPEN.search(page, at)
            parts.append(page[at : cut.start()] if cut else page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None or m[4] == "" and at == end:
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                parts.append(" ")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if name in BLOCK:
                        flush()
                    del stack[i:]
                    break
                if name not in BLOCK and stack[i][0] in BLOCK:
                    break
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "img"):
                parts.append(" ")
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/") or name in ("script", "style"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name not in BLOCK:
            stack.append((name, stack[-1][1]))
            continue
        flush()
        if stack[-1][0] == "head":
            del stack[-1]
        if name in ENDS_P:
            closed(("p",))
        if name in ENDS:
            closed(ENDS[name], ("td", "th"))
        place = stack[-1][1]
        up = nodes[place]
        attrs: dict[str, str] = {}
        if m[3]:
            for k, a, b, c in ATTR.findall(m[3]):
                k = k.lower()
                if k in ("class", "id", "role") and k not in attrs:
                    attrs[k] = a or b or c
        style = name + "".join(f"[{k}={attrs[k]}]" for k in ("class", "id", "role") if attrs.get(k))
        key = key_of(f"{up.key}/{style}")
        role = attrs.get("role", "").lower()
        title = up.main and name in HEADINGS  # an article's own header holds its title
        hard = up.hard or name in NOISE_TAGS and not title or role in NOISE_ROLES
        soft = up.soft or bool(attrs) and not title and names_noise(attrs)
        main = up.main or name in MAIN_NAMES or role in MAIN_NAMES
        judged = name not in ("html", "body") and (not main or up.main and (up.judged or bool(attrs)))
        up.shape.append(key)
        nodes.append(Node(place, name, key, hard, soft, main, judged))
        stack.append((name, len(nodes) - 1))
    flush()
    return nodes, out


def features(page: str | None) -> set[tuple[int, int, int]]:
    """(node, kind, feature), each once a page: kind 0 the node is there, 1 a child sequence, 2 a text of its own.

    Nodes whose importance the markup fixes are left out.
    """
    seen = set()
    for n in parse(page)[0]:
        if n.judged and not n.hard and not n.soft:
            seen.add((n.key, 0, 0))
            if any(n.shape):
                seen.add((n.key, 1, key_of(n.shape.tobytes())))
            seen.update((n.key, 2, key_of(t.encode("utf-8", "surrogatepass"))) for t in n.texts)
    return seen


def composite(nodes: list[Node], tree: dict[int, tuple[float, float, int]]) -> list[float]:
    """Importance of each node on its page; tree: node -> presentation, content, child sequences."""
    weight, inner, branch = [0.0] * len(nodes), [0.0] * len(nodes), [False] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):  # children before parents
        n = nodes[i]
        shown, content, shapes = tree.get(n.key, (1.0, 1.0, 1)) if n.judged else (1.0, 1.0, 1)
        own = sum(map(len, n.texts))
        total = weight[i] + own
        value = (inner[i] + own * content) / total if total else content
        if branch[i]:
            value = (1 - GAMMA**shapes) * shown + GAMMA**shapes * value
        weight[i], inner[i] = total, value
        if n.up >= 0:
            branch[n.up] = True
            weight[n.up] += total
            inner[n.up] += total * value
    return inner


def main_text(page: str | None, tree: dict[int, tuple[float, float, int]] = {}, least: float = MIN_IMPORTANCE) -> str:  # noqa: B006
    """The page's text without its branches of low importance."""
    nodes, texts = parse(page)
    texts = [(i, t) for i, t in texts if not nodes[i].hard]
    if any(not nodes[i].soft for i, _ in texts):
        texts = [(i, t) for i, t in texts if not nodes[i].soft]
    if any(nodes[i].main for i, _ in texts):
        texts = [(i, t) for i, t in texts if nodes[i].main]
    if tree:
        value = composite(nodes, tree)
        holds = [n.main and not n.judged for n in nodes]  # of a branch that is kept
        for i in range(len(nodes) - 1, 0, -1):
            holds[nodes[i].up] |= holds[i]
        gone = [False] * len(nodes)
        for i, n in enumerate(nodes[1:], 1):
            gone[i] = gone[n.up] or n.judged and not holds[i] and value[i] < least
        texts = [(i, t) for i, t in texts if not gone[i] and not (nodes[i].judged and tree.get(nodes[i].key, (1.0, 1.0, 1))[1] < least)]
    return "\n".join(t for _, t in texts)


def style_tree(pages: DataFrame) -> DataFrame:
    """pages: host, html. -> host, node, shown (presentation), content, shapes, pages: the nodes of two pages or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, cols = [], ([], [], [])
            for h, page in zip(b.column(0).to_pylist(), b.column(1)):
                seen = features(page.as_py())
                host += [h] * len(seen)
                for c, v in zip(cols, zip(*seen)):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int8()), pa.array(cols[2], pa.int64())], ["host", "node", "kind", "feature"])

    found = pages.select("host", "html").mapInArrow(run, "host string, node long, kind byte, feature long")
    # by feature first: no host and no node is in one task
    found = found.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("k"))
    of = lambda kind, v: F.when(F.col("kind") == kind, v)
    k = F.col("k").cast("double")
    sums = found.groupBy("host", "node").agg(
        F.max(of(0, F.col("k"))).alias("pages"), F.count(of(1, k)).alias("shapes"), F.sum(of(1, k)).alias("n"), F.sum(of(1, k * F.log(k))).alias("kk"), F.avg(of(2, F.log(k))).alias("same")
    )
    whole = F.log(F.col("pages") + PRIOR_PAGES)
    # entropy of the shares k / n: log n - sum(k log k) / n; more sequences than pages are possible, so it may pass log m
    entropy = F.log("n") - F.col("kk") / F.col("n")
    shown = F.least(F.lit(1.0), 1 - (F.log("pages") - F.coalesce(entropy, F.lit(0.0))) / whole)
    content = 1 - F.coalesce("same", F.lit(0.0)) / whole
    return sums.where("pages > 1").select("host", "node", shown.alias("shown"), content.alias("content"), F.greatest(F.lit(1), "shapes").cast("int").alias("shapes"), "pages")


def with_tree(pages: DataFrame, tree: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Adds tree, an array of nodes, and of, what it belongs to: the host where all hosts' trees are small, else the page by a join of its own nodes."""
    tree = saved(tree.select("host", "node", "shown", "content", "shapes"), "style-tree")
    size = tree.agg(F.sum(F.length("host") + 32)).first()[0] or 0
    packed = F.collect_list(F.struct("node", "shown", "content", "shapes")).alias("tree")
    if size <= broadcast_bytes:
        return pages.join(F.broadcast(tree.groupBy("host").agg(packed)), "host", "left").withColumn("of", F.col("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, h, k) for p, h, page in zip(*(c.to_pylist() for c in b.columns)) for k in {n.key for n in parse(page)[0] if n.judged}]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()))], ["page", "host", "node"])

    pages = pages.withColumn("page", F.xxhash64("host", "html"))
    own = pages.select("page", "host", "html").mapInArrow(run, "page long, host string, node long").distinct()
    return pages.join(own.join(tree, ["host", "node"]).groupBy("page").agg(packed), "page", "left").withColumn("of", F.col("page").cast("string"))


def extract(pages: DataFrame, least: float = MIN_IMPORTANCE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    pages = pages.select("page_id", "url", "html").withColumn("host", lower(F.regexp_extract(F.coalesce("url", F.lit("")), PARTS, 1)))
    joined = with_tree(pages, style_tree(pages), broadcast_bytes).select("page_id", "url", "html", "tree", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, dict] = (None, {})
        for b in batches:
            texts = []
            for page, tree, of in zip(b.column(2), b.column(3), b.column(4).to_pylist()):
                if last[0] != of:
                    last = of, {x["node"]: (x["shown"], x["content"], x["shapes"]) for x in tree.as_py() or ()}
                texts.append(main_text(page.as_py(), last[1], least))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
