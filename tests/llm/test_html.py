"""The style tree against a plain version of it, and cases of the parser."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wiregaze.llm import html


def brute(pages):
    """host -> pages -> texts, by dictionaries over whole hosts and recursion over each DOM."""
    hosts = defaultdict(list)
    for i, (host, page) in enumerate(pages):
        hosts[host].append((i, page))
    out = {}
    for own in hosts.values():
        held, shapes, texts = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
        doms = {}
        for i, page in own:
            nodes, _ = doms[i] = html.parse(page)
            for n in nodes:
                if n.judged and not n.hard and not n.soft:
                    held[n.key].add(i)
                    if any(n.shape):
                        shapes[n.key][tuple(n.shape)].add(i)
                    for t in n.texts:
                        texts[n.key][t].add(i)

        def shown(k):
            m = len(held[k])
            if m < 2:
                return 1.0
            counts = [len(x) for x in shapes[k].values()]
            h = -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)
            return min(1.0, 1 - (math.log(m) - h) / math.log(m + 8))

        def content(k):
            m = len(held[k])
            return 1.0 if m < 2 or not texts[k] else 1 - sum(math.log(len(x)) for x in texts[k].values()) / len(texts[k]) / math.log(m + 8)

        for i, (nodes, blocks) in doms.items():
            children = defaultdict(list)
            for j, n in enumerate(nodes):
                children[n.up].append(j)

            def size(j):
                return sum(map(len, nodes[j].texts)) + sum(map(size, children[j]))

            def importance(j):
                n = nodes[j]
                c = content(n.key) if n.judged else 1.0
                parts = [(len(t), c) for t in n.texts] + [(size(x), importance(x)) for x in children[j]]
                total = sum(w for w, _ in parts)
                value = sum(w * v for w, v in parts) / total if total else c
                if children[j]:
                    g = 0.9 ** (max(1, len(shapes[n.key])) if n.judged and len(held[n.key]) > 1 else 1)
                    value = (1 - g) * (shown(n.key) if n.judged else 1.0) + g * value
                return value

            def kept_branch(j):
                return nodes[j].main and not nodes[j].judged or any(map(kept_branch, children[j]))

            def visible(j):
                n = nodes[j]
                if n.up < 0:
                    return True
                return visible(n.up) and not (n.judged and not kept_branch(j) and importance(j) < 0.2)

            texts_ = [(j, t) for j, t in blocks if not nodes[j].hard]
            if any(not nodes[j].soft for j, _ in texts_):
                texts_ = [x for x in texts_ if not nodes[x[0]].soft]
            if any(nodes[j].main for j, _ in texts_):
                texts_ = [x for x in texts_ if nodes[x[0]].main]
            out[i] = "\n".join(t for j, t in texts_ if visible(j) and not (nodes[j].judged and content(nodes[j].key) < 0.2))
    return out


def site():
    """Pages without article or main, whose boilerplate no name gives away: only the tree can tell."""
    pages = []
    for i in range(40):
        host = "big.test" if i % 4 else f"small{i % 3}.test"
        paras = "".join(f"<p>Paragraph {j} of story {i} tells of {i * 7 + j} things</p>" for j in range(1 + i % 5))
        story = f'<div class="t1"><h1>Story {i}</h1>{paras}</div>'
        top = '<div class="a1"><ul><li>Home</li><li>About us</li><li>Press</li></ul></div>'
        end = f'<div class="z1"><p>All rights kept by the site</p><div class="z2"><p>Terms</p><p>at {i}:{i % 60}</p></div><p>Write to the desk for more on these pages</p></div>'
        mixed = f'<article><p>Main {i}</p><div class="k9"><p>Read it in our paper</p></div></article>' if i % 7 == 0 else ""
        pages.append((host, f"<html><head><title>x</title><body><div id=page>{top}{story}{end}</div>{mixed}"))
    pages += [("copies.test", "<body><main><p>One text on many pages</p></main>")] * 30 + [("none.test", None), ("none.test", ""), ("big.test", "just text")]
    return pages


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, f"http://{h}/{i}", p, "x", "y") for i, (h, p) in enumerate(site())], "page_id long, url string, html string, host string, tree string")


@pytest.mark.parametrize("size", [4 << 20, -1])
def test_tree_equals_brute_force(spark, frame, size):
    """Both ways of handing the tree to the pages."""
    want = brute(site())
    got = {r["page_id"]: r["text"] for r in html.extract(frame, broadcast_bytes=size).collect()}
    assert got == want
    alone = {i: html.main_text(p) for i, (_, p) in enumerate(site())}
    assert sum(got[i] != alone[i] for i in got) >= 25  # the tree decides here
    assert got[1] == "Story 1\nParagraph 0 of story 1 tells of 7 things\nParagraph 1 of story 1 tells of 8 things"
    assert got[21].startswith("Main 21") and got[45] == "One text on many pages"
    assert got[70] == got[71] == "" and got[72] == "just text"


def test_a_branch_goes_whole(spark):
    """The line that differs on each page goes with the branch that is alike on all."""
    pages = [(i, "http://h.test", f'<div class="s"><p>Text {i} that says something new of number {i * i}</p></div><div class="f"><p>The same words at the end of every page of it</p><div class="g"><p>{i}</p></div></div>') for i in range(60)]
    got = {r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {f"Text {i} that says something new of number {i * i}" for i in range(60)}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p data-a=it's>Hello world</p><p>don't go</p><p>tail</p></article>", "Hello world\ndon't go\ntail"),
        ('<article><header class="entry-header"><h1>Title</h1></header><p>x</article>', "Title\nx"),
        ('<div class="discussion"><article><p>whole</article></div>', "whole"),
        ('<article><p class="related-work">kept</p><div class="share-buttons">s</div>', "kept"),
        ("<html><head><meta charset=x><body><p>no end of head", "no end of head"),
        ('<p title="a > b">t</p> q', "t\nq"),
        ("<p>1 < 2 &amp;&nbsp;3 &lt;b></p>", "1 < 2 & 3 <b>"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<article>" + "<p>w </p>" * 20000, "\n".join(["w"] * 20000)),
        ('<article><p a="1"b=\'2\' c>x</p><p "">y</p>', "x\ny"),
    ],
)
def test_parser(page, text):
    assert html.main_text(page) == text


def test_odd_tables(spark, frame):
    assert html.extract(frame.where(F.lit(False))).count() == 0
    twice = html.extract(frame.union(frame))
    assert twice.count() == 2 * len(site())
    odd = spark.createDataFrame([(None, None, None), (1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (2, "no scheme", "")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.extract(odd).collect())
    assert got == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]
