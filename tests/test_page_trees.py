"""Selectors on the node table against recursion over random element trees."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sitelens import lexicons as L
from sitelens.operators import pages as P

TAGS = ["div", "p", "ul", "ol", "li", "section", "article", "main", "h1", "h3", "span", "nav", "script_", "footer"]
CLASSES = ["", "", "", "content", "x content", "sidebar-left", "main-content wide", "ads", "popup y"]


class Tree:
    """An element with what it holds: texts and elements in order."""

    def __init__(self, rng, depth):
        self.tag, self.cls = rng.choice(TAGS), rng.choice(CLASSES)
        self.inside = []
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5]) if depth < 9 else 0):
            if rng.random() < 0.45:
                self.inside.append(" ".join(rng.choice(["the", "data", "bot", "er", "Search", "x1", "long"]) for _ in range(rng.choice([1, 3, 12, 40]))))
                self.inside.append(None)  # keeps texts apart: a void element
            else:
                self.inside.append(Tree(rng, depth + 1))

    def html(self):
        return f'<{self.tag} class="{self.cls}">' + "".join("<br>" if x is None else x if isinstance(x, str) else x.html() for x in self.inside) + f"</{self.tag}>"

    def kids(self):
        return [x for x in self.inside if isinstance(x, Tree)]

    def below(self):
        return [d for k in self.kids() for d in (k, *k.below())]

    def text(self, drop=lambda n: False):
        parts = [x.text(drop) if isinstance(x, Tree) else x for x in self.inside if x is not None and not (isinstance(x, Tree) and drop(x))]
        return " ".join(p for p in parts if p)

    def kept(self, drop):
        """This and what is below it, without dropped subtrees."""
        return [] if drop(self) else [self, *(d for k in self.kids() for d in k.kept(drop))]


def boilerplate(n):
    return n.tag in L.REMOVED_TAGS or bool(re.search("|".join(L.REMOVED_CLASSES), n.cls, re.I))


def never(n):
    return False


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(21)
    out = []
    for _ in range(60):
        root = Tree(rng, 0)
        root.tag, root.cls = "body", ""
        root.inside += [Tree(rng, 1) for _ in range(3)]
        out.append(root)
    return out


@pytest.fixture(scope="module")
def dom(spark, trees):
    rows = [(i, t.html()) for i, t in enumerate(trees)] + [(900, None), (901, ""), (902, "no element at all")]
    return P.nodes(spark.createDataFrame(rows, "page_id long, html string").repartition(3)).cache()


def test_nodes_are_nested_sets(dom, trees):
    by = {}
    for r in dom.collect():
        by.setdefault(r.page_id, []).append(r)
    assert set(by) == set(range(len(trees)))
    for i, t in enumerate(trees):
        rows = sorted(by[i], key=lambda r: r.node_id)
        elements = [r for r in rows if r.tag != "br"]
        order = [t, *t.below()]
        assert [r.tag for r in elements] == [n.tag for n in order]
        brs = lambda n: sum(x is None for x in n.inside) + sum(brs(k) for k in n.kids())
        for r, n in zip(elements, order, strict=True):
            assert r.last_id - r.node_id == len(n.below()) + brs(n)
        parents = {r.node_id: r.parent_id for r in rows}
        for r in rows:
            assert r.parent_id == max((p.node_id for p in rows if p.node_id < r.node_id <= p.last_id), default=-1) == parents[r.node_id]


@pytest.mark.parametrize("drop", [None, "boilerplate"])
def test_subtree_texts(dom, trees, drop):
    rule = boilerplate if drop else never
    got = Counter((r.page_id, r.tag, r["class"], r.text) for r in P.subtree_text(dom, P.boilerplate() if drop else None).collect() if r.tag != "br")
    assert got == Counter((i, n.tag, n.cls, n.text(rule)) for i, t in enumerate(trees) for n in t.kept(rule))


def test_dropped_subtrees(dom, trees):
    got = Counter((r.page_id, r.tag, r["class"]) for r in P.without_boilerplate(dom).collect() if r.tag != "br")
    assert got == Counter((i, n.tag, n.cls) for i, t in enumerate(trees) for n in t.kept(boilerplate))
    chosen = lambda n: n.tag in L.REMOVED_SELECTOR_TAGS or bool(set(n.cls.split()) & set(L.REMOVED_SELECTOR_CLASSES))
    got = Counter((r.page_id, r.tag, r["class"]) for r in P.without_selectors(dom).collect() if r.tag != "br")
    assert got == Counter((i, n.tag, n.cls) for i, t in enumerate(trees) for n in t.kept(chosen))


def plain_main(t, rule, first_present, least=100, least_block=200):
    kept = t.kept(rule)
    selectors = [lambda n, x=x: n.tag == x for x in L.CONTENT_TAGS] + [lambda n, x=x: x in n.cls.split() for x in L.CONTENT_CLASSES]
    for s in selectors:
        found = [n for n in kept if s(n)]
        if found and (first_present or len(found[0].text(rule)) > least):
            return found[0].text(rule)
    if not first_present:
        blocks = [(-len(n.text(rule)), j, n) for j, n in enumerate(kept) if n.tag in ("div", "section", "article", "main") and len(n.text(rule)) > least_block]
        if blocks:
            return min(blocks)[2].text(rule)
    return t.text(rule)


@pytest.mark.parametrize("first_present", [False, True])
def test_main_content(dom, trees, first_present):
    got = {r.page_id: r.content for r in P.main_content(dom, P.boilerplate(), first_present=first_present).collect()}
    assert got == {i: plain_main(t, boilerplate, first_present) for i, t in enumerate(trees)}


def test_sections_and_lists(dom, trees):
    heads = [(i, n, [h for h in n.below() if h.tag in P.HEADINGS]) for i, t in enumerate(trees) for n in [t, *t.below()] if n.tag in ("section", "article", "main", "div")]
    assert Counter((r.page_id, r.tag, r.heading, r.text_length) for r in P.sections(dom).collect()) == Counter((i, n.tag, h[0].text(), len(n.text())) for i, n, h in heads if h)
    lists = [(i, n.tag, "\n".join(x for x in (d.text() for d in n.below() if d.tag == "li") if x)) for i, t in enumerate(trees) for n in t.below() if n.tag in ("ul", "ol")]
    assert Counter((r.page_id, r.kind, r["items"]) for r in P.lists(dom).collect()) == Counter(x for x in lists if x[2])


def siblings(t):
    """(node, the elements after it under the same parent), void ones too."""
    for n in [t, *t.below()]:
        inside = [x for x in n.inside if not isinstance(x, str)]
        for j, x in enumerate(inside):
            if x is not None:
                yield x, inside[j + 1 :]


def test_headings_with_what_follows(dom, trees):
    texts = P.subtree_text(dom)
    want = Counter()
    for i, t in enumerate(trees):
        for n, rest in siblings(t):
            follows = rest[0] if rest else None
            if n.tag in P.HEADINGS and 4 <= len(n.text()) <= 149 and "search" in n.text().lower() and follows is not None and follows.tag in ("p", "div", "span") and len(follows.text()) > 20:
                want[i, n.text(), follows.text()] += 1
    assert want and Counter((r.page_id, r.title, r.description) for r in P.heading_features(texts, ["search"]).collect()) == want


def test_blocks_of_keywords(spark, dom, trees):
    words = spark.createDataFrame([("the",), ("search",), ("zzz",)], "keyword string")
    want = {}
    for i, t in enumerate(trees):
        order = {id(n): j for j, n in enumerate([t, *t.below()])}
        for n, rest in sorted(siblings(t), key=lambda x: order[id(x[0])]):
            block = " ".join(x.text() for x in rest[:5] if x is not None and x.tag in ("p", "div", "span"))
            for k in ("the", "search"):
                if n.tag in P.HEADINGS and k in n.text().lower() and block:
                    want.setdefault((i, k), block[:500])
    assert want and {(r.page_id, r.keyword): r.block for r in P.section_blocks(P.subtree_text(dom), words).collect()} == want


def test_relevant_blocks(dom, trees):
    want = {}
    for i, t in enumerate(trees):
        found = {n.text() for n in [t, *t.below()] if n.tag in (*P.HEADINGS, "p", "li", "article") and len(n.text()) > 20 and any(w in n.text().lower() for w in ("search", "bot"))}
        if found:
            want[i] = " ".join(sorted(found))
    assert want and {r.page_id: r.blocks for r in P.relevant_blocks(P.subtree_text(dom), ["search", "bot"]).collect()} == want


def test_unclosed_tags_and_depth(spark):
    deep = "<div>" * 300 + "in" + "</div>" * 300
    rows = [(1, "<body><ul><li>a<li>b</ul><p>c"), (2, deep), (3, "</p>stray</div><p>x</p>")]
    dom = P.nodes(spark.createDataFrame(rows, "page_id long, html string"))
    assert [r["items"] for r in P.lists(dom).collect()] == ["a b\nb"]
    texts = P.subtree_text(dom).filter("page_id = 2").collect()
    assert len(texts) == 300 and {r.text for r in texts} == {"in"}
    assert [r.text for r in P.subtree_text(dom).filter("page_id = 3").collect()] == ["x"]


def test_text_is_shuffled_once_whatever_the_depth(spark):
    """Bytes that the assembly of texts moves: as many for nested elements as for flat ones, but for the nodes' own numbers."""
    words = [f"word{i} " * 200 for i in range(20)]
    flat = "<body>" + "".join(f"<p>{w}</p>" for w in words) + "</body>"
    nested = "<body>" + "".join(f"<p>{w}" for w in words) + "</p>" * 20 + "</body>"
    sizes = []
    for html in (flat, nested):
        dom = P.nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
        sizes.append(sum(sum(len(x) for x in r.pieces) for r in P.page_rows(dom).collect()))
    assert sizes[0] == sizes[1]
