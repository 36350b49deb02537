"""Page extraction: one parse to a node table, selectors as DataFrame operations; regular expressions where they suffice.

Nodes are numbered as nested sets: a node's subtree is the interval node_id to last_id, so what is below a dropped node is found by
one running maximum, and ancestors by comparing numbers.  The texts of a page are numbered too, and a subtree's text is a
slice of them: to assemble texts, the nodes of a page meet once, with each text once, however deep the page is.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..sources.materialise import sized

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: last_id: the last node of the subtree; first_text, last_text: the texts of the subtree, from the first to before the last; own: the node's own.
NODE_SCHEMA = (
    "page_id long, node_id int, last_id int, parent_id int, depth int, sib_ord int, tag string, class string, id string, href string, name string, content string, "
    "first_text int, last_text int, own array<struct<no:int,text:string>>"
)
#: Nodes that a parsing task hands on at a time, about.
NODES_A_BATCH = 20_000
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


class _Nodes(HTMLParser):
    """Start tags in document order; unclosed tags end with the nearest ancestor that closes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.children: dict[int, int] = {}
        self.texts = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        parent = self.open[-1] if self.open else -1
        node, place = len(self.rows), self.children.get(parent, 0)
        self.children[parent] = place + 1
        self.rows.append({
            "node_id": node, "last_id": node, "parent_id": parent, "depth": len(self.open), "sib_ord": place, "tag": tag, "class": a.get("class", ""), "id": a.get("id", ""), "href": a.get("href", ""),
            "name": a.get("name") or a.get("property", ""), "content": a.get("content", ""), "first_text": self.texts, "last_text": self.texts, "own": [],
        })
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]]["tag"] == tag:
                self.leave(i)
                return

    def leave(self, i: int) -> None:
        for node in self.open[i:]:
            self.rows[node] |= {"last_id": len(self.rows) - 1, "last_text": self.texts}
        del self.open[i:]

    def handle_data(self, data):
        if self.open and data.strip():
            self.rows[self.open[-1]]["own"].append({"no": self.texts, "text": " ".join(data.split())})
            self.texts += 1


def nodes(pages: DataFrame) -> DataFrame:
    """Pages (page_id, html) to one row for each element; null HTML has no nodes."""
    kinds = {"page_id": pa.int64(), "own": pa.list_(pa.struct([("no", pa.int32()), ("text", pa.string())]))}
    columns = [tuple(f.split(" ", 1)) for f in NODE_SCHEMA.split(", ")]
    schema = pa.schema([(c, kinds.get(c) or (pa.int32() if kind == "int" else pa.string())) for c, kind in columns])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html"), strict=True):
                parser = _Nodes()
                parser.feed(html.as_py() or "")
                parser.leave(0)
                rows += [{"page_id": page_id, **r} for r in parser.rows]
                if len(rows) >= NODES_A_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select("page_id", "html").mapInArrow(parse, NODE_SCHEMA)


def _gone(drop: Column) -> Column:
    """Whether a node is dropped or below a dropped one: subtrees nest, so the furthest end of those begun so far decides."""
    begun = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.max(F.when(drop, F.col("last_id"))).over(begun) >= F.col("node_id"), F.lit(False))


def without_subtrees(dom: DataFrame, drop: Column) -> DataFrame:
    """Nodes that are not, and are not below, a dropped node."""
    return dom.withColumn("__gone", _gone(drop)).filter(~F.col("__gone")).drop("__gone")


def boilerplate(tags: list[str] = L.REMOVED_TAGS, classes: list[str] = L.REMOVED_CLASSES) -> Column:
    """Boilerplate tags and elements whose class or id has a boilerplate word."""
    pattern = "(?i)" + "|".join(classes)
    return F.col("tag").isin(tags) | F.col("class").rlike(pattern) | F.col("id").rlike(pattern)


def without_boilerplate(dom: DataFrame) -> DataFrame:
    return without_subtrees(dom, boilerplate())


def without_selectors(dom: DataFrame, tags: list[str] = L.REMOVED_SELECTOR_TAGS, classes: list[str] = L.REMOVED_SELECTOR_CLASSES) -> DataFrame:
    """Without the elements that CSS selectors name: tags, and whole words of the class."""
    return without_subtrees(dom, F.col("tag").isin(tags) | F.arrays_overlap(F.split("class", r"\s+"), F.array(*map(F.lit, classes))))


def page_rows(dom: DataFrame, drop: Column | None = None, wanted: Column | None = None, more: list[str] | None = None) -> DataFrame:
    """(page_id, pieces, nodes): each page's texts in order, and its nodes that are wanted, in document order.

    dom has all nodes of a page.  Texts of dropped subtrees are empty, so places of texts stay; their nodes are left out.
    """
    columns = ["node_id", "last_id", "parent_id", "sib_ord", "tag", "class", "first_text", "last_text", *(more or [])]
    marked = dom.withColumn("__gone", F.lit(False) if drop is None else _gone(drop))
    own = F.when(F.col("__gone"), F.transform("own", lambda p: F.struct(p["no"].alias("no"), F.lit("").alias("text")))).otherwise(F.col("own"))
    asked = ~F.col("__gone") if wanted is None else ~F.col("__gone") & wanted
    return marked.groupBy("page_id").agg(
        F.transform(F.array_sort(F.flatten(F.collect_list(own))), lambda p: p["text"]).alias("pieces"),
        F.array_sort(F.collect_list(F.when(asked, F.struct(*columns)))).alias("nodes"),
    )


def _joined(pieces: Column) -> Column:
    return F.array_join(F.filter(pieces, lambda x: x != ""), " ")


def _text_of(node: Column) -> Column:
    """The text of a node of page_rows with its descendants, in document order."""
    return _joined(F.slice("pieces", node["first_text"] + 1, node["last_text"] - node["first_text"]))


def subtree_text(dom: DataFrame, drop: Column | None = None, wanted: Column | None = None) -> DataFrame:
    """(page_id, node_id, last_id, parent_id, sib_ord, tag, class, text): the text of each wanted node with its descendants.

    dom has all nodes of a page; drop: nodes to leave out with all below them.
    """
    shown = ["node_id", "last_id", "parent_id", "sib_ord", "tag", "class"]
    made = F.transform("nodes", lambda n: F.struct(*[n[c].alias(c) for c in shown], _text_of(n).alias("text")))
    return page_rows(dom, drop, wanted).select("page_id", F.explode(made).alias("n")).select("page_id", "n.*")


def non_empty(texts: DataFrame) -> DataFrame:
    return texts.filter(F.length("text") > 0)


def main_content(dom: DataFrame, drop: Column | None = None, least: int = 100, least_block: int = 200, first_present: bool = False) -> DataFrame:
    """(page_id, content): the first selector whose first element has enough text, else the block with most text, else all text.

    first_present: the first element of the first selector that has any, however short, else the body, else all text.
    """
    blocks = ["div", "section", "article", "main"]
    classes = F.split("class", r"\s+")
    wanted = F.col("tag").isin([*L.CONTENT_TAGS, *blocks, "body"]) | F.arrays_overlap(classes, F.array(*map(F.lit, L.CONTENT_CLASSES)))

    def first(rule) -> Column:
        return F.get(F.filter("nodes", lambda n: rule(n)), F.lit(0))

    by_tag = [first(lambda n, t=t: n["tag"] == t) for t in L.CONTENT_TAGS]
    by_class = [first(lambda n, c=c: F.array_contains(F.split(n["class"], r"\s+"), c)) for c in L.CONTENT_CLASSES]
    firsts = F.transform(F.filter(F.array(*by_tag, *by_class), lambda n: n.isNotNull()), _text_of)
    rows, whole = page_rows(dom, drop, wanted), _joined(F.col("pieces"))
    if first_present:
        body = F.get(F.transform(F.filter("nodes", lambda n: n["tag"] == "body"), _text_of), F.lit(0))
        return rows.select("page_id", F.coalesce(F.get(firsts, F.lit(0)), body, whole).alias("content"))
    chosen = F.get(F.filter(firsts, lambda t: F.length(t) > least), F.lit(0))
    sized_ = F.transform(F.filter("nodes", lambda n: n["tag"].isin(blocks)), lambda n: F.struct((-F.length(_text_of(n))).alias("size"), n["node_id"].alias("node_id"), _text_of(n).alias("text")))
    largest = F.array_min(F.filter(sized_, lambda b: b["size"] < -least_block))["text"]
    return rows.select("page_id", F.coalesce(chosen, largest, whole).alias("content"))


def meta(dom: DataFrame) -> DataFrame:
    """(page_id, key, value): the last value of each name or property."""
    rows = dom.filter((F.col("tag") == "meta") & (F.col("name") != ""))
    return rows.groupBy("page_id", F.col("name").alias("key")).agg(F.max_by("content", "node_id").alias("value"))


def page_meta(pages: DataFrame, dom: DataFrame) -> DataFrame:
    """(page_id, description, properties, og): each page with its meta tags as maps; og has the keys that begin with og:."""
    entry = F.struct(F.col("key"), F.col("value"))
    found = meta(dom).groupBy("page_id").agg(F.map_from_entries(F.collect_list(entry)).alias("properties"))
    nothing = F.create_map().cast("map<string,string>")
    out = pages.select("page_id").join(found, "page_id", "left").withColumn("properties", F.coalesce("properties", nothing))
    return out.select("page_id", F.try_element_at("properties", F.lit("description")).alias("description"), "properties", F.map_filter("properties", lambda k, _: k.startswith("og:")).alias("og"))


def sections(dom: DataFrame) -> DataFrame:
    """Containers that hold a heading: the first heading's text and the length of all text."""
    after = Window.partitionBy("page_id").orderBy(F.desc("node_id")).rowsBetween(Window.unboundedPreceding, -1)
    heading = F.when(F.col("tag").isin(HEADINGS), F.struct("node_id", "first_text", "last_text"))
    marked = dom.withColumn("head", F.last(heading, ignorenulls=True).over(after))  # the next heading; it is inside if its number is
    boxes = page_rows(marked, None, F.col("tag").isin("section", "article", "main", "div") & (F.col("head.node_id") <= F.col("last_id")), ["head"])
    made = F.transform("nodes", lambda n: F.struct(n["node_id"].alias("node_id"), n["tag"].alias("tag"), _text_of(n["head"]).alias("heading"), F.length(_text_of(n)).cast("long").alias("text_length")))
    return boxes.select("page_id", F.explode(made).alias("n")).select("page_id", "n.*")


def lists(dom: DataFrame) -> DataFrame:
    """Lists with any item: kind and the non-empty items at any depth below, in order."""
    rows = page_rows(dom, None, F.col("tag").isin("ul", "ol", "li"))
    items = F.filter(F.transform(F.filter("nodes", lambda n: n["tag"] == "li"), lambda n: F.struct(n["node_id"].alias("node_id"), _text_of(n).alias("text"))), lambda i: i["text"] != "")
    held = rows.select("page_id", F.filter("nodes", lambda n: n["tag"] != "li").alias("lists"), items.alias("items"))
    own = lambda n: F.filter("items", lambda i: (i["node_id"] > n["node_id"]) & (i["node_id"] <= n["last_id"]))
    made = F.transform("lists", lambda n: F.struct(n["node_id"].alias("list_id"), n["tag"].alias("kind"), F.array_join(F.transform(own(n), lambda i: i["text"]), "\n").alias("items")))
    return held.select("page_id", F.explode(made).alias("n")).select("page_id", "n.*").filter(F.length("items") > 0)


def with_next_sibling(texts: DataFrame) -> DataFrame:
    w = Window.partitionBy("page_id", "parent_id").orderBy("sib_ord")
    return texts.withColumns({"next_tag": F.lead("tag").over(w), "next_text": F.lead("text").over(w)})


def faq_pairs(texts: DataFrame, titles: DataFrame) -> DataFrame:
    """On pages titled as FAQ: questions of 6 to 199 characters and the sibling after them, cut at 300."""
    faq = titles.filter(T.has_any(F.lower("title"), ["faq", "질문"])).select("page_id")
    q = with_next_sibling(texts.join(faq, "page_id", "left_semi")).filter(F.col("tag").isin([*HEADINGS, "strong", "b"]) & F.length("text").between(6, 199) & (F.length("next_text") > 20))
    return q.select("page_id", F.col("text").alias("question"), T.cut(F.col("next_text"), 300).alias("answer"))


def heading_features(texts: DataFrame, terms: list[str]) -> DataFrame:
    """Headings of 4 to 149 characters with a feature word, and the text block after them."""
    h = with_next_sibling(texts).filter(F.col("tag").isin(HEADINGS) & F.length("text").between(4, 149) & T.has_any(F.lower("text"), terms))
    return h.filter(F.col("next_tag").isin("p", "div", "span") & (F.length("next_text") > 20)).select("page_id", F.col("text").alias("title"), F.col("next_text").alias("description"))


def section_blocks(texts: DataFrame, keywords: DataFrame, ahead: int = 5, cap: int = 500) -> DataFrame:
    """For each keyword the first heading of a page that contains it, with the text of the blocks among the next siblings."""
    w = Window.partitionBy("page_id", "parent_id").orderBy("sib_ord").rowsBetween(1, ahead)
    block = F.when(F.col("tag").isin("p", "div", "span"), F.col("text"))
    h = texts.withColumn("block", F.array_join(F.collect_list(block).over(w), " ")).filter(F.col("tag").isin(HEADINGS) & (F.length("block") > 0))
    hit = h.join(sized(keywords.select("keyword")), F.lower("text").contains(F.lower("keyword")))
    return hit.groupBy("page_id", "keyword").agg(F.min_by(F.substring("block", 1, cap), "node_id").alias("block"))


def relevant_blocks(texts: DataFrame, terms: list[str]) -> DataFrame:
    """Distinct blocks of more than 20 characters with any feature word, concatenated for each page."""
    rows = texts.filter(F.col("tag").isin([*HEADINGS, "p", "li", "article"]) & (F.length("text") > 20) & T.has_any(F.lower("text"), terms))
    return rows.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("text")), " ").alias("blocks"))


# Regular expressions, for well-formed pages.


def strip_tags(html: Column, tags: list[str]) -> Column:
    """Without the elements of these tags, one pass for each tag, then without comments."""
    for t in tags:
        html = F.regexp_replace(html, rf"(?is)<{t}\b.*?</{t}>", " ")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", " ")


def plain_text(html: Column, tags: list[str]) -> Column:
    return T.single_line(F.regexp_replace(strip_tags(html, tags), r"<[^>]*>", " "))


def title(html: Column) -> Column:
    """<title>, else the first <h1>, else ''."""
    got = lambda tag: F.nullif(F.trim(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>([^<]*)</{tag}>", 1)), F.lit(""))
    return F.coalesce(got("title"), got("h1"), F.lit(""))


def headings(pages: DataFrame) -> DataFrame:
    """(page_id, ord, level, text) of non-empty headings."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>[^<]*</h[1-6]>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "h"))
    return rows.select("page_id", "ord", F.regexp_extract("h", r"(?i)<h([1-6])", 1).cast("int").alias("level"), F.trim(F.regexp_extract("h", ">([^<]*)<", 1)).alias("text")).filter(F.length("text") > 0)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, ord, href, text) of the links of each page, in order."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">[^<]*</a>'), F.lit(0))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("ord", "a"))
    return rows.select("page_id", "url", "ord", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_extract("a", ">([^<]*)<", 1)).alias("text")).filter(F.length("text") > 0)


def first_links(page_links: DataFrame, n: int = 20, cap: int = 100) -> DataFrame:
    """The first n links of each page (page_id, ord, href, text), texts cut."""
    ranked = page_links.withColumn("row_no", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).filter(F.col("row_no") <= n)
    return ranked.select("page_id", "ord", "href", F.substring("text", 1, cap).alias("text"))


def list_item_features(pages: DataFrame, terms: list[str]) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r"(?is)<(?:li|p)>[^<]*</(?:li|p)>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "li")).select("page_id", "ord", F.trim(F.regexp_extract("li", ">([^<]*)<", 1)).alias("text"))
    return rows.filter(F.length("text").between(6, 199) & T.has_any(F.lower("text"), terms))


def link_features(page_links: DataFrame, pages: DataFrame, terms: list[str], n: int = 10) -> DataFrame:
    """Links whose text has a feature word, the first n of each page; a page without any has one row for itself."""
    hit = page_links.filter(T.has_any(F.lower("text"), terms))
    hit = hit.withColumn("row_no", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).filter(F.col("row_no") <= n)
    own = hit.select("page_id", F.col("text").alias("title"), F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), "href")).alias("link"))
    rest = pages.join(hit.select("page_id").distinct(), "page_id", "left_anti").select("page_id", title(F.col("html")).alias("title"), F.col("url").alias("link"))
    return own.unionByName(rest)


def preview(text: Column, whole: str = "Page: ", n: int = 300, least: int = 50) -> Column:
    return F.when(F.length(text) > least, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(F.concat(F.lit(whole), text))


def whole_sentences(rows: DataFrame, key: str, text: str, room: int = 1500) -> DataFrame:
    """(key, content): the longest run of leading sentences, each with a space after it, that fits the room."""
    fits = F.aggregate(
        T.sentences(F.col(text)),
        F.struct(F.lit("").alias("out"), F.lit(False).alias("full")),
        lambda held, s: F.when(held["full"] | (F.length(held["out"]) + F.length(s) + 1 > room), F.struct(held["out"].alias("out"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(held["out"], s, F.lit(" ")).alias("out"), F.lit(False).alias("full"))),
        lambda held: F.trim(held["out"]),
    )
    return rows.select(key, fits.alias("content"))
