"""Hand-made cases of rules that the tables rarely meet, and loops against sequential models."""

import difflib
import random

import pytest
from pyspark.sql import functions as F
from sitelens import lexicons as L
from sitelens.operators import catalog, links, pages, scoring, similarity
from sitelens.operators import pages as P
from sitelens.sources import files
from sitelens.sources.materialise import written
from sitelens.streaming import feeds


def test_keyword_support_rules(spark):
    text = "this is file text for an upload; audio is not supported, no extras"
    cases = {"file text": ("O", 0.9), "file upload": ("△", 0.7), "audio mail": ("△", 0.6), "zebra": ("X", 0.8), "Zebra crossing lines": ("X", 0.8)}
    rows = spark.createDataFrame([(k, text) for k in cases], "k string, t string")
    got = {r.k: (r.v.status, r.v.confidence) for r in rows.select("k", scoring.keyword_support(F.col("k"), F.lower("t")).alias("v")).collect()}
    assert got == cases


def test_polarity_blanks_out_denials(spark):
    rows = spark.createDataFrame([("It is not supported",), ("Fully supported and free",), ("nothing here",)], "t string")
    assert [r.s for r in rows.select(scoring.polarity(F.col("t"))["status"].alias("s")).collect()] == ["X", "O", "△"]


def test_feature_support_stages(spark):
    cases = [("a search box", "search", "O", 0.95), ("we have live chat here", "실시간 채팅", "O", 0.85), ("video calls. we offer video rooms", "video tool", "△", 0.6), ("coming soon", "zzz", "X", 0.9), ("nothing", "chat room", "O", 0.9), ("nothing", "zzz", "X", 0.3)]
    rows = spark.createDataFrame([c[:2] for c in cases], "t string, f string")
    got = [(r.v.status, r.v.confidence) for r in rows.select(scoring.feature_support(F.col("t"), F.col("f")).alias("v")).collect()]
    assert got == [c[2:] for c in cases]


def test_validation_branches(spark):
    rows = spark.createDataFrame([(1, "ab", "x", "d", 0.5), (2, " name ", "x", "d", 1.5), (3, "name", "other", "e" * 501, 0.2), (4, None, "x", "d", 0.2)], "ord int, name string, category string, description string, confidence double")
    clean, rejected = catalog.validate(rows, ["x"])
    got = {r.ord: r for r in clean.collect()}
    assert set(got) == {2, 3} and got[2].name == "name" and got[2].confidence == 0.5
    assert got[3].category == catalog.OTHER and len(got[3].description) == 500
    assert {r.ord for r in rejected.collect()} == {1, 4}


def test_dom_selectors(spark):
    html = "<html><head><title>FAQ</title><meta name='a' content='1'><meta name='a' content='2'></head><body><nav>menu</nav><article><h2>How does it work?</h2><p>" + "It works well. " * 10 + "</p><ul><li>one</li><li> </li><li>two</li></ul></article><div class='cookie-bar'>x</div></body></html>"
    page = spark.createDataFrame([(1, "https://a.example.com/x", html), (2, "https://b.example.com/", None)], "page_id long, url string, html string")
    dom = pages.nodes(page)
    texts = pages.subtree_text(dom, pages.boilerplate())
    assert "menu" not in [r.text for r in texts.collect()] and not [r for r in texts.collect() if r["class"] == "cookie-bar"]
    assert pages.main_content(dom, pages.boilerplate()).first().content.startswith("How does it work?")
    assert [(r.key, r.value) for r in pages.meta(dom).collect()] == [("a", "2")]
    assert pages.lists(dom).first()["items"] == "one\ntwo"
    titles = page.filter("page_id = 1").select("page_id", pages.title(F.col("html")).alias("title"))
    faq = pages.faq_pairs(texts, titles).collect()
    assert len(faq) == 1 and faq[0].question == "How does it work?"


def test_absolute_and_globs(spark):
    rows = spark.createDataFrame([("https://h.org/a/b.html?q=1", h) for h in ("/x", "c.html", "http://o.org/", "d/e")], "u string, h string")
    assert [r.t for r in rows.select(links.absolute(F.col("u"), F.col("h")).alias("t")).collect()] == ["https://h.org/x", "https://h.org/a/c.html", "http://o.org/", "https://h.org/a/d/e"]


def test_reach_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    got = {r.url: r.depth for r in links.reach(edges, spark.createDataFrame([("a",)], "url string"), 3, written).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def taken_one_by_one(edges):
    want, used_a, used_b = [], set(), set()
    for a, b, c in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if a not in used_a and b not in used_b:
            want.append((a, b, c))
            used_a.add(a)
            used_b.add(b)
    return sorted(want)


def test_greedy_equals_taking_edges_one_by_one(spark):
    """Two hundred graphs side by side, with many equal similarities; nodes of different graphs never meet."""
    rng = random.Random(4)
    edges = []
    for g in range(200):
        n, m, density = rng.randint(1, 9), rng.randint(1, 9), rng.random()
        edges += [(g * 100 + a, g * 100 + b, rng.choice([0.2, 0.5, 0.5, round(rng.random(), 2)])) for a in range(n) for b in range(m) if rng.random() < density]
    got, rounds = similarity.greedy_rounds(spark.createDataFrame(edges, "a long, b long, cosine double"), written)
    assert sorted(map(tuple, got.collect())) == taken_one_by_one(edges) and 1 < rounds < 30


def test_greedy_on_a_chain(spark):
    """Each edge of a chain is better than the one before, so taking the last decides one after the other."""
    chain = [(i, i + d, (2 * i + d) / 100) for i in range(12) for d in (0, 1)]
    got, rounds = similarity.greedy_rounds(spark.createDataFrame(chain, "a long, b long, cosine double"), written)
    assert sorted(map(tuple, got.collect())) == taken_one_by_one(chain) and rounds <= 12
    none, rounds = similarity.greedy_rounds(spark.createDataFrame([], "a long, b long, cosine double"), written)
    assert none.count() == rounds == 0


def test_keep_first_equals_sequential(spark):
    random.seed(5)
    edges = sorted({tuple(sorted(random.sample(range(40), 2))) for _ in range(60)})
    kept: list[int] = []
    for i in range(40):
        if not any((j, i) in set(edges) for j in kept):
            kept.append(i)
    nodes = spark.createDataFrame([(i,) for i in range(40)], "id long")
    got = similarity.keep_first(nodes, spark.createDataFrame(edges, "a long, b long"), written).collect()
    assert sorted(r.id for r in got) == kept


def test_replies(spark):
    cases = ['```json\n{"k": 1}\n```', '```\n{"k": 2}\n```', 'so {"k": 3} there', '```json\n{"k": 4}', "no braces", '{"k": bad}']
    replies = spark.createDataFrame(list(enumerate(cases)), "reply_id long, text string")
    good, bad = files.parse_replies(replies, "k BIGINT")
    assert {r.reply_id: r.parsed.k for r in good.collect()} == {0: 1, 1: 2, 2: 3, 3: 4}
    assert {r.reply_id for r in bad.collect()} == {4, 5}


def test_stream_dedupe_equals_batch(spark, sf_dir):
    from sitelens.plans.feed_plans import stream
    from sitelens.sources import tables

    batch = {(r.key, r.event_id) for r in feeds.dedupe_hour(tables.job_events(spark, sf_dir)).collect()}
    got = {(r.key, r.event_id) for r in feeds.drained(feeds.dedupe_hour_stream(stream(spark, sf_dir)), "append").collect()}
    assert got == batch


def test_adaptive_rate():
    rate, lat, errors, good = 1.0, [], 0, 0
    seen = []
    for _ in range(8):
        rate, lat, errors, good = feeds.adapt(rate, lat, errors, good, 1.0, False)
        seen.append((round(rate, 6), errors))
    assert seen == [(1.0, 1), (1.0, 2), (1.0, 3), (1.0, 4), (0.8, 0), (0.8, 1), (0.8, 2), (0.64, 0)]  # nothing before five requests


def test_lexicon_table_drops_repeats(spark):
    assert L.as_table(spark, {"a": ["x", "x", " "], "b": ["x"]}).count() == 2


def test_similarity_stage(spark):
    rows = spark.createDataFrame([("nothing", "zzz", 0.5), ("nothing", "zzz", 0.9), ("nothing", "zzz", 0.2)], "t string, f string, s double")
    got = [(r.v.status, r.v.confidence) for r in rows.select(scoring.feature_support(F.col("t"), F.col("f"), similar=F.col("s")).alias("v")).collect()]
    assert got == [("△", 0.5), ("△", 0.7), ("X", 0.3)]


def test_page_meta_and_faq(spark):
    html = """<html><head><title>FAQ</title><meta name="description" content="About us"><meta property="og:title" content="Shop">
    <meta name="description" content="Later"></head><body><h3>How do I start?</h3><p>Open the page and press the button at the top.</p>
    <div class="ads big">Buy now</div><h2>Search pages</h2><p>Search finds every page that has the word in it.</p></body></html>"""
    pages = spark.createDataFrame([(1, "http://a.example.com/", html), (2, "http://a.example.com/2", None)], "page_id long, url string, html string")
    dom = P.nodes(pages)
    got = {r.page_id: (r.description, r.og, len(r.properties)) for r in P.page_meta(pages, dom).collect()}
    assert got == {1: ("Later", {"og:title": "Shop"}, 2), 2: (None, {}, 0)}
    texts = P.subtree_text(dom)
    faq = P.faq_pairs(texts, pages.select("page_id", P.title(F.col("html")).alias("title"))).collect()
    assert [(r.question, r.answer) for r in faq][0] == ("How do I start?", "Open the page and press the button at the top.")
    assert {r["class"] for r in P.without_selectors(dom).collect()} == {""}
    assert [(r.title, r.description) for r in P.heading_features(texts, ["search"]).collect()] == [("Search pages", "Search finds every page that has the word in it.")]


def test_catalogue_rules_with_rows(spark):
    """The rules whose queries have no rows on the tables: common features, advantages, recommendations."""
    cells = [("a", "chat", "O"), ("b", "chat", "O"), ("a", "file", "O"), ("b", "file", "X")]
    matrix = spark.createDataFrame(cells, "product string, norm string, status string")
    assert [r.norm for r in catalog.common_to_all(matrix, 2).collect()] == ["chat"]
    assert [(r.product, r.norm) for r in catalog.advantages(matrix).collect()] == [("a", "file")]
    advice = {(r.product, r.rule) for r in catalog.recommendations(catalog.comparison_summary(matrix, 2)).collect()}
    assert advice == {("a", "unique"), ("a", "common"), ("b", "common")}


def test_index_expansion(spark):
    rows = [(1, "http://x.com/", 0, "/guide", "guide"), (1, "http://x.com/", 1, "/b", "other"), (2, "http://x.com/guide", 0, "deep", "deep page")]
    found = spark.createDataFrame(rows, "page_id long, url string, ord long, href string, text string")
    got = links.index_expansion(found, F.col("text").contains("guide")).collect()
    assert [(r.from_page, r.via, r.target, r.text) for r in got] == [(1, "http://x.com/guide", "http://x.com/deep", "deep page")]


def test_nested_sitemaps_and_robots(spark):
    bodies = [(f"m{i}", f"<sitemapindex><sitemap><loc>m{i + 1}</loc></sitemap></sitemapindex>") for i in range(8)]
    bodies += [("m8", "<sitemapindex><loc>m0</loc><loc>leaf</loc></sitemapindex>"), ("leaf", "<urlset><url><loc>http://x.com/1</loc></url></urlset>"), ("lost", "<urlset><url><loc>http://x.com/2</loc></url></urlset>")]
    locs = links.sitemap_urls(spark.createDataFrame(bodies, "url string, body string"))
    robots = spark.createDataFrame([("r", "User-agent: *\nSITEMAP: m0\n")], "url string, body string")
    seeds = links.robots_seeds(robots).select(F.col("loc").alias("url"))
    assert [r.loc for r in files.nested_sitemaps(locs, seeds, written).collect()] == ["http://x.com/1"]


def test_glob_forms(spark):
    urls = ["http://x.com/a/b.html", "http://x.com/b", "https://y.com/a/c.html"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    hit = lambda p: [r.url for r in rows.filter(links.matches_glob(F.col("url"), [p])).collect()]
    assert hit("*x.com*") == urls[:2] and hit("*.html") == [urls[0], urls[2]] and hit("https*") == [urls[2]]
    assert hit("http:*a*") == [urls[0]] and hit("*/a/*.html") == [urls[0], urls[2]] and hit("*x*b") == [urls[1]]


def test_tables_through_jdbc_and_by_project(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, f"k{i}") for i in range(20)], "keyword_id int, project_id int, keyword string")
    url = "jdbc:derby:memory:sitelens;create=true"
    rows.write.jdbc(url, "keywords", mode="overwrite")
    got = files.read_jdbc(spark, url, "keywords", "keyword_id", 0, 20, 4)
    assert got.rdd.getNumPartitions() == 4 and {tuple(r) for r in got.collect()} == {tuple(r) for r in rows.collect()}
    files.save_by_project(rows, "kept_keywords", f"{tmp_path}/kept")
    assert {tuple(r) for r in spark.table("kept_keywords").select(*rows.columns).collect()} == {tuple(r) for r in rows.collect()}


def sequential_similarity(a, b, weight=0.3):
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.9
    x, y = set(a.split()), set(b.split())
    groups = [[k, *v] for k, v in L.SYNONYMS.items()]
    bonus = 0.4 * any(any(w in a for w in g) and any(w in b for w in g) for g in groups)
    return min(1.0, 0.7 * len(x & y) / len(x | y) + bonus + weight * difflib.SequenceMatcher(None, a, b).ratio())


def test_support_matrix_equals_loops(spark):
    names = ["chat room", "chat", "message board", "file upload", "upload of files", "steel door", "small red door", "zzz"]
    rows = [("p" + str(i % 3), n, i, f"about {n}", f"http://x/{i}", i / 10) for i, n in enumerate(names)]
    catalogue = spark.createDataFrame(rows, "product string, norm string, ord int, description string, url string, confidence double")
    merged = spark.createDataFrame([(n,) for n in names], "norm string")
    got = {(r.product, r.feature): (r.status, r.description, r.source_url, r.confidence) for r in similarity.support_matrix(catalogue, merged, L.SYNONYMS, written).collect()}
    assert len(got) == 24
    for (product, feature), cell in got.items():
        scored = [(round(sequential_similarity(feature, n), 6), -i, d, u, c) for p, n, i, d, u, c in rows if p == product]
        s, _, d, u, c = max(x for x in scored)
        assert cell == (("O", d, u, c) if s > 0.05 else ("X", "", "", 0.0))


def invented_names(rng, n):
    """Names of one to four words, some of which are common, misspelt, part of others or of a synonym group."""
    words = ["".join(rng.choice("aeioubdfglmnprst") for _ in range(rng.randint(2, 8))) for _ in range(300)] + ["chat", "upload", "message", "file", "a"] * 20
    out = set()
    while len(out) < n:
        name = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.2:
            at = rng.randrange(len(name))
            name = " ".join((name[:at] + rng.choice("aexz") + name[at + 1 :]).split())
        out.add(name)
    return sorted(out)


@pytest.mark.parametrize(("weight", "block"), [(0.3, 1024), (0.3, 17), (0.0, 40)])
def test_best_names_equal_loops(spark, monkeypatch, weight, block):
    rng = random.Random(block)
    monkeypatch.setattr(similarity, "NAMES_A_BLOCK", block)
    monkeypatch.setattr(similarity, "MOST_WITH_TOKEN", 5)
    names = invented_names(rng, 130)
    rows = [(f"p{rng.randint(0, 4)}", n, i) for i, n in enumerate(rng.choices(names, k=170))]
    features = rng.sample(names, 60) + ["zz", "chat a"]
    own = spark.createDataFrame(rows, "product string, norm string, ord long").groupBy("product", "norm").agg(F.min("ord").alias("ord"))
    merged = spark.createDataFrame([(f,) for f in features], "norm string")
    got = similarity.best_by_product(own, merged, L.SYNONYMS, 0.05, weight).collect()
    first = {(r.product, r.feature): max((x.similarity, -x.ord) for x in got if (x.product, x.feature) == (r.product, r.feature)) for r in got if r.product}
    want = {}
    for p in {p for p, _, _ in rows}:
        for f in features:
            scored = []
            for q, n, i in rows:
                if q == p:
                    scored.append((round(sequential_similarity(f, n, weight), 6), -i))
            if max(scored)[0] > 0.05:
                want[p, f] = max(scored)
    assert {k: (round(s, 6), o) for k, (s, o) in first.items()} == {k: (round(s, 6), o) for k, (s, o) in want.items()}
    compared = sum(r.compared for r in got)
    assert compared < 0.6 * len({n for _, n, _ in rows}) * len(features) and (compared > 0) == (weight > 0)


def test_bounds_are_bounds():
    rng = random.Random(7)
    names = invented_names(rng, 120)
    groups = [[i for i, (w, vs) in enumerate(L.SYNONYMS.items()) if any(x in n for x in [w, *vs])] for n in names]
    held = similarity.NameBlock(names, groups)
    for b, g in zip(names, groups, strict=True):
        most, _, decided = held.bounds(b, g, 0.3)
        for i, a in enumerate(names):
            exact = sequential_similarity(b, a)
            assert most[i] >= exact - 1e-12 and (not decided[i] or most[i] == exact)


def test_candidates_lose_no_similar_pair(spark):
    names = ["chat room", "chat", "at", "hat", "message board", "upload", "file upload", "uploads", "zzz", "door z"]
    frame = spark.createDataFrame([(n,) for n in names], "norm string")
    got = {(r.a, r.b) for r in similarity.candidate_pairs(frame, L.SYNONYMS).collect()}
    want = {(a, b) for a in names for b in names if a < b and sequential_similarity(a, b) - 0.3 * difflib.SequenceMatcher(None, a, b).ratio() > 1e-9}
    assert want <= got


def test_titles_match_as_in_loops(spark):
    left = [(i, t) for i, t in enumerate(["red steel door", "red door", "blue window", "red red door", "", "one two three four five"])]
    right = [(10 + i, t) for i, t in enumerate(["red door", "steel door", "door red", "window", "one two three", "x y"])]
    frames = [spark.createDataFrame(x, "id long, title string") for x in (left, right)]
    got = {r.a: (r.b, r.status) for r in similarity.title_matches(*frames, written).collect()}
    tokens = lambda t: {w for w in t.split() if len(w) > 1}
    for i, t in left:
        scored = [(len(tokens(t) & tokens(u)) / len(tokens(t) | tokens(u)), -j) for j, u in right if tokens(t) | tokens(u)]
        s, j = max(scored)
        assert got[i] == ((-j, "O" if s > 0.5 else "△") if s > 0.3 else (None, "X"))


def test_products_are_named_by_place(spark):
    rows = spark.createDataFrame([(i * 7, None if i % 2 else f"n{i}") for i in range(50)], "ord long, product string").repartition(9)
    got = {r.ord: r.product for r in catalog.named_products(rows, written).collect()}
    assert got == {i * 7: f"product{i + 1}" if i % 2 else f"n{i}" for i in range(50)}


def test_texts_are_split_once_for_all_features(spark):
    """Below the join with features texts are split into sentences; above it they aren't."""
    from sitelens.operators import scoring

    texts = spark.createDataFrame([(1, "One. Two chat here.")], "doc_id long, text string")
    asked = scoring.asked_of(texts, spark.createDataFrame([("chat",), ("two",)], "feature string"))
    v = scoring.in_context(F.col("text"), F.col("feature"), sentences=F.col("__sentences"), parts=F.col("__parts"))
    out = asked.select("feature", v["matched"].alias("m"))
    assert {r.feature: r.m for r in out.collect()} == {"chat": "two chat here.", "two": "two chat here."}
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("Join Cross")
    assert "regexp_replace" in plan[1] and "regexp_replace" not in plan[0]
