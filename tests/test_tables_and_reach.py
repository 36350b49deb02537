"""Purges, pages of sorted tables, files, reach and two-product verdicts against loops."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F
from sitelens import lexicons as L
from sitelens.operators import links, reports, scoring
from sitelens.sources import files
from sitelens.sources.materialise import written


def parts_of(folder):
    return {p: sorted(os.path.basename(f) for f in glob.glob(f"{p}/*.parquet")) for p in sorted(glob.glob(f"{folder}/project_id=*"))}


def test_purge_touches_one_project(spark, tmp_path):
    rows = [(i, f"k{i}", "a" if i % 2 else None, i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "keyword_id long, keyword string, category string, project_id long")
    files.save_by_project(df, "purged", f"{tmp_path}/purged")
    before = parts_of(f"{tmp_path}/purged")
    assert files.purge_project(spark, "purged", 1, F.col("keyword_id") > 20) == 5
    after = parts_of(f"{tmp_path}/purged")
    assert {p for p in before if before[p] != after.get(p)} == {f"{tmp_path}/purged/project_id=1"}
    assert {r.keyword_id for r in spark.table("purged").collect()} == {i for i, *_ in rows if not (i % 4 == 1 and i > 20)}
    assert files.purge_project(spark, "purged", 2) == 10 and files.purge_project(spark, "purged", 99) == 0
    assert files.purge_project(spark, "purged", 3, F.col("category") == "b") == 0
    last = parts_of(f"{tmp_path}/purged")
    assert {p for p in after if after[p] != last.get(p)} == {f"{tmp_path}/purged/project_id=2"}
    assert not os.path.exists(f"{tmp_path}/purged/project_id=2") and {r.project_id for r in spark.table("purged").collect()} == {0, 1, 3}


def test_pages_of_a_sorted_table(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 20), f"r{i}") for i in range(137)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, at long, name string").repartition(5)
    order = sorted(rows, key=lambda r: (-r[1], -r[0]))
    boundaries = reports.page_boundaries(df, "at", "id", 10, written)
    assert sorted((r.page, r.at, r.id, r.total) for r in boundaries.collect()) == [(p + 1, order[p * 10][1], order[p * 10][0], 137) for p in range(14)]
    for page in (1, 2, 9, 14, 15):
        got = sorted(reports.page_of(df, "at", "id", boundaries, page, 10).collect(), key=lambda r: r.row_no)
        assert [(r.id, r.at, r.name) for r in got] == order[(page - 1) * 10 : page * 10]
        assert all((r.total, r.n_pages) == (137, 14) for r in got) and [r.row_no for r in got] == list(range((page - 1) * 10 + 1, min(page * 10, 137) + 1))[: len(got)]
    seen, after = [], None
    while batch := reports.next_page(df, "at", "id", after, 25).collect():
        seen += [(r.id, r.at, r.name) for r in batch]
        after = (batch[-1]["at"], batch[-1].id)
    assert seen == order
    assert reports.page_of(df.limit(0), "at", "id", reports.page_boundaries(df.limit(0), "at", "id", 10, written), 1, 10).count() == 0


def test_a_far_page_reaches_the_scan(spark, tmp_path):
    spark.range(2000).selectExpr("id", "id div 3 as at").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    page = reports.page_of(df, "at", "id", reports.page_boundaries(df, "at", "id", 10, written), 150, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "LessThanOrEqual(at" in pushed and "GreaterThanOrEqual(at" in pushed
    assert [r.id for r in page.orderBy(F.desc("id")).collect()] == list(range(2000 - 1490 - 1, 2000 - 1500 - 1, -1))


def plain_reach(edges, seeds, depth, budget=None):
    out, level, source = {}, sorted({u for u, _ in seeds}), {}
    for u, s in seeds:
        source[u] = min(s, source.get(u, s))
    rows = [(u, 0, source[u], None) for u in level]
    for d in range(depth + 1):
        for r in sorted(rows):
            if budget is not None and len(out) >= budget:
                return out
            out[r[0]] = r
        found = {}
        for a, b in edges:
            if a in {r[0] for r in rows} and b not in out:
                found[b] = min(a, found.get(b, a))
        rows = [(b, d + 1, "link", a) for b, a in found.items()]
    return out


@pytest.mark.parametrize("budget", [None, 1, 3, 17, 26, 500])
def test_reach_with_parents_and_budget(spark, budget):
    rng = random.Random(8)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(90)]
    seeds = [(3, "sitemap"), (3, "initial"), (40, "sitemap"), (7, "initial")]
    levels = []

    def keep(df):
        levels.append(df)
        return written(df)

    got = links.reach(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(seeds, "url long, source string"), 4, keep, budget)
    rows = {r.url: (r.url, r.depth, r.source, r.parent) for r in got.collect()}
    assert rows == plain_reach(edges, seeds, 4, budget)
    if budget in (1, 3):
        assert len(levels) == 1  # the seeds meet the budget: no level of links was joined


def test_keyword_files(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in/project_id=1")
    os.makedirs(f"{tmp_path}/in/project_id=2")
    with open(f"{tmp_path}/in/project_id=1/a.csv", "w") as f:
        f.write('keyword,category\n chat ,first\nchat,second\n,blank\n"a, ""b""",\nCHAT,\nold,x\n')
    with open(f"{tmp_path}/in/project_id=2/b.csv", "w") as f:
        f.write("keyword,category\nold,y\n")
    existing = spark.createDataFrame([(1, "old")], "project_id int, keyword string")
    got = {tuple(r) for r in files.import_keywords(spark, f"{tmp_path}/in", existing).collect()}
    assert got == {(1, "chat", "first"), (1, 'a, "b"', None), (1, "CHAT", None), (2, "old", "y")}
    files.write_csv(files.export_keywords(spark.createDataFrame([('x "y", z', None), ("k", "c")], "keyword string, category string")).coalesce(1), f"{tmp_path}/out")
    (name,) = glob.glob(f"{tmp_path}/out/*.csv")
    with open(name) as f:
        assert f.read() == 'keyword,category\n"x ""y"", z",""\nk,c\n'


def test_crawl_files(spark, tmp_path):
    pages = spark.createDataFrame([('A "title", with\nlines', "http://a/", "text", 0, "initial"), ("B", "http://b/", "", 2, "link")], "title string, url string, content string, depth int, source string")
    files.export_crawl(pages, f"{tmp_path}/crawl", {"max_pages": 10})
    results, statistics, csv = files.read_crawl(spark, f"{tmp_path}/crawl")
    assert {(r.title, r.url, r.content, r.depth, r.source) for r in results.collect()} == {tuple(r) for r in pages.collect()}
    assert tuple(statistics.first()) == (2, 1, 4, '{"max_pages":10}')
    assert {tuple(r) for r in csv.collect()} == {('A "title", with\nlines', "http://a/", 0, "initial", 4), ("B", "http://b/", 2, "link", 0)}


COMPETITOR = [("채팅 기능", "실시간 채팅 기능을 제공합니다. 메시지 전송과 수신이 가능합니다."), ("파일 업로드", "파일을 업로드하고 다운로드할 수 있습니다. 문서 첨부 기능을 제공합니다."), ("보안 설정", "사용자 인증과 권한 관리 기능을 제공합니다. 암호화된 보안 시스템입니다.")]
OWN = [("검색 기능", "강력한 검색 기능을 제공합니다. 필터와 쿼리를 사용하여 원하는 정보를 찾을 수 있습니다."), ("분석 리포트", "데이터 분석과 통계 리포트를 생성합니다. 인사이트를 제공합니다.")]


def test_two_products_side_by_side(spark):
    """Verdicts text by text equal those of each product's texts in a row, but that no sentence runs over two texts."""
    texts = [("one", i, f"{t}. {c}") for i, (t, c) in enumerate(COMPETITOR)] + [("two", i, f"{t}. {c}") for i, (t, c) in enumerate(OWN)] + [("one", 9, None), ("three", 0, "채팅")]
    asked = scoring.requested_features(" 채팅, 검색 ,, 파일 업로드, 권한 관리, zebra crossing, 보안 ")
    assert asked == ["채팅", "검색", "파일 업로드", "권한 관리", "zebra crossing", "보안"]
    df = spark.createDataFrame(texts, "product string, ord int, text string").repartition(3)
    got = {r.feature: r for r in scoring.two_product_support(df, spark.createDataFrame([(f,) for f in [*asked, " "]], "feature string"), "one", "two").collect()}
    assert set(got) == set(asked)
    assert [got[f].status_1 for f in ("채팅", "파일 업로드", "권한 관리", "보안")] == ["O"] * 4
    assert (got["채팅"].confidence_1, got["검색"].confidence_2, got["보안"].confidence_1) == (0.95, 0.95, 0.95)
    whole = spark.createDataFrame([(p, " ".join(t for q, _, t in texts if q == p and t)) for p in ("one", "two")], "product string, text string")
    rows = whole.crossJoin(spark.createDataFrame([(f,) for f in asked], "feature string")).select("product", "feature", scoring.feature_support(F.col("text"), F.col("feature")).alias("v")).collect()
    for r in rows:
        side = 1 if r["product"] == "one" else 2
        assert (got[r.feature][f"status_{side}"], got[r.feature][f"confidence_{side}"]) == (r.v.status, r.v.confidence), r


def test_categories_of_two_products(spark):
    """Terms of each category that the two products' pages hold, found by hand in the pages above."""
    pages = [("one", i, f"https://example.com/{i}", f"{t} {c}") for i, (t, c) in enumerate(COMPETITOR)] + [("two", i, f"https://ourproduct.com/{i}", f"{t} {c}") for i, (t, c) in enumerate(OWN)]
    lexicon = {"채팅": ["채팅", "메시지", "chat"], "파일": ["파일", "문서", "업로드"], "보안": ["보안", "암호", "인증"], "검색": ["검색", "필터"], "분석": ["분석", "통계", "리포트"]}
    found = scoring.category_features(spark.createDataFrame(pages, "product string, ord int, url string, content string"), L.as_table(spark, lexicon)).collect()
    assert {(r["product"], r.category): (r.terms, r.sources) for r in found} == {
        ("one", "채팅"): ("메시지, 채팅", "https://example.com/0"),
        ("one", "파일"): ("문서, 업로드, 파일", "https://example.com/1"),
        ("one", "보안"): ("보안, 암호, 인증", "https://example.com/2"),
        ("two", "검색"): ("검색, 필터", "https://ourproduct.com/0"),
        ("two", "분석"): ("리포트, 분석, 통계", "https://ourproduct.com/1"),
    }
