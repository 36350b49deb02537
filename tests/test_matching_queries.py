"""Section and page matches of the registered queries against loops over the rows they start from."""

import math
import re
from collections import Counter

from sitelens import lexicons as L
from sitelens.operators import pages as P
from sitelens.plans import similarity_plans as Q
from sitelens.sources import tables as S

from tests.test_operators import taken_one_by_one


def vectors(texts, n_grams, stop=(), most=1000, max_df=1.0):
    """TF-IDF unit vectors by their formula: the commonest terms, ties by term."""
    tf = {}
    for i, t in texts.items():
        w = [x for x in re.findall(r"\w{2,}", t.lower()) if x not in stop]
        tf[i] = Counter(" ".join(w[j : j + n]) for n in range(1, n_grams + 1) for j in range(len(w) - n + 1))
    df, total = Counter(w for c in tf.values() for w in c), Counter()
    for c in tf.values():
        total.update(c)
    known = {w for w, _ in sorted(((w, n) for w, n in total.items() if df[w] <= max_df * len(texts)), key=lambda x: (-x[1], x[0]))[:most]}
    out = {}
    for i, c in tf.items():
        raw = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items() if w in known}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out[i] = {w: x / norm for w, x in raw.items()}
    return out


def matches(left, right, least, n):
    edges = []
    for a, x in left.items():
        for b, y in right.items():
            cosine = round(sum(v * y.get(w, 0.0) for w, v in x.items()), 12)
            if cosine > least:
                edges.append((a, b, cosine))
    return sorted(taken_one_by_one(edges), key=lambda e: (-e[2], e[0], e[1]))[:n]


def polarity(text):
    low = text.lower()
    n = sum(t in low for t in L.NEGATIVE)
    for t in sorted(L.NEGATIVE, key=lambda t: (-len(t), t)):
        low = low.replace(t, " ")
    p = sum(t in low for t in L.POSITIVE)
    return "O" if p > n else "X" if n > p else "△"


def cut(text):
    return text[:100] + "..." if len(text) > 100 else text


def test_section_matches_and_their_verdicts(spark, sf_dir):
    sections = {r.id: r.sentence for r in Q.sections(spark, sf_dir).collect()}
    v = vectors(sections, 2, L.STOP_WORDS)
    of = lambda p: {i: x for i, x in v.items() if i.startswith(p + "#")}
    want = matches(of("src1"), of("src2"), 0.3, 20)
    got = Q.sim3(spark, sf_dir).collect()
    assert want and [(r.a, r.b) for r in got] == [(a, b) for a, b, _ in want]
    assert all(abs(r.cosine - c) < 1e-9 for r, (_, _, c) in zip(got, want, strict=True))
    verdicts = {(r.a, r.b): (r.status_1, r.status_2, r.text_1, r.text_2) for r in Q.sim11(spark, sf_dir).collect()}
    assert verdicts == {(a, b): (polarity(sections[a]), polarity(sections[b]), cut(sections[a]), cut(sections[b])) for a, b, _ in want}


def test_page_matches(spark, sf_dir):
    pages = S.pages(spark, sf_dir)
    rows = pages.select("page_id", "product", P.plain_text(pages["html"], ["script", "style"]).alias("content")).collect()
    top = []
    for p in {r["product"] for r in rows}:
        top += sorted((r for r in rows if r["product"] == p), key=lambda r: (-len(r.content), r.page_id))[:50]
    v = vectors({r.page_id: r.content for r in top}, 3, most=2000, max_df=0.95)
    of = lambda p: {r.page_id: v[r.page_id] for r in top if r["product"] == p}
    want = matches(of("com"), of("net"), 0.01, 15)
    text = {r.page_id: r.content[:300] for r in top}
    got = {(r.a, r.b): (r.cosine, r.status_1, r.status_2, r.text_1) for r in Q.sim4(spark, sf_dir).collect()}
    assert set(got) == {(a, b) for a, b, _ in want} and want
    for a, b, c in want:
        cosine, one, other, shown = got[a, b]
        assert abs(cosine - c) < 6e-4 and (one, other, shown) == (polarity(text[a]), polarity(text[b]), cut(text[a]))


def test_replies_of_a_product_are_bounded(spark, tmp_path, monkeypatch):
    """Many small replies of a product, equal ones among them, give the rows that one large reply gives."""
    from sitelens.plans import catalog_plans as plan

    rows = [(i + 1_000 * k, f"name {i % 7}", "type", f"brand {i % 2}", 900.0 + i) for i in range(100) for k in range(3)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    seen, parse = [], plan.X.parse_replies
    monkeypatch.setattr(plan.X, "parse_replies", lambda replies: seen.append(replies.count()) or parse(replies))
    found = []
    for keys in (1_000_000, 10):
        monkeypatch.setattr(plan, "KEYS_A_REPLY", keys)
        found.append(sorted(map(tuple, plan.cat25(spark, str(tmp_path)).collect())))
    assert seen == [2, 60] and found[0] == found[1] == [("brand 0", 150, "name 0", 0.98), ("brand 1", 150, "name 0", 0.99)]
