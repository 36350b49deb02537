"""Periodic runs against a loop over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from sitelens.llm import periodic_runs, queries


def brute(words, times=4, least=6):
    """Every maximal stretch of smallest period q, found by trying all periods."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part = words[start : i + q]
            if len(part) >= max(least, times * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, i + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    out = []
    while len(out) < rng.choice([0, 5, 40, 150, 400]):
        if rng.random() < 0.4 or not out:
            out += [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 9))]
        else:
            p = rng.randint(1, min(len(out), rng.choice([3, 20, 40])))
            out += (out[-p:] * rng.randint(1, 6))[: rng.randint(1, 6 * p)]
    return out


@pytest.mark.parametrize("times", [3, 4])
def test_runs_equal_brute_force_however_words_are_appended(times):
    rng = random.Random(times)
    for _ in range(250):
        words = random_words(rng)
        want = brute(words, times)
        assert [tuple(r) for r in periodic_runs.runs_of([[b"%d" % w for w in words]], times)[0].tolist()] == want
        held, i = periodic_runs.Catchers(times), 0
        while i < len(words):
            k = rng.choice([1, 1, 2, 7, 64])
            held.append(np.array(words[i : i + k], dtype=np.int64))
            i += k
            assert [tuple(r) for r in held.runs().tolist()] == brute(words[:i], times)


def test_texts_in_one_row_stay_apart():
    rng = random.Random(5)
    texts = [[b"%d" % w for w in random_words(rng)] for _ in range(120)] + [[], [b"a"] * 9, [b"a"] * 9, []]
    got = periodic_runs.runs_of(texts)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(t) for t in texts]


def test_long_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "APPEND", 1000)
    base = [b"%d" % i for i in range(700)]
    words = base * 6 + [b"x"] * 5000 + [b"a", b"b"] * 40 + [b"a"]
    n = 6 * 700
    want = [(0, n, 700), (n, n + 5000, 1), (n + 5000, n + 5081, 2)]
    assert [tuple(r) for r in periodic_runs.runs_of([words])[0].tolist()] == want


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = [(s, e - s, q) for s, e, q in brute(words)]
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    return (
        doc_id,
        len(runs),
        *best,
        None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_equals_brute_force(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    small = [r for r in rows if len(r["text"] or "") < 12_000]
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r[c] for c in names) for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    assert [got[r["doc_id"]] for r in small] == [expected(r["doc_id"], r["text"]) for r in small]
    assert sum(g[1] > 0 for g in got.values()) > 10


def test_operator_on_edge_rows(docs, empty):
    got = periodic_runs.periodic_runs(docs).collect()
    assert len(got) == docs.count()
    assert {r.n_words for r in got if r.doc_id in (3, 4)} == {0}
    (six,) = [r for r in got if r.doc_id == 6]
    assert [tuple(r) for r in six.runs] == [(5, 3000, 1)] and tuple(six.best) == (5, 3000, 1) and six.collapsed.endswith("<|endoftext|> word")
    assert periodic_runs.periodic_runs(empty).count() == 0
