"""Repeated passages of words against a loop over all windows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from sitelens.llm import recompression
from sitelens.llm.textblocks import Words, text_blocks


def brute(rows, window):
    """rows (doc_id, text) to sorted (doc_id, n_words, n_removed, kept)."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    low = {}
    for i, words in split:
        if i is not None:
            for p in range(len(words) - window + 1):
                g = tuple(words[p : p + window])
                low[g] = min(low.get(g, i), i)
    out = []
    for i, words in split:
        gone = set()
        if i is not None:
            for p in range(len(words) - window + 1):
                if low[tuple(words[p : p + window])] < i:
                    gone.update(range(p, p + window))
        out.append((i, len(words), len(gone), " ".join(w.decode() for p, w in enumerate(words) if p not in gone)))
    return sorted(out, key=repr)


def random_rows(rng, n, window):
    shared = [[rng.choice("abcdef") * rng.randint(1, 2) for _ in range(rng.randint(window - 2, 4 * window))] for _ in range(4)] + [["a"] * 60, ["a", "b"] * 30]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice([*shared, [rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randint(1, 30))]])[rng.choice([0, 0, 1, 5]) :]
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n", "\t  "]) for w in words)))
    return rows


@pytest.mark.parametrize(("window", "rounds"), [(13, 3), (5, 2), (2, 1), (20, 4), (13, 0)])
def test_equals_brute_force(spark, window, rounds):
    rng = random.Random(window)
    rows = random_rows(rng, 160, window)
    copy = " ".join(rng.choice("abcdefgh") for _ in range(50))
    rows += [(1000 + i, copy) for i in range(80)]  # a third of all rows is one text
    rows += [(7, rows[8][1]), (7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (None, None), (2000, None), (2001, ""), (-5, rows[20][1]), (2002, "é ü 日本 " * 20), (2003, "x é ü 日本 é ü 日本 é ü 日本 é ü 日本 é ü y")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, h int, spans double").repartition(5)
    got = recompression.remove_repeats(df, window, rounds).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute(rows, window)
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in got)


def test_a_window_has_one_symbol_wherever_it_stands():
    """The symbol of a window depends on its words alone: the same passage in random surroundings."""
    rng = random.Random(4)
    for _ in range(60):
        passage = [rng.choice(["a", "b", "c", "dd", "e"]) for _ in range(13)]
        texts = [" ".join([rng.choice("abcde") for _ in range(rng.randint(0, 9))] + passage + [rng.choice("abcde") for _ in range(rng.randint(0, 9))]) for _ in range(12)]
        ((_, data, offsets),) = text_blocks(pa.array(texts, pa.string()))
        words = Words(data, offsets, lower=False)
        doc, first, last, name = recompression.segments(words, 13, 3)
        seen = set()
        for d, t in enumerate(texts):
            own = t.split()
            places = [p for p in range(len(own) - 12) if own[p : p + 13] == passage]
            for p in places:
                at = int(words.first[d]) + p
                (one,) = np.flatnonzero((doc == d) & (first <= at) & (at <= last))
                seen.add(int(name[one]))
        assert len(seen) == 1


def test_edge_and_empty_tables(docs, empty):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in recompression.remove_repeats(docs).collect()}
    assert (1, 20, 0) in got and (2, 20, 20) in got and (3, 0, 0) in got and (None, 5, 0) in got
    assert recompression.remove_repeats(empty).count() == 0
