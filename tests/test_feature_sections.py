"""Sentences are scored once, from text that was lower-cased once."""

import re

from pyspark.sql import functions as F
from sitelens.operators import scoring

LEXICON = {"a": ["chat", "File"], "b": ["chat"]}
TEXTS = [
    (1, "We Chat FREELY here. Nothing to see in this one!  Free FILE chat is available?  short. Chat only, not supported at all"),
    (2, None), (3, ""), (None, "Chat and file are free. Chat and file are free."), (4, "ΣΑΣ chat file free. chat İ file free ok"), (4, "again a chat about a file"),
]


def test_best_sentences_are_scored_once(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = scoring.feature_sections(docs, LEXICON, 0.1, 2)
    rows = []
    for doc_id, text in TEXTS:
        for pos, sentence in enumerate(re.split("\x01", re.sub(r"([.!?])\s+", "\\1\x01", text)) if text is not None else []):
            if len(sentence) >= 10:
                rows.append((doc_id, pos, sentence))
    scores = spark.createDataFrame(rows, "doc_id long, pos int, sentence string").withColumn("score", scoring.feature_score(F.col("sentence"), LEXICON)).collect()
    want = []
    for doc_id in {r[0] for r in rows}:
        own = sorted((r for r in scores if r.doc_id == doc_id and r.score > 0.1), key=lambda r: (-r.score, r.pos))[:2]
        want += [(r.doc_id, r.pos, r.sentence, r.score, i + 1) for i, r in enumerate(own)]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select("doc_id", "pos", "sentence", "score", "rank").collect()), key=key) == sorted(want, key=key) and len(want) >= 5
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "Contains(" in line]
    assert "Contains(lower(" not in plan
