"""Work in parts of bounded size: pieces of long texts, files of the training order."""

import pyarrow as pa
import pytest
from sitelens.llm import bpe, training_order
from sitelens.llm.queries import tokenizer_file


def test_pieces_are_encoded_in_parts():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + n))], names=["piece"]) for a, n in ((0, 300), (300, 0), (300, 5))]
    parts = list(bpe.in_parts(iter(batches)))
    assert max(p.num_rows for p in parts) <= bpe.PIECES and [x for p in parts for x in p.column(0).to_pylist()] == list(range(305))


@pytest.mark.parametrize("rows", [0, 1, 40])
def test_files_of_several_turns_equal_those_of_one(spark, monkeypatch, rows):
    docs = spark.createDataFrame([(i, f"text {i} " * (i + 1)) for i in range(rows)], "doc_id long, text string")
    found = []
    for turns in (1, 2, 5):
        monkeypatch.setattr(training_order, "TURNS", turns)
        index, shards, folder = training_order.write_shards(docs, tokenizer_file(), length=16, per_shard=8)
        read = [r.tolist() for r in training_order.read_records(folder, 0, length=16, per_shard=8)]
        found.append((sorted(map(tuple, index.collect())), sorted(map(tuple, shards.collect())), read))
        assert len(read) == index.count() and len(shards.inputFiles()) >= (min(turns, 2) if rows == 40 else 0)
    assert found[0] == found[1] == found[2]
