"""What an encoder remembers is bounded and small, and doesn't decide results."""

import random

import numpy as np
import pyarrow as pa
import pytest
from sitelens.llm import bpe
from sitelens.llm.queries import tokenizer_file


@pytest.mark.parametrize("memo", [1, 7, 200_000])
@pytest.mark.parametrize("decode", [True, False])
def test_batches_equal_library_whatever_is_remembered(monkeypatch, memo, decode):
    monkeypatch.setattr(bpe, "MEMO", memo)
    monkeypatch.setattr(bpe, "CODED", 5)
    held, rng = bpe.ChunkEncoder(tokenizer_file()), random.Random(7)
    held.decode = decode
    words = ["plain", "plain.", "Plain,", "naïve", "naïve!", "ñandú?", "it's", ",", ".)", "..", "日本語", "日本語.", "é𝒳", "12.5", "a-b", "​", "<|endoftext|>", "x\x1cy", "ÿ:", "ß"]
    for n in (0, 1, 6, 30):
        texts = [None if n == 6 and i == 2 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for i in range(n)]
        ids, decoded = held.encode_texts(pa.array(texts, pa.string()).fill_null(""))
        want = [held.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(i, "<u4").tolist() for i in ids.to_pylist()] == want
        assert decoded.to_pylist() == [held.tokenizer.decode(w, skip_special_tokens=False).encode() if decode else None for w in want]
        assert len(held.known[0]) <= memo * (1 if decode else 2)


def test_remembered_chunks_take_few_bytes():
    held = bpe.ChunkEncoder(tokenizer_file())
    held.encode_texts(pa.array([" ".join(f"word{i}" for i in range(20_000))]))
    assert len(held.known[0]) == 20_000 and not held.memo
    assert sum(x.nbytes for x in held.known) < 100 * 20_000  # some 300 bytes each in a dictionary
