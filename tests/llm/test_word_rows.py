"""Words are encoded in rows and remembered without marks and case; ids are the library's."""

import random

import numpy as np
import pyarrow as pa
import pytest
from sitelens.llm import bpe
from sitelens.llm.queries import tokenizer_file

WESTERN = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))


def ids_of(held, texts):
    return [np.frombuffer(i, "<u4").tolist() for i in held.encode_texts(pa.array(texts, pa.string()))[0].to_pylist()]


def library(held, texts):
    return [held.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


class Counting:
    """A tokenizer that notes what is encoded by a call or an entry of its own."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.own = tokenizer, self, []

    def encode_batch_fast(self, texts, **options):
        self.own += texts
        return self.tokenizer.encode_batch_fast(texts, **options)

    def tokenize(self, word):
        self.own.append(word)
        return self.tokenizer.model.tokenize(word)


def test_no_word_is_encoded_on_its_own():
    held, rng = bpe.ChunkEncoder(tokenizer_file()), random.Random(3)
    words = ["".join(rng.choice("abcdeinorstéüñÉ") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts = [" ".join(w + rng.choice(["", ",", ".", "!!", "$$$", ".,###"]) for w in words[i : i + 100]) for i in range(0, 3000, 100)]
    want = library(held, texts)
    held.tokenizer, held.decode = Counting(held.tokenizer), False
    assert ids_of(held, texts) == want
    assert set(held.tokenizer.own) <= {"", ",", ".", "!!", "$$$", ".,###"}


def test_marks_and_case_share_what_is_remembered():
    held, texts = bpe.ChunkEncoder(tokenizer_file()), ["Word word, WORD!! word$$$ École école. ÉCOLE", "it's 12, word(x)"]
    assert ids_of(held, texts) == library(held, texts)
    assert sorted(held.known[0].to_pylist()) == ["12,", "it's", "word", "word(x)", "école"]


@pytest.mark.parametrize("row", [1, 5, 1024])
@pytest.mark.parametrize("plain", [True, False])
def test_rows_equal_library(monkeypatch, row, plain):
    monkeypatch.setattr(bpe, "ROW", row)
    monkeypatch.setattr(bpe, "CODED", 50)
    held, rng = bpe.ChunkEncoder(tokenizer_file()), random.Random(row)
    assert held.plain_words
    held.plain_words = plain
    letters = "abcdefghijklmnopqrstuvwxyzEINS" + WESTERN
    odd = ["×", "a÷b", "ªº.", "µ,", "é!", "İ.", "ẞ", "Σας,", "x…,", "5.", "<|endoftext|>", "a<|endoftext|>.", "<|", "a|>", "'s", "we're.", "we're's", "̸", "a≮", "y" * 5000 + "?!", *bpe.MARKS, bpe.MARKS]
    texts = [""]
    for _ in range(60):
        made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) + "".join(rng.choice(bpe.MARKS) for _ in range(rng.randint(0, 3))) for _ in range(20)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(made + rng.sample(odd, 3)))
    ids, decoded = held.encode_texts(pa.array(texts, pa.string()))
    want = library(held, texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids.to_pylist()] == want
    assert decoded.to_pylist() == [held.tokenizer.decode(w, skip_special_tokens=False).encode() for w in want]
    chunks = list(dict.fromkeys(c for t in texts for c in t.encode().split()))
    held.learn(chunks)
    assert [held.memo[c][0] for c in chunks] == [np.asarray(i, "<u4").tobytes() for i in library(held, [c.decode() for c in chunks])]
