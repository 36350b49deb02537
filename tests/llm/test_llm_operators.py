"""The training-data operators against brute force, on hand-made texts and on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from sitelens.llm import bpe, fingerprints, jaccard_join, mixing, nn_descent, quality, queries, secrets, suffix_dedup, toxicity, training_order

FILE = queries.tokenizer_file()


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def table(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def test_bpe_equals_library(docs):
    t = library()
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), np.asarray(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)] += 1
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode_documents(docs, FILE, long_text=500, leaf=64).collect())
    assert got == want


def test_words_that_skip_the_normaliser():
    """Letters of western languages and marks after a word are what the whole tokenizer makes of them."""
    t, held = library(), bpe.encoder(FILE)
    letters = [chr(c) for c in [*range(ord("a"), ord("z") + 1), *range(0xDF, 0x100)]]
    rng = random.Random(3)
    for _ in range(400):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + rng.choice(["", "", *(m.decode() for m in bpe.MARKS), "'", "-", "..", "÷"])
        held.learn([word.encode()])
        assert np.frombuffer(held.memo[word.encode()][0], "<u4").tolist() == t.encode(word, add_special_tokens=False).ids, word


def test_ids_without_decoded_texts(docs):
    """Workers serve tasks with and without decoding in turn; long texts are joined right after short ones."""
    t = library()
    want = Counter((r.doc_id, np.asarray(t.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in docs.collect())
    for _ in range(2):
        got = bpe.encode_documents(docs.repartition(6), FILE, long_text=60, leaf=24, decode=False)
        assert Counter((r.doc_id, bytes(r.ids)) for r in got.collect()) == want


def test_halved_texts_equal_library():
    """Texts cut at any place, also within words, characters of several bytes and special tokens, joined in trees."""
    rng, t, held = random.Random(9), library(), bpe.encoder(FILE)
    parts = ["<|endoftext|>", "<|ENDOFtext|>", "<|endof", "text|>", "Über", "naïve", "it's", "IT'S", "don't", "日本語", "e\u0301", "x" * 30, "12,345.67", "...", "word", "\u00a0", "ﬁ", "😀"]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice(["", "", " ", "\n", "  "]) for _ in range(rng.randint(0, 40)))
        tree, leaf = bpe.TextTree(held), rng.choice([12, 20, 64])
        items, leaves, cuts = [], [], []
        for kind, piece in [*bpe.pieces_of(text.encode(), FILE, leaf), (None, "")]:
            if kind in (bpe.HALF, bpe.HALF_CUT):
                leaves.append(tree.leaf(piece.encode()))
                cuts.append(kind == bpe.HALF_CUT)
                continue
            items += tree.tree(leaves, cuts)
            leaves, cuts = [], []
            if kind is not None:
                break  # a chunk longer than a leaf: joined by tokens, see the next test
        else:
            ids = t.encode(text, add_special_tokens=False).ids
            assert b"".join(i for _, i, _ in items) == np.asarray(ids, "<u4").tobytes()
            assert b" ".join(d for _, i, d in items if i).decode() == t.decode(ids, skip_special_tokens=False)


def test_tree_concatenation_is_exact():
    random.seed(1)
    t, tree = library(), bpe.tree_of(FILE)
    for alphabet in ("ab", "theing", "aaab", "!?.#"):
        word = "".join(random.choice(alphabet) for _ in range(700))
        cuts = [word[i : i + 9] for i in range(0, len(word), 9)]
        leaves = [tree.leaf(c, i == len(cuts) - 1) for i, c in enumerate(cuts)]
        assert tree.tree(leaves) == t.encode(word, add_special_tokens=False).ids


def held_out_accuracy(rows, labels, name):
    known = {r["doc_id"]: r[name] for r in labels}
    pairs = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_toxicity_and_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = table(d, "labels")
    tox = queries.op2_toxicity(spark, d).collect()
    assert len(tox) == len(table(d, "documents")) and all(0 <= r.score <= 1 for r in tox)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in tox)
    assert held_out_accuracy(tox, labels, "toxic") > 0.9
    good = queries.op4_quality_classifier(spark, d).collect()
    assert held_out_accuracy(good, labels, "quality") > 0.9


def test_toxicity_with_names_of_its_own_columns(spark, docs):
    """Documents whose columns are called as features and as what the models add."""
    d = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    clash = given.select("doc_id", "text", *[F.lit(float(i)).alias(c) for i, c in enumerate([*toxicity.FEATURES, "features", "raw", "share", "prediction", "probability", "score"])])
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(clash, labels, F.lit(True))
    got = toxicity.score_toxicity(clash, model)
    assert got.columns == [*[c for c in clash.columns if c not in ("text", "score")], "score"]
    assert {(r.doc_id, r.score) for r in got.collect()} == {(r.doc_id, r.score) for r in toxicity.score_toxicity(given, model).collect()}


def test_classifiers_without_labels_or_texts(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none, F.lit(True))
    assert {round(r["__s"], 6) for r in quality.score_quality(docs, model, "__s").collect()} == {0.5}
    assert quality.score_quality(empty, model, "__s").count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs.select("doc_id", "text"), toxicity.fit(docs, none, F.lit(True))).collect()} == {0.0}


def test_quality_learns_from_whole_texts(spark):
    """Good and bad texts differ only after their first 6,000 characters; every sampled text enters its dictionary."""
    random.seed(4)
    words = {y: ["".join(random.choice("abcdefghij" if y == 1 else "klmnopqrst") for _ in range(7)) for _ in range(40)] for y in (0, 1)}
    same = ["".join(random.choice("uvwxyz") for _ in range(7)) for _ in range(40)]
    made = [(i, " ".join(random.choices(same, k=750) + random.choices(words[i % 2], k=750))) for i in range(80)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    got = quality.score_quality(docs, quality.fit(docs, labels, F.col("doc_id") < 60)).collect()
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_dictionaries_hold_whole_texts(spark):
    """Texts enter a dictionary whole or not at all, as many as it holds."""
    rng = random.Random(8)
    made = [(i, i % 2, "".join(rng.choice("abc ") for _ in range(rng.randint(1, 300)))) for i in range(60)] + [(99, 1, "x" * 900)]
    got = quality.fitting_texts(spark.createDataFrame(made, "doc_id long, y int, text string"), 2000).collect()
    whole = {i: (y, t) for i, y, t in made}
    assert all((r.y, r.text) == whole[r.doc_id] for r in got) and 99 not in {r.doc_id for r in got}
    for y in (0, 1):
        used = sum(len(r.text) + 1 for r in got if r.y == y)
        assert 1600 < used <= 2000


def brute_repeats(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append(bytes(b for b, g in zip(t, gone, strict=False) if not g))
    return out


@pytest.mark.parametrize("small", [2, 16])
def test_suffix_dedup_equals_brute_force(spark, docs, monkeypatch, small):
    random.seed(2)
    monkeypatch.setattr(suffix_dedup.repeated_windows, "__defaults__", (small,))
    part = ["".join(random.choice("abcdefgh ") for _ in range(90)) for _ in range(6)]
    made = [(i, "".join(random.choice(part)[random.randint(0, 30) :] for _ in range(6))) for i in range(40)] + [(99, None), (98, "z" * 300), (97, "")]
    texts = [(t or "").encode() for _, t in made]
    want = {i: k for (i, _), k in zip(made, brute_repeats(texts, 50), strict=True)}
    got = suffix_dedup.remove_repeats(spark.createDataFrame(made, "doc_id long, text string"), 50).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == want
    assert all(r.n_bytes - sum(s.end - s.start for s in r.spans) == len(r.kept) for r in got)


class Weak:
    """A hash of byte ranges with four values."""

    def __init__(self, data):
        self.sum = np.concatenate([[0], np.cumsum(data)])

    def of(self, start, end):
        return ((self.sum[end] - self.sum[start]) % 4).astype(np.uint64)


@pytest.mark.parametrize("weak", [False, True])
def test_suffix_dedup_at_200_bytes_whatever_the_fast_hash(spark, monkeypatch, weak):
    """The fast hash chooses what is compared and decides nothing: with nearly all ranges equal the result is the same."""
    rng = random.Random(12)
    part = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([150, 230, 420]))) for _ in range(7)]
    made = [(i, "".join(rng.choice(part)[rng.choice([0, 0, 1, 30]) :] + rng.choice(["", "-", "+ "]) for _ in range(4))) for i in range(45)]
    if weak:
        monkeypatch.setattr(suffix_dedup, "RangeHash", Weak)
    want = {i: k for (i, _), k in zip(made, brute_repeats([t.encode() for _, t in made], 200), strict=True)}
    docs = spark.createDataFrame(made, "doc_id long, text string")
    segments = suffix_dedup.segment_table(suffix_dedup._keyed(docs), 200, 64)
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs).collect()} == want
    assert segments.count() > 0 and any(len(k) < len(t) for k, (_, t) in zip(want.values(), made, strict=True))


def brute_links(rows, threshold=0.98):
    """Rows (vec_id, vector, label) of usable vectors to {place: (n_links, component_id)}."""
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= threshold) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    root = np.arange(len(x))
    while True:
        least = np.array([min(root[i], root[near[i]].min(initial=root[i])) for i in range(len(x))])
        if (least == root).all():
            break
        root = least
    first = {}
    for r, g in zip(rows, root, strict=True):
        first[g] = min(first.get(g, r[0]), r[0])
    return [(int(n), first[g]) for n, g in zip(near.sum(axis=1), root, strict=True)]


@pytest.mark.parametrize("kind, least_recall", [("float", 0.97), ("double", 0.97), ("float", 1.1)])
def test_nn_descent_equals_brute_force(spark, kind, least_recall, monkeypatch):
    """A recall that can't be met leads to the exact way, here in small blocks."""
    rng = np.random.default_rng(3)
    if least_recall > 1:
        monkeypatch.setattr(nn_descent.compare_blocks, "__defaults__", (32,))
    rows = []
    for i in range(300):
        base = rng.standard_normal(16) if i % 3 == 0 or not rows else np.array(rows[-1][1]) + rng.standard_normal(16) * 0.02
        rows.append((i, [float(np.float32(x) if kind == "float" else x) for x in base], i // 150))
    rows += [(i + 400, rows[i][1], rows[i][2]) for i in range(0, 300, 9)] + [(3, rows[8][1], 0)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (904, rows[0][1], None), (905, [1.0, None] * 8, 1), (906, [], 0), (907, [1.0], 0)]
    frame = spark.createDataFrame([(*r, 1) for r in rows + odd], f"vec_id long, embedding array<{kind}>, label int, n_links int")
    got = nn_descent.near_duplicates(frame, least_recall=least_recall, extra=0).collect()
    want = Counter((r[0], n, c) for r, (n, c) in zip(rows, brute_links(rows), strict=True)) + Counter((r[0], 0, r[0]) for r in odd)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) and r.recall >= 0.97 for r in got)
    none = nn_descent.near_duplicates(frame.limit(0), extra=0)
    assert none.count() == 0


@pytest.mark.parametrize("size, groups", [(20, 2), (40, 5)])
def test_nn_descent_links_groups_larger_than_lists(spark, size, groups):
    """Tight groups, each linked as a whole to the next: lists have room for members of the own group only."""
    rng = np.random.default_rng(11)
    centres = [np.eye(16)[0]]
    for g in range(1, groups):
        centres.append(0.985 * centres[-1] + np.sqrt(1 - 0.985**2) * np.eye(16)[g])
    x = np.concatenate([c + rng.standard_normal((size, 16)) * 0.0008 for c in centres] + [rng.standard_normal((60, 16))])
    x = np.float32(x[rng.permutation(len(x))])
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    root = list(range(len(x)))
    for _ in range(groups + 1):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
    rows = spark.createDataFrame([(i, [float(f) for f in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(rows).collect()}
    assert got == {i: (int(near[i].sum()), root[i], root[i] == i) for i in range(len(x))}
    assert max(n for n, _, _ in got.values()) >= 2 * size - 1


def plain_slot(x, n, key=training_order.KEY):
    """The keyed permutation in whole numbers, one at a time."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    keys = [plain_mix((i * 0x9E3779B97F4A7C15 + key) & M64) for i in range(1, 5)]
    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for k in keys:
            left, right = right, left ^ plain_mix((right + k) & M64) & ((1 << half) - 1)
        x = left << half | right
        if x < n:
            return x


def test_slots_equal_plain_arithmetic():
    for n in (1, 2, 5, 37, 1000):
        assert training_order.feistel(np.arange(n), n).tolist() == [plain_slot(x, n) for x in range(n)]


def test_training_order_is_a_permutation(spark, docs, empty):
    for n in (1, 2, 7, 1000, 4097):
        assert sorted(training_order.feistel(np.arange(n), n).tolist()) == list(range(n))
    made = []
    for parts in (3, 11):  # the order doesn't depend on how rows are dealt
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        made.append(training_order.write_shards(docs.repartition(parts), FILE, length=8, per_shard=16))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    dealt, before = training_order.sequences_of(docs, FILE, 8)
    assert [r.n for r in dealt.groupBy("bucket").agg(F.count("*").alias("n")).orderBy("bucket").collect()] == [n for n in np.diff([*before.tolist()]).tolist() if n]
    (index, shards), (again, _) = [(sorted(map(tuple, i.collect()), key=str), s.orderBy("shard").collect()) for i, s, _ in made]
    assert index == again and sorted(r[3] for r in index) == list(range(len(index)))
    folder = made[0][2]
    records = list(training_order.read_records(folder, 0, 8, 16))
    assert len(records) == len(index) > 40
    # reading resumes in the middle of a file, and at its end
    for slot in (5, 16, 37, len(records) - 1, len(records)):
        rest = list(training_order.read_records(folder, slot, 8, 16))
        assert len(rest) == len(records) - slot and all((x == y).all() for x, y in zip(rest, records[slot:], strict=True))
    path = folder.removeprefix("file://")
    for r in shards:
        data = open(f"{path}/{training_order.shard_name(r.shard)}", "rb").read()
        assert (len(data), hashlib.sha256(data).hexdigest(), r.first_slot) == (r.n_bytes, r.sha256, r.shard * 16)
    got, want, t = Counter(), Counter(), library()
    for doc_id, sequence, n_tokens, slot, shard, offset in index:
        assert (slot // 16, slot % 16 * 16) == (shard, offset)
        assert (records[slot][n_tokens:] == training_order.PAD).all()
        got[doc_id, sequence, tuple(records[slot][:n_tokens].tolist())] += 1
    for d in docs.collect():
        ids = t.encode(d.text or "", add_special_tokens=False).ids
        for i in range(0, len(ids), 8):
            want[d.doc_id, i // 8, tuple(ids[i : i + 8])] += 1
    assert got == want
    assert training_order.write_shards(empty, FILE)[1].count() == 0


def test_training_order_query(spark, sf_dir):
    rows = queries.op6_training_order(spark, sf_dir).collect()
    t, texts = library(), {r["doc_id"]: r["text"] for r in table(sf_dir, "documents")}
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    for r in rows[::7]:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids[r.sequence * training_order.LENGTH :][: training_order.LENGTH]
        record = np.full(training_order.LENGTH, training_order.PAD, "<u2")
        record[: len(ids)] = ids
        assert r.n_tokens == len(ids) and r.record_sha256 == hashlib.sha256(record.tobytes()).hexdigest()


def base_spans(t):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def test_secret_base_spans_equal_regex(spark, sf_dir, docs):
    for rows in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = secrets.scan(rows, secrets.train(rows), names=("__b", "__s")).collect()
        for r in got:
            base = [(s.kind, s.start, s.end) for s in r["__b"]]
            assert base == base_spans(r.text or "")
            assert set(base) <= {(s.kind, s.start, s.end) for s in r["__s"]}


def test_secret_models_and_redaction(spark):
    model = secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = spark.createDataFrame([(1, "key sk-9f8G7h6J5k4L3m2N1b0V and token=abcdef1234 end"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(rows, model).collect()}
    assert got == {1: "key [SECRET] and [SECRET] end", 2: None}


def loop_of_quotients(votes, seats, caps):
    held = [0] * len(votes)
    for _ in range(min(seats, sum(c for v, c in zip(votes, caps, strict=True) if v > 0))):
        best = max((i for i in range(len(votes)) if held[i] < caps[i] and votes[i] > 0), key=lambda i: (Fraction(votes[i]) / (2 * held[i] + 1), -i))
        held[best] += 1
    return held


def test_targets_and_quotas():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75.0, 37.5])
    assert mixing.targets([10, 1000], [5, 2]) == pytest.approx([30, 980])
    rng = random.Random(5)
    cases = [([6, 2, 18, 61.29433763761614, 17, 42.331833763376404, 9, 19], 20, [6, 9, 11, 1, 0, 4, 0, 0])]
    for _ in range(1500):
        n = rng.randint(1, 9)
        cases.append(([rng.choice([rng.randint(0, 20), rng.random() * 70]) for _ in range(n)], rng.randint(0, 40), [rng.randint(0, 12) for _ in range(n)]))
    for votes, seats, caps in cases:
        assert mixing.sainte_lague(votes, seats, caps).tolist() == loop_of_quotients(votes, seats, caps)


def test_blocks_of_a_line():
    rng = random.Random(6)
    for _ in range(300):
        size = np.array([rng.randint(0, 60) for _ in range(rng.randint(1, 30))])
        total, block = int(size.sum()), rng.choice([1, 3, 16, 64])
        quota, cut = rng.randint(0, 3 * total), rng.randint(0, len(size))
        taken = mixing.taken_tokens(0, size, total, quota, block, 7)
        assert taken.sum() == quota and ((taken >= 0) & (taken <= 3 * size)).all()
        parts = [mixing.taken_tokens(0, size[:cut], total, quota, block, 7), mixing.taken_tokens(int(size[:cut].sum()), size[cut:], total, quota, block, 7)]
        assert np.concatenate(parts).tolist() == taken.tolist()


def brute_mix(rows):
    """(doc_id, source, size) to the rows of the mix, by loops over words and blocks in plain lists."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    own = {s: [r for r in rows if r[1] == s] for s in sources}
    size = [sum(r[2] for r in own[s]) for s in sources]
    goal, free, left = {}, set(range(len(sources))), Fraction(sum(size))
    while free:
        weight = {i: (5, 2, 1)[i % 3] for i in free}
        share = {i: left * weight[i] / sum(weight.values()) for i in free}
        over = [i for i in free if share[i] > 3 * size[i]]
        for i in over or free.copy():
            goal[i] = 3 * size[i] if over else share[i]
            left -= goal[i]
            free.discard(i)
    goal = {i: float(g) for i, g in goal.items()}
    return {(d, s, n): (size[i], goal[i]) for i, s in enumerate(sources) for d, _, n in own[s]}


def test_mixing(spark, sf_dir, docs, empty):
    for frame in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = mixing.mix_sources(frame, block_tokens=16).collect()
        sizes = [(d.doc_id, d.source, len((d.text or "").encode().split())) for d in frame.collect()]
        assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter(sizes)
        want = brute_mix(sizes)
        assert all((r.source_size, pytest.approx(r.target)) == (want[r.doc_id, r.source, r.size][0], want[r.doc_id, r.source, r.size][1]) for r in got)
        assert all(0 <= r.taken <= 3 * r.size for r in got)
        for source in {r.source for r in got}:
            part = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in part) - part[0].target) <= 1
        spark.conf.set("spark.sql.shuffle.partitions", 5)
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_sources(frame.repartition(7), block_tokens=16).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert mixing.mix_sources(empty).count() == 0


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    first = {}
    for i, (doc, _) in enumerate(sets):
        first[find(i)] = min(first.get(find(i), doc), doc)
    return {(doc, len(s), first[find(i)]) for i, (doc, s) in enumerate(sets)}


@pytest.mark.parametrize("hubs", [1, 256])
def test_jaccard_components_equal_brute_force(spark, docs, monkeypatch, hubs):
    random.seed(6)
    monkeypatch.setattr(jaccard_join, "HUBS", hubs)
    words = [f"w{i}" for i in range(300)]
    passage = random.choices(words, k=20)
    rows = []
    for i in range(120):
        if i % 3 and rows:
            w = rows[random.randrange(len(rows))][1].split()
            for _ in range(random.randint(0, 2)):
                w[random.randrange(len(w))] = random.choice(words)
        else:
            w = random.choices(words, k=random.randint(3, 60)) + passage * (i % 2)
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, " "), (902, "A b"), (903, "a B")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == brute_components(rows, 4, 85, 100)


def test_keep_one(docs, empty):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "None", "7"])
    assert jaccard_join.keep_one(empty).count() == 0


M64 = (1 << 64) - 1


def plain_mix(h):
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & M64
    return h ^ h >> 31


def plain_sketch(text, k=5):
    """Values of the shingles' hashes on a 32-bit scale below one half, and the least: sets and whole numbers only."""
    values = set()
    for words in shingles(text, k):
        lanes = [0, 0]
        for w in words:
            d = hashlib.blake2b(w, digest_size=16).digest()
            for i, factor in enumerate((0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)):
                lanes[i] = (lanes[i] * factor + int.from_bytes(d[8 * i : 8 * i + 8], "little")) & M64
        values.add(plain_mix((plain_mix((lanes[0] + len(words)) & M64) + lanes[1]) & M64) >> 32)
    return sorted(v for v in values if v < 1 << 31 or v == min(values))


def plain_text(sketch):
    return "2:" + "".join(f"{v:08x}" for v in sketch)


def plain_likeness(a, b):
    x, y = ({v for v in s if v < 1 << 31} for s in (a, b))
    if x and y:
        return len(x & y) / min(len(x), len(y))
    return float(a[:1] == b[:1])


def test_fingerprints_equal_brute_force(spark, sf_dir):
    rows = sorted(table(sf_dir, "documents"), key=lambda r: -r["doc_id"])
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        t, u = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        k = len(t) // 3
        made = t[: len(t) - k] + u[:k]
        g = got[r["doc_id"]]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(made.encode()).hexdigest())
        a, b, c = map(plain_sketch, (t, made, u))
        assert g.fingerprint == plain_text(a) and g.edited_fingerprint == plain_text(b)
        assert g.near_edited == plain_likeness(a, b) and g.near_next == plain_likeness(a, c)


def test_fingerprints_of_edge_cases(docs, empty):
    got = fingerprints.fingerprint_documents(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r, t in ((r, r.fingerprint) for r in got):
        by.setdefault(r.doc_id, set()).add(t)
    assert by[1] == by[2] and by[3] == by[4]
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    given = {r["doc_id"]: r for r in table(sf_dir, "documents")}
    docs, sizes = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    from sitelens.llm.common import written

    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf_dir))
        sizes.append((name, docs.count()))
        if name != "bpe_tokens":
            assert docs.columns == before.columns
        if name == "jaccard_near_duplicates":
            inputs = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in docs.collect()} == {c for _, _, c in brute_components(inputs, 5, 80, 100)}
        if name == "secret_scan":
            assert docs.count() == before.count() and all(not base_spans(r.text) for r in docs.collect())
    assert {r.doc_id for r in docs.collect()} <= set(given) and sizes[-1][1] > 0


def test_words_that_plain_polynomials_confuse(spark):
    """A word of Thue and Morse and its complement have equal polynomials modulo 2**64; as texts they share nothing."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(i, w[:n]) for i, (w, n) in enumerate((w, n) for n in (200, 1024, 2048) for w in (word, word.translate(str.maketrans("ab", "ba"))))]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == brute_components(rows, 4, 85, 100) and len({r.component_id for r in got}) == 6
    a, b = fingerprints.sketches([rows[2][1], rows[3][1]])
    assert fingerprints.likeness(a, b) == 0.0


def test_words_made_to_collide(spark):
    """Two words on which a chain of eight-byte lanes with an invertible step agrees."""
    rows = [(1, "2)[0ztwk!*'!!,(!"), (2, "$nkp21*?,@@\\j@]="), (3, "$nkp21*?,@@\\j@]= 2)[0ztwk!*'!!,(!")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 1, 1), (2, 1, 2), (3, 1, 3)}


def test_suffix_dedup_and_jaccard_on_edge_rows(docs, empty):
    rows = docs.collect()
    want = Counter((r.doc_id, k) for r, k in zip(rows, brute_repeats([(r.text or "").encode() for r in rows], 50), strict=True))
    assert Counter((r.doc_id, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, 50).collect()) == want
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
    first = {1: 1, 2: 1}
    assert got == Counter((r.doc_id, len(shingles(r.text, 4)), first.get(r.doc_id, r.doc_id)) for r in rows)


def test_secret_keys_of_letters_and_long_lists(spark):
    """Planted keys are found, prose is left alone, and very many matches have the places that a regular expression gives."""
    random.seed(8)
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = secrets.train(documents)
    assert model["held_out"]["random"][0] > 0 and model["held_out"]["ordinary"][1] <= 1
    mixed, letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = ["".join(random.choice(a) for _ in range(20)) for a in (mixed, letters) for _ in range(150)]
    rows = spark.createDataFrame([(i, f"the key is {k} here") for i, k in enumerate(keys)], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r["spans"]] for r in secrets.scan(rows, model).collect()}
    assert sum(found[i] == [(11, 31)] for i in found) >= 0.95 * len(keys)
    added = secrets.scan(documents, model).select(F.size("spans") - F.size("base_spans")).collect()
    assert sum(r[0] > 0 for r in added) <= 0.001 * len(added)
    text = " ".join(random.choice(["%032x" % random.getrandbits(128), "token=abcdef12", "é plain", "key: x"]) for _ in range(5000))
    (r,) = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [(s.kind, s.start, s.end) for s in r["base_spans"]] == base_spans(text)
    (r,) = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert not base_spans(r.text) and r.text.count("[SECRET]") == len(base_spans(text))


@pytest.fixture(scope="module")
def edge_dir(spark, docs, tmp_path_factory):
    """Tables with nulls, empties, repeats, clashing columns and no usual row; and the same tables without rows."""
    base = tmp_path_factory.mktemp("edges")
    clash = ["__n", "__text", "__own", "__copies", "first", "d1", "size", "label", "taken", "place", "__first_"]
    rng = random.Random(3)
    long_rows = [(8, " ".join(rng.choice(["alpha", "beta", "gamma", "é"]) for _ in range(40_000)), "en", "c", 0, 1.0, "k"), (9, "".join(rng.choice("abcdef0123") for _ in range(150_000)), "en", "c", 0, 1.0, "k")]
    documents = docs.unionByName(spark.createDataFrame(long_rows, docs.schema)).withColumns({c: F.lit("x") for c in clash})
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 0, 1), (6, 1, 0), (None, 1, 1), (7, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")
    vectors = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (3, None, 1), (4, [], 1), (5, [1.0, 0.0], None)]
    embeddings = spark.createDataFrame([(*v, 7) for v in vectors], "vec_id long, embedding array<float>, label int, n_links int")
    for name, frame in (("documents", documents), ("labels", labels), ("embeddings", embeddings)):
        frame.write.parquet(f"{base}/rows/{name}.parquet")
        frame.limit(0).write.parquet(f"{base}/none/{name}.parquet")
    return base


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES)))
def test_queries_on_edge_and_empty_tables(spark, docs, edge_dir, name):
    got = queries.QUERIES[name](spark, f"{edge_dir}/rows").collect()
    ids = Counter(r[0] for r in got)
    if name == "op5_nn_descent":
        assert ids == Counter([1, 2, 2, None, 3, 4, 5]) and {(r.vec_id, r.n_links, r.component_id) for r in got} == {(1, 2, 1), (2, 2, 1), (None, 0, None), (3, 0, 3), (4, 0, 4), (5, 0, 5)}
    elif name == "op13_sharded_lloyd":
        assert got == []  # no vector has 64 components
    elif name != "op6_training_order":
        assert ids == Counter([*(r.doc_id for r in docs.collect()), 8, 9])
        repeated = [r for r in got if r[0] == 5]
        assert name == "op8_mix_sources" or repeated[0] == repeated[1] or name == "op10_fingerprints"
    if name in ("op2_toxicity", "op4_quality_classifier"):
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.5 if name[2] == "2" else 0.7)) for r in got)
    none = queries.QUERIES[name](spark, f"{edge_dir}/none")
    assert none.collect() == []


def test_pipeline_on_edge_and_empty_tables(spark, edge_dir):
    import corpus_pipeline
    from sitelens.llm.common import written

    documents = spark.read.parquet(f"{edge_dir}/rows/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, documents, f"{edge_dir}/rows"))
        rows = Counter(str(r.doc_id) for r in made.collect())
        if name == "jaccard_near_duplicates":
            assert rows == Counter(["1", "3", "4", "5", "6", "None", "7", "8", "9"])
        elif name in ("secret_scan", "bpe_tokens"):
            assert rows == Counter(str(r.doc_id) for r in documents.collect())
        elif name == "source_mixing":
            assert {"3", "4"} <= set(rows)
        if name != "bpe_tokens":
            assert made.columns == documents.columns and made.schema["first"].dataType.simpleString() == "string"
    assert corpus_pipeline.run(spark, f"{edge_dir}/none").collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf_dir, name):
    from compare import duck_rows, spark_rows

    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(queries.ORACLE_SQL[name], sf_dir)
