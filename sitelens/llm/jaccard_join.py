"""N-gram Jaccard join: exact components of documents whose shingle sets reach a Jaccard threshold.

Documents of equal sets form one class.  A set at the threshold must share a token with its partner among its first
tokens (the prefix) under any global order of tokens; candidates share prefix tokens under three orders, of which the
first is joined and the others are intersected before sets are compared.  All orders put frequent tokens last, by
counts of all documents in buckets of tokens.  A parity sketch of each set (SKETCH_BITS bits, each token flips one) goes
with it: sketches that differ in more bits than the sets may differ in tokens prove a pair to be below the threshold.

Only the connection of classes is asked for, so the classes that share a token are first compared with one of them
(their hub).  A token whose classes are then connected needs no other comparison; in the rest the members outside the
group's largest component meet all members of other components, a bounded number of them in a turn.  No link is lost
and no group is expanded into all its pairs.  Links found in a turn join components, not classes, so later turns
handle few rows.

Edge cases: texts without words have size 0 and no links; a text with fewer than k words is one shingle; null ids
order before all others; repeated rows are members of one class; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, discard, fresh_names, tidy, written
from .textblocks import Words, as_long, mix, secret_key, text_blocks

SHINGLE = 4
#: Link when DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 85, 100
#: Tokens are counted in so many buckets by their hash, which tasks send in blocks.  Those of a bucket whose count is above the
#: middle one by at least so much, and by so many times what chance makes of it, are put last.
BUCKETS, BLOCK = 1 << 21, 1 << 14
LEAST_COUNT, DEVIATIONS = 5, 3
#: About so many members of a group, outside its largest component, meet all others in the first turn: few of them
#: connect most of what is connected.  Each turn takes so many times more, up to the most.
HUBS, MORE_HUBS, MOST_HUBS = 64, 8, 2048
#: Groups of so few members meet without their sketches, which are compared once for each pair instead.
FEW = 16
SKETCH_BITS = 512
#: First tokens of a prefix, among those of more classes, that go with each posting: a pair that has one of them in common is met
#: there, not at later tokens.
HEAD = 6
#: Classes whose sets are wanted are sent to all executors up to so many (40 bytes each); beyond it the texts are shuffled.
MOST_SENT = 1_000_000

_SEEDS = (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F)
_NULL_ID = -(1 << 63)


class Shingling(NamedTuple):
    """Words of a shingle, and the key of the run that words are hashed under."""

    k: int
    key: tuple[int, int]


def shingling(k: int) -> Shingling:
    return Shingling(k, secret_key())


def shingle_sets(column: pa.Array, k: Shingling):
    """(row, ascending distinct shingle hashes) of each text of a batch."""
    for first, data, offsets in text_blocks(column):
        hashes, at = Words(data, offsets, key=k.key).shingles(k.k)
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            yield first + i, np.unique(hashes[a:b])


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(s):
        return 0, 0
    a = mix(s + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    b = mix(s ^ np.uint64(0x6A09E667F3BCC909)).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def parities(s: np.ndarray) -> list[int]:
    """SKETCH_BITS bits, as longs: each token flips one, so two sketches differ in no more bits than the sets in tokens."""
    bits = np.bincount(mix(s ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(SKETCH_BITS), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]


def near_size(numerator: int, denominator: int):
    """Whether sizes n_a and n_b of a pair allow a link."""
    return denominator * F.least("n_a", "n_b") >= numerator * F.greatest("n_a", "n_b")


def may_link(numerator: int, denominator: int):
    """Whether sizes n_a, n_b and sketches of a pair allow a link (sets that link differ in few tokens)."""
    total, differ = F.col("n_a") + F.col("n_b"), sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCH), F.lit(0))
    return near_size(numerator, denominator) & ((denominator + numerator) * differ <= (denominator - numerator) * total)


def prefix_length(n: int, numerator: int, denominator: int) -> int:
    return n - -(-n * numerator // denominator) + 1


def bucket(s: np.ndarray) -> np.ndarray:
    return (mix(s ^ np.uint64(0x452821E638D01377)) % np.uint64(BUCKETS)).astype(np.int64)


def token_counts(docs: DataFrame, k: Shingling) -> np.ndarray:
    """For each bucket in how many documents its tokens are, of all documents; 0 where that is not much more than usual.

    A task sends its counts in blocks, which are added by block; the driver holds a number for each bucket.
    """

    def tokens(batches):
        counts = np.zeros(BUCKETS, dtype="<u4")
        for batch in batches:
            for _, s in shingle_sets(batch.column("text"), k):
                np.add.at(counts, bucket(s), np.uint32(1))
        blocks = counts.reshape(-1, BLOCK)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([blocks[i].tobytes() for i in at], pa.binary())], names=["block", "n"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), strict=True):
                held[block] = held.get(block, 0) + np.frombuffer(n, dtype="<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.minimum(n, (1 << 32) - 1).astype("<u4").tobytes() for n in held.values()], pa.binary())], names=["block", "n"])

    found = docs.select("text").mapInArrow(tidy(tokens), "block long, n binary").repartition("block").mapInArrow(tidy(add), "block long, n binary").collect()
    counts = np.zeros(BUCKETS, dtype=np.uint32)
    for r in found:
        counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["n"], dtype="<u4")
    usual = float(np.median(counts))
    often = counts >= usual + LEAST_COUNT + DEVIATIONS * math.sqrt(usual)
    return np.where(often, np.minimum(counts, (1 << 24) - 1), 0).astype(np.uint32)  # 24 bits of an order's key


def with_digest(docs: DataFrame, k: Shingling, added: tuple[str, str, str] = ("n_shingles", "d1", "d2")) -> DataFrame:
    """docs with n_shingles and the digest (d1, d2) of each shingle set, or as named; other columns stay."""
    names, at = [*docs.columns, *added], docs.columns.index("text")

    def run(batches):
        for batch in batches:
            n, d1, d2 = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for row, s in shingle_sets(batch.column(at), k):
                n[row], (d1[row], d2[row]) = len(s), digest(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(d1), pa.array(d2)], names=names)

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in added)]))


def classes_of(docs: DataFrame, k: Shingling, numerator: int, denominator: int) -> DataFrame:
    """One row for each distinct non-empty set: node, first_id, n, d1, d2, sketch, prefix (in order 1), second, third (orders 2 and 3)."""
    counts = token_counts(docs, k)
    longs = ["id", "n", "d1", "d2", *SKETCH]
    schema = ", ".join(f"{c} long" for c in longs) + ", prefix array<long>, second array<int>, third array<int>"

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column("id").to_pylist()
            for row, s in shingle_sets(batch.column("text"), k):
                if not len(s):
                    continue
                often = counts[bucket(s)].astype(np.uint64)
                p, firsts = prefix_length(len(s), numerator, denominator), []
                for seed in _SEEDS:
                    key = (often << np.uint64(40)) | (mix(s ^ np.uint64(seed)) >> np.uint64(24))
                    first = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
                    firsts.append(s[first[np.argsort(key[first])]])
                short = [as_long(f).astype(np.int32) for f in firsts[1:]]  # the low half is enough to compare
                rows.append((ids[row], len(s), *digest(s), *parities(s), as_long(firsts[0]), *short))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [*[pa.int64()] * len(longs), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[*longs, "prefix", "second", "third"])

    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), "text")
    merged = source.mapInArrow(tidy(run), schema).groupBy("d1", "d2").agg(
        F.min("id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", *SKETCH, "prefix", "second", "third")]
    )
    return written(merged.withColumn("node", F.monotonically_increasing_id()))


def class_sets(docs: DataFrame, wanted: DataFrame, k: Shingling) -> DataFrame:
    """(node, s): the sorted set of each wanted class (first_id, d1, d2, node), from the document that stands for it."""

    def run(batches):
        for batch in batches:
            node, d1, d2 = (batch.column(c).to_numpy() for c in ("node", "d1", "d2"))
            got = [(node[row], s.tobytes()) for row, s in shingle_sets(batch.column("text"), k) if digest(s) == (d1[row], d2[row])]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], names=["node", "s"])

    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("first_id"), "text")
    if wanted.count() <= MOST_SENT:
        wanted = F.broadcast(wanted)
    return source.join(wanted, "first_id").select("node", "d1", "d2", "text").mapInArrow(tidy(run), "node long, s binary")


def sides(table: DataFrame, columns: list[str]) -> list[DataFrame]:
    """Columns of a table of nodes for either side of pairs: node becomes a (or b), others get _a (or _b)."""
    return [table.select(F.col("node").alias(c), *[F.col(v).alias(f"{v}_{c}") for v in columns]) for c in "ab"]


def linked(near: DataFrame, docs: DataFrame, classes: DataFrame, k: Shingling, numerator: int, denominator: int) -> DataFrame:
    """Of candidate pairs (a, b) those that reach the threshold: the other orders' prefixes first, then whole sets."""
    of_a, of_b = sides(classes, ["second", "third"])
    near = near.distinct().join(of_a, "a").join(of_b, "b").filter(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")
    near = written(near, True)
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct().join(classes.select("node", "first_id", "d1", "d2"), "node")
    wanted = written(wanted, True)
    sets = written(class_sets(docs, wanted, k))

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(denominator * both >= numerator * (len(x) + len(y) - both))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(chosen), batch.column("b").filter(chosen)], names=["a", "b"])

    left, right = (sets.select(F.col("node").alias(c), F.col("s").alias(f"s_{c}")) for c in "ab")
    found = written(near.join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b").mapInArrow(tidy(compare), "a long, b long"), True)
    for done in (near, wanted, sets):
        discard(done)
    return found


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) with the components that links (a, b) connect made one; ids without a label get one."""
    ends = [labels.select(F.col("id").alias(c), F.col("component").alias(f"label_{c}")) for c in "ab"]
    edges = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select("a", "b", F.coalesce("label_a", "a").alias("from"), F.coalesce("label_b", "b").alias("to"))
    edges = written(edges, True)
    roots = components(edges.select("from", "to").distinct(), "from", "to").select(F.col("id").alias("component"), F.col("component").alias("root"))
    new = edges.select(F.col("a").alias("id"), F.col("from").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("to").alias("component")))
    known = labels.unionByName(new).distinct()
    return written(known.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component")), True)


def join_classes(docs: DataFrame, k: Shingling, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """(classes, labels): labels (id = node, component = smallest node) of the classes that have a link."""
    classes = classes_of(docs, k, numerator, denominator)
    postings = classes.select("node", "n", F.posexplode("prefix").alias("at", "token"))
    hubs = postings.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub != last").select("token", "hub")
    of_node = postings.join(hubs, "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("at", "token", "hub"))).alias("s"))
    head = F.transform(F.slice("s", 1, HEAD), lambda x: x["token"])
    shared = written(of_node.select("node", "n", head.alias("head"), F.posexplode("s").alias("place", "x")).select("x.token", "node", "n", "x.at", "x.hub", "place", "head"), True)
    of_a, of_b = sides(classes, ["n", *SKETCH])
    possible = may_link(numerator, denominator)
    pairs = shared.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()

    def sketched(pairs: DataFrame) -> DataFrame:
        # the side of fewer rows is read first; the condition is part of the second join
        return pairs.join(of_a, "a").join(of_b, (pairs["b"] == of_b["b"]) & possible).select("a", pairs["b"])

    labels = components(linked(sketched(pairs), docs, classes, k, numerator, denominator))

    # sizes of a linked pair are in the same or the next size class (a little wider than the threshold, for rounding)
    size_class = F.floor(F.log("n") / (math.log(denominator / numerator) * (1 + 1e-6)))
    about = classes.select("node", *SKETCH, size_class.alias("size"))
    own = ["token", "node", "n", "at", "place", "head"]
    rest, before = shared.select(*own), shared
    for turn in itertools.count():
        labelled = rest.join(labels.withColumnRenamed("id", "node"), "node", "left").select(*own, F.coalesce("component", "node").alias("label"))
        by_label = labelled.groupBy("token", "label").agg(F.count("*").alias("m"))
        mixed = by_label.groupBy("token").agg(F.max_by("label", F.struct("m", "label")).alias("major"), (F.sum("m") - F.max("m")).alias("others"), (F.sum("m") <= FEW).alias("few")).filter("others > 0")
        # pairs of different components have at least one member outside the group's largest component: a hub
        is_hub = (F.col("label") != F.col("major")) & (F.pmod(F.xxhash64(F.lit(turn), "label"), F.ceil(F.col("others") / min(HUBS * MORE_HUBS ** min(turn, 9), MOST_HUBS))) == 0)
        marked = written(labelled.join(mixed, "token").select(*own, "label", "few", is_hub.alias("hub")), True)
        discard(before)
        before = marked
        if marked.isEmpty():
            return classes, labels
        # at their first common token too little may be left of either set; other common tokens come later
        left = 1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)
        enough = (denominator + numerator) * left >= numerator * (F.col("n_a") + F.col("n_b"))
        once = ~F.col("hub_b") | (F.col("node_a") < F.col("node_b"))
        first = ~F.arrays_overlap(F.slice("head_a", F.lit(1), F.col("place_a")), F.slice("head_b", F.lit(1), F.col("place_b")))
        meet = (F.col("token_a") == F.col("token")) & (F.col("label_a") != F.col("label_b")) & once & enough & first
        pair, parts = [F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")], ["node", *own[2:], "label", "hub"]
        x, y = (marked.filter("few").select("token", *[F.col(v).alias(f"{v}_{c}") for v in parts]) for c in "ab")
        x = x.filter("hub_a").withColumnRenamed("token", "token_a")
        pairs = sketched(x.join(y, meet & near_size(numerator, denominator)).select(*pair).distinct())
        x, y = (marked.filter("not few").join(about, "node").select("token", "size", *[F.col(v).alias(f"{v}_{c}") for v in (*parts, *SKETCH)]) for c in "ab")
        x = x.filter("hub_a").withColumn("size_a", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).withColumnRenamed("token", "token_a").drop("size")
        pairs = pairs.unionByName(x.join(y, meet & (F.col("size_a") == F.col("size")) & possible).select(*pair))
        new = linked(pairs, docs, classes, k, numerator, denominator)
        if not new.isEmpty():
            labels = joined_labels(labels, new)
        rest = marked.filter(~F.col("hub")).select(*own)


def component_table(docs: DataFrame, k: Shingling, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(d1, d2, component_id, chosen): the smallest id of each class's component; chosen marks the class that has it."""
    classes, labels = join_classes(docs, k, numerator, denominator)
    all_labels = classes.select("node", "d1", "d2", "first_id").join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    all_labels = written(all_labels, True)
    least = all_labels.groupBy("component").agg(F.min(F.struct("first_id", "node")).alias("least"))
    return all_labels.join(least, "component").select("d1", "d2", F.col("least.first_id").alias("component_id"), (F.col("node") == F.col("least.node")).alias("chosen"))


def jaccard_components(docs: DataFrame, k: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """Documents (doc_id, text) to (doc_id, n_shingles, component_id: the smallest doc_id reachable by links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    k = shingling(k)
    found = component_table(docs, k, numerator, denominator).drop("chosen")
    sized = with_digest(docs, k).select("doc_id", "n_shingles", "d1", "d2")
    out = sized.join(found, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("component_id") != _NULL_ID, F.col("component_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """docs with one document of each component (the smallest id), columns as they were; texts without words all stay.

    Of repeated rows of that document one stays, the first by its text.  Texts and other columns are moved once, by a join
    with the ids that stay; only rows of repeated ids are told apart by their digests.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    k = shingling(k)
    known = written(with_digest(plain, k).select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("first"), "n_shingles", "d1", "d2"))
    chosen = written(component_table(plain, k, numerator, denominator).filter("chosen").select(F.col("component_id").alias("first"), "d1", "d2"), True)
    # the digest is part of the key, so that a large group of copies (or of null ids) isn't dealt to one task
    stay = known.filter("n_shingles > 0").join(chosen, ["first", "d1", "d2"], "left_semi").unionByName(known.filter("n_shingles = 0"))
    rows = known.groupBy("first").agg(F.count("*").alias("rows"))
    single = written(stay.join(rows.filter("rows = 1"), "first", "left_semi").select("first"), True)
    again = written(rows.filter("rows > 1").select("first"), True)
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))
    kept = docs.join(single.hint("shuffle_hash"), own == single["first"], "left_semi")
    if again.isEmpty():
        return kept
    n, d1, d2, first, place = fresh_names(docs.columns, "n", "d1", "d2", "first", "place")
    several = with_digest(docs.join(again.hint("shuffle_hash"), own == again["first"], "left_semi"), k, (n, d1, d2)).withColumn(first, own)
    wanted = chosen.select(F.col("first").alias(first), F.col("d1").alias(d1), F.col("d2").alias(d2))
    several = several.filter(F.col(n) == 0).unionByName(
        several.filter(F.col(n) > 0).join(wanted, [first, d1, d2], "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(first, d1, d2).orderBy("text"))).filter(F.col(place) == 1).drop(place)
    )
    return kept.unionByName(several.select(*[F.col(f"`{c}`") for c in docs.columns]))
