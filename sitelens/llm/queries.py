"""The registered queries of the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, jaccard_join, lloyd, mixing, nn_descent, periodic_runs, quality, recompression, secrets, suffix_dedup, toxicity, training_order
from .common import fold, table


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, and digests of the ids and of what they decode to.

    Null and empty texts have no tokens and decode to an empty text; repeated rows and null ids are rows like any other; other
    columns are ignored; an empty table gives no rows.
    """
    made = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file())
    return made.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated score of every text by trees over dense rates, learnt from the rows that are not held out.

    Null and empty texts have all-zero rates and are scored like others; repeated rows score alike; a null id counts as the
    empty text in the fold; without labels of both classes every score is 0; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score_toxicity(docs, model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 200-byte strings that also start elsewhere.

    Null, empty and short texts lose nothing; repeated rows lose all; null ids are rows like any other; other columns are
    ignored; an empty table gives no rows.
    """
    made = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_bytes",
        suffix_dedup.removed_bytes(F.col("spans")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated score of every text by its compressed sizes, learnt from the rows that are not held out.

    Null and empty texts score as an average text does; repeated rows score alike; a null id counts as the empty text in the
    fold; without labels of both classes every score is 0.5; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    scored = quality.score_quality(docs, model)
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector.

    Unusable vectors (null, zero, empty, null or non-finite components) and those without a label link with nothing; copies are
    linked; a null vec_id is its own component's null; repeated ids are rows of their own; an empty table gives no rows.
    """
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each sequence: its document, its place in the files written, and the digest of its record read back.

    Null and empty texts have no row; repeated rows and null ids are rows like any other; an empty table gives no rows.
    """
    index, shards, folder = training_order.write_shards(table(spark, sf_dir, "documents"), tokenizer_file())
    if shards.isEmpty():
        return index.withColumn("record_sha256", F.lit(None).cast("string"))
    return index.join(training_order.record_digests(spark, folder), "slot").select(
        "doc_id", "sequence", "n_tokens", "slot", "shard", "byte_offset", "record_sha256"
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts and digest of the base spans, and all spans.

    Null and empty texts have none; repeated rows and null ids are rows like any other; without strings to train on
    only base spans are found; other columns are ignored; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secrets.scan(docs, secrets.train(docs)).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *map(count, secrets.KINDS),
        F.sha2(secrets.listed(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document.

    Null and empty texts have size 0; a null source is a source of its own, the last; repeated rows are documents of their own;
    an empty table gives no rows.
    """
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by its four-word shingles.

    Texts without words link with nothing; a text of fewer words is one shingle; a null id is the smallest of its component,
    which is then null; repeated rows are linked; other columns are ignored; an empty table gives no rows.
    """
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and of its edited text, with their likeness, and that to the next document.

    Null and empty texts have the empty sketch; null ids come last in descending order; repeated rows follow each other; a single
    document follows itself; other columns are ignored; an empty table gives no rows.
    """
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten from a place on repeat a stretch of them; a null id has none."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of every text, some of which repeat a planted stretch, and what is left when runs collapse.

    Null and empty texts have no runs and collapse to an empty text; a null id has nothing planted; repeated rows are rows
    like any other; of runs with equally many periods the first, then the shortest period is the best; very long texts are
    appended in parts; other columns are ignored; an empty table gives no rows.
    """
    made = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), prepare=planted)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return made.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the passages of 13 words and more that a document of a smaller id also has.

    Null, empty and short texts lose nothing; a null id neither loses words nor takes any from others; rows of one id don't
    take from each other; other columns are ignored; an empty table gives no rows.
    """
    made = recompression.remove_repeats(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every usable vector after five rounds of Lloyd's iteration on whole numbers, and its distances.

    Vectors that are null, of another length or hold null or non-finite components have no row; repeated rows and null ids
    are rows like any other; with fewer vectors than centroids there are as many centroids as vectors; other columns are
    ignored; an empty table gives no rows.
    """
    made = lloyd.cluster(table(spark, sf_dir, "embeddings"))
    return made.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip,
        op2_toxicity,
        op3_suffix_dedup,
        op4_quality_classifier,
        op5_nn_descent,
        op6_training_order,
        op7_secret_scan,
        op8_mix_sources,
        op9_jaccard_join,
        op10_fingerprints,
        op11_periodic_runs,
        op12_recompression,
        op13_sharded_lloyd,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REACH = "r AS (SELECT id, id AS reach FROM n UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach)"

#: DuckDB SQL where it can express an operator; the others are tested against brute force in tests/llm.
#: One round of Lloyd's iteration: the centroids after the ones in table c{i}.
LLOYD_ROUND = """a{i} AS (SELECT vec_id, u, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT vec_id, u, k, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d, v FROM e CROSS JOIN c{i}) GROUP BY vec_id, u),
m{i} AS (SELECT k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{i} JOIN e USING (u) CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i),
c{j} AS (SELECT c{i}.k, coalesce(x.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{i} GROUP BY k) x ON x.k = c{i}.k)"""

ORACLE_SQL: dict[str, str] = {
    "op5_nn_descent": f"""WITH RECURSIVE n AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM n WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.label = y.label AND x.id <> y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{REACH}, c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id), k AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a)
SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept, 1.0::DOUBLE AS recall FROM c LEFT JOIN k USING (id)""",
    "op9_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
n AS (SELECT id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS s FROM w),
e AS (SELECT id, len(s) AS n, unnest(s) AS h FROM n),
p AS (SELECT x.id AS a, y.id AS b, any_value(x.n) + any_value(y.n) AS total, count(*) AS k FROM e x JOIN e y ON x.h = y.h AND x.id <> y.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (total - k)),
{REACH}, c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM n JOIN c USING (id)""",
    "op12_recompression": r"""WITH d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT u, doc_id, i, list_slice(ws, i, i + 12) AS g FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE doc_id IS NOT NULL)),
f AS (SELECT g, min(doc_id) AS low FROM x GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT u, unnest(range(i, i + 13)) AS i FROM x JOIN f USING (g) WHERE doc_id > low),
r AS (SELECT u, list(i) AS gone, count(*) AS n FROM c GROUP BY u)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ') ELSE
coalesce((SELECT string_agg(w, ' ' ORDER BY i) FROM (SELECT unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i) WHERE NOT list_contains(gone, i)), '') END) AS kept_sha256 FROM d LEFT JOIN r USING (u)""",
    "op13_sharded_lloyd": f"""WITH e AS (SELECT vec_id, row_number() OVER () AS u, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT k - 1 AS k, c FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) AS k, v AS c FROM e) WHERE k <= 40),
{", ".join(LLOYD_ROUND.format(i=i, j=i + 1) for i in range(6))},
t AS (SELECT k, sum(d)::BIGINT AS cluster_inertia FROM a5 GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a5) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a5 JOIN t USING (k) JOIN c5 USING (k)""",
}
