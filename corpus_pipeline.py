"""Corpus pipeline: quality, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import bpe, jaccard_join, mixing, quality, secrets
from sitelens.llm.common import fresh_names, table, written
from sitelens.llm.queries import tokenizer_file

#: A document goes when its score is below this.
LEAST_QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the compression classifier, fitted on all labels of the corpus, doesn't reject.

    Null and empty texts score as an average text does; repeated rows are scored alike; null ids have no label and are only
    scored; without labels of both classes every score is 0.5 and all stay; an empty table stays empty; other columns are
    kept, whatever their names.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    (score,) = fresh_names(docs.columns, "score")
    return quality.score_quality(docs, model, score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest id, of each group linked by a five-word Jaccard similarity of 0.8 or more.

    Texts without words (null, empty, blank) all stay; a null id counts as the smallest; of repeated rows of the kept
    document the first by its text stays; an empty table stays empty; other columns are kept, whatever their names.
    """
    return jaccard_join.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret found; all documents stay.

    Null texts stay null; n_chars follows a masked text; repeated rows and null ids are rows like any other; an empty table
    stays empty; other columns are kept, whatever their names.
    """
    return secrets.redact(docs, secrets.train(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources have their target weights.

    The words that the mix takes of a document decide: it is written once for each whole time its size is taken, and once
    more with a chance, by a hash of its id, of the rest's share.  Documents without words stay once; repeated rows of an
    id (null ids too) share what their rows are taken, rounded up; a null source is a source of its own; an empty table
    stays empty; other columns are kept, whatever their names.
    """
    mixed = mixing.mix_sources(docs)
    share = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1.0))
    chance = F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = (F.floor(share) + F.when(chance < share - F.floor(share), 1).otherwise(0)).cast("int")
    own, copies, copy = fresh_names(docs.columns, "own", "copies", "copy")
    counted = mixed.select("doc_id", times.alias("times")).groupBy("doc_id").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    counted = counted.select(F.col("doc_id").alias(own), F.ceil(F.col("times") / F.col("rows")).cast("int").alias(copies))
    joined = docs.join(counted.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(own)))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every text, and what they decode to: a row for each document.

    Null and empty texts have no tokens and decode to an empty text; repeated rows and null ids are rows like any other; an
    empty table gives no rows; columns but doc_id and text are left out.
    """
    return bpe.encode_documents(docs, tokenizer_file())


STAGES = [
    ("quality_classifier", quality_stage),
    ("jaccard_near_duplicates", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("source_mixing", mixing_stage),
    ("bpe_tokens", token_stage),
]

#: No stage but the mix's arithmetic can be written in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
