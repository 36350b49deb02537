"""Many terms in many texts: one automaton finds all terms of a lexicon in one pass over each text.

A lexicon of FEW terms compiles to columns instead, which stay in the JVM: for so few the texts' way to Python costs more than a
search for each term.

The lexicon is a dimension: its distinct terms are counted, and up to PART of them make one automaton, which is sent to the
executors once and built once by each Python worker.  A larger lexicon makes several automata, each in a map of its own
behind the last one, so no worker holds more than PART terms; texts are read once all the same, and nothing is shuffled.
Texts and terms are lower-cased by Spark, so both sides agree.  Blank terms match nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.materialise import sized

#: Terms of one automaton, at most about so many; up to FEW, none is built.
PART, FEW = 200_000, 64
HITS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("at", T.LongType())]))

_built: dict[str, object] = {}


def automaton(key: str, terms: list[str]):
    """The automaton of a list of terms; a worker keeps the last one it built."""
    if key not in _built:
        import ahocorasick

        made = ahocorasick.Automaton()
        for term in terms:
            made.add_word(term, term)
        made.make_automaton()
        _built.clear()
        _built[key] = made
    return _built[key]


def first_places(found: Iterator[tuple[int, str]]) -> dict[str, int]:
    """Each term's first place, from 1, of (last place from 0, term) in ascending order of places."""
    out: dict[str, int] = {}
    for end, term in found:
        if term not in out:
            out[term] = end - len(term) + 2
    return out


def _searched(rows: DataFrame, low: str, hits: str, terms: list[str]) -> DataFrame:
    """rows whose array of hits also has those of these terms in column `low`."""
    key = hashlib.md5("\0".join(terms).encode()).hexdigest()
    sent = rows.sparkSession.sparkContext.broadcast(terms)
    names, at, have = rows.columns, rows.columns.index(low), rows.columns.index(hits)
    kind = pa.list_(pa.struct([("term", pa.string()), ("at", pa.int64())]))

    def run(batches):
        for batch in batches:
            search, out = automaton(key, sent.value), []
            for text, before in zip(batch.column(at), batch.column(have).to_pylist(), strict=True):
                text = text.as_py()
                new = first_places(search.iter(text)) if text else {}
                out.append((before or []) + [{"term": t, "at": p} for t, p in new.items()])
            columns = [pa.array(out, kind) if i == have else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, rows.schema)


def _columns(low: Column, terms: list[str], places: bool) -> Column:
    """The hits of a few terms; a term is searched once more for its place, where it was found and if places are asked for."""
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))
    at = (lambda t: F.call_function("locate", t, low).cast("long")) if places else (lambda _: F.lit(None).cast("long"))
    hits = F.transform(found, lambda t: F.struct(t.alias("term"), at(t).alias("at")))
    return F.when(low.isNull(), F.array().cast(HITS)).otherwise(hits)


def with_terms(rows: DataFrame, text: Column, lexicon: DataFrame, name: str = "hits", part: int = PART, few: int = FEW, places: bool = True) -> DataFrame:
    """rows with `name`: an array of (term, at), the lexicon's terms that the lower-cased text contains and their first places, from 1.

    Without a hit, and for a null text, the array is empty.  Without places they may be null.  Cost is linear in the text and in the terms found.
    """
    terms = lexicon.select(F.lower("term").alias("term")).filter(F.trim("term") != "").distinct()
    first, low = [r["term"] for r in terms.limit(few + 1).collect()], f"__low_{name}"
    if 0 < len(first) <= few:
        return rows.withColumn(low, F.lower(text)).withColumn(name, _columns(F.col(low), sorted(first), places)).drop(low)
    n = terms.count() if first else 0
    parts = max(1, -(-n // part))
    rows = rows.withColumns({low: F.lower(text), name: F.array().cast(HITS)})
    for i in range(parts if n else 0):
        own = terms if parts == 1 else terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == i)
        rows = _searched(rows, low, name, sorted(r["term"] for r in own.collect()))
    return rows.drop(low)


def lexicon_hits(rows: DataFrame, text: Column, lexicon: DataFrame, keep: list[str] | None = None, part: int = PART, few: int = FEW) -> DataFrame:
    """A row for each row of `rows` and lexicon row whose term its lower-cased text contains.

    keep: columns of rows that are wanted further on, so that texts stay behind.
    """
    kept = rows.columns if keep is None else keep
    found = with_terms(rows, text, lexicon, "__hits", part, few, False).select(*[F.col(f"`{c}`") for c in kept], F.explode_outer("__hits").alias("__hit"))
    # the outer form, or Spark would search texts once more for a filter on the array's size
    found = found.filter(F.col("__hit").isNotNull()).select(*[F.col(f"`{c}`") for c in kept], F.col("__hit.term").alias("__term"))
    return found.join(sized(lexicon.withColumn("__key", F.lower("term"))), F.col("__term") == F.col("__key")).drop("__term", "__key")
