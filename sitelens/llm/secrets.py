"""Secret scans with DataFrame functions only: three base patterns, and character Markov models for the rest.

Matches are found by regexp_extract_all, their places from the lengths of the text pieces between them.  What the base
patterns found is masked; every run of key-like characters in the rest is judged by the log-likelihood ratio of two
character bigram models: one of random strings, trained on what the base patterns found, one of ordinary identifiers,
trained on ordinary long words.  Both come from a bounded sample; half of its strings are held out of the models, and
the thresholds, precision and recall are taken from these.  Scanning is a map without a shuffle, in time that grows
with the text and its matches.

Edge cases: null and empty texts have no spans (a null text stays null); spans are code points, end exclusive; without training
strings of both kinds no span is added; texts with very many matches are scanned in full; repeated rows and null ids are
rows like any other; columns of any name stay; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names

#: The base patterns, in order, with what a match must have.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs of 20 and more
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")

#: Runs that the models judge: those with a letter, as others are numbers.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[0-9+/_=-]*+[A-Za-z][A-Za-z0-9+/_=-]*+(?<=[A-Za-z0-9+/_=-]{16})"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Bound on the documents that the models are trained on, and on the strings of a kind.
SAMPLE_DOCS = 20_000
SAMPLE_STRINGS = 20_000
#: Least log-likelihood ratio of a random run, in all and for each transition; held-out strings may raise them.
LEAST_RATIO = 12.0
LEAST_RATE = 0.5
#: Share of held-out ordinary strings that may pass the thresholds.
FALSE_SHARE = 0.0005
#: Spans are put together in chunks of so many.
CHUNK = 64
#: Masked characters become the first of these noncharacters that the text doesn't have.
MASKS = ("\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3")

SPANS = "array<struct<start:int,end:int,kind:string,text:string>>"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _pieces(text: Column, found: Column, pattern: str) -> Column:
    """(m, gap): each match with the text between the match before and it."""
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    return F.zip_with(found, between, lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda t, x: t + x)


def _with_places(out: DataFrame, name: str, text: Column, found: Column, pattern: str, kind: str, keep=None) -> DataFrame:
    """Adds the spans of the matches of a pattern; keep: a test of a match.

    Ends are running sums of lengths, taken within chunks of CHUNK matches and then over the chunks, each a column of its
    own: a lambda that carried all spans so far would copy them at every match.
    """
    rows, steps, sums = fresh_names(out.columns, f"{kind}_rows", f"{kind}_steps", f"{kind}_sums")
    some = F.size(found) > 0
    # a column that is referred to twice is not pulled into the lambda, where it would be made anew for each chunk
    chunk_no = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int"))
    chunked = lambda pieces: F.transform(chunk_no, lambda c: F.slice(pieces, c * CHUNK + 1, CHUNK))
    out = out.withColumn(steps, F.when(some, F.transform(_pieces(text, found, pattern), lambda x: F.struct(x["m"].alias("m"), (F.length(x["gap"]) + F.length(x["m"])).alias("n")))))
    out = out.withColumn(rows, F.when(some, chunked(F.col(steps))))
    out = out.withColumn(sums, F.transform(rows, lambda r: _total(F.transform(r, lambda x: x["n"]))))
    out = out.withColumn(sums, F.transform(sums, lambda _, c: _total(F.slice(sums, 1, c))))

    def spans_of(chunk: Column, before: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            end = before + _total(F.transform(F.slice(chunk, 1, i + 1), lambda y: y["n"]))
            return F.struct(end.alias("end"), x["m"].alias("text"))

        return F.transform(chunk, span)

    spans = F.flatten(F.zip_with(rows, sums, spans_of))
    spans = F.transform(spans, lambda x: F.struct((x["end"] - F.length(x["text"])).alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["text"].alias("text")))
    if keep is not None:
        spans = F.filter(spans, lambda x: keep(x["text"]))
    return out.withColumn(name, F.coalesce(spans, F.array().cast(SPANS))).drop(rows, steps, sums)


def _masked(text: Column, found: Column, pattern: str, mark: Column, keep=None) -> Column:
    """The text with each character of the matches (that are kept) replaced by the mark."""
    hide = lambda m: F.repeat(mark, F.length(m))
    hidden = hide if keep is None else lambda m: F.when(keep(m), hide(m)).otherwise(m)
    tail = F.element_at(F.split(text, pattern, -1), -1)
    parts = F.transform(_pieces(text, found, pattern), lambda x: F.concat(x["gap"], hidden(x["m"])))
    return F.when(F.size(found) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(text)


def _value(match: Column) -> Column:
    """Group 2 of an assignment."""
    return F.regexp_extract(match, ASSIGN, 2)


def _long_enough(match: Column) -> Column:
    return F.length(_value(match)) >= 6


#: Pattern and test of each base kind.
BASE = {"assign": (ASSIGN, _long_enough), "access": (ACCESS, None), "hex": (HEX, None)}


def _log_ratio(ratio: list[float], s: Column) -> Column:
    """Log-likelihood ratio of a string by the two models, summed over its transitions."""
    n = len(ALPHABET)
    table = F.from_json(F.lit("[" + ",".join(f"{v:.4f}" for v in ratio) + "]"), "array<double>")
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.size(codes)), lambda a, b: F.get(table, a * n + b))
    return F.aggregate(pairs, F.lit(0.0), lambda t, v: t + v)


def _is_random(model: dict, s: Column) -> Column:
    return _log_ratio(model["ratio"], s) >= F.greatest(F.lit(model["least_ratio"]), F.lit(model["least_rate"]) * (F.length(s) - 1))


def _labelled_strings(docs: DataFrame, sample_docs: int, sample_strings: int) -> DataFrame:
    """(random, s, held): a bounded sample of strings; every other one, by its hash, is held out.

    The documents are those whose id hash falls in one class of as many as bound them by sample_docs on average.
    Labels are the base patterns': what they find is random, other words of eight and more characters are ordinary.
    """
    n_docs = docs.select("doc_id").count()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = docs.select("doc_id", text.alias("text")).filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(max(1, -(-n_docs // sample_docs)))) == 0)
    found = {kind: _matches(F.col("text"), pattern) for kind, (pattern, _) in BASE.items()}
    secret = F.concat(F.filter(F.transform(found["assign"], _value), lambda v: F.length(v) >= 6), F.transform(found["access"], lambda m: F.substring(m, 5, 1000)), found["hex"])
    ordinary = F.array_distinct(_matches(F.regexp_replace("text", "|".join((ASSIGN, ACCESS, HEX)), " "), r"[A-Za-z0-9_-]{8,}"))
    labelled = lambda strings, kind: F.transform(strings, lambda v: F.struct(F.lit(kind).alias("random"), v.alias("s")))
    strings = sample.select(F.explode(F.concat(labelled(secret, 1), labelled(ordinary, 0))).alias("x")).select("x.*").distinct()
    parts = [strings.filter(F.col("random") == kind).orderBy(F.xxhash64(F.lit(12), "s"), "s").limit(sample_strings) for kind in (1, 0)]
    return parts[0].unionByName(parts[1]).withColumn("held", F.pmod(F.xxhash64(F.lit(13), "s"), F.lit(2)) == 1)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_strings: int = SAMPLE_STRINGS, smoothing: float = 2.0, false_share: float = FALSE_SHARE) -> dict | None:
    """The models and their thresholds; None without strings of both kinds.

    ratio: bigram log-likelihood ratios in the order of ALPHABET x ALPHABET.  least_ratio and least_rate: the least thresholds
    that at most false_share of the held-out ordinary strings of a candidate's length pass, and no less than the constants.
    held_out: numbers of held-out random and ordinary strings of that length, and how many of either pass.
    """
    drawn = _labelled_strings(docs, sample_docs, sample_strings).persist()
    try:
        chars = F.filter(F.split("s", ""), lambda c: c != "")
        pairs = drawn.filter("not held").select("random", F.explode(F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b))).alias("pair"))
        counts = pairs.filter(F.col("pair").isNotNull()).groupBy("random", "pair").agg(F.count("*").alias("n")).collect()  # at most 2 x the square of the alphabet
        ratio = _ratios({(r["random"], r["pair"]): r["n"] for r in counts}, smoothing)
        if ratio is None:
            return None
        long = drawn.filter(F.col("held") & F.col("s").rlike(f"^{CANDIDATE}$")).select("random", "s", _log_ratio(ratio, F.col("s")).alias("llr"), (F.length("s") - 1).alias("steps"))
        passed = F.percentile_approx(F.when(F.col("random") == 0, F.col("llr")), 1 - false_share, 100_000).alias("llr"), F.percentile_approx(F.when(F.col("random") == 0, F.col("llr") / F.col("steps")), 1 - false_share, 100_000).alias("rate")
        limits = long.agg(*passed).first()
        model = {"ratio": ratio, "least_ratio": max(LEAST_RATIO, limits["llr"] or 0.0), "least_rate": max(LEAST_RATE, limits["rate"] or 0.0)}
        hit = (F.col("llr") >= model["least_ratio"]) & (F.col("llr") >= model["least_rate"] * F.col("steps"))
        seen = {r["random"]: (r["n"], r["hit"]) for r in long.groupBy("random").agg(F.count("*").alias("n"), F.count_if(hit).alias("hit")).collect()}
        return model | {"held_out": {"random": seen.get(1, (0, 0)), "ordinary": seen.get(0, (0, 0))}}
    finally:
        drawn.unpersist()


def _ratios(counts: dict[tuple[int, str], int], smoothing: float) -> list[float] | None:
    n, log_p = len(ALPHABET), []
    for kind in (1, 0):
        grid = [[0.0] * n for _ in range(n)]
        for (random, pair), times in counts.items():
            if random == kind and (i := ALPHABET.find(pair[0])) >= 0 and (j := ALPHABET.find(pair[1])) >= 0:
                grid[i][j] += times
        total = sum(map(sum, grid))
        if not total:
            return None
        # an ordinary bigram backs off to its second character's share, a random one to an even share: keys of any alphabet
        single = [1.0 / n if kind else (sum(row[j] for row in grid) + 1.0) / (total + n) for j in range(n)]
        log_p.append([math.log((grid[i][j] + smoothing * n * single[j] / 4) / (sum(grid[i]) + smoothing * n / 4)) for i in range(n) for j in range(n)])
    return [a - b for a, b in zip(*log_p, strict=True)]


def _scanned(docs: DataFrame, model: dict | None, mask: bool) -> tuple[DataFrame, dict[str, str]]:
    """docs with base spans, added spans and, if asked for, the masked text and its mark; and the names of these columns."""
    names = dict(zip(("text", "mark", "rest", "base", "other", "added", "masked", *KINDS), fresh_names(docs.columns, "text", "mark", "rest", "base", "other", "added", "masked", *KINDS), strict=True))
    col = {k: F.col(v) for k, v in names.items()}
    out = docs.withColumn(names["text"], F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumns({names[kind]: _matches(col["text"], pattern) for kind, (pattern, _) in BASE.items()})
    mark = F.coalesce(*[F.when(~F.contains(col["text"], F.lit(m)), F.lit(m)) for m in MASKS[:-1]], F.lit(MASKS[-1]))
    out = out.withColumn(names["mark"], mark)
    parts = dict(zip(KINDS, fresh_names(out.columns, *(f"{kind}_spans" for kind in KINDS)), strict=True))
    for kind, (pattern, keep) in BASE.items():
        out = _with_places(out, parts[kind], col["text"], col[kind], pattern, kind, keep)
    out = out.withColumn(names["base"], F.concat(*parts.values()))
    # a later kind is masked in what is left of the text, where it is found anew if an earlier one was
    for kind, (pattern, keep) in BASE.items():
        now = col["text"] if kind == "assign" else col["rest"]
        out = out.withColumn(names["rest"], _masked(now, col["assign"] if kind == "assign" else _matches(now, pattern), pattern, col["mark"], keep))
    random = (lambda s: F.lit(False)) if model is None else (lambda s: _is_random(model, s))
    out = out.withColumn(names["other"], _matches(col["rest"], CANDIDATE))
    out = _with_places(out, names["added"], col["rest"], col["other"], CANDIDATE, "markov", random)
    if mask:
        out = out.withColumn(names["masked"], _masked(col["rest"], col["other"], CANDIDATE, col["mark"], random))
    return out, names


def _ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    kinds = F.array(*map(F.lit, (*KINDS, "markov")))
    ranked = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))
    return F.transform(F.array_sort(ranked), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))


def scan(docs: DataFrame, model: dict | None, names: tuple[str, str] = ("base_spans", "spans")) -> DataFrame:
    """All columns of docs, then base_spans and spans (or as named): arrays of (start, end, kind, text) by start, then kind as listed.

    spans are the base spans and those the models add (kind 'markov') in the text that no base span covers.
    """
    out, own = _scanned(docs, model, False)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], _ordered(F.col(own["base"])).alias(names[0]), _ordered(F.concat(own["base"], own["added"])).alias(names[1]))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: dict | None, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text, overlapping or touching ones as one, replaced by the mask; n_chars follows the text.

    Of the noncharacters in MASKS a text that has them all loses the runs of the last.
    """
    out, own = _scanned(docs, model, True)
    hit = (F.size(own["base"]) > 0) | (F.size(own["added"]) > 0)
    clean = F.regexp_replace(F.col(own["masked"]), F.concat(F.col(own["mark"]), F.lit("+")), F.lit(mask))
    text = {"text": F.when(hit, clean).otherwise(F.col("text").cast("string"))}
    if "n_chars" in docs.columns:
        text["n_chars"] = F.when(hit, F.length(clean)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(text).select(*[F.col(f"`{c}`") for c in docs.columns])
