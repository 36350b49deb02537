"""Text columns: normalising, cutting, indicator counts.  Java's \\w is ASCII, so words are [\\p{L}\\p{N}_]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def single_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def kept_lines(text: Column, longer_than: int = 0) -> Column:
    """Lines trimmed, white space within collapsed, those of more than so many characters kept."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: F.length(x) > longer_than), "\n")


def cut(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def sentences(text: Column) -> Column:
    """Split after . ! ? and white space."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether the text contains any of a few fixed terms."""
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def count_terms(text: Column, terms: list[str]) -> Column:
    """How many of a few fixed terms the text contains; a sum of generated columns, inside code generation."""
    out = F.lit(0)
    for t in terms:
        out = out + text.contains(t).cast("int")
    return out


def terms_in(text: Column, terms: list[str]) -> Column:
    """The terms that the text contains, ascending."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in terms])))


def without(text: Column, terms: list[str]) -> Column:
    """Blank out fixed terms, longest first."""
    for t in sorted(terms, key=lambda t: (-len(t), t)):
        text = F.replace(text, F.lit(t), F.lit(" "))
    return text


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
