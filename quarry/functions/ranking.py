"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of BM25 and of reciprocal rank fusion, and the least overlap of a match.
K1, B = 1.5, 0.75
RRF_K = 60
MIN_IOU = 0.05
# End of the fixed values.

#: Sums of doubles depend on their order in the last bits: scores are compared after rounding to so many places.
PLACES = 9


def _sound(value: Column, rule: Column, what: str) -> Column:
    return F.when(rule, value).otherwise(F.raise_error(F.lit(what)).cast("double"))


def idf(n_docs: Column, df: Column) -> Column:
    value = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return _sound(value, (n_docs > 0) & (df > 0) & (df <= n_docs), "idf: document counts out of range")


def checked(k1: float, b: float) -> None:
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must not be negative, b be in 0..1")


def bm25(tf: Column, dl: Column, avgdl: Column, idf_: Column, k1: float = K1, b: float = B) -> Column:
    checked(k1, b)
    value = idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    return _sound(value, (tf > 0) & (dl >= 0) & (avgdl > 0), "bm25: statistics out of range")


def rrf(rank0: Column, k: int = RRF_K) -> Column:
    """Share of a list's item at a rank that counts from 0."""
    return F.lit(1.0) / (F.lit(k) + rank0 + 1)


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Intersection over hull of two spans of one file; 0 where the hull is empty."""
    shared = F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))
    hull = F.greatest(end_a, end_b) - F.least(start_a, start_b)
    return F.when(hull > 0, shared / hull).otherwise(F.lit(0.0))


def normalised(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
