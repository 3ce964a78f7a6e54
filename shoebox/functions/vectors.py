"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def comparable(a: Column, dim: int) -> Column:
    """Full length, no null or NaN element, not all zero; never null."""
    return F.coalesce((F.size(a) == dim) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x)) & F.exists(a, lambda x: x != 0), F.lit(False))


def softmax(sims: Column, temperature: float = 20.0) -> Column:
    """Probabilities of an array of similarities."""
    e = F.transform(sims, lambda x: F.exp(x.cast("double") * temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def top_labels(labels: Column, probabilities: Column, k: int = 3, least: float = 0.15) -> Column:
    """array<struct(p, label)> of the k most probable labels above ``least``, best first."""
    rows = F.arrays_zip(probabilities.alias("p"), labels.alias("label"))
    return F.slice(F.reverse(F.array_sort(F.filter(rows, lambda r: r["p"] > least))), 1, k)
