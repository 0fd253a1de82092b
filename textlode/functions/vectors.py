"""Distances between a stored vector column and a query vector, as JVM-side expressions in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "inner_product")


def _query(vector: Sequence[float]) -> Column:
    if not len(vector):
        raise ValueError("the query vector is empty")
    return F.array(*[F.lit(float(x)) for x in vector])


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def distance(stored: Column, vector: Sequence[float], metric: str = "cosine") -> Column:
    """Smaller is nearer. Null where ``stored`` is null or has another dimension; NaN for the cosine of a zero vector.

    ``cosine``: 1 - cos, ``l2``: Euclidean, ``inner_product``: the negative inner product.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    query = _query(vector)
    if metric == "inner_product":
        value = -_dot(stored, query)
    elif metric == "l2":
        value = F.sqrt(_sum(F.zip_with(stored, query, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))
    else:
        norms = F.sqrt(_dot(stored, stored)) * F.lit(float(sum(float(x) ** 2 for x in vector) ** 0.5))
        value = F.when(norms == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - _dot(stored, query) / norms)
    return F.when(F.size(stored) == len(vector), value)


def similarity_score(stored: Column, vector: Sequence[float]) -> Column:
    """The score of the deduplicating profile: (1 + cos) / 2, higher is nearer."""
    return F.lit(1.0) - distance(stored, vector, "cosine") / 2


def usable(stored: Column, dims: int) -> Column:
    """True where a vector has ``dims`` finite values that aren't all zero; never null."""
    finite = F.forall(stored, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(stored) == dims) & finite & F.exists(stored, lambda x: x != 0), F.lit(False))
