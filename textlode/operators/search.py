"""Exact vector search over a chunk table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.functions.vectors import distance, similarity_score
from textlode.operators.filters import compile_filter


def top_k(
    df: DataFrame, vector: Sequence[float], k: int = 4, metric: str = "cosine", where: Mapping | Column | None = None, *, vector_column: str = "embedding",
    row_id: str = "uuid", metadata: str = "cmetadata", promoted: Mapping[str, str | tuple[str, str]] | None = None, profile: str = "columnar", collection: str | None = None,
) -> DataFrame:
    """The ``k`` rows nearest to ``vector`` with their ``score``, nearest first, ties to the smaller id.

    ``where`` filters before the search, and ``collection`` keeps it to one collection. In the ``columnar`` profile the score is a distance, in the ``dedup`` profile a similarity from 0 to 1.
    Rows without a vector, or one of another dimension, are no candidates; NaN distances (zero vectors) come last.
    Plans to one scan with a bounded sort in each task; only ``k`` rows a task are exchanged.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    if collection is not None:
        df = df.where(F.col("collection_id") == F.lit(collection))
    if where is not None:
        df = df.where(where if isinstance(where, Column) else compile_filter(where, metadata, promoted))
    v = F.col(vector_column)
    df = df.where(F.size(v) == len(vector))
    if profile == "dedup":
        return df.withColumn("score", similarity_score(v, vector)).orderBy(F.isnan("score"), F.desc("score"), row_id).limit(k)
    return df.withColumn("score", distance(v, vector, metric)).orderBy(F.asc_nulls_last("score"), row_id).limit(k)


def within(hits: DataFrame, threshold: float | None, profile: str = "columnar") -> DataFrame:
    """Hits at a distance of at most ``threshold``; none is set aside without a threshold or in the ``dedup`` profile."""
    return hits if threshold is None or profile == "dedup" else hits.where(F.col("score") <= F.lit(float(threshold)))


def owned(hits: DataFrame, owner: str, principal: str, fallback: str | None = None, row_id: str = "uuid", descending: bool = False) -> DataFrame:
    """All hits if the first one has no ``owner`` or that of the principal (or of ``fallback``), else none.

    The first hit decides for all, so the window holds the hits of one search: at most k rows.
    """
    allowed = [principal] + ([fallback] if fallback is not None else [])
    order = F.desc("score") if descending else F.asc_nulls_last("score")
    first = F.first(F.struct(F.col(owner).alias("o"))).over(Window.orderBy(order, row_id).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = hits.withColumn("_first", first)
    return seen.where(F.col("_first.o").isNull() | F.col("_first.o").isin(allowed)).drop("_first")


def resolve_principal(user: str | None, entity: str | None) -> tuple[str, str | None]:
    """(principal, fallback): whom a search is for, and who is tried if the entity doesn't own the first hit."""
    if user is None:
        return entity or "public", None
    return (entity, user) if entity else (user, None)


def query(
    df: DataFrame, vector: Sequence[float], file_id: str, k: int = 4, user: str | None = None, entity: str | None = None, threshold: float | None = None,
    owner: Column | None = None, **kwargs: object,
) -> DataFrame:
    """Search within one file, then the threshold, then the owner check on the first hit that is left."""
    profile = str(kwargs.get("profile", "columnar"))
    owner = F.get_json_object(str(kwargs.get("metadata", "cmetadata")), "$.user_id") if owner is None else owner
    hits = within(top_k(df, vector, k, where={"file_id": file_id}, **kwargs), threshold, profile).withColumn("_owner", owner)
    principal, fallback = resolve_principal(user, entity)
    return owned(hits, "_owner", principal, fallback, str(kwargs.get("row_id", "uuid")), profile == "dedup").drop("_owner")


def query_multiple(df: DataFrame, vector: Sequence[float], file_ids: Sequence[str], k: int = 4, threshold: float | None = None, **kwargs: object) -> DataFrame:
    """The nearest ``k`` over all the files together; owners are not checked."""
    hits = top_k(df, vector, k, where={"file_id": {"$in": list(file_ids)}}, **kwargs)
    return within(hits, threshold, str(kwargs.get("profile", "columnar")))


def top_k_per_key(df: DataFrame, vector: Sequence[float], key: str, k: int = 4, metric: str = "cosine", vector_column: str = "embedding", row_id: str = "uuid") -> DataFrame:
    """The ``k`` nearest rows of each value of ``key``, with ``score`` and ``rank``; the group limit runs before the shuffle."""
    v = F.col(vector_column)
    scored = df.where(F.size(v) == len(vector)).withColumn("score", distance(v, vector, metric))
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last("score"), row_id)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
