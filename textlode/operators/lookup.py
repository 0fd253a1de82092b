"""Listing, fetching and deleting rows by id or by metadata. Deletions return the surviving rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.operators.filters import compile_filter

#: Ids up to this number become literals of the plan, where the scan can prune by them; more are joined.
LITERAL_IDS = 200


class NotFound(LookupError):
    """Ids that were asked for don't exist."""


def ids_frame(spark: SparkSession, ids: Iterable[str] | DataFrame) -> DataFrame:
    """One column ``id`` of distinct non-null ids."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).alias("id")).where("id IS NOT NULL").distinct()
    return spark.createDataFrame([(str(i),) for i in sorted({str(i) for i in ids if i is not None})], "id string")


def list_ids(df: DataFrame, column: str = "custom_id") -> DataFrame:
    """Every non-null id once, whatever its collection."""
    return df.select(F.col(column).alias("id")).where("id IS NOT NULL").distinct()


def with_ids(df: DataFrame, ids: Iterable[str] | DataFrame, column: str = "custom_id") -> DataFrame:
    """The rows of the ids. A short list is pushed down to the scan; a long one, or a table, is joined, and Spark
    broadcasts it only if its size allows."""
    if not isinstance(ids, DataFrame):
        ids = sorted({str(i) for i in ids if i is not None})
        if len(ids) <= LITERAL_IDS:
            return df.where(F.col(column).isin(ids))
    wanted = ids_frame(df.sparkSession, ids)
    return df.join(wanted, df[column] == wanted["id"], "left_semi")


def existing_ids(df: DataFrame, ids: Iterable[str] | DataFrame, column: str = "custom_id", distinct: bool = True) -> DataFrame:
    """Those of the ids that have rows: once, or (as the columnar profile reports them) once a row."""
    found = with_ids(df, ids, column).select(F.col(column).alias("id"))
    return found.distinct() if distinct else found


def missing_ids(df: DataFrame, ids: Iterable[str] | DataFrame, column: str = "custom_id") -> DataFrame:
    """Those of the ids that have no row."""
    wanted = ids_frame(df.sparkSession, ids)
    have = df.select(F.col(column).alias("id")).where("id IS NOT NULL")
    return wanted.join(have, "id", "left_anti")


def fetch_by_ids(df: DataFrame, ids: Iterable[str] | DataFrame, column: str = "custom_id", metadata: str = "cmetadata") -> DataFrame:
    """All rows of the ids, in any collection; missing metadata is an empty object."""
    rows = with_ids(df, ids, column)
    return rows.withColumn(metadata, F.coalesce(metadata, F.lit("{}")))


def require_ids(df: DataFrame, ids: Iterable[str] | DataFrame, column: str = "custom_id") -> None:
    """Raise ``NotFound`` unless every id has a row; names at most 20 of those missing."""
    missing = [r["id"] for r in missing_ids(df, ids, column).orderBy("id").limit(20).collect()]
    if missing:
        raise NotFound(f"no documents for {', '.join(missing)}")


def delete_by_ids(df: DataFrame, ids: Iterable[str] | DataFrame | None, column: str = "custom_id", collection: str | None = None) -> DataFrame:
    """The rows that stay when those of the ids go - of all collections, or of one. None deletes nothing."""
    if ids is None:
        return df
    wanted = ids_frame(df.sparkSession, ids)
    same = df[column] == wanted["id"]
    if collection is not None:
        same = same & (df["collection_id"] == F.lit(collection))
    return df.join(wanted, same, "left_anti")


def delete_by_metadata(df: DataFrame, spec: Mapping[str, object], collection: str, metadata: str = "cmetadata", promoted: Mapping[str, str] | None = None) -> DataFrame:
    """The rows that stay when those of one collection that match every equality of ``spec`` go. A row for which the filter is
    unknown stays."""
    check_metadata_filter(spec)
    return df.where(~matches(spec, collection, metadata, promoted))


def check_metadata_filter(spec: Mapping[str, object]) -> None:
    if not spec:
        raise ValueError("deleting by metadata needs a filter")
    if any(isinstance(v, Mapping) for v in spec.values()):
        raise ValueError("deleting by metadata takes equalities only")


def matches(spec: Mapping[str, object], collection: str, metadata: str = "cmetadata", promoted: Mapping[str, str] | None = None) -> Column:
    """Whether a row is in the collection and fulfils ``spec``; false where that is unknown."""
    return F.coalesce(compile_filter(spec, metadata, promoted) & (F.col("collection_id") == F.lit(collection)), F.lit(False))


def chunk_counts(df: DataFrame, column: str = "custom_id") -> DataFrame:
    """Rows by id."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("n_chunks"))
