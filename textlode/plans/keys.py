"""Queries over keys of very uneven size (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.operators.skew import key_profile, rank_within
from textlode.session import table

#: A key with at least this share of the rows counts as large.
LARGE_SHARE = 0.02


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distinct digests and page figures of every file."""
    out = key_profile(table(spark, sf_dir, "atlas_mongo_vector"), "file_id", "digest", "page")
    return out.select(
        "file_id", "n_rows", F.round("share", 9).alias("share"), "n_digests", "n_copies", "top_digest",
        "top_digest_rows", F.col("first_value").alias("first_page"), F.col("last_value").alias("last_page"),
        F.col("median_value").alias("median_page"), F.col("mode_value").alias("mode_page"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that own at least 2 % of the rows with a file."""
    profile = key_profile(table(spark, sf_dir, "atlas_mongo_vector"), "file_id", "digest", "page")
    return profile.where(F.col("share") >= LARGE_SHARE).select("file_id")


def p2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that has a file, with its place among the rows of that file by page and arrival."""
    rows = table(spark, sf_dir, "atlas_mongo_vector").where("file_id IS NOT NULL").select("row_seq", "file_id", "page")
    return rank_within(rows, ["file_id"], ["page", "row_seq"], "position")


QUERIES = {"p2_found": p2_found, "p2_profile": p2_profile, "p2_chunks": p2_chunks}

SQL = {
    "p2_found": """
        SELECT file_id FROM atlas_mongo_vector WHERE file_id IS NOT NULL GROUP BY file_id
        HAVING count(*) >= 0.02 * (SELECT count(*) FROM atlas_mongo_vector WHERE file_id IS NOT NULL)""",
    "p2_profile": """
        WITH r AS (SELECT file_id, nullif(digest, '') AS digest, page FROM atlas_mongo_vector WHERE file_id IS NOT NULL),
        d AS (SELECT file_id, digest, count(*) AS n FROM r WHERE digest IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT file_id, digest, n, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, digest) AS k FROM d),
        q AS (SELECT file_id, page, row_number() OVER (PARTITION BY file_id ORDER BY count(*) DESC, page) AS k
              FROM r WHERE page IS NOT NULL GROUP BY file_id, page)
        SELECT r.file_id, count(*) AS n_rows, round(count(*)::DOUBLE / (SELECT count(*) FROM r), 9) AS share,
               count(DISTINCT r.digest) AS n_digests, count(r.digest) - count(DISTINCT r.digest) AS n_copies,
               any_value(t.digest) AS top_digest, any_value(t.n) AS top_digest_rows,
               min(r.page) AS first_page, max(r.page) AS last_page, quantile_cont(r.page, 0.5) AS median_page,
               any_value(q.page) AS mode_page
        FROM r LEFT JOIN t ON t.file_id = r.file_id AND t.k = 1 LEFT JOIN q ON q.file_id = r.file_id AND q.k = 1
        GROUP BY r.file_id""",
    "p2_chunks": """
        SELECT row_seq, file_id, page,
               row_number() OVER (PARTITION BY file_id ORDER BY page NULLS LAST, row_seq) - 1 AS position
        FROM atlas_mongo_vector WHERE file_id IS NOT NULL""",
}
