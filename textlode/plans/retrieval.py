"""Queries over the chunk store and its neighbours: search, filters, lookup, deletion, chunking and context."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.functions.text import basename, clean_text, digest, store_id, strip
from textlode.functions.vectors import usable
from textlode.operators import chunking, context, filters, lookup, search
from textlode.plans.ingest import HashingEmbedder, embed
from textlode.sources import formats, store
from textlode.session import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A file that holds a tenth of the chunks.
LARGE_FILE = "7c1f0e52-3b7a-4d6e-9a41-0d2f6b8ce915"
K = 10


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "langchain_pg_embedding")


# ---------------------------------------------------------------- vector search


def _first_vector(df: DataFrame, order: str, dims: int = 64) -> list[float]:
    return list(df.where(usable(F.col("embedding"), dims)).orderBy(order).select("embedding").first()[0])


_QV = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_DISTANCES = {"cosine": "list_cosine_distance", "l2": "list_distance", "inner_product": "list_negative_inner_product"}


def _topk(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings")
        vector = list(rows.where("vec_id = 0").select("embedding").first()[0])
        hits = search.top_k(rows, vector, K, metric, row_id="vec_id")
        return hits.select("vec_id", "label", F.round("score", 6).alias("score"))

    return run


for _metric, _function in _DISTANCES.items():
    QUERIES[f"topk_{_metric}"] = _topk(_metric)
    SQL[f"topk_{_metric}"] = f"""
        SELECT vec_id, label, round({_function}(embedding::DOUBLE[], {_QV}), 6) AS score FROM embeddings
        ORDER BY {_function}(embedding::DOUBLE[], {_QV}), vec_id LIMIT {K}"""


@_query(f"""
    SELECT vec_id, round(1 - list_cosine_distance(embedding::DOUBLE[], {_QV}) / 2, 6) AS score FROM embeddings
    ORDER BY list_cosine_distance(embedding::DOUBLE[], {_QV}), vec_id LIMIT {K}""")
def topk_similarity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    vector = list(rows.where("vec_id = 0").select("embedding").first()[0])
    return search.top_k(rows, vector, K, row_id="vec_id", profile="dedup").select("vec_id", F.round("score", 6).alias("score"))


@_query(f"""
    SELECT label, vec_id, rank, round(d, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rank
        FROM (SELECT label, vec_id, list_cosine_distance(embedding::DOUBLE[], {_QV}) AS d FROM embeddings)) WHERE rank <= 4""")
def topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    vector = list(rows.where("vec_id = 0").select("embedding").first()[0])
    return search.top_k_per_key(rows, vector, "label", row_id="vec_id").select("label", "vec_id", "rank", F.round("score", 6).alias("score"))


_FINE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_CHUNK_HITS = f"""
    WITH u AS (SELECT uuid, custom_id, cmetadata::JSON AS m, embedding::DOUBLE[] AS v FROM langchain_pg_embedding WHERE {_FINE}),
    q AS (SELECT v AS qv FROM u ORDER BY uuid LIMIT 1),
    h AS (SELECT uuid, custom_id, m, list_cosine_distance(v, qv) AS d FROM u, q)"""


def _usable_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    rows = _chunks(spark, sf_dir)
    return rows.where(usable(F.col("embedding"), 64)), _first_vector(rows, "uuid")


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("uuid", "custom_id", F.round("score", 6).alias("score"))


@_query(f"{_CHUNK_HITS} SELECT uuid, custom_id, round(d, 6) AS score FROM h WHERE m->>'$.user_id' = 'public' ORDER BY d, uuid LIMIT {K}")
def search_where_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vector = _usable_chunks(spark, sf_dir)
    return _hits(search.top_k(rows, vector, K, where={"user_id": "public"}))


@_query(f"""{_CHUNK_HITS} SELECT uuid, custom_id, round(d, 6) AS score FROM h
    WHERE uuid IN (SELECT uuid FROM langchain_pg_embedding WHERE collection_id IN (SELECT uuid FROM langchain_pg_collection WHERE name = 'testcollection')) ORDER BY d, uuid LIMIT {K}""")
def search_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search within one collection."""
    rows, vector = _usable_chunks(spark, sf_dir)
    named = table(spark, sf_dir, "langchain_pg_collection").where("name = 'testcollection'").first()
    return _hits(search.top_k(rows, vector, K, collection=named["uuid"] if named else ""))


@_query(f"{_CHUNK_HITS} SELECT uuid, custom_id, round(d, 6) AS score FROM h WHERE m->>'$.page' IN ('0', '1', '2') ORDER BY d, uuid LIMIT {K}")
def search_where_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vector = _usable_chunks(spark, sf_dir)
    return _hits(search.top_k(rows, vector, K, where={"page": {"$in": [0, 1, 2]}}))


@_query(f"{_CHUNK_HITS} SELECT * FROM (SELECT uuid, custom_id, round(d, 6) AS score FROM h ORDER BY d, uuid LIMIT 50) WHERE score <= 0.1")
def search_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vector = _usable_chunks(spark, sf_dir)
    return _hits(search.within(search.top_k(rows, vector, 50), 0.1000005))


def _single(user: str, entity: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, vector = _usable_chunks(spark, sf_dir)
        return _hits(search.query(rows, vector, LARGE_FILE, K, user, entity))

    return run


def _single_sql(allowed: str) -> str:
    return f"""{_CHUNK_HITS}, t AS (SELECT *, m->>'$.user_id' AS owner FROM h WHERE m->>'$.file_id' = '{LARGE_FILE}' ORDER BY d, uuid LIMIT {K})
        SELECT uuid, custom_id, round(d, 6) AS score FROM t
        WHERE (SELECT owner IS NULL OR owner IN ({allowed}) FROM t ORDER BY d, uuid LIMIT 1)"""


_OWNER = f"(SELECT m->>'$.user_id' FROM h WHERE m->>'$.file_id' = '{LARGE_FILE}' ORDER BY d, uuid LIMIT 1)"


@_query(_single_sql(_OWNER))
def search_file_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search by whoever owns the nearest chunk."""
    rows, vector = _usable_chunks(spark, sf_dir)
    nearest = search.top_k(rows, vector, 1, where={"file_id": LARGE_FILE}).select(F.get_json_object("cmetadata", "$.user_id")).first()
    return _hits(search.query(rows, vector, LARGE_FILE, K, nearest[0] if nearest and nearest[0] else "nobody"))


QUERIES |= {"search_file_stranger": _single("stranger"), "search_file_public": _single("public"), "search_file_entity": _single("public", "agent")}
SQL |= {
    "search_file_stranger": _single_sql("'stranger'"),
    "search_file_public": _single_sql("'public'"),
    "search_file_entity": _single_sql("'agent', 'public'"),
}


@_query(f"""{_CHUNK_HITS} SELECT uuid, custom_id, round(d, 6) AS score FROM h
    WHERE m->>'$.file_id' IN (SELECT file_id FROM store_document WHERE file_content_type = 'text/csv') ORDER BY d, uuid LIMIT {K}""")
def search_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over the files of a table of ids: joined, not listed."""
    rows, vector = _usable_chunks(spark, sf_dir)
    rows = rows.withColumn("_file", F.get_json_object("cmetadata", "$.file_id"))
    wanted = table(spark, sf_dir, "store_document").where("file_content_type = 'text/csv'").select("file_id")
    return _hits(search.top_k(lookup.with_ids(rows, wanted, "_file"), vector, K))


@_query(f"{_CHUNK_HITS} SELECT uuid, custom_id, round(d, 6) AS score FROM h WHERE m->>'$.file_id' IN ('{LARGE_FILE}', '0', '1') ORDER BY d, uuid LIMIT {K}")
def search_several_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vector = _usable_chunks(spark, sf_dir)
    return _hits(search.query_multiple(rows, vector, [LARGE_FILE, "0", "1"], K))


# ---------------------------------------------------------------- metadata filters

_PAGE = "json_type(m, '$.page') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND (m->>'$.page')::DOUBLE"
_INDEX_TEXT = "json_type(m, '$._rag_chunk_index') = 'VARCHAR' AND m->>'$._rag_chunk_index'"
FILTERS: dict[str, tuple[dict, str]] = {
    "meta_eq": ({"user_id": "public"}, "m->>'$.user_id' = 'public'"),
    "meta_eq_number": ({"page": 3}, "m->>'$.page' = '3'"),
    "meta_ne": ({"user_id": {"$ne": "public"}}, "m->>'$.user_id' <> 'public'"),
    "meta_in": ({"page": {"$in": [1, 2, 5]}}, "m->>'$.page' IN ('1', '2', '5')"),
    "meta_nin": ({"page": {"$nin": [1, 2, 5]}}, "m->>'$.page' NOT IN ('1', '2', '5')"),
    "meta_gt": ({"page": {"$gt": 10}}, f"{_PAGE} > 10"),
    "meta_gte": ({"page": {"$gte": 10}}, f"{_PAGE} >= 10"),
    "meta_lt": ({"page": {"$lt": 4}}, f"{_PAGE} < 4"),
    "meta_lte": ({"page": {"$lte": 4}}, f"{_PAGE} <= 4"),
    "meta_between": ({"page": {"$between": [3, 7]}}, f"{_PAGE} BETWEEN 3 AND 7"),
    "meta_gt_text": ({"_rag_chunk_index": {"$gte": "1"}}, f"{_INDEX_TEXT} >= '1'"),
    "meta_like": ({"source": {"$like": "/uploads/public/%.pdf"}}, "m->>'$.source' LIKE '/uploads/public/%.pdf'"),
    "meta_ilike": ({"source": {"$ilike": "%REPORT_%"}}, "m->>'$.source' ILIKE '%REPORT_%'"),
    "meta_and_or": (
        {"$or": [{"$and": [{"user_id": "public"}, {"page": {"$lt": 3}}]}, {"file_id": LARGE_FILE}]},
        f"coalesce(m->>'$.user_id' = 'public' AND {_PAGE} < 3, false) OR m->>'$.file_id' = '{LARGE_FILE}'",
    ),
    "meta_several": ({"user_id": "public", "page": {"$gte": 1}}, f"m->>'$.user_id' = 'public' AND {_PAGE} >= 1"),
}


def _filtered(spec: dict) -> Query:
    return lambda spark, sf_dir: _chunks(spark, sf_dir).where(filters.compile_filter(spec)).select("uuid")


for _name, (_spec, _sql) in FILTERS.items():
    QUERIES[_name] = _filtered(_spec)
    SQL[_name] = f"SELECT uuid FROM (SELECT uuid, cmetadata::JSON AS m FROM langchain_pg_embedding) WHERE {_sql}"


@_query(f"SELECT row_seq FROM atlas_mongo_vector WHERE file_id = '{LARGE_FILE}'")
def meta_eq_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality on a key that has a column: pushed down to the scan."""
    rows = table(spark, sf_dir, "atlas_mongo_vector")
    return rows.where(filters.compile_filter({"file_id": LARGE_FILE}, "metadata", {"file_id": "file_id"})).select("row_seq")


# ---------------------------------------------------------------- lookup and deletion

_CSV = "SELECT file_id FROM store_document WHERE file_content_type = 'text/csv'"


def _csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "store_document").where("file_content_type = 'text/csv'").select("file_id")


@_query("SELECT DISTINCT custom_id AS id FROM langchain_pg_embedding WHERE custom_id IS NOT NULL")
def list_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.list_ids(_chunks(spark, sf_dir))


@_query(f"SELECT DISTINCT custom_id AS id FROM langchain_pg_embedding WHERE custom_id IN ({_CSV})")
def existing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.existing_ids(_chunks(spark, sf_dir), _csv_files(spark, sf_dir))


@_query(f"SELECT custom_id AS id FROM langchain_pg_embedding WHERE custom_id IN ({_CSV})")
def existing_ids_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.existing_ids(_chunks(spark, sf_dir), _csv_files(spark, sf_dir), distinct=False)


@_query("SELECT DISTINCT file_id AS id FROM store_document s WHERE file_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM langchain_pg_embedding e WHERE e.custom_id = s.file_id)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.missing_ids(_chunks(spark, sf_dir), table(spark, sf_dir, "store_document").select("file_id"))


@_query(f"SELECT uuid, custom_id, document, coalesce(cmetadata, '{{}}') AS cmetadata FROM langchain_pg_embedding WHERE custom_id IN ({_CSV})")
def fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.fetch_by_ids(_chunks(spark, sf_dir), _csv_files(spark, sf_dir)).select("uuid", "custom_id", "document", "cmetadata")


@_query(f"SELECT uuid, custom_id, document FROM langchain_pg_embedding WHERE custom_id = '{LARGE_FILE}'")
def fetch_by_custom_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.fetch_by_ids(_chunks(spark, sf_dir), [LARGE_FILE]).select("uuid", "custom_id", "document")


@_query(f"SELECT uuid FROM langchain_pg_embedding WHERE custom_id IS NULL OR custom_id NOT IN ({_CSV} AND file_id IS NOT NULL)")
def delete_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.delete_by_ids(_chunks(spark, sf_dir), _csv_files(spark, sf_dir)).select("uuid")


_ARCHIVE = "(SELECT uuid FROM langchain_pg_collection WHERE name = 'testcollection')"


@_query(f"""SELECT uuid FROM langchain_pg_embedding WHERE NOT coalesce(cmetadata::JSON->>'$.user_id' = 'public' AND collection_id = {_ARCHIVE}, false)""")
def delete_by_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "langchain_pg_collection").where("name = 'testcollection'").first()
    rows = _chunks(spark, sf_dir)
    return lookup.delete_by_metadata(rows, {"user_id": "public"}, named["uuid"] if named else "").select("uuid")


@_query(f"SELECT uuid FROM langchain_pg_embedding WHERE NOT coalesce(custom_id = '{LARGE_FILE}' AND collection_id = {_ARCHIVE}, false)")
def delete_by_ids_in_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "langchain_pg_collection").where("name = 'testcollection'").first()
    return lookup.delete_by_ids(_chunks(spark, sf_dir), [LARGE_FILE], collection=named["uuid"] if named else "").select("uuid")


@_query("SELECT custom_id AS id, count(*) AS n_chunks FROM langchain_pg_embedding WHERE custom_id IS NOT NULL GROUP BY custom_id")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.chunk_counts(_chunks(spark, sf_dir))


# ---------------------------------------------------------------- scalar functions and storage

_STRIP = r"'^[\s\x{85}\p{Z}\x0B\x1C-\x1F]+|[\s\x{85}\p{Z}\x0B\x1C-\x1F]+$', '', 'g'"


@_query("SELECT uuid, md5(replace(document, chr(0), '')) AS digest, length(document) AS n FROM langchain_pg_embedding")
def clean_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("uuid", digest(clean_text(F.col("document"))).alias("digest"), F.length("document").alias("n"))


@_query("SELECT row_seq, file_id || '_' || coalesce(nullif(digest, ''), md5(text)) AS store_id, list_last(string_split(source, '/')) AS name FROM atlas_mongo_vector")
def store_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "atlas_mongo_vector")
    return rows.select("row_seq", store_id(F.col("file_id"), F.col("digest"), F.col("text")).alias("store_id"), basename(F.col("source")).alias("name"))


@_query("""
    SELECT row_seq, store_id FROM (SELECT row_seq, store_id, row_number() OVER (PARTITION BY store_id ORDER BY row_seq DESC) AS k FROM atlas_mongo_vector)
    WHERE k = 1 OR store_id IS NULL""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after every row was stored under its id."""
    rows = table(spark, sf_dir, "atlas_mongo_vector").select("row_seq", "store_id")
    return store.latest_by_store_id(rows)


@_query(f"SELECT uuid FROM langchain_pg_embedding WHERE custom_id IS DISTINCT FROM '{LARGE_FILE}' AND NOT coalesce(cmetadata::JSON->>'$.user_id' = 'public' AND collection_id = {_ARCHIVE}, false)")
def store_after_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chunk store holds after all chunks were stored, a file was deleted, and then chunks by metadata."""
    kept = store.ChunkStore(spark, f"{shared_dir(spark)}/store-{uuid4().hex}", buckets=8)
    rows = _chunks(spark, sf_dir).select("uuid", F.col("custom_id").alias("file_id"), "collection_id", "cmetadata")
    kept.append(rows)
    kept.delete_by_ids([LARGE_FILE])
    named = table(spark, sf_dir, "langchain_pg_collection").where("name = 'testcollection'").first()
    kept.delete_by_metadata({"user_id": "public"}, named["uuid"] if named else "")
    return kept.read().select("uuid")


@_query(f"SELECT uuid, document FROM langchain_pg_embedding WHERE custom_id = '{LARGE_FILE}'")
def store_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's chunks from a store: one bucket is read."""
    kept = store.ChunkStore(spark, f"{shared_dir(spark)}/store-{uuid4().hex}", buckets=8)
    kept.append(_chunks(spark, sf_dir).select("uuid", F.col("custom_id").alias("file_id"), "document"))
    return kept.of_files([LARGE_FILE]).select("uuid", "document")


# ---------------------------------------------------------------- requests

_RULES = " ".join(
    f"WHEN ext IN ({', '.join(map(repr, e))})" + (f" OR {'(' if n == 'markdown' else ''}mime IN ({', '.join(map(repr, t))})" if t else "")
    + (f" AND ext NOT IN {formats.BINARY_EXTENSIONS})" if n == "markdown" else "") + f" THEN '{n}'"
    for n, e, t in formats.RULES
)


@_query(f"""
    SELECT loader, count(*) AS n FROM (
        SELECT CASE {_RULES} WHEN ext IN ({', '.join(map(repr, formats.SOURCE_EXTENSIONS))}) OR contains(mime, 'text/') THEN 'text' ELSE 'unknown' END AS loader
        FROM (SELECT lower(list_last(string_split(coalesce(filename, ''), '.'))) AS ext, coalesce(file_content_type, '') AS mime FROM store_document))
    GROUP BY loader""")
def request_loaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "store_document")
    return rows.groupBy(formats.loader(F.col("filename"), F.col("file_content_type")).alias("loader")).agg(F.count(F.lit(1)).alias("n"))


@_query("""
    SELECT file_id, count(*) AS n_requests, max(requested_at) AS last_requested, count(*) FILTER (received_at - requested_at > INTERVAL 1 DAY) AS n_late
    FROM (SELECT DISTINCT * FROM store_document) WHERE file_id IS NOT NULL GROUP BY file_id""")
def requests_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "store_document").where("file_id IS NOT NULL").distinct()
    late = F.col("received_at") - F.col("requested_at") > F.expr("INTERVAL 1 DAY")
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_requests"), F.max("requested_at").alias("last_requested"), F.count_if(late).alias("n_late"))


@_query("SELECT date_trunc('day', requested_at) AS day, count(*) AS n_requests FROM (SELECT DISTINCT * FROM store_document) WHERE requested_at IS NOT NULL GROUP BY 1")
def stream_requests_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct requests by day, counted by a stream over the table's files."""
    path = Path(f"{sf_dir}/store_document.parquet")
    schema = table(spark, sf_dir, "store_document").schema
    folder, pattern = (path, "*.parquet") if path.is_dir() else (path.parent, path.name)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(str(folder))
    once = stream.where("requested_at IS NOT NULL").dropDuplicates()
    days = once.groupBy(F.date_trunc("day", "requested_at").alias("day")).agg(F.count(F.lit(1)).alias("n_requests"))
    out = f"{shared_dir(spark)}/days-{uuid4().hex}"
    sink = days.writeStream.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out))
    sink.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


# ---------------------------------------------------------------- chunking and context


@_query()
def split_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of every record, with its digest."""
    rows = table(spark, sf_dir, "document_model").select("record_id", "page_content")
    rows = rows.select("record_id", F.posexplode(chunking.chunks_of(F.col("page_content"))).alias("chunk_index", "document"))
    return rows.select("record_id", "chunk_index", "document", digest(F.col("document")).alias("digest"))


@_query()
def prepare_and_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every file in order, with the metadata they are stored under."""
    rows = table(spark, sf_dir, "document_model")
    meta = F.col("metadata")
    rows = rows.select(
        F.coalesce(F.get_json_object(meta, "$.file_id"), F.concat(F.lit("record-"), F.col("record_id").cast("string"))).alias("file_id"), F.col("record_id"),
        F.coalesce(F.get_json_object(meta, "$.user_id"), F.lit("public")).alias("user_id"), "metadata", "page_content",
    )
    chunks = chunking.prepare(rows, "page_content", ["record_id"], clean=F.lit(True))
    return chunking.tag(chunks, "0" * 32, 1).select("file_id", "chunk_index", "digest", "cmetadata")


@_query()
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of every chunk text by the stand-in embedder."""
    rows = _chunks(spark, sf_dir).where("document IS NOT NULL").select("uuid", "document")
    return embed(rows, "document", HashingEmbedder()).select("uuid", "embedding")


_ORDERED = """
    WITH r AS (SELECT uuid, custom_id, document, cmetadata::JSON AS m FROM langchain_pg_embedding WHERE custom_id IS NOT NULL),
    a AS (SELECT *, coalesce(json_type(m, '$._rag_ingestion_attempt_id') = 'VARCHAR' AND length(m->>'$._rag_ingestion_attempt_id') > 0
                             AND json_type(m, '$._rag_ingestion_attempt_started_at_ns') = 'UBIGINT', false) AS marked,
              CASE WHEN json_type(m, '$._rag_chunk_index') = 'UBIGINT' THEN (m->>'$._rag_chunk_index')::BIGINT END AS idx FROM r),
    b AS (SELECT *, CASE WHEN marked THEN (m->>'$._rag_ingestion_attempt_started_at_ns')::BIGINT END AS started,
              CASE WHEN marked THEN m->>'$._rag_ingestion_attempt_id' END AS attempt FROM a),
    t AS (SELECT custom_id, started, attempt, count(*) = count(idx) AND count(idx) = count(DISTINCT idx) AS trusted FROM b WHERE marked GROUP BY ALL),
    p AS (SELECT b.*, row_number() OVER (PARTITION BY b.custom_id ORDER BY b.marked, b.started NULLS FIRST, b.attempt NULLS FIRST,
              CASE WHEN t.trusted THEN b.idx END NULLS FIRST, b.uuid) - 1 AS position
          FROM b LEFT JOIN t ON b.marked AND b.custom_id = t.custom_id AND b.started = t.started AND b.attempt = t.attempt)"""


@_query(f"{_ORDERED} SELECT uuid, custom_id, position FROM p")
def context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).select("uuid", "custom_id", "cmetadata")
    return context.positions(rows).select("uuid", "custom_id", "position")


_TURN = "(x.page IS NOT NULL AND x.page IS DISTINCT FROM a.page)"
_SO_FAR = f"(CASE WHEN {_TURN} THEN a.t || chr(10) || '# PAGE ' || x.w || chr(10) || chr(10) ELSE a.t END)"
_NUMBER = """(CASE WHEN json_type(m, '$.page') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN try_cast(m->>'$.page' AS DOUBLE) WHEN m->>'$.page' = 'true' AND json_type(m, '$.page') = 'BOOLEAN' THEN 1.0 END)"""
_PAGE_KEY = f"""CASE WHEN {_NUMBER} <> 0 THEN 'n' || {_NUMBER} WHEN json_type(m, '$.page') = 'VARCHAR' AND m->>'$.page' <> '' THEN 's' || (m->>'$.page') END"""


@_query(f"""{_ORDERED},
    c AS (SELECT custom_id, list({{'t': coalesce(document, ''), 'page': {_PAGE_KEY}, 'w': CASE WHEN json_type(m, '$.page') = 'BOOLEAN' THEN 'True' ELSE m->>'$.page' END}} ORDER BY position) AS c,
              coalesce(list_last(string_split(first(m->>'$.source' ORDER BY position) FILTER (m->>'$.source' IS NOT NULL), '/')) || chr(10), '') AS head
          FROM p GROUP BY custom_id),
    f AS (SELECT custom_id, list_reduce(c, lambda a, x: {{'t': {_SO_FAR} || CASE WHEN suffix({_SO_FAR}, substring(x.t, 1, 100)) THEN substring(x.t, 101) ELSE x.t END,
              'page': CASE WHEN {_TURN} THEN x.page ELSE a.page END, 'w': ''}}, {{'t': head, 'page': NULL::VARCHAR, 'w': ''}}) AS f FROM c)
    SELECT custom_id, md5(regexp_replace(f.t, {_STRIP})) AS digest, length(regexp_replace(f.t, {_STRIP})) AS n FROM f""")
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every file, as its fingerprint and length."""
    out = context.assemble(_chunks(spark, sf_dir).select("uuid", "custom_id", "document", "cmetadata"))
    return out.select("custom_id", digest(F.col("context")).alias("digest"), F.length("context").alias("n"))


@_query(f"SELECT doc_id, length(regexp_replace(text, {_STRIP})) AS n, md5(text) AS digest FROM documents")
def document_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(strip(F.col("text"))).alias("n"), digest(F.col("text")).alias("digest"))

