"""Queries that show operators without an SQL equivalent by what must hold of their results, or by a way there and back.

The loaders are given every record of ``document_model`` as a file of their format, made here; the store, the pipeline and the catalog are given
whole tables.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from html import escape
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.functions.text import basename, digest, strip
from textlode.operators import chunking
from textlode.plans import service
from textlode.plans.ingest import HashingEmbedder, ingest
from textlode.session import shared_dir, table
from textlode.sources import loaders
from textlode.sources.store import ChunkStore

_NOT_XML = "[\\x00-\\x08\\x0B-\\x1F\\x{FFFE}\\x{FFFF}]"
_WHITE = r"[\s\x{85}\p{Z}\x0B\x1C-\x1F]+"
_STRIP = rf"'^{_WHITE}|{_WHITE}$', '', 'g'"


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def _runs(text: str, tag: str) -> str:
    return "".join(f"<{tag}:p><{tag}:r><{tag}:t>{escape(line)}</{tag}:t></{tag}:r></{tag}:p>" for line in text.split("\n"))


def _sheet(text: str) -> bytes:
    rows = "".join(f'<row><c t="inlineStr"><is><t>{escape(line)}</t></is></c></row>' for line in text.split("\n"))
    return _zip({"xl/worksheets/sheet1.xml": f'<worksheet xmlns="s"><sheetData>{rows}</sheetData></worksheet>'})


def _book(text: str) -> bytes:
    body = "".join(f"<p>{escape(line)}</p>" for line in text.split("\n"))
    return _zip({
        "META-INF/container.xml": '<container xmlns="c"><rootfile full-path="b.opf"/></container>',
        "b.opf": '<package xmlns="o"><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>',
        "a.xhtml": f"<html><body>{body}</body></html>",
    })


def _csv(text: str) -> bytes:
    lines = text.split("\n")
    return ("line,text\n" + "".join('{},"{}"\n'.format(k, x.replace('"', '""')) for k, x in enumerate(lines))).encode()


#: By extension: what makes a file of a text without control characters.
MAKERS: dict[str, Callable[[str], bytes]] = {
    "txt": str.encode,
    "py": lambda text: text.encode("utf-16"),
    "json": lambda text: b"\xef\xbb\xbf" + text.encode(),
    "csv": _csv,
    "xml": lambda text: ("<r>" + "".join(f"<a>{escape(x)}</a>" for x in text.split("\n")) + "</r>").encode(),
    "docx": lambda text: _zip({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{_runs(text, "w")}</w:body></w:document>'}),
    "pptx": lambda text: _zip({"ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a">{_runs(text, "a")}</p:sld>'}),
    "xlsx": _sheet,
    "epub": _book,
}


def _loaded(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        make = MAKERS[kind]
        text = F.regexp_replace("page_content", _NOT_XML, "")
        rows = table(spark, sf_dir, "document_model").where("page_content IS NOT NULL").select(F.col("record_id").cast("string").alias("file_id"), text.alias("t"))

        def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"file_id": batch["file_id"], "content": [make(t) for t in batch["t"]]})

        made = rows.mapInPandas(files, "file_id string, content binary")
        name = F.concat("file_id", F.lit(f".{kind}"))
        made = made.select("file_id", name.alias("filename"), F.lit(None).cast("string").alias("file_content_type"), name.alias("path"), "content")
        out = loaders.load(made, raw=True)
        return out.select(F.col("file_id").cast("long").alias("record_id"), "part_index", digest(F.col("page_content")).alias("digest"), "error")

    return run


_TEXT = f"SELECT record_id, regexp_replace(page_content, '{_NOT_XML}', '', 'g') AS t FROM document_model WHERE page_content IS NOT NULL"
_FULL = f"list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, {_STRIP}) <> '')"


def _whole(text: str) -> str:
    return f"SELECT record_id, 0 AS part_index, md5({text}) AS digest, NULL AS error FROM ({_TEXT})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "load_text": _loaded("txt"), "load_utf16_source": _loaded("py"), "load_json_with_mark": _loaded("json"), "load_csv": _loaded("csv"), "load_xml": _loaded("xml"),
    "load_word": _loaded("docx"), "load_slides": _loaded("pptx"), "load_sheet": _loaded("xlsx"), "load_epub": _loaded("epub"),
}
SQL: dict[str, str] = {
    "load_text": _whole("t"),
    "load_utf16_source": _whole("t"),
    "load_json_with_mark": _whole("t"),
    "load_csv": f"""
        SELECT record_id, (k - 1)::INT AS part_index, md5('line: ' || (k - 1) || chr(10) || 'text: ' || regexp_replace(l[k], {_STRIP})) AS digest, NULL AS error
        FROM (SELECT record_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT record_id, string_split(t, chr(10)) AS l FROM ({_TEXT})))""",
    "load_xml": _whole(f"coalesce(array_to_string(list_transform({_FULL}, lambda x: regexp_replace(x, {_STRIP})), chr(10)), '')"),
    "load_word": _whole(f"coalesce(array_to_string({_FULL}, chr(10) || chr(10)), '')"),
    "load_slides": _whole(f"coalesce(array_to_string({_FULL}, chr(10)), '')"),
    "load_sheet": _whole("array_to_string(list_filter(string_split(t, chr(10)), lambda x: x <> ''), chr(10))"),
    "load_epub": _whole(f"""coalesce(array_to_string(list_filter(list_transform(string_split(t, chr(10)),
        lambda x: regexp_replace(regexp_replace(x, '[\\s\\x{{85}}\\p{{Z}}\\x0B\\x1C-\\x1F]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> ''), chr(10)), '')"""),
}


def _query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


_BLACK = rf"length(regexp_replace(page_content, '{_WHITE}', '', 'g'))"


def _black(c: Column) -> Column:
    """How many characters aren't white space."""
    return F.length(F.regexp_replace(c, r"[\s\p{Z}\x0B\x1C-\x1F\x85]+", ""))


@_query(f"""
    SELECT record_id, true AS within_size, true AS in_text, true AS whole, true AS one_if_short
    FROM document_model WHERE regexp_replace(page_content, {_STRIP}) <> ''""")
def split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every record: its chunks are within the size, stand in its text, leave no character out, and a short text is one chunk."""
    rows = table(spark, sf_dir, "document_model").select("record_id", "page_content")
    chunks = rows.select("*", F.explode(chunking.chunks_of(F.col("page_content"))).alias("document"))
    chunks = chunks.select(
        "record_id", F.length("document").alias("n"), F.contains("page_content", "document").alias("inside"), _black(F.col("document")).alias("black"),
        _black(F.col("page_content")).alias("all"), (F.length("page_content") < chunking.CHUNK_SIZE).alias("short"), (F.col("document") == strip(F.col("document"))).alias("bare"),
    )
    return chunks.groupBy("record_id").agg(
        (F.max("n") <= chunking.CHUNK_SIZE).alias("within_size"), (F.bool_and("inside") & F.bool_and("bare")).alias("in_text"),
        (F.sum("black") >= F.max("all")).alias("whole"), (~F.max("short") | (F.count(F.lit(1)) == 1)).alias("one_if_short"),
    )


_FILE = "coalesce(metadata::JSON->>'$.file_id', 'record-' || record_id)"
_FILES = f"SELECT DISTINCT {_FILE} AS file_id FROM document_model WHERE regexp_replace(page_content, {_STRIP}) <> ''"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, meta = table(spark, sf_dir, "document_model"), F.col("metadata")
    file = F.coalesce(F.get_json_object(meta, "$.file_id"), F.concat(F.lit("record-"), F.col("record_id").cast("string")))
    return rows.select(
        file.alias("file_id"), F.col("record_id").cast("int").alias("part_index"), "page_content", F.get_json_object(meta, "$.source").alias("source"),
        F.lit(None).cast("int").alias("page"), F.when(F.get_json_object(meta, "$.source").isNotNull(), F.to_json(F.struct(F.get_json_object(meta, "$.source").alias("source")))).alias("metadata"),
    )


@_query(f"SELECT file_id, true AS gapless, true AS digests, true AS tagged, true AS in_order FROM ({_FILES})")
def prepare_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every file: the indexes of its chunks are gapless and follow its parts, digests are those of the texts, and the tags are in the metadata."""
    chunks = chunking.prepare(_records(spark, sf_dir), "page_content", ["part_index"], clean=F.lit(True)).withColumn("user_id", F.lit("u"))
    meta = F.col("cmetadata")
    rows = chunking.tag(chunks, "0" * 32, 7).select(
        "file_id", "chunk_index", "part_index", (F.md5("document") == F.col("digest")).alias("digested"),
        ((F.get_json_object(meta, "$.file_id") == F.col("file_id")) & (F.get_json_object(meta, "$._rag_chunk_index") == F.col("chunk_index").cast("string"))
         & (F.get_json_object(meta, "$._rag_ingestion_attempt_id") == "0" * 32) & (F.get_json_object(meta, "$.digest") == F.col("digest"))).alias("tagged"),
    )
    pairs = rows.groupBy("file_id", "part_index").agg(F.min("chunk_index").alias("lo"), F.max("chunk_index").alias("hi"), F.count(F.lit(1)).alias("n"), F.bool_and("digested").alias("d"), F.bool_and("tagged").alias("t"))
    return pairs.groupBy("file_id").agg(
        ((F.min("lo") == 0) & (F.max("hi") == F.sum("n") - 1)).alias("gapless"), F.bool_and("d").alias("digests"), F.bool_and("t").alias("tagged"), (F.bool_and(F.col("hi") - F.col("lo") == F.col("n") - 1)).alias("in_order"),
    )


def _store(spark: SparkSession, profile: str = "columnar") -> ChunkStore:
    return ChunkStore(spark, f"{shared_dir(spark)}/store-{uuid4().hex}", profile, 8)


@_query(f"SELECT file_id, true AS gapless, true AS one_attempt, true AS embedded FROM ({_FILES})")
def ingest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records ingested: of every file all chunks are stored in one attempt, with gapless indexes and vectors of unit length or none."""
    store = _store(spark)
    report = ingest(store, _records(spark, sf_dir), "u", "c", HashingEmbedder(16))
    if not report["status"]:
        raise RuntimeError(report["error"])
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = store.read().withColumn("fine", (F.size("embedding") == 16) & ((F.abs(norm - 1) < 1e-4) | (norm == 0)))
    return rows.groupBy("file_id").agg(
        ((F.min("chunk_index") == 0) & (F.max("chunk_index") == F.count(F.lit(1)) - 1)).alias("gapless"), (F.count_distinct("attempt_id") == 1).alias("one_attempt"), F.bool_and("fine").alias("embedded"),
    )


@_query(f"""
    SELECT {_FILE} AS file_id, md5(rtrim(string_agg(page_content || chr(10), '' ORDER BY record_id), chr(10))) AS digest
    FROM document_model WHERE page_content IS NOT NULL AND NOT coalesce(lower(metadata::JSON->>'$.source') LIKE '%.pdf', false) GROUP BY 1
    UNION ALL BY NAME SELECT file_id, digest FROM (SELECT {_FILE} AS file_id, md5(rtrim(string_agg(replace(page_content, chr(0), '') || chr(10), '' ORDER BY record_id), chr(10))) AS digest
    FROM document_model WHERE page_content IS NOT NULL AND coalesce(lower(metadata::JSON->>'$.source') LIKE '%.pdf', false) GROUP BY 1)""")
def extract_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verbatim text of every file, of its PDF parts and of the others."""
    rows = _records(spark, sf_dir).withColumn("_pdf", F.coalesce(F.lower("source").like("%.pdf"), F.lit(False)))
    parts = [loaders.extract_text(rows.where(F.col("_pdf") == flag)) for flag in (False, True)]
    return parts[0].unionByName(parts[1]).select("file_id", digest(F.col("text")).alias("digest"))


@_query("""
    WITH r AS (SELECT row_seq, CASE WHEN file_id IS NOT NULL THEN file_id || '_' || coalesce(nullif(digest, ''), md5(text)) END AS store_id FROM atlas_mongo_vector)
    SELECT store_id, max(row_seq) AS row_seq FROM r WHERE store_id IS NOT NULL GROUP BY store_id UNION ALL SELECT store_id, row_seq FROM r WHERE store_id IS NULL""")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a deduplicating store holds after the earlier half of the rows, then the later one were stored: the last row of each id."""
    store = _store(spark, "dedup")
    rows = table(spark, sf_dir, "atlas_mongo_vector").select("row_seq", "file_id", "digest", F.col("text").alias("document"))
    middle = rows.agg(F.expr("percentile_approx(row_seq, 0.5)")).first()[0] or 0
    for part in (rows.where(F.col("row_seq") <= middle), rows.where(F.col("row_seq") > middle)):
        store.append(part)
    return store.read().select("store_id", "row_seq")


@_query("SELECT uuid, name, cmetadata FROM langchain_pg_collection")
def dump_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table by name."""
    view = f"collections_{uuid4().hex}"
    table(spark, sf_dir, "langchain_pg_collection").createOrReplaceTempView(view)
    return service.records(spark, view, [view])


LARGE_FILE = "7c1f0e52-3b7a-4d6e-9a41-0d2f6b8ce915"


@_query(f"SELECT uuid, custom_id FROM langchain_pg_embedding WHERE custom_id = '{LARGE_FILE}'")
def records_of_custom_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = f"chunks_{uuid4().hex}"
    table(spark, sf_dir, "langchain_pg_embedding").createOrReplaceTempView(view)
    return service.records(spark, view, [view], LARGE_FILE).select("uuid", "custom_id")


@_query("SELECT column_name, (row_number() OVER () - 1)::INT AS position FROM (DESCRIBE langchain_pg_embedding)")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a table in their order."""
    view = f"chunks_{uuid4().hex}"
    table(spark, sf_dir, "langchain_pg_embedding").createOrReplaceTempView(view)
    return spark.createDataFrame(list(zip(service.columns(spark, view), range(10**6))), "column_name string, position int")


@_query("SELECT unnest(['documents', 'langchain_pg_collection', 'langchain_pg_embedding']) AS name")
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that a schema has."""
    mark = uuid4().hex
    for name in ("documents", "langchain_pg_collection", "langchain_pg_embedding"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"{name}_{mark}")
    found = [n.removesuffix(f"_{mark}") for n in service.tables(spark) if n.endswith(mark)]
    return spark.createDataFrame([(n,) for n in found], "name string")


@_query(f"""SELECT custom_id AS file_id, count(*) AS n_chunks FROM langchain_pg_embedding WHERE custom_id IS NOT NULL AND custom_id <> '{LARGE_FILE}' GROUP BY 1""")
def service_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a service, with their chunks, after one was deleted through its route and others were asked for."""
    api = service.Service(_store(spark))
    rows = table(spark, sf_dir, "langchain_pg_embedding").where("custom_id IS NOT NULL")
    api.store.append(rows.select("uuid", "custom_id", F.col("custom_id").alias("file_id"), "collection_id", "document", "cmetadata"))
    api.delete_documents([LARGE_FILE])
    ids = [r["id"] for r in api.list_ids().orderBy("id").collect()]
    return api.get_documents(ids).groupBy(F.col("custom_id").alias("file_id")).agg(F.count(F.lit(1)).alias("n_chunks"))


@_query("SELECT record_id, list_last(string_split(metadata::JSON->>'$.source', '/')) AS name FROM document_model")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_model").select("record_id", basename(F.get_json_object("metadata", "$.source")).alias("name"))


_laid_out: dict[tuple[str, str], str] = {}


def _by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks with their file id in a column, sorted by it in files; written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _laid_out:
        path = f"{shared_dir(spark)}/by-file-{uuid4().hex}"
        rows = table(spark, sf_dir, "langchain_pg_embedding").withColumn("file_id", F.get_json_object("cmetadata", "$.file_id"))
        rows.repartitionByRange("file_id", "uuid").sortWithinPartitions("file_id").write.parquet(path)
        _laid_out[key] = path
    return spark.read.parquet(_laid_out[key])


_OF_FILE = f"SELECT uuid FROM langchain_pg_embedding WHERE cmetadata::JSON->>'$.file_id' = '{LARGE_FILE}'"


@_query(_OF_FILE)
def chunks_of_file_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a file by the JSON of each row; on the same rows as ``chunks_of_file_column``."""
    return _by_file(spark, sf_dir).where(F.get_json_object("cmetadata", "$.file_id") == LARGE_FILE).select("uuid")


@_query(_OF_FILE)
def chunks_of_file_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a file by its column: row groups are skipped."""
    return _by_file(spark, sf_dir).where(F.col("file_id") == LARGE_FILE).select("uuid")
