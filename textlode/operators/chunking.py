"""Chunk preparation: split loaded texts recursively, clean, fingerprint and tag the chunks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlode.functions.text import clean_text, digest
from textlode.operators.skew import rank_within
from textlode.session import ship

CHUNK_SIZE, CHUNK_OVERLAP = 1500, 100
SEPARATORS = ("\n\n", "\n", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of ``text``, each after the first with the separator at its start."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *[separator + r for r in rest]] if p]


def _windows(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Runs of consecutive pieces of at most ``size`` characters, each beginning with up to ``overlap`` characters of the run before."""
    lo, total, lengths = 0, 0, [len(p) for p in pieces]
    for hi, n in enumerate(lengths):
        if total + n > size and hi > lo:
            yield "".join(pieces[lo:hi])
            while lo < hi and (total > overlap or (total + n > size and total > 0)):
                total -= lengths[lo]
                lo += 1
        total += n
    if lo < len(pieces):
        yield "".join(pieces[lo:])


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, stripped, none empty, cut at the coarsest separator that occurs; a piece
    that is still too long is cut at the finer ones."""
    at = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    out, short = [], []
    finer = separators[at + 1 :]

    def flush() -> None:
        out.extend(_windows(short, size, overlap))
        short.clear()

    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        flush()
        out.extend(split_text(piece, size, overlap, finer) if finer else [piece])
    flush()
    return [c for c in (x.strip() for x in out) if c]


def chunks_of(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """The chunks of each text as an array, by an Arrow-batched function."""
    if not 0 <= overlap <= size or size < 1:
        raise ValueError("the overlap must not exceed the chunk size")
    session = SparkSession.getActiveSession()
    if session is not None:
        ship(session)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield series.map(lambda t: split_text(t, size, overlap) if t is not None else [])

    return split(text)


def prepare(df: DataFrame, text: str, order: Sequence[str], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, clean: Column | bool = False) -> DataFrame:
    """One row for each chunk: the other columns of ``df``, ``chunk_index`` within the file across its parts in ``order``, ``document`` and ``digest``.

    ``clean`` says where U+0000 is removed - before the digest is taken. ``df`` has ``file_id``. A file may own any share of the rows: chunks are numbered by
    ``rank_within``, for which the lengths of the texts tell how many chunks a file has at least, so that nothing is split for counting.
    """
    parts = df.withColumn("_chunks", chunks_of(F.col(text), size, overlap)).select(*[c for c in df.columns if c != text], F.posexplode("_chunks").alias("_pos", "document"))
    sizes = df.groupBy("file_id").agg(F.sum(1 + F.coalesce(F.length(text), F.lit(0)) / F.lit(size)).alias("_n"))
    rows = rank_within(parts, ["file_id"], [*order, "_pos"], "chunk_index", sizes).drop("_pos").withColumn("chunk_index", F.col("chunk_index").cast("int"))
    where = F.lit(clean) if isinstance(clean, bool) else clean
    rows = rows.withColumn("document", F.when(where, clean_text(F.col("document"))).otherwise(F.col("document")))
    return rows.withColumn("digest", digest(F.col("document")))


def new_attempt(now_ns: int) -> tuple[str, int]:
    """Identifier and start of an ingestion attempt: literals of the plan, the same when a task runs again."""
    return uuid.uuid4().hex, now_ns


def tag(df: DataFrame, attempt_id: str, started_at_ns: int, metadata: str = "metadata") -> DataFrame:
    """``cmetadata`` of each chunk: file, user and digest, over them what the loader gave, over all the file, index and attempt.

    ``df`` has ``file_id``, ``user_id``, ``digest``, ``chunk_index`` and the loader's JSON object in ``metadata`` (null: none). A loader may thus
    set another user or digest, never another file or position.
    """
    kinds = "map<string,string>"
    loader = F.coalesce(_raw_map(F.col(metadata)), F.create_map().cast(kinds))
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    base = F.create_map(F.lit("file_id"), quoted(F.col("file_id")), F.lit("user_id"), quoted(F.col("user_id")), F.lit("digest"), quoted(F.col("digest")))
    own = F.create_map(
        F.lit("file_id"), quoted(F.col("file_id")), F.lit("_rag_chunk_index"), F.col("chunk_index").cast("string"),
        F.lit("_rag_ingestion_attempt_id"), F.lit(f'"{attempt_id}"'), F.lit("_rag_ingestion_attempt_started_at_ns"), F.lit(str(int(started_at_ns))),
    )
    without = lambda m, over: F.map_filter(m, lambda k, v: ~F.array_contains(F.map_keys(over), k))
    merged = F.map_concat(without(base, F.map_concat(without(loader, own), own)), F.map_concat(without(loader, own), own))
    pairs = F.transform(F.map_entries(merged), lambda e: F.concat(quoted(e["key"]), F.lit(": "), F.coalesce(e["value"], F.lit("null"))))
    return df.withColumn("cmetadata", F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))


def _raw_map(c: Column) -> Column:
    """A JSON object's values by key, as JSON text."""
    variant = F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")
    return F.transform_values(variant, lambda k, v: F.to_json(v))
