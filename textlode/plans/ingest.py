"""Ingestion: files to records, chunks, embeddings and rows of the chunk store."""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, new_attempt, prepare, tag
from textlode.session import ship
from textlode.sources.formats import extension
from textlode.sources.store import ChunkStore


class Embedder(Protocol):
    """What turns texts into vectors; sent to the tasks, so it must pickle. ``batch_size`` limits the texts of a call."""

    dims: int
    batch_size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """A stand-in without a model: hashed words, scaled to length one. It makes the pipeline run and says nothing about retrieval quality."""

    dims: int = 64
    batch_size: int = 500

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype="f4")
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode("utf-8", "replace"))
                out[k, h % self.dims] += 1.0 if h >> 31 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1.0, norm)


def embed(df: DataFrame, text: str, embedder: Embedder, output: str = "embedding") -> DataFrame:
    """``df`` with a vector of each text; texts go to the embedder in batches of its size, a batch at a time in each task."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        step = embedder.batch_size if embedder.batch_size > 0 else 1 << 30
        for series in batches:
            texts = [t or "" for t in series]
            rows: list[np.ndarray] = []
            for k in range(0, len(texts), step):
                rows.extend(embedder.embed(texts[k : k + step]))
            yield pd.Series(rows, dtype=object)

    return df.withColumn(output, vectors(F.col(text)))


def chunk_rows(
    records: DataFrame, user_id: Column | str, collection_id: str, embedder: Embedder, attempt: tuple[str, int], size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP, tagged: bool = True,
) -> DataFrame:
    """Rows of the chunk table from loaded ``records`` (file_id, part_index, page_content, source, page, metadata).

    Texts of PDF files are cleaned. With ``tagged`` the metadata hold the place in the file and the attempt, and the
    file's own id wins over what the loader says.
    """
    attempt_id, started = attempt
    user = F.lit(user_id) if isinstance(user_id, str) else user_id
    records = records.where("page_content IS NOT NULL").select("file_id", "part_index", "page_content", "source", "page", "metadata")
    chunks = prepare(records, "page_content", ["part_index"], size, overlap, F.coalesce(extension(F.col("source")) == "pdf", F.lit(False)))
    chunks = chunks.withColumn("user_id", user)
    if tagged:
        chunks = tag(chunks, attempt_id, started)
    else:
        chunks = chunks.withColumn("cmetadata", F.col("metadata"))
    chunks = embed(chunks, "document", embedder)
    # a literal, the file and the place make an id that is the same when a task runs again
    key = F.sha2(F.concat_ws("\x01", F.lit(attempt_id), "file_id", F.col("chunk_index").cast("string")), 256)
    return chunks.select(
        F.substring(key, 1, 32).alias("uuid"), F.lit(collection_id).alias("collection_id"), "file_id", F.col("file_id").alias("custom_id"), "user_id", "digest", "source",
        "page", "chunk_index", F.lit(attempt_id).alias("attempt_id"), F.lit(started).cast("long").alias("attempt_started_at_ns"),
        (F.lit(started).cast("long") + F.col("chunk_index")).alias("row_seq"), "document", "cmetadata", "embedding",
    )


def ingest(
    store: ChunkStore, records: DataFrame, user_id: Column | str, collection_id: str, embedder: Embedder | None = None, whole_files: bool = False, **kwargs: int,
) -> dict[str, object]:
    """Store all chunks of ``records`` in one attempt and report it.

    The rows appear all at once when the attempt is published; if anything fails before, none do, rows of earlier attempts
    stay as they were, and the report has ``status`` False with the error. With ``whole_files``, as the flat profile may want it, a failed ingestion
    takes all rows of its files away, those of earlier attempts too.
    """
    ship(records.sparkSession)
    attempt = new_attempt(time.time_ns())
    try:
        rows = chunk_rows(records, user_id, collection_id, embedder or HashingEmbedder(), attempt, tagged=store.profile == "columnar", **kwargs)
        version = store.append(rows)
    except Exception as e:  # noqa: BLE001 - reported to the caller as a failed request
        if whole_files:
            store.delete_by_ids(records.select("file_id"))
        return {"status": False, "attempt_id": attempt[0], "error": f"{type(e).__name__}: {e}"[:2000]}
    return {"status": True, "attempt_id": attempt[0], "version": version}
