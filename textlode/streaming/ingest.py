"""Continuous ingestion of records and requests from a watched directory (an extension: the service takes requests one by one)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textlode.plans.ingest import Embedder, chunk_rows
from textlode.session import ship
from textlode.sources.store import ChunkStore


def watch(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of ``folder`` as a stream, a bounded number of files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest_stream(stream: DataFrame, store: ChunkStore, user_id: str, collection_id: str, embedder: Embedder, checkpoint: str) -> StreamingQuery:
    """Append the chunks of every batch of records. The attempt is named after the stream's checkpoint - its query id is kept there - and the batch; the
    store's version remembers the last batch of each stream, so one that was published before the stream stopped is not published again, and
    other streams, or one with a new checkpoint, are told apart."""
    spark = stream.sparkSession
    ship(spark)

    def write(batch: DataFrame, number: int) -> None:
        # the id is the checkpoint's, and the same when the stream starts again
        name = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        attempt = (f"{name}-{number:016d}", number)
        store.append(chunk_rows(batch, user_id, collection_id, embedder, attempt), name, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def requests_per_window(stream: DataFrame, lateness: str = "3 days", width: str = "1 day") -> DataFrame:
    """Distinct requests by day of ``requested_at``; whole rows repeated within the watermark count once, rows later than it are dropped."""
    once = stream.withWatermark("requested_at", lateness).dropDuplicatesWithinWatermark(["file_id", "filepath", "requested_at", "received_at"])
    return once.groupBy(F.window("requested_at", width).alias("day")).agg(F.count(F.lit(1)).alias("n_requests"), F.approx_count_distinct("file_id").alias("n_files"))
