"""Putting the ordered text of a file together from its overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.functions import metadata as M
from textlode.functions.text import basename, strip
from textlode.operators.chunking import CHUNK_OVERLAP
from textlode.operators.skew import rank_within

INDEX, ATTEMPT, STARTED = "_rag_chunk_index", "_rag_ingestion_attempt_id", "_rag_ingestion_attempt_started_at_ns"


def ordered(df: DataFrame, file_id: str = "custom_id", received: str = "uuid", metadata: str = "cmetadata", drop: tuple[str, ...] = ("_json",)) -> DataFrame:
    """``df`` with the columns ``marked``, ``started``, ``attempt`` and ``place``, by which the chunks of a file are in order.

    A chunk belongs to an attempt if it has a non-empty text as attempt id and a whole start of at least 0; chunks without come first, as
    received. Attempts go by start and id. Within one, chunks go by index if every chunk has a whole index of at least 0
    and no two the same; else as received.
    """
    df = df.withColumn("_json", M.parsed(F.col(metadata)))
    meta, json = F.col(metadata), F.col("_json")
    attempt, started = M.as_string(meta, ATTEMPT, json), M.as_index(meta, STARTED, json)
    marked = F.coalesce((F.length(attempt) > 0) & started.isNotNull(), F.lit(False))
    rows = df.withColumn("marked", marked).withColumn("started", F.when(marked, started)).withColumn("attempt", F.when(marked, attempt))
    rows = rows.withColumn("_index", M.as_index(meta, INDEX, json))
    keys = [file_id, "marked", "started", "attempt"]
    state = rows.where("marked").groupBy(*keys).agg(
        ((F.count(F.lit(1)) == F.count("_index")) & (F.count("_index") == F.count_distinct("_index"))).alias("_trusted")
    )
    rows = rows.join(state, keys, "left")
    return rows.withColumn("place", F.when(F.col("_trusted"), F.col("_index"))).drop("_index", "_trusted", *drop)


def positions(df: DataFrame, file_id: str = "custom_id", received: str = "uuid", metadata: str = "cmetadata") -> DataFrame:
    """``df`` with each chunk's 0-based ``position`` in its file; rows without a file are left out.

    A file may own any share of the rows: see ``rank_within``.
    """
    rows = ordered(df.where(F.col(file_id).isNotNull()), file_id, received, metadata)
    keys = {"_s": F.coalesce("started", F.lit(-1)), "_a": F.coalesce("attempt", F.lit("")), "_p": F.coalesce("place", F.lit(-1))}
    sizes = df.where(F.col(file_id).isNotNull()).groupBy(file_id).agg(F.count(F.lit(1)).alias("_n"))
    return rank_within(rows.withColumns(keys), [file_id], ["marked", *keys, received], "position", sizes).select(*df.columns, "position")


def page_of(metadata: Column, json: Column) -> tuple[Column, Column]:
    """(what tells a chunk's page from others, how it is written), null where the page is missing, 0, false or empty. Numbers are one page if they are
    equal; true is 1; a text is itself. Lists and objects count as no page."""
    text, kind = M.as_text(metadata, "page"), M.kind(metadata, "page", json)
    number = F.when(kind == "number", text.try_cast("double")).when((kind == "boolean") & (text == "true"), F.lit(1.0))
    key = F.when(number != 0, F.concat(F.lit("n"), number.cast("string"))).when((kind == "string") & (text != ""), F.concat(F.lit("s"), text))
    return key, F.when(kind == "boolean", F.lit("True")).otherwise(text)


def assemble(df: DataFrame, file_id: str = "custom_id", received: str = "uuid", metadata: str = "cmetadata", text: str = "document", overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``(file_id, context)``: the text of each file.

    It begins with the file's base name (of the first chunk with a source), then a header for each page but page 0, and drops from a chunk its first
    ``overlap`` characters where the text so far ends in them. A file is one row, so it must fit in one: its chunks are
    collected sorted and folded in the JVM. The fold keeps the pieces and the end of the text so far, and they are joined once. Null texts count as empty.
    """
    rows = ordered(df.where(F.col(file_id).isNotNull()), file_id, received, metadata, drop=())
    meta = F.col(metadata)
    page, written = page_of(meta, F.col("_json"))
    entry = F.struct(
        F.col("marked"), F.coalesce("started", F.lit(-1)).alias("s"), F.coalesce("attempt", F.lit("")).alias("a"), F.coalesce("place", F.lit(-1)).alias("p"),
        F.col(received).alias("r"), F.coalesce(text, F.lit("")).alias("t"), page.alias("page"), written.alias("written"), F.get_json_object(meta, "$.source").alias("source"),
    )
    files = rows.groupBy(file_id).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    named = F.filter("c", lambda x: x["source"].isNotNull())
    head = F.when(F.size(named) > 0, F.concat(basename(F.element_at(named, 1)["source"]), F.lit("\n"))).otherwise(F.lit(""))
    end = lambda c: F.right(c, F.lit(max(1, overlap)))

    def step(acc: Column, x: Column) -> Column:
        turn = x["page"].isNotNull() & ~x["page"].eqNullSafe(acc["page"])
        header = F.when(turn, F.concat(F.lit("\n# PAGE "), x["written"], F.lit("\n\n"))).otherwise(F.lit(""))
        so_far = F.concat(acc["tail"], header)
        shared = F.substring(x["t"], 1, overlap) if overlap else F.lit("")
        rest = F.when(F.endswith(so_far, shared), F.substr(x["t"], F.lit(overlap + 1))).otherwise(x["t"])
        pieces = F.concat(acc["pieces"], F.array(F.concat(header, rest)))
        return F.struct(pieces.alias("pieces"), end(F.concat(so_far, rest)).alias("tail"), F.when(turn, x["page"]).otherwise(acc["page"]).alias("page"))

    start = F.struct(F.array(head).alias("pieces"), end(head).alias("tail"), F.lit(None).cast("string").alias("page"))
    return files.select(file_id, strip(F.array_join(F.aggregate("c", start, step, lambda a: a["pieces"]), "")).alias("context"))
