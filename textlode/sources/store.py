"""A chunk table in versioned snapshots on any file system that Hadoop's clients reach.

A version is a list of parts in ``_versions/NNNNNNNNNN.json``; the file with the highest number is the current one, so no other mark can disagree with it.
Writers stage files in a directory of their own, then publish a new list by putting the complete file in place under a number that must be
free: a failed attempt leaves nothing to undo, a writer that dies at any moment blocks no other, and a reader that has opened a version
keeps seeing it. One writer at a time is assumed; of two, the second fails on publishing.

Rows are spread over directories by a hash of the file id ("buckets") and sorted by it within files, so a search by file opens one bucket
and skips row groups. Deletions and replacements write the buckets anew that they touch; of the others, the new version names the old files.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textlode.functions.text import store_id
from textlode.operators import lookup
from textlode.session import ship

#: Rows of a bucket that ``compact`` aims at.
BUCKET_ROWS = 1_000_000


class Files:
    """The few file operations a store needs, by Hadoop's client."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        path = self._path(root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = str(self._fs.makeQualified(path).toString())
        self.local = self._fs.getUri().getScheme() == "file"

    def _path(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(f"{self.root}/{name}"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """A whole new file in one step; ``FileExistsError`` if there is one of that name."""
        draft = f"{name}.{uuid.uuid4().hex}"
        self.write(draft, text)
        source, target = self._path(f"{self.root}/{draft}"), self._path(f"{self.root}/{name}")
        try:
            if self.local:  # renaming replaces files here, linking doesn't
                os.link(source.toUri().getPath(), target.toUri().getPath())
            elif not self._fs.rename(source, target):
                raise FileExistsError(name)
        finally:
            self._fs.delete(source, False)


class ChunkStore:
    """Chunks with the columns ``file_id`` and ``collection_id`` (columnar profile) or ``store_id`` (dedup profile) among others."""

    def __init__(self, spark: SparkSession, path: str, profile: str = "columnar", buckets: int = 32) -> None:
        if profile not in ("columnar", "dedup"):
            raise ValueError(f"unknown profile {profile!r}")
        ship(spark)
        self.spark, self.profile, self.buckets, self.files = spark, profile, buckets, Files(spark, path)
        self.root = self.files.root

    # -- versions

    def version(self) -> int:
        return max((int(n[:10]) for n in self.files.names("_versions") if n[:10].isdigit() and n[10:] == ".json"), default=0)

    def _state(self, version: int) -> dict:
        """``parts`` (path, number of buckets, those that count or None for all), and ``done``, the last batch of each stream."""
        return json.loads(self.files.read(f"_versions/{version:010d}.json")) if version else {"parts": [], "done": {}}

    def _publish(self, state: dict, base: int) -> int:
        version = base + 1
        self.files.publish(f"_versions/{version:010d}.json", json.dumps(state))
        return version

    @staticmethod
    def _bucket(n: int, column: str = "file_id") -> Column:
        return F.pmod(F.xxhash64(F.coalesce(column, F.lit(""))), F.lit(n)).cast("int")

    def _stage(self, df: DataFrame, name: str, buckets: int | None = None) -> dict:
        """Write ``df`` as a part. A bucket is written by as many tasks as its size asks for: a file may own any share of the rows."""
        n = buckets or self.buckets
        part = f"data/{name}-{uuid.uuid4().hex}"
        out = df.withColumn("_bucket", self._bucket(n))
        out.hint("rebalance", F.col("_bucket")).sortWithinPartitions("_bucket", "file_id").write.partitionBy("_bucket").parquet(f"{self.root}/{part}")
        self.files.write(f"{part}/_schema.json", out.schema.json())  # a part without rows has no files to tell
        return {"path": part, "of": n, "keep": None}

    def _open(self, part: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.files.read(f"{part['path']}/_schema.json")))
        df = self.spark.read.schema(schema).parquet(f"{self.root}/{part['path']}")
        return df if part["keep"] is None else df.where(F.col("_bucket").isin(part["keep"]))

    @staticmethod
    def _all(frames: Iterable[DataFrame]) -> DataFrame | None:
        out: DataFrame | None = None
        for df in frames:
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return None if out is None else out.drop("_bucket")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest by default; None of an empty store."""
        return self._all(map(self._open, self._state(self.version() if version is None else version)["parts"]))

    def _buckets_of(self, ids: DataFrame, part: dict) -> list[int]:
        """The buckets of a part that the file ids of ``ids`` (id) hash to: no more than it has."""
        found = ids.select(self._bucket(part["of"], "id").alias("b")).distinct().collect()
        return sorted(r["b"] for r in found if part["keep"] is None or r["b"] in part["keep"])

    def of_files(self, file_ids: Iterable[str], version: int | None = None) -> DataFrame | None:
        """The rows of some files: the buckets they hash to are read, and row groups by the file id's range."""
        ids = sorted(set(file_ids))
        parts = self._state(self.version() if version is None else version)["parts"]
        if not parts or not ids:
            return None
        wanted = lookup.ids_frame(self.spark, ids)
        return self._all(lookup.with_ids(self._open(p).where(F.col("_bucket").isin(self._buckets_of(wanted, p))), ids, "file_id") for p in parts)

    # -- changes

    def append(self, df: DataFrame, stream: str | None = None, batch: int = 0) -> int:
        """Add rows; duplicates are kept. In the dedup profile a row replaces that of the same ``store_id``.

        With ``stream``, the version remembers ``batch`` as done, and a batch of the stream that was published before isn't again.
        """
        base = self.version()
        state = self._state(base)
        if stream is not None:
            if state["done"].get(stream, -1) >= batch:
                return base
            state["done"][stream] = batch
        if self.profile == "dedup":
            new = self._stage(latest_by_store_id(with_store_id(df)), "upsert")
            staged = self._open(new).where("store_id IS NOT NULL").select("store_id")
            state = self._without(state, lambda rows: rows.join(staged, "store_id", "left_semi"), lambda rows: rows.join(staged, "store_id", "left_anti"))
        else:
            new = self._stage(df, "append")
        return self._publish(state | {"parts": [*state["parts"], new]}, base)

    def _without(self, state: dict, hit: object, rest: object, ids: DataFrame | None = None) -> dict:
        """``state`` without the rows that ``hit`` gives: the buckets that have some (``ids`` tells which may) are written anew with what ``rest`` leaves."""
        parts, anew = [], []
        for part in state["parts"]:
            df = self._open(part)
            touched = self._buckets_of(ids, part) if ids is not None else None
            some = df if touched is None else df.where(F.col("_bucket").isin(touched))
            touched = sorted(r["_bucket"] for r in hit(some).select("_bucket").distinct().collect())
            if touched:
                anew.append(rest(df.where(F.col("_bucket").isin(touched))))
            stay = [b for b in (range(part["of"]) if part["keep"] is None else part["keep"]) if b not in touched]
            if stay:
                parts.append(part if not touched else part | {"keep": stay})
        if anew:
            parts.append(self._stage(self._all(anew), "kept"))
        return state | {"parts": parts}

    def _delete(self, base: int, state: dict, hit: object, rest: object, ids: DataFrame | None = None) -> int:
        after = self._without(state, hit, rest, ids)
        return base if after["parts"] == state["parts"] else self._publish(after, base)

    def delete_by_ids(self, ids: Iterable[str] | DataFrame | None, collection: str | None = None) -> int:
        """Delete the files' rows, of all collections or of one; the version stays if there are none."""
        base = self.version()
        if ids is None:
            return base
        wanted = lookup.ids_frame(self.spark, ids)
        same = F.lit(True) if collection is None else F.coalesce(F.col("collection_id") == F.lit(collection), F.lit(False))
        hit = lambda rows: rows.where(same).join(wanted, rows["file_id"] == wanted["id"], "left_semi")
        rest = lambda rows: lookup.delete_by_ids(rows, wanted, "file_id", collection)
        return self._delete(base, self._state(base), hit, rest, wanted)

    def delete_by_metadata(self, spec: Mapping[str, object], collection: str, promoted: Mapping[str, str] | None = None) -> int:
        base = self.version()
        lookup.check_metadata_filter(spec)
        hit = lambda rows: rows.where(lookup.matches(spec, collection, promoted=promoted))
        rest = lambda rows: lookup.delete_by_metadata(rows, spec, collection, promoted=promoted)
        return self._delete(base, self._state(base), hit, rest)

    def compact(self) -> int:
        """One part instead of many, with as many buckets as the number of rows asks for; the rows stay."""
        base = self.version()
        state, rows = self._state(base), self.read(base)
        if rows is None:
            return base
        self.buckets = max(self.buckets, -(-rows.count() // BUCKET_ROWS))
        return self._publish(state | {"parts": [self._stage(rows, "kept")]}, base)

    def is_laid_out_by(self, column: str) -> bool:
        """Whether a filter on ``column`` can skip files: every part must be in directories by its hash and sorted by it, as its files show."""
        parts = self._state(self.version())["parts"]
        folders = [[n for n in self.files.names(p["path"]) if n.startswith("_bucket=")] for p in parts]
        return bool(parts) and column == "file_id" and all(f or self._open(p).isEmpty() for f, p in zip(folders, parts))


def with_store_id(df: DataFrame) -> DataFrame:
    """``df`` with ``store_id``, from ``file_id``, ``digest`` and ``document``."""
    return df.withColumn("store_id", store_id(F.col("file_id"), F.col("digest"), F.col("document")))


def latest_by_store_id(df: DataFrame, order: str = "row_seq") -> DataFrame:
    """The last row of each store id by ``order``; rows without a store id all stay. The group limit runs before the shuffle."""
    named, rest = df.where("store_id IS NOT NULL"), df.where("store_id IS NULL")
    last = F.row_number().over(Window.partitionBy("store_id").orderBy(F.desc(order)))
    return named.withColumn("_k", last).where("_k = 1").drop("_k").unionByName(rest)
