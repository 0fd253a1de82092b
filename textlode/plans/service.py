"""The requests a retrieval service answers, over a chunk store."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.operators import context as ctx
from textlode.operators import lookup, search
from textlode.session import stage
from textlode.plans.ingest import Embedder, HashingEmbedder, ingest
from textlode.sources.loaders import extract_text, load, read_files
from textlode.sources.store import ChunkStore

PROMOTED = {"file_id": "file_id"}


class Service:
    """``principal`` arguments take the place of the web service's sessions. Searches are within ``collection``, if one is given here or there; listing,
    fetching and deleting go by file id alone."""

    def __init__(self, store: ChunkStore, embedder: Embedder | None = None, threshold: float | None = None, collection: str | None = None) -> None:
        self.store, self.embedder, self.threshold, self.collection = store, embedder or HashingEmbedder(), threshold, collection
        self._vector = lru_cache(128)(lambda text: tuple(map(float, self.embedder.embed([text])[0])))

    def _rows(self) -> DataFrame:
        rows = self.store.read()
        if rows is None:
            raise lookup.NotFound("the store is empty")
        return rows

    def health(self) -> dict[str, str]:
        try:
            self.store.spark.range(1).count()
            self.store.version()
        except Exception:  # noqa: BLE001
            return {"status": "DOWN"}
        return {"status": "UP"}

    def list_ids(self) -> DataFrame:
        return lookup.list_ids(self._rows())

    def get_documents(self, ids: Iterable[str]) -> DataFrame:
        """All chunks of the ids; ``NotFound`` if any has none."""
        rows, ids = self._rows(), list(ids)
        lookup.require_ids(rows, ids)
        return lookup.fetch_by_ids(rows, ids)

    def delete_documents(self, ids: Iterable[str]) -> int:
        """Delete the ids' chunks, then report missing ones: those that exist are gone even if ``NotFound`` is raised."""
        ids = list(ids)
        before = self._rows()
        missing = [r["id"] for r in lookup.missing_ids(before, ids).limit(20).collect()]
        self.store.delete_by_ids(ids)
        if missing:
            raise lookup.NotFound(f"no documents for {', '.join(sorted(missing))}")
        return len(ids)

    def query(self, text: str, file_id: str, k: int = 4, user: str | None = None, entity: str | None = None, collection: str | None = None) -> DataFrame:
        rows = self.store.of_files([file_id])
        if rows is None:
            raise lookup.NotFound("the store is empty")
        return search.query(
            rows, self._vector(text), file_id, k, user, entity, self.threshold, owner=F.get_json_object("cmetadata", "$.user_id"), promoted=PROMOTED, profile=self.store.profile,
            collection=collection or self.collection,
        )

    def query_multiple(self, text: str, file_ids: Sequence[str], k: int = 4, collection: str | None = None) -> DataFrame:
        """``NotFound`` if nothing is found."""
        rows = self.store.of_files(file_ids)
        where = collection or self.collection
        hits = None if rows is None else search.query_multiple(rows, self._vector(text), file_ids, k, self.threshold, promoted=PROMOTED, profile=self.store.profile, collection=where)
        if hits is None or hits.isEmpty():
            raise lookup.NotFound("no documents for the query")
        return hits

    def embed_files(self, requests: DataFrame, folder: str, user: str, collection: str) -> dict[str, object]:
        records = stage(load(read_files(requests, folder)))  # files are read and parsed once
        failed = records.where("error IS NOT NULL").select("source", "error").limit(20).collect()
        report = ingest(self.store, records, user, collection, self.embedder)
        return report | {"unreadable": [tuple(r) for r in failed]}

    def context(self, file_id: str) -> DataFrame:
        rows = self.store.of_files([file_id])
        if rows is None or rows.isEmpty():
            raise lookup.NotFound(f"no documents for {file_id}")
        return ctx.assemble(rows, "file_id", "row_seq")

    def extract(self, requests: DataFrame, folder: str) -> DataFrame:
        return extract_text(load(read_files(requests, folder), raw=True))


def tables(spark: SparkSession, schema: str | None = None) -> list[str]:
    return sorted(t.name for t in (spark.catalog.listTables(schema) if schema else spark.catalog.listTables()))


def columns(spark: SparkSession, name: str) -> list[str]:
    """The columns of a table in their order."""
    return [c.name for c in spark.catalog.listColumns(name)]


def records(spark: SparkSession, name: str, allowed: Sequence[str], custom_id: str | None = None) -> DataFrame:
    """All rows of an allowed table, or those of one id."""
    if name not in allowed:
        raise ValueError(f"{name!r} may not be read")
    df = spark.table(name)
    return df if custom_id is None else df.where(F.col("custom_id") == custom_id)


def search_path(target: str, others: str = "", default: str = "public") -> list[str]:
    """The schemas in which names are looked up: those of a comma-separated list, ``target`` first and the default one last."""
    names = [s.strip() for s in [target, *others.split(","), default]]
    return list(dict.fromkeys(s for s in names if s))


def use_schemas(spark: SparkSession, target: str, others: str = "", default: str = "default") -> list[str]:
    """Look names up in ``target`` from here on; ``NotFound`` if it or one of the others doesn't exist. Gives the search path."""
    path = search_path(target, others, default)
    missing = [s for s in path if not spark.catalog.databaseExists(s)]
    if missing:
        raise lookup.NotFound(f"no schema {', '.join(missing)}")
    spark.catalog.setCurrentDatabase(path[0])
    return path


def find_table(spark: SparkSession, name: str, path: Sequence[str]) -> DataFrame:
    """The table of that name in the first schema of ``path`` that has one."""
    for schema in path:
        if spark.catalog.tableExists(f"{schema}.{name}"):
            return spark.table(f"{schema}.{name}")
    raise lookup.NotFound(f"no table {name}")
