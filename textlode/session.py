"""Session helpers: table access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it on their path; once a context."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    where = tempfile.mkdtemp(prefix="textlode-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{where}/{root.name}", "zip", root.parent, root.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or, only where that is unset, a
    temporary one (tests and other single-machine sessions)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="textlode-")
        spark.conf.set("spark.checkpoint.dir", where)
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where.rstrip("/")


_open: list[list[str]] = []


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside the block are removed at its end: for who writes a result and then needs nothing of it.

    >>> with intermediate(spark):
    ...     near_duplicates(df, "uuid", "document").write.parquet(path)
    """
    _open.append([])
    try:
        yield
    finally:
        for name in _open.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and the files outlive any executor. They stay until the
    innermost ``intermediate`` block ends, or for good outside of one (a temporary folder goes with the process). Filters on the columns ``by``, of few
    values, then read the files of those values only."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}.parquet"
    if _open:
        _open[-1].append(path)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
