"""Cutting lineage in the folder that driver and executors share.

What is cut is written as Parquet, so a lost executor costs nothing, later plans are short and read only the columns that
they need, and Spark knows the sizes by which it chooses joins.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: str | None = None
_made: list[str] = []


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the folder given to setCheckpointDir; for a local session without either one of our own."""
    global _own
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if not found:
        held = context._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="lodestone-graph-")
            atexit.register(shutil.rmtree, _own, ignore_errors=True)
        context.setCheckpointDir(_own)
        found = _own
    return found.rstrip("/")


def ready(spark: SparkSession) -> None:
    """Make sure that the session has a checkpoint folder."""
    root(spark)


@dataclass(frozen=True)
class Table:
    """Rows written to the shared folder, how many there are and how many bytes they take."""

    df: DataFrame
    path: str
    rows: int
    size: int


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def table(df: DataFrame) -> Table:
    """df, computed and written in one job, which also counts its rows."""
    spark, seen = df.sparkSession, Observation()
    path = f"{root(spark)}/lodestone-graph-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    _made.append(path)
    p, fs = _folder(spark, path)
    return Table(spark.read.schema(df.schema).parquet(path), path, seen.get["n"], fs.getContentSummary(p).getLength())


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder."""
    return table(df).df


def release(spark: SparkSession, *tables: Table) -> None:
    """Delete these tables, or without any all that were cut so far; plans that read them can't run any more."""
    for path in [t.path for t in tables] or _made[:]:
        p, fs = _folder(spark, path)
        fs.delete(p, True)
        _made.remove(path)
