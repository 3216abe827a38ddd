"""Helpers shared by the llm operators: scratch tables in the shared folder, salted joins, Arrow batches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.workers import importable

#: Copies of the small side of a salted join; a key with a third of all rows is dealt to so many tasks.
SALTS = 32
#: Bounds of one Arrow batch: whole texts are long, so batches are short; a row beyond the bytes is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: A key with more rows than this is a hub, and what joins it is dealt to SALTS tasks.
HUB = 100_000

_own_root: str | None = None
_made: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the folder that driver and executors share.

    The folder is spark.checkpoint.dir, or one given to setCheckpointDir. Only where neither is set and the session is
    a local one (tests) a temporary folder is made and set as the session's checkpoint folder; on a cluster it's an error.
    """
    global _own_root
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        held = context._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _own_root is None:
            _own_root = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
        context.setCheckpointDir(_own_root)
        root = _own_root
    _made.append(f"{root.rstrip('/')}/lodestone-{what}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession, made: list[str] | None = None) -> None:
    """Delete the given scratch paths, or every one made so far; plans that read them can't run any more."""
    for name in _made[:] if made is None else made:
        _made.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Like store, with the path that holds the rows, so that it can be released."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def store(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here and a lost executor loses nothing."""
    return written(df, what)[0]


def alone(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> tuple[DataFrame, str]:
    """make()'s rows, written; all other scratch paths that came up meanwhile are released."""
    before = set(_made)
    out, path = written(make(), what)
    release(spark, [x for x in _made if x not in before and x != path])
    return out, path


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "left") -> DataFrame:
    """left joined to right on key, each key of left dealt to SALTS tasks by the hash of spread.

    right must be unique by key; its rows are repeated SALTS times, so a hot key of left never meets in one task.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    return (
        left.withColumn("__salt", salt)
        .join(right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "__salt"], how)
        .drop("__salt")
    )


def hub_join(left: DataFrame, right: DataFrame, key: str, spread: Column, hubs: DataFrame | None) -> DataFrame:
    """left inner joined to right on key, where only the keys in hubs (distinct, one column) are dealt to SALTS tasks.

    right must be unique by key. hubs has at most one row for HUB rows of left; whether it is broadcast is left to
    Spark's size check.
    """
    if hubs is None or hubs.isEmpty():
        return left.join(right, key)
    marked = hubs.select(key, F.lit(True).alias("__hub"))
    salt = F.when(F.col("__hub"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("__hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    many = left.join(marked, key, "left").withColumn("__salt", salt).drop("__hub")
    one = right.join(marked, key, "left").withColumn("__salt", F.explode(salts)).drop("__hub")
    return many.join(one, [key, "__salt"]).drop("__salt")


def short_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds, by rows and by bytes; called before any Python step is planned.

    The bounds are the same for all steps, so it doesn't matter when a plan is run.
    """
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the text's bytes; null counts as empty. Every other column is left behind, so none can clash."""
    short_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )


def keep_rows(docs: DataFrame, judge) -> DataFrame:
    """docs without the rows that judge(list of texts as bytes) -> list of bool turns down; all columns stay as they are."""
    short_batches(docs.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = batch.column("text").to_pylist()
            mask = judge([b"" if x is None else x.encode() for x in found])
            yield batch.filter(pa.array([bool(x) for x in mask], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
