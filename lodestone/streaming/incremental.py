"""Incremental refresh driven by a stream of changed files.

Each micro-batch is compared with the stored hashes; deletes, changes and additions become a new snapshot. The stream's
checkpoint and the snapshots lie in shared folders, so a restart goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.merge import Snapshots, last_wins
from lodestone.operators.vectors import reindex_diff

SCHEMA = "path string, content string, deleted boolean, seq long"


def apply_changes(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """stored(path, hash, content) after a batch of SCHEMA: the last change of a path counts, equal content changes nothing."""
    last = last_wins(batch, "path", "seq").select("path", "content", "deleted", F.sha2("content", 256).alias("hash"))
    alive = last.where("not coalesce(deleted, false)").select("path", "hash", "content")
    if stored is None:
        return alive
    diff = reindex_diff(stored.select(F.col("path").alias("key"), "hash"), last.select(F.col("path").alias("key"), F.when(F.col("deleted"), None).otherwise(F.col("hash")).alias("hash")))
    touched = diff.where("change in ('changed', 'added')").select(F.col("key").alias("path"))
    return stored.join(touched, "path", "left_anti").unionByName(alive.join(touched, "path", "left_semi"))


def run_stream(spark: SparkSession, changes: str, state: str, after=None) -> StreamingQuery:
    """Fold the files of JSON change rows that are new in `changes` into the snapshots below `state`, then stop.

    after(snapshot DataFrame, epoch) is called for each batch; what it raises is kept in the table of failures and
    doesn't end the run. A batch that is run again after a crash gives the same snapshot.
    """
    snapshots, failures = Snapshots(spark, f"{state}/files"), f"{state}/failures"

    def each(batch: DataFrame, epoch: int) -> None:
        now = snapshots.write(apply_changes(snapshots.read(), batch))
        if after is not None:
            try:
                after(now, epoch)
            except Exception as error:  # noqa: BLE001 each step's failure is recorded, not fatal
                spark.createDataFrame([(epoch, repr(error)[:500])], "epoch long, error string").write.mode("append").json(failures)

    return (
        spark.readStream.schema(SCHEMA).json(changes).writeStream.foreachBatch(each)
        .option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    )


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type, late ones up to the watermark; works on a stream and on a table alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))


def progress(query: StreamingQuery) -> dict:
    """What the last batch did: its number, rows and rows per second."""
    p = query.lastProgress
    return {} if p is None else {"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p["processedRowsPerSecond"]}
