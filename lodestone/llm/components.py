"""Connected components of a distributed edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm.common import hub_join, release, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges(a long, b long) -> (node, root): one row per node that has an edge; root is the component's smallest node.

    Each round hangs every neighbour below the smallest one it can see; rounds grow with the logarithm of the
    longest chain. Minima are combined before the shuffle, the edges of a hub (more than common.HUB neighbours) are
    dealt to many tasks where they meet its minimum, and each round's edges are written to the shared folder, where the
    round before is deleted. Self links and repeated links are ignored; no edges give no rows. Raises if max_rounds
    rounds don't suffice, rather than return a partial answer.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = written(pairs, "edges")
    state = _state(e)
    for _ in range(max_rounds if state[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_path = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "low")
        hubs = low.where(F.col("n") > common.HUB).select("u")
        large = hub_join(both.where("v > u"), low.select("u", "m"), "u", F.col("v"), hubs)
        large, large_path = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        floor = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        hubs = floor.where(F.col("n") > common.HUB).select("u")
        floor = floor.select("u", "m")
        small = hub_join(large, floor, "u", F.col("v"), hubs).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = path
        e, path = written(small.unionByName(floor.withColumnRenamed("m", "v")).distinct(), "stars")
        release(spark, [old, low_path, large_path])
        if (after := _state(e)) == state:
            break
        state = after
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
