"""Python workers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let workers import this package from where the driver has it, whatever folder the session was started in.

    On a cluster without shared code the package is shipped with the job as usual; a path that isn't there does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    parts = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, root])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by the hash of its keys to as many tasks as a shuffle has, three a core at least.

    Work in Python isn't told by bytes: a table that Parquet holds in a few MB is read in one or two tasks, and Spark would
    merge small partitions again if their number weren't given.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)
