"""Keyed upserts and cascades on snapshots: a new version is a plan over the old one, written to a path of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a curated term that an automatic run leaves alone.
GUARDED = ("display_name", "definition", "criticality", "ui_role", "domain_area", "nls_file")


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's values over old's by key: null in new keeps the old value; rows of either side alone stay. new must be unique by key."""
    n = new.select(F.col(key), *(F.col(c).alias(f"__new_{c}") for c in new.columns if c != key))
    value = lambda c: F.coalesce(f"__new_{c}", c) if c in new.columns else F.col(c)
    extra = [c for c in new.columns if c not in old.columns]
    return old.join(n, key, "full").select(key, *(value(c).alias(c) for c in old.columns if c != key), *(F.col(f"__new_{c}").alias(c) for c in extra))


def curated_merge(old: DataFrame, new: DataFrame, key: str = "term_id") -> DataFrame:
    """merge, but a curated row keeps its guarded columns; usage counts always follow the new run."""
    n = new.select(F.col(key), *(F.col(c).alias(f"__new_{c}") for c in new.columns if c != key))
    j = old.join(n, key, "full")
    held = F.coalesce(F.col("curated"), F.lit(False))
    out = []
    for c in old.columns:
        if c == key:
            out.append(F.col(c))
        elif c not in new.columns:
            out.append(F.coalesce(F.col(c), F.lit(False)).alias(c) if c == "curated" else F.col(c))
        elif c in GUARDED:
            out.append(F.when(held, F.col(c)).otherwise(F.coalesce(f"__new_{c}", c)).alias(c))
        else:
            out.append((held | F.coalesce(f"__new_{c}", F.lit(False)) if c == "curated" else F.coalesce(f"__new_{c}", c)).alias(c))
    return j.select(*out)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the largest order: hash aggregation with a partial step, no sort of groups."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def cascade_delete(gone: DataFrame, tables: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> dict[str, DataFrame]:
    """gone(fqn): every table without the rows that any of its class columns ties to a deleted class."""
    out = {}
    for name, (df, columns) in tables.items():
        for c in columns:
            df = df.join(gone.select(F.col("fqn").alias(c)), c, "left_anti")
        out[name] = df
    return out


def keep_curated(terms: DataFrame) -> DataFrame:
    """What stays before a full run."""
    return terms.where("curated")


def paths_to_classes(classes: DataFrame, paths: DataFrame) -> DataFrame:
    return classes.join(paths.select("source_path").distinct(), "source_path", "left_semi").select("fqn", "source_path", "content_hash")


class Snapshots:
    """Numbered versions of a table below a folder; a version is read only once it is complete."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._folder()
        if not fs.exists(path):
            return []
        found = []
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            done = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("v=") and fs.exists(done):
                found.append(int(name[2:]))
        return sorted(found)

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.root}/v={found[-1]}") if found else None

    def write(self, df: DataFrame, keep: int = 2) -> DataFrame:
        """Write the next version and drop all but the newest ones; the version that df reads is never overwritten."""
        found = self.versions()
        number = found[-1] + 1 if found else 1
        df.write.mode("overwrite").parquet(f"{self.root}/v={number}")
        path, fs = self._folder()
        for old in found[: len(found) + 1 - keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"v={old}"), True)
        return self.spark.read.parquet(f"{self.root}/v={number}")
