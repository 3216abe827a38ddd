"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints at most 3 bits apart agree in one segment up to one
bit, so every fingerprint is stored under its two segments and looks up each segment's Hamming ball of radius 1; of the
two texts of a link, the one whose differing bit is 0 finds the other, which halves the probes. What a probe fetches is
kept only if the complete 64-bit distance is within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice, repeat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import salted_join, store, table, texts
from lodestone.llm.components import components

RADIUS = 3
SHINGLE_WORDS = 3
#: XXH64 seed of a shingle.
SEED = 42
#: A table bucket with more fingerprints than this is split by the other segment's halves instead of paired directly.
HOT_BUCKET = 256
_RUN = 1 << 16


def fingerprint(data: bytes) -> int:
    """The signed 64-bit SimHash of a UTF-8 text; 0 for a text without words. Memory is bounded by the word list."""
    import numpy as np
    import xxhash

    words = data.lower().split()  # bytes: lowers A-Z only, splits at 0x20 and 0x09-0x0D only
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(SHINGLE_WORDS))))
    counts, n = np.zeros(64, np.int64), 0
    for first in shingles:
        part = chain([first], islice(shingles, _RUN - 1))
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        fps = [fingerprint(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fps, pa.int64())], names=["doc_id", "key", "fp"])


def spanning(fps, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a forest with the same components as all links within the radius among distinct uint64 fingerprints."""
    import numpy as np

    out, left = [], np.unique(fps)
    while left.size:
        frontier, left = [left[0]], left[1:]
        while frontier and left.size:
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= radius
            found, left = left[near], left[~near]
            out += [(x, y) for y in found]
            frontier += list(found)
    return out


def links(fps: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """fps(fp long, distinct) -> (a, b): links of 3 or fewer differing bits, enough of them to join all that any joins.

    Buckets up to hot_bucket are paired in the JVM. Larger ones are split once more: their members meet in cells that
    share one 16-bit quarter of the other segment up to one bit; a cell spans 16 free bits, so its size has a bound that
    does not grow with the input, and it returns a spanning forest instead of all its pairs.
    """
    buckets = fps.select(
        "fp",
        F.explode(F.expr("array((fp & 4294967295L) * 2, shiftrightunsigned(fp, 32) * 2 + 1)")).alias("bucket"),
    )
    probes = buckets.select(
        "fp",
        F.explode(
            F.expr(
                "concat(array(bucket), transform(filter(sequence(1, 32), b -> (bucket & shiftleft(1L, b)) = 0),"
                " b -> bucket | shiftleft(1L, b)))"
            )
        ).alias("bucket"),
    )
    hot = store(buckets.groupBy("bucket").count().where(F.col("count") > hot_bucket).select("bucket"), "hot")
    split = not hot.isEmpty()
    cold, seek = (buckets.join(hot, "bucket", "left_anti"), probes.join(hot, "bucket", "left_anti")) if split else (buckets, probes)
    found = (
        seek.withColumnRenamed("fp", "a")
        .join(cold.withColumnRenamed("fp", "b"), "bucket")
        .where(f"a <> b and bit_count(a ^ b) <= {RADIUS}")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    if not split:
        return found

    def forest(pdf):
        import numpy as np
        import pandas as pd

        pairs = np.array(spanning(pdf["fp"].to_numpy().astype(np.uint64)), np.uint64).reshape(-1, 2).astype(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    cells = (
        probes.join(hot, "bucket", "left_semi")
        .withColumn("other", F.expr("if(bucket % 2 = 0, shiftrightunsigned(fp, 32), fp & 4294967295L)"))
        .select("fp", "bucket", F.explode(F.expr("array((other & 65535L) * 2, shiftrightunsigned(other, 16) * 2 + 1)")).alias("q"))
        .select(
            "fp",
            "bucket",
            F.explode(
                F.expr(
                    "concat(array(q), transform(filter(sequence(1, 16), b -> (q & shiftleft(1L, b)) = 0),"
                    " b -> q | shiftleft(1L, b)))"
                )
            ).alias("cell"),
        )
    )
    dense = cells.groupBy("bucket", "cell").applyInPandas(forest, "a long, b long")
    return found.unionByName(dense.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def text_key(text: Column) -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")).cast("binary"))


def _groups(docs: DataFrame, hot_bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key, fp) of every row; (fp, rep, head, n) of every fingerprint; (fp, root) of those with links.

    rep is the smallest doc_id of a fingerprint; head names its first row: by doc_id, null last, then by key.
    """
    rows = texts(docs).withColumn("key", text_key(F.col("text")))
    found = store(rows.mapInArrow(_fingerprints, "doc_id long, key long, fp long"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    nodes = store(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), first.alias("head"), F.count(F.lit(1)).alias("n")), "nodes")
    return found, nodes, components(links(nodes.select("fp"), hot_bucket)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null text counts as empty; texts without words share fingerprint zero and link like any others. Equal fingerprints
    are one node of the link graph, so copies are never paired. component_id is the smallest doc_id reachable through
    links of at most 3 bits (null ids are passed over; a group of null ids only has component null). Repeated rows come
    out repeated. Other columns are ignored. An empty table gives no rows.
    """
    found, nodes, stars = _groups(docs, hot_bucket)
    least = stars.join(nodes, "fp").groupBy("root").agg(F.min("rep").alias("component"))
    linked = stars.join(least, "root").select("fp", "component")
    shared = (
        nodes.join(linked, "fp", "left")
        .where("n > 1 or component is not null")
        .select("fp", F.coalesce("component", "rep").alias("component"))
    )
    return salted_join(found, shared, "fp", F.col("doc_id")).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def first_of_groups(docs: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """docs without all but one row of each group of near duplicates; all columns as they are.

    The row with the smallest doc_id stays (null ids come last; of different texts under that id the one with the
    smallest hash). Rows that share an id are told apart by their texts; of rows that share both, one stays.
    """
    found, nodes, stars = _groups(docs, hot_bucket)
    least = stars.join(nodes, "fp").groupBy("root").agg(F.min("head").alias("first"))
    linked = stars.join(least, "root").select("fp", "first")
    shared = nodes.join(linked, "fp", "left").where("n > 1 or first is not null").select("fp", F.coalesce("first", "head").alias("first"))
    judged = store(salted_join(found, shared, "fp", F.struct("doc_id", "key"), "inner"), "judged")
    stays = judged["doc_id"].eqNullSafe(F.col("first.doc_id")) & (judged["key"] == F.col("first.key"))
    gone = judged.where(~stays).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    again = store(judged.where(stays).groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")), "again")

    def same(other: DataFrame) -> Column:
        return docs["doc_id"].cast("long").eqNullSafe(other["__id"]) & (text_key(docs["text"]) == other["__key"])

    left = docs.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return left.select(docs.columns)
    once = left.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, same(again), "left_anti").unionByName(once).select(docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every near-duplicate group: first_of_groups."""
    return first_of_groups(docs)
