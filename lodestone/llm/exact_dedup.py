"""Exact deduplication by a stateful stream, in DataFrame and SQL functions only.

Arrivals (digest, identifier, content locator) stream into keyed state on disk (RocksDB) that never expires: per digest
the stable identifier that stays, where its content lies, and how many rows arrived. A later run with the same folder
goes on from that state. Whatever hits (a digest with more than one arrival) has its full bytes compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import SALTS, salted_join, scratch, store, table

#: The state store on disk. Without pre-allocated manifests an empty partition of it takes kilobytes, not 4 MB.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fold(arrivals: DataFrame, state_dir: str) -> DataFrame:
    """Fold a stream of arrivals(digest, doc_id, seq, locator) into the state kept in state_dir; return the state.

    State per digest: head (the arrival with the largest doc_id; among repeated rows of it the last seq) and n. There is
    no watermark, so nothing expires; running again with more arrivals and the same state_dir continues the counts.
    """
    spark = arrivals.sparkSession
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        (
            arrivals.groupBy("digest")
            .agg(F.max(F.struct("doc_id", "seq", "locator")).alias("head"), F.count(F.lit(1)).alias("n"))
            .writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", state_dir)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
        state = spark.read.format("statestore").load(state_dir)
        head, n = state.schema["value"].dataType.names
        return state.select(
            F.col("key.digest").alias("digest"), F.col(f"value.{head}").alias("head"), F.col(f"value.{n}").alias("n")
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(docs: DataFrame, digest=sha256) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest doc_id stays
    (null ids come last; of repeated rows with that same id exactly one is marked kept). digest is the key of the state;
    a digest that different texts share is found by the byte comparison and its texts are grouped by the bytes
    themselves. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    path = scratch(spark, "arrivals")
    keyed = whole.select(
        "doc_id",
        digest(F.col("text")).alias("digest"),
        sha256(F.col("text")).alias("sha"),
        F.monotonically_increasing_id().alias("seq"),
        F.input_file_name().alias("locator"),
    )
    keyed.write.parquet(path)
    arrived = spark.read.schema(keyed.schema).parquet(path)
    stream = spark.readStream.schema(keyed.schema).parquet(path)
    heads = store(fold(stream.select("digest", "doc_id", "seq", "locator"), scratch(spark, "state")), "heads")
    hits = heads.where("n > 1").select("digest", "head", "n")

    # Full bytes of whatever hits: equal texts have equal smallest and largest bytes, per salt and then per digest.
    salted = hits.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    ends = (
        whole.select(
            F.col("text").cast("binary").alias("bytes"),
            digest(F.col("text")).alias("digest"),
            F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        )
        .join(salted, ["digest", "salt"])
        .groupBy("digest", "salt")
        .agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi"))
    )
    torn = store(
        ends.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("digest"),
        "torn",
    )
    out = salted_join(arrived, hits, "digest", F.col("seq"))
    if not torn.isEmpty():
        out = out.join(torn, "digest", "left_anti")
    out = out.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("head.seq") == F.col("seq"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    if torn.isEmpty():
        return out
    # Different texts under one digest: the bytes are the key. Only such texts come here.
    rows = whole.withColumn("seq", F.monotonically_increasing_id()).withColumn("digest", digest(F.col("text"))).join(torn, "digest", "left_semi")
    rows = store(rows, "torn-rows")
    own = rows.groupBy("text").agg(F.max(F.struct("doc_id", "seq")).alias("head"), F.count(F.lit(1)).alias("n"))
    return out.unionByName(
        salted_join(rows, own, "text", F.col("seq"), "inner").select(
            "doc_id",
            F.col("head.doc_id").alias("keep_id"),
            F.col("n").alias("group_size"),
            (F.col("head.seq") == F.col("seq")).alias("kept"),
            sha256(F.col("text")).alias("text_sha256"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text) AS keep_id,
       count(*) OVER (PARTITION BY text) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text) AS kept,
       text_sha256
FROM d
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts; of rows repeated under one id, one stays."""
    judged = store(exact_dedup(docs), "judged")
    gone = judged.where("not kept").select("doc_id", "text_sha256").distinct()
    again = gone.join(judged.where("kept").select("doc_id", "text_sha256"), ["doc_id", "text_sha256"], "left_semi")
    own = gone.join(again, ["doc_id", "text_sha256"], "left_anti")
    ids = own.where("doc_id is not null").select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__sha")).distinct()
    text = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    out = docs.join(ids, (docs["doc_id"] == ids["__gone"]) & (text == ids["__sha"]), "left_anti")
    # Rows repeated under one id (or without one) can only be told apart by dropping the repeats themselves.
    return out.select(docs.columns) if again.isEmpty() else out.dropDuplicates(["doc_id", "text"]).select(docs.columns)
