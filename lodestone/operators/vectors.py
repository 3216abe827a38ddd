"""Vector operators: exact cosine search, chunking and keyed re-indexing. Scores are JVM expressions over arrays."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import module_from_package, terms_json, uuid5
from lodestone.plans.scratch import cut
from lodestone.plans.workers import importable

#: Order in which a class's stereotype is picked.
PRIORITY = ("Service", "Repository", "VaadinView", "Controller")
#: Vectors of a block of points and of a block of queries.
POINT_BLOCK, QUERY_BLOCK = 2048, 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """b_norm is b's length, where it is known beforehand."""
    norm = F.sqrt(dot(a, a)) * (F.sqrt(dot(b, b)) if b_norm is None else b_norm)
    return F.when(norm > 0, dot(a, b) / norm)


def top_k(points: DataFrame, query: DataFrame, k: int = 10, id_column: str = "vec_id", **equals: str | list[str] | None) -> DataFrame:
    """The k points nearest to the query vector by cosine; keyword filters (a value, or a list of which any fits) and
    membership apply before scoring.

    query has one row with a column vector (more rows are an error), or any number of rows with query_id and vector: then
    each query gets its own k, in rows that begin with query_id. Each partition keeps its own best k, so only those are
    shuffled.
    """
    for column, value in equals.items():
        if value is not None:
            points = points.where(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    if "query_id" in query.columns:
        return _top_k_each(points, query.select("query_id", "vector"), k, id_column)
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several query vectors need a query_id"))).otherwise(F.first("vector"))
    q = query.agg(one.alias("__q"), F.count(F.lit(1)).alias("__n")).where("__n > 0").select("__q", F.sqrt(dot(F.col("__q"), F.col("__q"))).alias("__norm"))
    scored = points.crossJoin(F.broadcast(q)).withColumn("score", F.round(cosine(F.col("vector"), F.col("__q"), F.col("__norm")), 6)).drop("__q", "__norm")  # one row
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def _top_k_each(points: DataFrame, queries: DataFrame, k: int, id_column: str) -> DataFrame:
    """Every query against all points, a block of queries at a time as products of matrices.

    A partition passes on the points whose product reaches the k best it has seen (less what rounding can turn); the
    score itself is the expression of the single search, taken over those few only. Each block's points are written to
    the checkpoint folder, so the driver and the workers never hold more than a block of queries.
    """
    spark = points.sparkSession
    importable(spark)
    types = {x: df.schema[x].dataType.simpleString() for df, x in ((queries, "query_id"), (points, id_column))}

    def unit(vectors):
        """Rows of length 1, and which have a direction at all."""
        import numpy as np

        size = max((len(x) for x in vectors if x is not None), default=0)
        v = np.array([[0.0] * size if x is None else x for x in vectors], float).reshape(len(vectors), size)
        n = np.sqrt((v * v).sum(axis=1))
        return v / np.where(n > 0, n, 1)[:, None], n > 0

    def nearest(block):
        held = spark.sparkContext.broadcast(([r["query_id"] for r in block], *unit([r["vector"] for r in block])))

        def run(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa

            ids, q, q_ok = held.value
            ids, top = pa.array(ids), np.full((len(q), k), -np.inf)
            for batch in batches:
                for at in range(0, batch.num_rows, POINT_BLOCK):
                    part = batch.slice(at, POINT_BLOCK)
                    p, p_ok = unit(part.column("vector").to_pylist())
                    scores = np.where(q_ok[:, None] & p_ok, q @ p.T, -2.0) if p.shape[1] == q.shape[1] else np.full((len(q), len(p)), -2.0)
                    both = np.hstack([top, scores])
                    top = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                    row, col = np.nonzero(scores >= top.min(axis=1)[:, None] - 2e-6)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), part.column("point").take(pa.array(col))], names=["query_id", "point"])

        found = cut(points.select(F.col(id_column).alias("point"), "vector").mapInArrow(run, f"query_id {types['query_id']}, point {types[id_column]}").distinct())
        held.destroy()
        return found

    near, rows = spark.createDataFrame([], f"query_id {types['query_id']}, point {types[id_column]}"), queries.toLocalIterator()
    while block := list(islice(rows, QUERY_BLOCK)):
        near = near.unionByName(nearest(block))
    scored = (
        points.join(near.withColumnRenamed("point", id_column), id_column)
        .join(queries.withColumnRenamed("vector", "__q"), "query_id")
        .withColumn("score", F.round(cosine(F.col("vector"), F.col("__q")), 6))
    )
    best = scored.withColumn("__at", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), id_column))).where(F.col("__at") <= k)
    return best.select("query_id", *points.columns, "score")


def top_k_within(points: DataFrame, members: DataFrame, query: DataFrame, k: int = 10, id_column: str = "vec_id") -> DataFrame:
    """top_k among the points of the members given by fqn."""
    return top_k(points.join(members.select("fqn").distinct(), "fqn", "left_semi"), query, k, id_column)


def stereotype(labels: Column) -> Column:
    return F.get(F.filter(F.array(*map(F.lit, PRIORITY)), lambda x: F.array_contains(labels, x)), F.lit(0))


#: Scores that a point carries, and labels of what has to be migrated.
SCORES = ("structural_risk", "enhanced_risk", "domain_criticality", "security_sensitivity", "financial_involvement", "business_rule_density")
LEGACY = ("VaadinView", "VaadinComponent", "VaadinDataBinding")


def points(
    classes: DataFrame, methods: DataFrame, depends: DataFrame, uses: DataFrame, calls: DataFrame, terms: DataFrame,
    implements: DataFrame, scores: DataFrame, texts: DataFrame,
) -> DataFrame:
    """The whole points of an index: chunk, with the text, the scores (0 where unknown), the classes that depend on this
    one (callers), the interfaces it implements (implementors), its terms as JSON, and what of it has to be migrated.

    texts(fqn, method_id, text) says which chunks there are: a class without a source path, or whose source isn't there,
    has none. A blank module is derived from the package.
    """
    gather = lambda df, key, value, name: df.groupBy(F.col(key).alias("fqn")).agg(F.array_sort(F.collect_set(value)).alias(name))
    named = uses.join(terms.select("term_id", "display_name"), "term_id").groupBy("fqn").agg(F.array_sort(F.collect_set(F.struct("term_id", "display_name"))).alias("domain_terms"))
    chunks = chunk(classes, methods, depends, uses, calls).drop("callers")
    legacy = F.array_intersect("labels", F.array(*map(F.lit, LEGACY)))
    about = classes.select("fqn", F.coalesce(F.when(F.trim("module") != "", F.col("module")), module_from_package(F.col("package_name"))).alias("module"), legacy.alias("legacy_labels"))
    out = chunks.drop("module").join(about.hint("merge"), "fqn").join(scores.select("fqn", *SCORES).hint("merge"), "fqn", "left").na.fill(0.0, list(SCORES))
    for df, name in ((gather(depends, "dst", "src", "callers"), "callers"), (gather(implements, "src", "dst", "implementors"), "implementors")):
        out = out.join(df.hint("merge"), "fqn", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    out = out.join(named.hint("merge"), "fqn", "left").withColumn("domain_terms", terms_json(F.col("domain_terms"))).withColumn("legacy", F.size("legacy_labels") > 0)
    said = texts.select(F.col("fqn").alias("__fqn"), F.col("method_id").alias("__method"), "text")
    return out.join(said.hint("merge"), (out["fqn"] == said["__fqn"]) & out["method_id"].eqNullSafe(said["__method"])).drop("__fqn", "__method")


def chunk(classes: DataFrame, methods: DataFrame, depends: DataFrame, uses: DataFrame, calls: DataFrame) -> DataFrame:
    """One header chunk per class with a source path and one per method, with the neighbours' sorted lists; ids are
    name-based UUIDs.

    Every list is gathered once for all classes instead of by a query per class.
    """
    if "source_path" in classes.columns:
        classes = classes.where("source_path is not null")
    gather = lambda df, key, value, name: df.groupBy(F.col(key).alias("fqn")).agg(F.array_sort(F.collect_set(value)).alias(name))
    base = classes.select("fqn", "module", "content_hash", stereotype(F.col("labels")).alias("stereotype"))
    for df, key, value, name in ((depends, "src", "dst", "dependencies"), (uses, "fqn", "term_id", "terms"), (calls, "dst", "src", "callers"), (calls, "src", "dst", "callees")):
        base = base.join(gather(df, key, value, name).hint("merge"), "fqn", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    head = uuid5(F.concat("fqn", F.lit("#CLASS_HEADER")))
    headers = base.select(head.alias("point_id"), F.lit("CLASS_HEADER").alias("chunk_type"), F.lit(None).cast("string").alias("method_id"), head.alias("header_id"), *base.columns)
    own = base.join(methods.select("fqn", "method_id").hint("merge"), "fqn")
    return headers.unionByName(own.select(uuid5(F.col("method_id")).alias("point_id"), F.lit("METHOD").alias("chunk_type"), "method_id", head.alias("header_id"), *base.columns))


def reindex_diff(stored: DataFrame, current: DataFrame, key: str = "key") -> DataFrame:
    """(key, change): stored and current hashes compared; of several stored hashes of a key the smallest counts, and a null
    current hash counts as changed."""
    s = stored.groupBy(key).agg(F.min("hash").alias("old"))
    j = s.withColumn("__s", F.lit(1)).join(current.select(key, F.col("hash").alias("new"), F.lit(1).alias("__c")), key, "full")
    change = F.when(F.col("__s").isNull(), "added").when(F.col("__c").isNull(), "deleted").when(F.col("new").isNull() | ~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.select(key, change.otherwise("unchanged").alias("change"))


def upsert_points(points: DataFrame, changes: DataFrame, id_column: str = "point_id") -> DataFrame:
    return points.join(changes.select(id_column), id_column, "left_anti").unionByName(changes)


def delete_by_class(points: DataFrame, gone: DataFrame) -> DataFrame:
    return points.join(gone.select("fqn"), "fqn", "left_anti")


def module_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("module").agg(F.count(F.lit(1)).alias("points"))


def embed(texts: DataFrame, text: str = "text", size: int = 384) -> DataFrame:
    """A vector per text for use without a model: signed counts of hashed words, scaled to length 1."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    h = F.transform(words, lambda w: F.xxhash64(w))
    spread = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(h, F.lit(0.0), lambda s, x: s + F.when(F.pmod(x, F.lit(size)) == i, F.when(x > 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    raw = texts.withColumn("__v", spread)
    norm = F.sqrt(dot(F.col("__v"), F.col("__v")))
    return raw.withColumn("vector", F.when(norm > 0, F.transform("__v", lambda x: x / norm)).otherwise(F.col("__v"))).drop("__v")
