"""Hybrid retrieval: graph distance and vector similarity re-ranked under a token budget."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import hop_text
from lodestone.operators.graph import cone_with_hops
from lodestone.operators.vectors import top_k
from lodestone.plans.scratch import cut

VECTOR, GRAPH, RISK = 0.40, 0.35, 0.25
BUDGET = int(8000 * 0.9)
CONE_NODES = 50


def resolve(classes: DataFrame, query: str) -> tuple[str, list[str]]:
    """What a query means: ("fqn", [name]), ("ambiguous", names) or ("text", []). At most eleven names come to the driver."""
    found = [r["fqn"] for r in classes.where((F.col("fqn") == query) | (F.col("simple_name") == query)).select("fqn").orderBy("fqn").limit(11).collect()]
    if query in found:
        return "fqn", [query]
    return ("fqn" if len(found) == 1 else "ambiguous" if found else "text"), found


def final_score(similarity: Column, hop: Column, risk: Column) -> Column:
    """0.40 similarity + 0.35 / max(hop, 1) + 0.25 risk; without a path the graph part is 0."""
    return similarity * VECTOR + F.coalesce(F.lit(GRAPH) / F.greatest(hop, F.lit(1)), F.lit(0.0)) + F.coalesce(risk, F.lit(0.0)) * RISK


def rerank(hits: DataFrame, hops: DataFrame, risk: DataFrame, limit: int = 20, id_column: str = "vec_id") -> DataFrame:
    """hits(fqn, score, ...), hops(fqn, hop), risk(fqn, enhanced_risk) -> the best by the final score, of each query_id if
    the hits have one."""
    limit = max(1, min(100, limit))
    j = hits.join(hops, "fqn", "left").join(risk.select("fqn", "enhanced_risk"), "fqn", "left")
    j = j.withColumn("final_score", F.round(final_score(F.col("score"), F.col("hop"), F.col("enhanced_risk")), 6)).withColumn("path", hop_text(F.col("hop")))
    order = F.desc("final_score"), id_column
    if "query_id" in hits.columns:
        return j.withColumn("__at", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("__at") <= limit).drop("__at")
    return j.orderBy(*order).limit(limit)


def retrieve(points: DataFrame, query: DataFrame, edges: DataFrame, risk: DataFrame, focal: DataFrame | None = None, limit: int = 20, seeds: int = 3) -> DataFrame:
    """From a focal class (focal: one column node), or from the classes of the best hits: cones with the smallest hop, the
    nearest points inside them over-fetched threefold, then re-ranked."""
    if focal is None:
        if "query_id" in query.columns:
            raise ValueError("several queries need a focal class")
        focal = top_k(points, query, seeds).select(F.col("fqn").alias("node")).distinct()
    hops = cone_with_hops(edges, focal).select(F.col("node").alias("fqn"), "hop")
    hits = top_k(points.join(hops, "fqn", "left_semi"), query, 3 * limit)
    return rerank(hits, hops, risk, limit)


def cone_summary(cone: DataFrame, classes: DataFrame, risk: DataFrame, legacy: Column) -> DataFrame:
    """One row: cone size, legacy classes, mean risk of the cone's classes."""
    j = cone.select(F.col("node").alias("fqn")).join(classes.select("fqn", legacy.alias("legacy")), "fqn").join(risk.select("fqn", "enhanced_risk"), "fqn", "left")
    return j.agg(F.count(F.lit(1)).alias("cone_size"), F.count_if("legacy").alias("legacy_count"), F.avg("enhanced_risk").alias("avg_risk"))


def top_terms(cone: DataFrame, uses: DataFrame, k: int = 10) -> DataFrame:
    """The cone's commonest terms."""
    own = uses.join(cone.select(F.col("node").alias("fqn")), "fqn", "left_semi")
    return own.groupBy("term_id").agg(F.count(F.lit(1)).alias("classes")).orderBy(F.desc("classes"), "term_id").limit(k)


def token_budget(ranked: DataFrame, tokens: str = "tokens", rank: str = "rank", others: int = 0, budget: int = BUDGET, whole: int | None = None) -> DataFrame:
    """The rows that stay when the last ones are dropped until all fits: a row stays if what is dropped after it doesn't
    suffice. whole is the estimate for all rows as one list (their sum, if None). Ranges of the rank are summed each by
    itself and then moved on by the sum of the ranges behind, so only one row a range is ever ordered in one task."""
    parts = cut(ranked.repartitionByRange(rank).withColumn("__part", F.spark_partition_id()))
    sums = parts.groupBy("__part").agg(F.sum(tokens).alias("__own"))
    behind = F.sum("__own").over(W.orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1))
    total = F.lit(whole) if whole is not None else F.sum("__own").over(W.partitionBy(F.lit(1)))
    moved = sums.select("__part", (total + F.lit(others) - F.coalesce(behind, F.lit(0))).alias("__from"))
    tail = F.sum(tokens).over(W.partitionBy("__part").orderBy(F.desc(rank)).rowsBetween(W.unboundedPreceding, -1))
    left = parts.withColumn("__tail", F.coalesce(tail, F.lit(0))).join(moved, "__part")
    return left.where(F.col("__from") - F.col("__tail") <= budget).select(ranked.columns)


def completeness(cone: bool, risk: bool, terms: bool, rules: bool, chunks: bool) -> float:
    """Weight of the parts of a context that were found."""
    return round(0.25 * cone + 0.20 * risk + 0.15 * terms + 0.10 * rules + 0.30 * chunks, 2)


#: Parts of a context whose weight counts as soon as they could be read, and those that need rows.
READ_WEIGHTS, FOUND_WEIGHTS = {"terms": 0.15, "rules": 0.10}, {"cone": 0.25, "risk": 0.20, "chunks": 0.30}


@dataclass(frozen=True)
class Context:
    """What is known of a class, cut to a number of tokens; parts that failed are missing and told in warnings."""

    parts: dict[str, DataFrame]
    warnings: list[tuple[str, str]]
    completeness: float
    truncated: bool
    truncated_items: int


def assemble(parts: dict[str, Callable[[], DataFrame]], budget: int = BUDGET, cone_nodes: int = CONE_NODES) -> Context:
    """Every part is read by itself: one that fails gives a warning, and an empty cone or risk another.

    If all parts together take more tokens than the budget, chunks (with a column rank) are dropped from the last on, and
    if that doesn't suffice, the cone (with hop and node) is cut to its nearest nodes. A part's tokens are a quarter of
    its JSON list; a dropped chunk gives back those of its own JSON.
    """
    held, warnings, tokens = {}, [], {}
    size = F.length(F.to_json(F.struct("*")))
    for name, make in parts.items():
        try:
            df = cut(make())
            row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
        except Exception as error:  # noqa: BLE001 any failure of a part is a warning
            warnings.append((name, str(error).partition("\n")[0][:500]))
            continue
        if name in ("cone", "risk") and not row["n"]:
            warnings.append((name, f"nothing found for {name}"))
        held[name] = (df, row["n"])
        tokens[name] = (row["bytes"] + max(0, row["n"] - 1) + 2) // 4
    full = sum(w for k, w in READ_WEIGHTS.items() if k in held) + sum(w for k, w in FOUND_WEIGHTS.items() if k in held and held[k][1])
    out, total, dropped, truncated = {k: df for k, (df, _) in held.items()}, sum(tokens.values()), 0, False
    if total > budget and "chunks" in held:
        df, n = held["chunks"]
        kept = cut(token_budget(df.withColumn("tokens", F.floor(size / 4)), others=total - tokens["chunks"], budget=budget, whole=tokens["chunks"]))
        left = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
        dropped = n - left["n"]
        gone = df.agg(F.sum(F.floor(size / 4))).first()[0] or 0
        total, truncated, out["chunks"] = total - (gone - left["tokens"]), dropped > 0, kept.drop("tokens")
    if total > budget and "cone" in held and held["cone"][1] > cone_nodes:
        out["cone"], truncated = held["cone"][0].orderBy("hop", "node").limit(cone_nodes), True
    return Context(out, warnings, round(min(full, 1.0), 2), truncated, dropped)


def best_description(curated: Column, automatic: Column) -> Column:
    """A description by hand before one made automatically; blank ones don't count."""
    own = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(own(curated), own(automatic))


def context(points: DataFrame, query: DataFrame, edges: DataFrame, risk: DataFrame, fqn: str, limit: int = 20, budget: int = BUDGET) -> dict[str, DataFrame]:
    """The parts of a class's migration context; each is a plan of its own, chunks cut to the budget."""
    focal = query.sparkSession.createDataFrame([(fqn,)], "node string")
    hops = cone_with_hops(edges, focal)
    ranked = retrieve(points, query, edges, risk, focal, limit)
    ranked = ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc("final_score"), "vec_id"))).withColumn("tokens", F.floor(F.length(F.to_json(F.struct("fqn", "score"))) / 4))
    return {"cone": hops.orderBy("hop", "node").limit(CONE_NODES), "risk": risk.where(F.col("fqn") == fqn), "chunks": token_budget(ranked, budget=budget)}
