"""Module analytics, scheduling and pilot selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import dependent_counts, module_dependencies, waves

#: Labels of classes that the migration is about.
LEGACY = ("VaadinView", "VaadinComponent", "VaadinDataBinding")
HIGH = 0.7


def legacy(labels: str = "labels") -> Column:
    return F.arrays_overlap(labels, F.array(*map(F.lit, LEGACY)))


def module_summary(scored: DataFrame) -> DataFrame:
    """Per module: classes, legacy classes and share, mean risk, heat (share times mean), classes of high risk."""
    g = scored.where("module is not null and module <> ''").groupBy("module").agg(
        F.count(F.lit(1)).alias("class_count"), F.count_if(legacy()).alias("legacy_count"),
        F.avg(F.coalesce("enhanced_risk", F.lit(0.0))).alias("avg_risk"), F.count_if(F.col("enhanced_risk") > HIGH).alias("high_risk_count"),
    )
    share = F.col("legacy_count") / F.col("class_count")
    return g.select("module", "class_count", "legacy_count", share.alias("legacy_share"), "avg_risk", (share * F.col("avg_risk")).alias("heat"), "high_risk_count")


def risk_clusters(scored: DataFrame) -> DataFrame:
    return scored.where("module is not null and module <> ''").groupBy("module").agg(
        F.count(F.lit(1)).alias("class_count"), F.avg(F.coalesce("enhanced_risk", F.lit(0.0))).alias("avg_risk"),
        F.max(F.coalesce("enhanced_risk", F.lit(0.0))).alias("max_risk"), F.count_if(F.col("enhanced_risk") > HIGH).alias("high_risk_count"),
    )


def package_rollup(scored: DataFrame) -> DataFrame:
    return scored.groupBy("package_name").agg(F.count(F.lit(1)).alias("class_count"), F.avg("enhanced_risk").alias("avg_risk"))


def commit_counts(commits: DataFrame, days: int) -> DataFrame:
    """commits(ts, module) -> (module, commits) of the days before the newest commit."""
    newest = commits.agg(F.max("ts").alias("newest"))
    recent = commits.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.date_trunc("day", F.col("newest")) - F.expr(f"make_dt_interval({days})"))  # newest is one row
    return recent.groupBy("module").agg(F.count(F.lit(1)).alias("commits"))


def commit_modules(lines: DataFrame, prefix: str, part: int = 5) -> DataFrame:
    """lines(value) of a name-only log -> (module, commits): files below prefix, the module being that part of the path."""
    parts = F.split("value", "/")
    return lines.where(F.col("value").startswith(prefix) & (F.size(parts) > part)).groupBy(F.get(parts, F.lit(part)).alias("module")).agg(F.count(F.lit(1)).alias("commits"))


def schedule_scores(scored: DataFrame, dependents: DataFrame, commits: DataFrame) -> DataFrame:
    """Per module: 0.35 mean risk + 0.25 dependents + 0.2 commits + 0.2 log complexity, the last three by their maxima.

    The maxima are taken over one row per module.
    """
    g = scored.where("module is not null and module <> ''").groupBy("module").agg(
        F.count(F.lit(1)).alias("class_count"), F.avg(F.coalesce("enhanced_risk", F.lit(0.0))).alias("avg_risk"),
        F.avg(F.coalesce("complexity_sum", F.lit(0)).cast("double")).alias("avg_complexity"),
    )
    j = g.join(dependents, "module", "left").join(commits, "module", "left").na.fill(0, ["dependents", "commits"])
    top = j.agg(F.max("dependents").alias("td"), F.max("commits").alias("tc"), F.max("avg_complexity").alias("tx"))
    part = lambda x, most: F.least(x / F.when(most > 0, most).otherwise(1), F.lit(1.0))
    j = j.crossJoin(F.broadcast(top))  # one row
    risk, dep = F.col("avg_risk") * 0.35, part(F.col("dependents"), F.col("td")) * 0.25
    freq, cc = part(F.col("commits"), F.col("tc")) * 0.2, part(F.log1p("avg_complexity"), F.log1p("tx")) * 0.2
    return j.select(
        "module", "class_count", "avg_risk", "avg_complexity", "dependents", "commits", risk.alias("risk_part"), dep.alias("dependents_part"),
        freq.alias("commits_part"), cc.alias("complexity_part"), (risk + dep + freq + cc).alias("score"),
    )


def recommend_schedule(scored: DataFrame, depends: DataFrame, commits: DataFrame) -> DataFrame:
    """Modules by wave and then score, with a sentence why; an empty graph gives no rows."""
    edges = module_dependencies(scored, depends).select(F.col("source_module").alias("src"), F.col("target_module").alias("dst"))
    ranked = schedule_scores(scored, dependent_counts(scored, depends), commits).join(waves(scored.where("module <> ''").select("module"), edges), "module")
    grade = lambda x, a, b, c: F.when(x < 0.3, a).when(x < 0.6, b).otherwise(c)
    why = F.format_string(
        "mean risk %.2f is %s; %d modules depend on it, %d commits touched it, mean complexity %.1f: %s", "avg_risk", grade(F.col("avg_risk"), "low", "middling", "high"),
        "dependents", "commits", "avg_complexity", grade(F.col("score"), "take it early", "take it in the middle", "leave it for late"),
    )
    return ranked.withColumn("rationale", why).orderBy("wave", "score", "module")


def pilot_recommend(scored: DataFrame, limit: int = 5, least: int = 5) -> DataFrame:
    """Modules of at least five classes by 0.4 legacy share + 0.3 deviation of risk + 0.3 if 15 to 40 classes."""
    risk = F.coalesce("enhanced_risk", F.lit(0.0))
    g = scored.where("module is not null and module <> ''").groupBy("module").agg(
        F.count(F.lit(1)).alias("class_count"), F.count_if(legacy()).alias("legacy_count"), F.avg(risk).alias("avg_risk"),
        F.coalesce(F.stddev_samp(risk), F.lit(0.0)).alias("risk_diversity"),
    ).where(F.col("class_count") >= least)
    ideal = F.col("class_count").between(15, 40)
    score = F.col("legacy_count") / F.col("class_count") * 0.4 + F.col("risk_diversity") * 0.3 + F.when(ideal, 0.3).otherwise(0.0)
    why = F.concat(
        F.format_string("%d of %d classes are to be migrated; risk deviates by %.3f; ", "legacy_count", "class_count", "risk_diversity"),
        F.when(ideal, "an ideal size for a pilot").otherwise("a pilot had better have 15 to 40 classes"),
    )
    return g.withColumn("score", F.round(score, 9)).withColumn("rationale", why).orderBy(F.desc("score"), "module").limit(limit)


def pilot_validate(scored: DataFrame, uses: DataFrame, chunks: DataFrame, module: str) -> DataFrame:
    """The five checks of a module: (check, status, value); ready is true on all of them iff none fails."""
    own = scored.where(F.col("module") == module)
    sums = own.agg(F.count(F.lit(1)).alias("classes"), F.count_if(legacy()).alias("legacy"), F.count_if(F.expr("enhanced_risk is null or enhanced_risk = 0")).alias("unscored"))
    terms = uses.join(own.select("fqn"), "fqn", "left_semi").agg(F.countDistinct("term_id").alias("terms"), F.countDistinct("fqn").alias("covered"))
    points = chunks.where(F.col("module") == module).agg(F.count(F.lit(1)).alias("points"))
    one = sums.crossJoin(terms).crossJoin(points)  # one row each
    rows = one.selectExpr(
        "stack(5, 'class_count', case when classes >= 15 then 'PASS' else 'FAIL' end, classes,"
        " 'legacy_classes', case when legacy > 0 then 'PASS' else 'FAIL' end, legacy,"
        " 'vector_chunks', case when points > 0 then 'PASS' else 'WARN' end, points,"
        " 'business_terms', case when terms > 0 then 'PASS' else 'WARN' end, terms,"
        " 'risk_scores', case when unscored = 0 then 'PASS' else 'WARN' end, unscored) as (check, status, value)",
        "legacy > 0 and classes >= 15 as ready",
        "case when classes > 0 then 100.0D * covered / classes else 0.0D end as term_coverage",
    )
    return rows


def pilot_report(checks: DataFrame, module: str) -> DataFrame:
    """A markdown table of pilot_validate's rows; five rows, so one list."""
    line = F.concat(F.lit("| "), "check", F.lit(" | "), "status", F.lit(" | "), F.col("value").cast("string"), F.lit(" |"))
    return checks.groupBy().agg(
        F.concat_ws("\n", F.lit(f"# Pilot validation: {module}"), F.lit("| Check | Status | Value |"), F.lit("|---|---|---|"), F.array_sort(F.collect_list(line)),
                    F.when(F.bool_and("ready"), "**READY**").otherwise("**NOT READY**")).alias("markdown")
    )


def lexicon_coverage(terms: DataFrame) -> DataFrame:
    """One row: terms, curated ones, their percentage (0 without terms)."""
    g = terms.agg(F.count(F.lit(1)).alias("total"), F.count_if("curated").alias("curated"))
    return g.withColumn("coverage", F.when(F.col("total") > 0, F.col("curated") * 100.0 / F.col("total")).otherwise(0.0))


def backfill_modules(classes: DataFrame, by_path: DataFrame | None = None, suite: str | None = None) -> DataFrame:
    """classes with module filled: the path map's, else the path rule's, else the package rule's, where one isn't blank."""
    from lodestone.functions.text import module_from_package, module_from_path

    blank = lambda c: F.when(F.trim(c) == "", None).otherwise(c)
    out = classes
    if by_path is not None:
        out = out.join(by_path.select("source_path", F.col("module").alias("__mapped")), "source_path", "left")
    else:
        out = out.withColumn("__mapped", F.lit(None).cast("string"))
    found = F.coalesce(blank(F.col("__mapped")), blank(module_from_path(F.col("source_path"), suite)), blank(module_from_package(F.col("package_name"), suite)), F.col("module"))
    return out.withColumn("module", found).drop("__mapped").select(classes.columns)
