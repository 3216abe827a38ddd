"""Migration rules and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.graph import _side, ancestors, transitive_ancestors
from lodestone.plans.scratch import table

#: Package parts of code that summaries leave out.
EXCLUDED = ("castor", "persistentObjects", "businessObjects", "com4j")
OVERRIDE, CALLS, WRAPPER_CALLS, BINDING, COMPONENT, ASSISTED = 0.3, 0.3, 0.2, 0.2, 0.2, 0.4


def included(classes: DataFrame) -> DataFrame:
    """Without the excluded packages; a null package is left out too."""
    out = F.lit(False)
    for x in EXCLUDED:
        out = out | F.col("package_name").contains(x)
    return classes.where(~out)


def overlay(*books: DataFrame) -> DataFrame:
    """Rule books of rising priority, each with (source, ...) and an own order pos: the last book's rule replaces an
    earlier one of the same source and takes its place; new sources follow."""
    rows = None
    for k, book in enumerate(books):
        b = book.withColumn("__prio", F.lit(k)).withColumn("is_base", F.lit(k == 0))
        rows = b if rows is None else rows.unionByName(b)
    fields = [c for c in rows.columns if c not in ("source", "pos", "__prio")]
    g = rows.groupBy("source").agg(F.max_by(F.struct(*fields), F.struct("__prio", "pos")).alias("r"), F.min(F.struct("__prio", "pos")).alias("place"))
    return g.select("source", "r.*", F.col("place.__prio").alias("book"), F.col("place.pos").alias("pos"))


def classify_imports(imports: DataFrame, rules: DataFrame, framework: str, modern: str, wrappers: str | None = None) -> DataFrame:
    """imports(fqn, import_name) -> (fqn, import_name, action_type, target, automatable).

    The first that fits: a mapped rule of that very name; a package rule whose source the name begins with (the first by
    pos), the rest of the name going to its target; an unknown name of the framework, or of the wrappers; else no row.
    Package rules are matched by equality with each dotted beginning of the name. What the distinct names come to is
    written when this is called; if it is small, imports are not shuffled by names that very many of them share.
    """
    exact = rules.where("status <> 'NEEDS_MAPPING' and category <> 'PACKAGE'").select(F.col("source").alias("import_name"), F.struct("action_type", "target", "automatable").alias("exact"))
    dots = F.split("import_name", r"\.")
    begins = F.transform(F.sequence(F.lit(1), F.size(dots)), lambda k: F.array_join(F.slice(dots, 1, k), "."))
    distinct = imports.select("import_name").distinct()
    heads = distinct.select("import_name", F.explode(F.flatten(F.transform(begins, lambda b: F.array(b, F.concat(b, F.lit(".")))))).alias("source"))
    prefix = (
        heads.join(rules.where("category = 'PACKAGE'").select("source", F.col("target").alias("to"), "pos"), "source")
        .groupBy("import_name").agg(F.min_by(F.struct("source", "to"), "pos").alias("p"))
    )
    unknown = F.col("import_name").startswith(framework) & ~F.col("import_name").startswith(modern)
    if wrappers:
        unknown = unknown | F.col("import_name").startswith(wrappers)
    moved = F.concat("p.to", F.expr("substring(import_name, length(p.source) + 1)"))
    action = F.coalesce(
        F.col("exact"),
        F.when(F.col("p").isNotNull(), F.struct(F.lit("CHANGE_PACKAGE").alias("action_type"), moved.alias("target"), F.lit("YES").alias("automatable"))),
        F.when(unknown, F.struct(F.lit("COMPLEX_REWRITE").alias("action_type"), F.lit("Unknown").alias("target"), F.lit("NO").alias("automatable"))),
    )
    judged = distinct.join(exact, "import_name", "left").join(prefix, "import_name", "left").select("import_name", action.alias("a")).where("a is not null")
    judged = table(judged)
    return imports.join(_side(judged, judged.df), "import_name").select("fqn", "import_name", "a.action_type", "a.target", "a.automatable")


def override_counts(pairs: DataFrame, methods: DataFrame) -> DataFrame:
    """pairs(fqn, ancestor), methods(fqn, name) -> (fqn, ancestor, overrides): the class's methods named like one of the ancestor's."""
    theirs = pairs.join(methods.select(F.col("fqn").alias("ancestor"), "name").distinct(), "ancestor")
    return theirs.join(methods.select("fqn", "name"), ["fqn", "name"]).groupBy("fqn", "ancestor").agg(F.count(F.lit(1)).alias("overrides"))


def transitive_migrations(
    classes: DataFrame, extends: DataFrame, actions: DataFrame, rules: DataFrame, methods: DataFrame, calls: DataFrame,
    framework: str, modern: str, wrappers: str = "\0",
) -> DataFrame:
    """Inherited actions: one per class and rule-named ancestor that the class has no own action from, all at once.

    complexity = min(1, 0.3 overrides + 0.3 calls into the framework + 0.2 calls of wrappers + 0.2 own binding + 0.2 own
    component); up to 0.4 it is PARTIAL, beyond NO; a pure wrapper has none.
    """
    pairs = transitive_ancestors(extends, rules, actions)
    over = override_counts(pairs, methods)
    old = F.col("dst").startswith(framework) & ~F.col("dst").startswith(modern)
    called = calls.groupBy(F.col("src").alias("fqn")).agg(
        F.countDistinct(F.when(old, F.col("dst"))).alias("calls"), F.countDistinct(F.when(F.col("dst").startswith(wrappers), F.col("dst"))).alias("wrapper_calls")
    )
    j = pairs.join(classes.select("fqn", "labels"), "fqn").join(over, ["fqn", "ancestor"], "left").join(called, "fqn", "left").na.fill(0, ["overrides", "calls", "wrapper_calls"])
    raw = (
        F.col("overrides") * OVERRIDE + F.col("calls") * CALLS + F.col("wrapper_calls") * WRAPPER_CALLS
        + F.when(F.array_contains("labels", "VaadinDataBinding"), BINDING).otherwise(0.0) + F.when(F.array_contains("labels", "VaadinComponent"), COMPONENT).otherwise(0.0)
    )
    x = F.round(F.least(raw, F.lit(1.0)), 9)
    return j.select(
        F.concat("fqn", F.lit("#INHERITED#"), "ancestor").alias("action_id"), "fqn", F.col("ancestor").alias("source"), F.lit(True).alias("is_inherited"),
        "overrides", "calls", "wrapper_calls", x.alias("complexity"), (x == 0).alias("pure_wrapper"), F.when(x <= ASSISTED, "PARTIAL").otherwise("NO").alias("automatable"),
    )


def migration_scores(actions: DataFrame) -> DataFrame:
    """Per class with actions: how many, how many automatable, (yes + partial / 2) / all, and whether any can't be automated."""
    g = actions.groupBy("fqn").agg(
        F.count(F.lit(1)).alias("action_count"), F.count_if(F.col("automatable") == "YES").alias("automatable_count"),
        F.count_if(F.col("automatable") == "PARTIAL").alias("partial_count"), F.count_if(F.col("automatable") == "NO").alias("manual_count"),
    )
    score = (F.col("automatable_count") + F.col("partial_count") * 0.5) / F.col("action_count")
    return g.select("fqn", "action_count", "automatable_count", score.alias("automation_score"), (F.col("manual_count") > 0).alias("needs_ai"))


def enrich_rules(rules: DataFrame, actions: DataFrame, framework: str, modern: str) -> DataFrame:
    """(rule_id, source, status, usage_count): direct usages of each rule, and new NEEDS_MAPPING rules DISC-nnn for the
    framework's types that only manual rewrites name, by usage. New rules are numbered in one task: one row per type."""
    usage = actions.where(~F.col("is_inherited")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    old = rules.join(usage, "source", "left").select("rule_id", "source", "status", F.coalesce("n", "usage_count").cast("long").alias("usage_count"))
    unmapped = actions.where(
        F.col("source").startswith(framework) & ~F.col("source").startswith(modern) & (F.col("automatable") == "NO") & (F.col("action_type") == "COMPLEX_REWRITE")
    )
    new = unmapped.groupBy("source").agg(F.count(F.lit(1)).alias("usage_count")).join(rules.select("source"), "source", "left_anti")
    number = F.row_number().over(W.orderBy(F.desc("usage_count"), "source"))
    return old.unionByName(new.select(F.format_string("DISC-%03d", number).alias("rule_id"), "source", F.lit("NEEDS_MAPPING").alias("status"), "usage_count"))


def migration_plan(actions: DataFrame, fqn: str) -> DataFrame:
    """One class's actions in two sorted lists with the counts and score; no row without actions."""
    own = actions.where(F.col("fqn") == fqn)
    lists = own.groupBy("fqn").agg(
        F.array_sort(F.collect_list(F.when(F.col("automatable") == "YES", F.col("action_id")))).alias("automatable_actions"),
        F.array_sort(F.collect_list(F.when(F.col("automatable") != "YES", F.col("action_id")))).alias("manual_actions"),
    )
    return lists.join(migration_scores(own), "fqn")


def wrapper_intermediaries(actions: DataFrame, fqn: str, wrappers: str) -> DataFrame:
    """One row: distinct wrapper classes that one class inherits actions from, and whether there are any."""
    own = actions.where((F.col("fqn") == fqn) & F.col("inherited_from").startswith(wrappers))
    return own.agg(F.countDistinct("inherited_from").alias("intermediaries")).withColumn("has_intermediaries", F.col("intermediaries") > 0)


def wrapper_counts(classes: DataFrame, actions: DataFrame, wrappers: str) -> DataFrame:
    """One row over the included classes: those with an action from a wrapper, and those that inherit one through a wrapper."""
    direct, through = F.col("source").startswith(wrappers), F.col("is_inherited") & F.col("inherited_from").startswith(wrappers)
    own = actions.where(direct | through).groupBy("fqn").agg(F.bool_or(F.coalesce(direct, F.lit(False))).alias("direct"), F.bool_or(F.coalesce(through, F.lit(False))).alias("through"))
    return own.join(included(classes).select("fqn"), "fqn", "left_semi").agg(F.count_if("direct").alias("affected"), F.count_if("through").alias("second_layer"))


def top_gaps(rules: DataFrame, begins: str = "", limit: int = 5) -> DataFrame:
    """The sources that most usages wait for a mapping of, of one prefix if it is given."""
    return gaps(rules.where(F.col("source").startswith(begins)), limit=limit).select("source", "usage_count")


def by_automatability(actions: DataFrame) -> DataFrame:
    """Actions in the order in which they are shown: what can't be automated first, then in part, then wholly."""
    rank = F.when(F.col("automatable") == "NO", 0).when(F.col("automatable") == "PARTIAL", 1).when(F.col("automatable") == "YES", 2).otherwise(3)
    return actions.withColumn("rank", rank).orderBy("rank", "source", "action_id")


def apply_changes(sources: DataFrame, renames: DataFrame, path: str) -> DataFrame:
    """rewrite, with the files that change written below path as (path, content); their (path, diff) is returned."""
    changed = rewrite(sources, renames).where("before <> after")
    changed.select("path", F.col("after").alias("content"), "diff").write.mode("errorifexists").parquet(path)
    return changed.sparkSession.read.parquet(path).select("path", "diff")


def summary(classes: DataFrame, actions: DataFrame) -> DataFrame:
    """One row over the included classes: per class first, then all together."""
    c = included(classes).select("fqn", "module")
    per = actions.groupBy("fqn").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("automatable") == "YES").alias("yes"),
        ((F.count_if(F.col("automatable") == "YES") + F.count_if(F.col("automatable") == "PARTIAL") * 0.5) / F.count(F.lit(1))).alias("score"),
        F.count_if("is_inherited").alias("inherited"),
    )
    j = c.join(per, "fqn", "left").na.fill(0, ["n", "yes", "inherited"])
    return j.agg(
        F.count(F.lit(1)).alias("total_classes"), F.count_if(F.col("n") > 0).alias("classes_with_actions"), F.count_if(F.col("score") == 1).alias("fully_automatable"),
        F.count_if((F.col("score") > 0) & (F.col("score") < 1)).alias("partially_automatable"), F.count_if((F.col("n") > 0) & (F.col("score") == 0)).alias("needs_ai_only"),
        F.coalesce(F.avg(F.when(F.col("n") > 0, F.col("score"))), F.lit(0.0)).alias("avg_score"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_actions"),
        F.coalesce(F.sum("yes"), F.lit(0)).alias("total_automatable"), F.count_if(F.col("inherited") > 0).alias("transitive_classes"),
    )


def coverage(classes: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: shares of distinct (source, automatable) pairs and of usages that are mapped, direct actions only."""
    own = actions.where(~F.col("is_inherited")).join(included(classes).select("fqn"), "fqn", "left_semi")
    ratio = lambda m, t: F.when(t > 0, m / t).otherwise(0.0)
    types = own.select("source", "automatable").distinct().agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("automatable") != "NO").alias("m"))
    uses = own.agg(F.count(F.lit(1)).alias("u"), F.count_if(F.col("automatable") != "NO").alias("w"))
    return types.crossJoin(uses).select(ratio(F.col("m"), F.col("t")).alias("coverage_by_type"), ratio(F.col("w"), F.col("u")).alias("coverage_by_usage"))  # one row each


def gaps(rules: DataFrame, actions: DataFrame | None = None, fqn: str | None = None, limit: int | None = None) -> DataFrame:
    """Rules that need a mapping by usage; of one class only, if fqn is given."""
    out = rules.where("status = 'NEEDS_MAPPING'")
    if actions is not None and fqn is not None:
        out = out.join(actions.where(F.col("fqn") == fqn).select("source"), "source", "left_semi")
    out = out.orderBy(F.desc("usage_count"), "source")
    return out if limit is None else out.limit(limit)


def filter_rules(rules: DataFrame, category: str | None = None, status: str | None = None, automatable: str | None = None) -> DataFrame:
    for column, value in (("category", category), ("status", status), ("automatable", automatable)):
        if value and value.strip():
            rules = rules.where(F.col(column) == value)
    return rules


def upsert_rule(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """changes replace the rules of their source and are no base rules; new ones go last."""
    kept = rules.join(changes.select("source"), "source", "left_anti")
    last = rules.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("last"))
    return kept.unionByName(changes.crossJoin(F.broadcast(last)).withColumn("pos", F.col("last") + F.col("pos")).drop("last").withColumn("is_base", F.lit(False)))  # one row


def delete_rule(rules: DataFrame, source: str) -> DataFrame:
    """Without the rule of that source, unless it is a base rule."""
    return rules.where((F.col("source") != source) | F.col("is_base"))


def category_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("category").agg(F.count(F.lit(1)).alias("rules"), F.sum("usage_count").alias("usages"))


def audit(classes: DataFrame, examples: int = 5) -> DataFrame:
    """Per label: classes and the first few names; ranks are cut before the shuffle, so no list of all names arises."""
    rows = classes.select("fqn", F.explode("labels").alias("label"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("class_count"))
    ranked = rows.distinct().withColumn("__at", F.row_number().over(W.partitionBy("label").orderBy("fqn"))).where(F.col("__at") <= examples)
    return counts.join(ranked.groupBy("label").agg(F.array_sort(F.collect_list("fqn")).alias("examples")), "label")


def rewrite(sources: DataFrame, renames: DataFrame) -> DataFrame:
    """sources(path, content), renames(path, old, new) -> (path, before, after, diff): imports and simple names renamed.

    An approximation of a syntax-tree rewrite: qualified names are replaced at word boundaries, and a simple name where
    its import was replaced. One task per file.
    """

    def run(batches):
        import difflib
        import re

        import pandas as pd

        for pdf in batches:
            rows = []
            for path, before, pairs in zip(pdf["path"], pdf["content"], pdf["pairs"]):
                after = before
                for pair in sorted(pairs, key=lambda p: (-len(p["old"]), p["old"])):
                    old, new = pair["old"], pair["new"]
                    after, n = re.subn(rf"(?<![\w.]){re.escape(old)}\b", new, after)
                    a, b = old.rsplit(".", 1)[-1], new.rsplit(".", 1)[-1]
                    if n and a != b:
                        after = re.sub(rf"(?<![\w.]){re.escape(a)}\b", b, after)
                diff = "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{path}", f"b/{path}"))
                rows.append((path, before, after, diff))
            yield pd.DataFrame(rows, columns=["path", "before", "after", "diff"])

    grouped = renames.groupBy("path").agg(F.collect_list(F.struct("old", "new")).alias("pairs"))
    return sources.join(grouped, "path").select("path", "content", "pairs").mapInPandas(run, "path string, before string, after string, diff string")


__all__ = ["ancestors", "overlay", "classify_imports", "transitive_migrations", "migration_scores", "enrich_rules", "migration_plan", "summary", "coverage"]
