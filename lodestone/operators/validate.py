"""Graph-integrity validation: fifty checks as data, one plan.

Each check is a DataFrame of offending items, or a count with its message. The runner writes all items as one table, of
which it takes counts and, by a ranked limit, the first twenty details; counts of the same table are one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.graph import bfs, without_path
from lodestone.operators.lexicon import RULE_NAME
from lodestone.operators.modules import legacy
from lodestone.plans.scratch import cut

#: Details of a check, and of the one that lists modules.
DETAILS, MODULE_DETAILS = 20, 1000
ENTITY = ("javax.persistence.Entity", "jakarta.persistence.Entity")


@dataclass
class Graph:
    """The tables a validation reads; a kind that isn't given is empty. Edges hold (src_kind, src, type, dst_kind, dst)."""

    classes: DataFrame
    edges: DataFrame
    methods: DataFrame
    fields: DataFrame
    annotations: DataFrame
    packages: DataFrame
    modules: DataFrame
    tables: DataFrame
    terms: DataFrame
    actions: DataFrame
    pilot: str = "pilot"
    wrappers: str = "com.acme.wrappers."

    def settled(self) -> Graph:
        """The same graph with the tables that most checks read computed once and written to the checkpoint folder."""
        return replace(self, classes=cut(self.classes), edges=cut(self.edges))

    def of(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    def without(self, df: DataFrame, key: str, side: str, *types: str) -> DataFrame:
        """df's rows that no edge of these types has on that side."""
        return df.join(self.of(*types).select(F.col(side).alias(key)), key, "left_anti")


@dataclass(frozen=True)
class Items:
    """Offenders: the rows of one column item that aren't null; up to `above` of them count as none."""

    df: DataFrame
    details: int = DETAILS
    above: int = 0


@dataclass(frozen=True)
class Check:
    name: str
    severity: str
    #: graph -> Items, or (DataFrame, aggregate that counts, aggregate with a bounded list of details)
    run: Callable[[Graph], Items | tuple[DataFrame, Column, Column]]


def _items(df: DataFrame, what: Column | str, details: int = DETAILS, above: int = 0) -> Items:
    return Items(df.select((F.col(what) if isinstance(what, str) else what).alias("item")), details, above)


def _flag(df: DataFrame, bad: Column, message: str) -> tuple[DataFrame, Column, Column]:
    """A count of 1 and the message if the condition on aggregates holds."""
    return df, F.when(bad, 1).otherwise(0), F.when(bad, F.array(F.lit(message))).otherwise(F.array().cast("array<string>"))


def _missing(condition: Column) -> Column:
    return F.count_if(condition) == 0


def _labelled(g: Graph, label: str) -> DataFrame:
    return g.classes.where(F.array_contains("labels", label))


def _ends(g: Graph, kind: str, src: str, dst: str) -> Items:
    bad = g.of(kind).where((F.col("src_kind") != src) | (F.col("dst_kind") != dst))
    return _items(bad, F.concat("src", F.lit(f" -{kind}-> "), "dst"))


def _parent_missing(g: Graph) -> Items:
    named = g.classes.where("super_class is not null").select("fqn", "super_class")
    known = named.join(g.classes.select(F.col("fqn").alias("super_class")), "super_class", "left_semi")
    have = g.of("EXTENDS").select(F.col("src").alias("fqn"), F.col("dst").alias("super_class"))
    return _items(known.join(have, ["fqn", "super_class"], "left_anti"), F.concat("fqn", F.lit(" -> "), "super_class"))


def _repository_queries(g: Graph) -> Items:
    declared = g.of("DECLARES_METHOD").select(F.col("src").alias("fqn"), F.col("dst").alias("method_id"))
    querying = declared.join(g.of("QUERIES").select(F.col("src").alias("method_id")), "method_id", "left_semi").select("fqn")
    return _items(_labelled(g, "Repository").join(querying, "fqn", "left_anti"), "fqn")


def _reachable(g: Graph) -> tuple[DataFrame, Column, Column]:
    # Reach within three hops is there as soon as one hop is.
    ends = g.of("DEPENDS_ON", "EXTENDS", "IMPLEMENTS", "CALLS").where("src_kind = 'class' and dst_kind = 'class'")
    return _flag(ends, F.count(F.lit(1)) == 0, "no class reaches another")


def _pilot_size(g: Graph) -> tuple[DataFrame, Column, Column]:
    own, n = g.classes.where(F.col("module") == g.pilot), F.count(F.lit(1))
    few = n < 15
    return own, F.when(few, n).otherwise(0), F.when(few, F.array(F.concat(F.lit("too few pilot classes: "), n.cast("string")))).otherwise(F.array().cast("array<string>"))


def _action_counts(g: Graph) -> Items:
    edges = g.of("HAS_MIGRATION_ACTION").groupBy(F.col("src").alias("fqn")).agg(F.count(F.lit(1)).alias("n"))
    return _items(edges.join(g.classes.select("fqn", "action_count"), "fqn").where("n <> action_count"), "fqn")


def _zero_risk(g: Graph) -> Items:
    per = g.classes.where("module is not null and module <> ''").groupBy("module").agg(F.avg(F.coalesce("enhanced_risk", F.lit(0.0))).alias("r"))
    return _items(per.where("r = 0"), "module", MODULE_DETAILS)


def _cross_module(g: Graph) -> tuple[DataFrame, Column, Column]:
    m = g.classes.where("module is not null and module <> ''").select("fqn", "module")
    e = g.of("DEPENDS_ON").join(m.select(F.col("fqn").alias("src"), F.col("module").alias("s")), "src").join(m.select(F.col("fqn").alias("dst"), F.col("module").alias("t")), "dst")
    return _flag(e, _missing(F.col("s") != F.col("t")), "no dependency crosses modules")


def _unmapped(g: Graph) -> Items:
    return _items(g.actions.where("automatable = 'NO' and action_type = 'COMPLEX_REWRITE'").select("source").distinct(), "source", above=10)


def _nothing(g: Graph) -> tuple[DataFrame, Column, Column]:
    return _flag(g.actions, F.lit(False), "")


CHECKS = (
    Check("ORPHAN_CLASS_NODES", "WARNING", lambda g: _items(g.without(g.classes, "fqn", "dst", "CONTAINS_CLASS"), "fqn")),
    Check("DANGLING_METHOD_NODES", "ERROR", lambda g: _items(g.without(g.methods, "method_id", "dst", "DECLARES_METHOD"), "method_id")),
    Check("DANGLING_FIELD_NODES", "ERROR", lambda g: _items(g.without(g.fields, "field_id", "dst", "DECLARES_FIELD"), "field_id")),
    Check("DANGLING_ANNOTATION_NODES", "WARNING", lambda g: _items(g.without(g.annotations, "annotation", "dst", "HAS_ANNOTATION"), "annotation")),
    Check("DUPLICATE_CLASS_FQNS", "ERROR", lambda g: _items(g.classes.groupBy("fqn").count().where("count > 1"), "fqn")),
    Check("EXTENDS_CHAIN_DANGLING", "WARNING", lambda g: _items(g.without(g.classes.where("super_class is not null and super_class <> ''"), "fqn", "src", "EXTENDS"), F.concat("fqn", F.lit(" -> "), "super_class"))),
    Check("IMPLEMENTS_MISSING", "WARNING", lambda g: _items(g.without(g.classes.where(F.size("interfaces") > 0), "fqn", "src", "IMPLEMENTS"), "fqn")),
    Check("MAPS_TO_TABLE_ORPHAN_TABLE", "WARNING", lambda g: _items(g.without(g.tables, "table_name", "dst", "MAPS_TO_TABLE"), "table_name")),
    Check("QUERIES_EDGE_INTEGRITY", "ERROR", lambda g: _ends(g, "QUERIES", "method", "table")),
    Check("BINDS_TO_EDGE_INTEGRITY", "ERROR", lambda g: _ends(g, "BINDS_TO", "class", "class")),
    Check("SERVICE_HAS_DEPENDENCIES", "WARNING", lambda g: _items(g.without(_labelled(g, "Service"), "fqn", "src", "DEPENDS_ON"), "fqn")),
    Check("REPOSITORY_HAS_QUERIES", "WARNING", _repository_queries),
    Check("UI_VIEW_HAS_BINDS_TO", "WARNING", lambda g: _items(g.without(_labelled(g, "VaadinView"), "fqn", "src", "BINDS_TO"), "fqn")),
    Check("ENTITY_MAPS_TO_TABLE", "WARNING", lambda g: _items(g.without(g.of("HAS_ANNOTATION").where(F.col("dst").isin(*ENTITY)).select(F.col("src").alias("fqn")), "fqn", "src", "MAPS_TO_TABLE"), "fqn")),
    Check("INHERITANCE_CHAIN_COMPLETENESS", "ERROR", _parent_missing),
    Check("TRANSITIVE_REPO_DEPENDENCY", "WARNING", lambda g: _items(without_path(g.of("DEPENDS_ON").select("src", "dst"), g.classes), "fqn")),
    Check("NO_ISOLATED_MODULES", "WARNING", lambda g: _items(g.without(g.modules, "module", "src", "CONTAINS_PACKAGE"), "module")),
    Check("NO_EMPTY_PACKAGES", "WARNING", lambda g: _items(g.without(g.packages, "package_name", "src", "CONTAINS_CLASS"), "package_name")),
    Check("ANNOTATION_COVERAGE", "WARNING", lambda g: _items(g.without(g.classes.where("annotations is null or size(annotations) = 0"), "fqn", "src", "HAS_ANNOTATION"), "fqn")),
    Check("CALLS_EDGE_COVERAGE", "WARNING", lambda g: (g.of("CALLS"), F.count(F.lit(1)), F.array().cast("array<string>"))),
    Check("ORPHAN_BUSINESS_TERMS", "WARNING", lambda g: _items(g.without(g.terms, "term_id", "dst", "USES_TERM"), "term_id")),
    Check("DEFINES_RULE_COVERAGE", "WARNING", lambda g: _items(g.without(g.classes.where(F.col("simple_name").rlike(f"^(?:{RULE_NAME})$")), "fqn", "src", "DEFINES_RULE"), "fqn")),
    Check("USES_TERM_EDGE_INTEGRITY", "ERROR", lambda g: _ends(g, "USES_TERM", "class", "term")),
    Check("RISK_SCORES_POPULATED", "ERROR", lambda g: _items(g.classes.where("structural_risk is null"), "fqn")),
    Check("FAN_IN_OUT_POPULATED", "ERROR", lambda g: _items(g.classes.where("fan_in is null or fan_out is null"), "fqn")),
    Check("HIGH_RISK_NO_DEPENDENCIES", "WARNING", lambda g: _items(g.without(g.without(g.classes.where("structural_risk > 2"), "fqn", "src", "DEPENDS_ON"), "fqn", "dst", "DEPENDS_ON"), "fqn")),
    Check("DOMAIN_SCORES_POPULATED", "ERROR", lambda g: _items(g.classes.where("enhanced_risk is null"), "fqn")),
    Check("HIGH_DOMAIN_RISK_NO_BUSINESS_TERMS", "WARNING", lambda g: _items(g.without(g.classes.where("domain_criticality > 0"), "fqn", "src", "USES_TERM"), "fqn")),
    Check("SECURITY_FINANCIAL_FLAGGED", "WARNING", lambda g: _items(g.classes.where("security_sensitivity > 0 or financial_involvement > 0"), "fqn")),
    Check("VECTOR_INDEX_POPULATED", "WARNING", lambda g: _items(g.classes.where("source_path is not null"), "fqn")),
    Check("VECTOR_CHUNKS_HAVE_CONTENT_HASH", "ERROR", lambda g: _items(g.classes.where("source_path is not null and content_hash is null"), "fqn")),
    Check("VECTOR_SOURCE_FILES_ACCESSIBLE", "WARNING", lambda g: _items(g.classes.where("source_path is not null"), "source_path")),
    Check("PILOT_MODULE_CLASS_COUNT", "ERROR", _pilot_size),
    Check("PILOT_VAADIN7_NODES_PRESENT", "WARNING", lambda g: _flag(g.classes.where(F.col("module") == g.pilot), _missing(legacy()), "no legacy class in the pilot module")),
    Check("PILOT_BUSINESS_TERMS_EXTRACTED", "WARNING", lambda g: _flag(g.of("USES_TERM").join(g.classes.where(F.col("module") == g.pilot).select(F.col("fqn").alias("src")), "src", "left_semi"), F.count(F.lit(1)) == 0, "no term in the pilot module")),
    Check("RAG_CONE_QUERY_FUNCTIONAL", "WARNING", _reachable),
    Check("RAG_VECTOR_INDEX_ALIGNED", "WARNING", lambda g: _flag(g.classes, _missing(F.col("source_path") != ""), "no class has a source path")),
    Check("RAG_RISK_SCORES_AVAILABLE", "WARNING", lambda g: _flag(g.classes, _missing(F.col("enhanced_risk") > 0), "no class has a risk score")),
    Check("SCHEDULING_MODULES_EXIST", "ERROR", lambda g: _flag(g.classes, _missing(F.length("package_name") > 0), "no class has a package")),
    Check("SCHEDULING_RISK_SCORES_POPULATED", "WARNING", _zero_risk),
    Check("SCHEDULING_DEPENDENCY_EDGES_EXIST", "WARNING", _cross_module),
    Check("MIGRATION_ACTIONS_POPULATED", "WARNING", lambda g: _flag(g.actions, F.count(F.lit(1)) == 0, "no migration action")),
    Check("MIGRATION_SCORES_COMPUTED", "WARNING", lambda g: _flag(g.classes, _missing((F.col("action_count") > 0) & F.col("automation_score").isNotNull()), "no class with actions has a score")),
    Check("MIGRATION_ACTION_EDGES_INTACT", "ERROR", _action_counts),
    Check("RECIPE_BOOK_LOADED", "WARNING", lambda g: _flag(g.actions, _missing(F.col("source").isNotNull()), "no action names its rule")),
    Check("TRANSITIVE_ACTIONS_DETECTED", "WARNING", lambda g: _flag(g.actions, _missing(F.col("is_inherited")), "no inherited action")),
    Check("MIGRATION_COVERAGE_GAPS", "WARNING", _unmapped),
    Check("WRAPPER_MIGRATION_ACTIONS_PRESENT", "WARNING", lambda g: _flag(g.actions, _missing(F.col("source").startswith(g.wrappers)), "no action from a wrapper")),
    Check("WRAPPER_TRANSITIVE_DETECTION_ACTIVE", "WARNING", _nothing),
    Check("WRAPPER_NEEDS_MAPPING_DISCOVERABLE", "WARNING", _nothing),
)


def report(graph: Graph, checks=CHECKS) -> DataFrame:
    """(name, severity, status, count, details) of every check.

    A count of zero passes; else a warning warns and an error fails. The count of call edges is meant to be positive.
    The offending items are written when this is called.
    """
    graph, items, flags = graph.settled(), [], {}
    for c in checks:
        found = c.run(graph)
        if isinstance(found, Items):
            items.append((c, found))
        else:
            flags.setdefault(id(found[0]), (found[0], []))[1].append((c, *found[1:]))
    rows = [_counted(df, own) for df, own in flags.values()]
    if items:
        rows.append(_listed(items))
    out = rows[0] if rows else graph.classes.sparkSession.createDataFrame([], "name string, severity string, count long, details array<string>")
    for more in rows[1:]:
        out = out.unionByName(more)
    ok = F.when(F.col("name") == "CALLS_EDGE_COVERAGE", F.col("count") > 0).otherwise(F.col("count") == 0)
    status = F.when(ok, "PASS").when(F.col("severity") == "ERROR", "FAIL").otherwise("WARN")
    return out.select("name", "severity", status.alias("status"), "count", "details")


def _counted(df: DataFrame, checks: list[tuple[Check, Column, Column]]) -> DataFrame:
    """The checks that count one table, as one aggregate."""
    one = df.agg(*(x for k, (_, n, details) in enumerate(checks) for x in (n.cast("long").alias(f"n{k}"), details.alias(f"d{k}"))))
    each = [F.struct(F.lit(c.name).alias("name"), F.lit(c.severity).alias("severity"), F.col(f"n{k}").alias("count"), F.col(f"d{k}").alias("details")) for k, (c, _, _) in enumerate(checks)]
    return one.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def _listed(checks: list[tuple[Check, Items]]) -> DataFrame:
    """The checks that list items: all items as one table, counted and ranked; the rank's limit is applied before the shuffle."""
    found = None
    for k, (_, x) in enumerate(checks):
        rows = x.df.where("item is not null").select(F.lit(k).alias("k"), F.col("item").cast("string").alias("item"))
        found = rows if found is None else found.unionByName(rows)
    found = cut(found)
    counts = found.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    most = max(x.details for _, x in checks)
    ranked = found.withColumn("at", F.row_number().over(W.partitionBy("k").orderBy("item"))).where(F.col("at") <= most)
    about = [F.struct(F.lit(k).alias("k"), F.lit(c.name).alias("name"), F.lit(c.severity).alias("severity"), F.lit(x.details).alias("most"), F.lit(x.above).alias("above")) for k, (c, x) in enumerate(checks)]
    spec = found.sparkSession.range(1).select(F.explode(F.array(*about)).alias("r")).select("r.*")
    lists = ranked.join(F.broadcast(spec.select("k", "most")), "k").where("at <= most").groupBy("k").agg(F.array_sort(F.collect_list("item")).alias("details"))  # a row a check
    joined = spec.join(counts, "k", "left").join(lists, "k", "left")
    bad = F.coalesce("n", F.lit(0)) > F.col("above")
    return joined.select(
        "name", "severity", F.when(bad, F.col("n")).otherwise(0).cast("long").alias("count"),
        F.when(bad, F.col("details")).otherwise(F.array().cast("array<string>")).alias("details"),
    )


def totals(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("checks"))


def reachable_classes(graph: Graph, hops: int = 3) -> DataFrame:
    """Classes that reach or are reached within some hops; what the cone check counts when it is wanted in full."""
    return bfs(graph.of("DEPENDS_ON", "EXTENDS", "IMPLEMENTS", "CALLS").select("src", "dst"), graph.classes.select(F.col("fqn").alias("node")), hops)
