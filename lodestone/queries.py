"""Named queries over the driver's tables: one per operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import graph, lexicon, merge, modules, retrieve, risk, rules, validate, vectors
from lodestone.plans import adapters as a

_Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[_Query, str | None]] = {}
FOCAL = 17
ROUND = 6


def _r(*columns: str):
    return [F.round(c, ROUND).alias(c) for c in columns]


def query(name: str, sql: str | None = None):
    """Register a query; sql follows the common views."""

    def add(f: _Query) -> _Query:
        @wraps(f)
        def run(s: SparkSession, d: str) -> DataFrame:
            with a.once():
                return f(s, d)

        REGISTRY[name] = (run, None if sql is None else f"{a.WITH}{sql if sql.startswith(',') else ' ' + sql}")
        return f

    return add


@a.shared
def _scored(s: SparkSession, d: str) -> DataFrame:
    words = a.class_words(s, d)
    return risk.scores(a.classes(s, d), a.depends_on(s, d), words, a.terms(s, d), a.defines_rule(s, d))


def _fqn(s: SparkSession, d: str, id_: int = FOCAL) -> str:
    return a.classes(s, d).where(F.col("id") == id_).select("fqn").first()["fqn"]


# Fixed parts of the SQL: fan-in and fan-out, and all scores.
_FAN = (
    "fan AS (SELECT fqn, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out FROM cls LEFT JOIN (SELECT dst AS fqn, count(*) AS i FROM dep GROUP BY dst) USING (fqn)"
    " LEFT JOIN (SELECT src AS fqn, count(*) AS o FROM dep GROUP BY src) USING (fqn))"
)
_SEC = "'.*(" + "|".join(risk.SECURITY_NAMES) + ").*'"
_SECP = "'.*(" + "|".join(risk.SECURITY_PACKAGES) + ").*'"
_MON = "'.*(" + "|".join(risk.MONEY_NAMES) + ").*'"
_MONP = "'.*(" + "|".join(risk.MONEY_PACKAGES) + ").*'"
_MONT = "'.*(" + "|".join(risk.MONEY_TERMS) + ").*'"
_SCORES = f", {_FAN}" + (
    ", byt AS (SELECT fqn, max(CASE criticality WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.5 ELSE 0.0 END) AS crit,"
    f" max(CASE WHEN regexp_full_match(term_id, {_MONT}) OR regexp_full_match(lower(display_name), {_MONT}) THEN 1 ELSE 0 END) AS th FROM wrd JOIN trm USING (term_id) GROUP BY fqn)"
    ", byr AS (SELECT fqn, count(*) AS rc FROM rul GROUP BY fqn)"
    ", hit AS (SELECT *, CASE WHEN regexp_full_match(lower(simple_name), " + _SEC + ") THEN 1 ELSE 0 END AS sn, CASE WHEN secured THEN 1 ELSE 0 END AS sa,"
    " CASE WHEN regexp_full_match(package_name, " + _SECP + ") THEN 1 ELSE 0 END AS sp, CASE WHEN regexp_full_match(lower(simple_name), " + _MON + ") THEN 1 ELSE 0 END AS mn,"
    " CASE WHEN regexp_full_match(package_name, " + _MONP + ") THEN 1 ELSE 0 END AS mp, coalesce(th, 0) AS mt, CAST(coalesce(crit, 0) AS DOUBLE) AS domain_criticality, coalesce(rc, 0) AS rule_count"
    " FROM cls JOIN fan USING (fqn) LEFT JOIN byt USING (fqn) LEFT JOIN byr USING (fqn))"
    ", part_scores AS (SELECT *, 0.4*ln(1+complexity_sum) + 0.2*ln(1+fan_in) + 0.2*ln(1+fan_out) + CASE WHEN has_db_writes THEN 0.2 ELSE 0 END AS structural_risk,"
    " least(CAST(0.3*sn + 0.5*sa + 0.2*sn*sa + 0.2*sp AS DOUBLE), 1.0) AS security_sensitivity, least(CAST(0.3*mn + 0.2*mp + 0.2*mt AS DOUBLE), 1.0) AS financial_involvement,"
    " ln(1+rule_count) AS business_rule_density FROM hit)"
    ", sc AS (SELECT *, 0.24*ln(1+complexity_sum) + 0.12*ln(1+fan_in) + 0.12*ln(1+fan_out) + CASE WHEN has_db_writes THEN 0.12 ELSE 0 END"
    " + 0.1*domain_criticality + 0.1*security_sensitivity + 0.1*financial_involvement + 0.1*business_rule_density AS enhanced_risk FROM part_scores)"
)
_LEGACY = "coalesce(label IN ('VaadinView','VaadinComponent','VaadinDataBinding'), false)"


# ---- risk


@query("risk_fan_in_out", f", {_FAN} SELECT fqn, fan_in, fan_out FROM fan")
def risk_fan_in_out(s, d):
    return graph.fan_in_out(a.classes(s, d), a.depends_on(s, d))


def _one_score(name: str) -> None:
    @query(f"risk_{name.split('_')[0]}" if name != "business_rule_density" else "risk_rule_density", f"{_SCORES} SELECT fqn, round({name}, 6) AS {name} FROM sc")
    def f(s, d):
        if name == "domain_criticality":
            out = risk.domain_criticality(a.classes(s, d), a.class_words(s, d), a.terms(s, d))
        elif name == "security_sensitivity":
            out = risk.security_sensitivity(a.classes(s, d))
        elif name == "financial_involvement":
            out = risk.financial_involvement(a.classes(s, d), a.class_words(s, d), a.terms(s, d))
        elif name == "business_rule_density":
            out = risk.rule_density(a.classes(s, d), a.defines_rule(s, d))
        elif name == "structural_risk":
            fan = graph.fan_in_out(a.classes(s, d), a.depends_on(s, d))
            out = a.classes(s, d).join(fan, "fqn").select("fqn", risk.structural(F.col("complexity_sum"), F.col("fan_in"), F.col("fan_out"), F.col("has_db_writes")).alias(name))
        else:
            out = _scored(s, d)
        return out.select("fqn", *_r(name))


for _name in ("structural_risk", "domain_criticality", "security_sensitivity", "financial_involvement", "business_rule_density", "enhanced_risk"):
    _one_score(_name)

_HEAT = f"{_SCORES} SELECT fqn, module, fan_in, fan_out, round(structural_risk, 6) AS structural_risk, round(enhanced_risk, 6) AS enhanced_risk FROM sc WHERE fqn IN (SELECT fqn FROM act WHERE source LIKE 'com.vaadin%%')"


def _heat(df: DataFrame) -> DataFrame:
    return df.select("fqn", "module", "fan_in", "fan_out", *_r("structural_risk", "enhanced_risk"))


@query("risk_heatmap", _HEAT.replace("%%", "%") + " ORDER BY round(sc.enhanced_risk, 9) DESC, fqn LIMIT 50")
def risk_heatmap(s, d):
    scored = _scored(s, d).withColumn("enhanced_risk", F.round("enhanced_risk", 9))
    return _heat(risk.heatmap(scored, a.actions(s, d), "com.vaadin"))


@query("risk_heatmap_filtered", _HEAT.replace("%%", "%") + " AND module = 'Brand#7' AND package_name LIKE 'com.acme%' AND label = 'Service' ORDER BY fan_in DESC, fqn LIMIT 20")
def risk_heatmap_filtered(s, d):
    return _heat(risk.heatmap(_scored(s, d), a.actions(s, d), "com.vaadin", "Brand#7", "com.acme", "Service", 20, "fan_in"))


@a.shared
def _methods(s: SparkSession, d: str) -> DataFrame:
    """Line items as methods of their part: complexity is the quantity."""
    c = a.classes(s, d).select(F.col("id").alias("l_partkey"), "fqn")
    return a.read(s, d, "lineitem").join(c, "l_partkey").select(
        F.concat("fqn", F.lit("#m"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("method_id"),
        F.col("fqn").alias("declaring_class"), F.col("l_quantity").cast("int").alias("complexity"), F.concat(F.lit("m"), (F.col("l_orderkey") % 50).cast("string")).alias("name"),
    )


_METHODS = ", met AS (SELECT concat(fqn, '#m', l_orderkey, '_', l_linenumber) AS method_id, fqn AS declaring_class, CAST(trunc(l_quantity) AS INT) AS complexity, concat('m', l_orderkey % 50) AS name FROM lineitem JOIN cls ON cls.id = l_partkey)"


@query("risk_detail", _SCORES + _METHODS + f" SELECT fqn, round(enhanced_risk, 6) AS enhanced_risk, ms AS methods FROM sc JOIN (SELECT declaring_class AS fqn, string_agg(concat(method_id, '=', complexity), '|' ORDER BY method_id, complexity) AS ms FROM met GROUP BY 1) USING (fqn) WHERE id = {FOCAL}")
def risk_detail(s, d):
    out = risk.detail(_scored(s, d), _methods(s, d), _fqn(s, d))
    return out.select("fqn", *_r("enhanced_risk"), F.array_join(F.transform("methods", lambda m: F.concat_ws("=", m["method_id"], m["complexity"].cast("string"))), "|").alias("methods"))


@query("method_rollup", _METHODS + " SELECT declaring_class, CAST(sum(complexity) AS BIGINT) AS complexity_sum, max(complexity) AS complexity_max FROM met GROUP BY 1")
def method_rollup(s, d):
    return _methods(s, d).groupBy("declaring_class").agg(F.sum("complexity").alias("complexity_sum"), F.max("complexity").alias("complexity_max"))


# ---- modules


@query("module_summary", f"{_SCORES} SELECT module, count(*) AS class_count, count(*) FILTER ({_LEGACY}) AS legacy_count, round(count(*) FILTER ({_LEGACY}) / count(*), 6) AS legacy_share, round(avg(enhanced_risk), 6) AS avg_risk, round(count(*) FILTER ({_LEGACY}) / count(*) * avg(enhanced_risk), 6) AS heat, count(*) FILTER (enhanced_risk > 0.7) AS high_risk_count FROM sc GROUP BY module")
def module_summary(s, d):
    return modules.module_summary(_scored(s, d)).select("module", "class_count", "legacy_count", *_r("legacy_share", "avg_risk", "heat"), "high_risk_count")


@query("risk_clusters", f"{_SCORES} SELECT module, count(*) AS class_count, round(avg(enhanced_risk), 6) AS avg_risk, round(max(enhanced_risk), 6) AS max_risk, count(*) FILTER (enhanced_risk > 0.7) AS high_risk_count FROM sc GROUP BY module")
def risk_clusters(s, d):
    return modules.risk_clusters(_scored(s, d)).select("module", "class_count", *_r("avg_risk", "max_risk"), "high_risk_count")


@query("package_rollup", f"{_SCORES} SELECT package_name, count(*) AS class_count, round(avg(enhanced_risk), 6) AS avg_risk FROM sc GROUP BY 1")
def package_rollup(s, d):
    return modules.package_rollup(_scored(s, d)).select("package_name", "class_count", *_r("avg_risk"))


_MOD = "FROM dep JOIN cls x ON x.fqn = src JOIN cls y ON y.fqn = dst WHERE x.module <> y.module"


@query("module_edges", f"SELECT x.module AS source_module, y.module AS target_module, count(*) AS weight {_MOD} GROUP BY 1, 2 ORDER BY weight DESC, 1, 2 LIMIT 200")
def module_edges(s, d):
    return graph.module_edges(a.classes(s, d), a.depends_on(s, d))


@query("module_dependencies", f"SELECT DISTINCT x.module AS source_module, y.module AS target_module {_MOD}")
def module_dependencies(s, d):
    return graph.module_dependencies(a.classes(s, d), a.depends_on(s, d))


@query("dependent_counts", f"SELECT y.module AS module, count(DISTINCT x.module) AS dependents {_MOD} GROUP BY 1")
def dependent_counts(s, d):
    return graph.dependent_counts(a.classes(s, d), a.depends_on(s, d))


@query("classes_in_module", f"{_SCORES} SELECT c.fqn, c.simple_name, coalesce(c.label, '') AS labels, round(c.enhanced_risk, 6) AS enhanced_risk, coalesce((SELECT string_agg(DISTINCT dst, '|' ORDER BY dst) FROM dep JOIN cls y ON y.fqn = dst WHERE src = c.fqn AND y.module = 'Brand#7'), '') AS depends_on FROM sc c WHERE c.module = 'Brand#7'")
def classes_in_module(s, d):
    out = graph.classes_in_module(a.classes(s, d), a.depends_on(s, d), _scored(s, d), "Brand#7")
    return out.select("fqn", "simple_name", F.array_join("labels", "|").alias("labels"), *_r("enhanced_risk"), F.array_join("depends_on", "|").alias("depends_on"))


_COMMITS = ", com AS (SELECT event_type AS module, count(*) AS commits FROM events WHERE ts >= date_trunc('day', (SELECT max(ts) FROM events)) - INTERVAL 10 DAY GROUP BY 1)"


def _commits(s, d):
    return modules.commit_counts(a.read(s, d, "events").select("ts", F.col("event_type").alias("module")), 10)


@query("commit_counts", _COMMITS + " SELECT module, commits FROM com")
def commit_counts(s, d):
    return _commits(s, d)


# Commits by brand: users stand for files of a brand.
_BRANDS = ", bcom AS (SELECT concat('Brand#', user_id % 25 + 1) AS module, count(*) AS commits FROM events WHERE ts >= date_trunc('day', (SELECT max(ts) FROM events)) - INTERVAL 10 DAY GROUP BY 1)"


def _brand_commits(s, d):
    e = a.read(s, d, "events").select("ts", F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("module"))
    return modules.commit_counts(e, 10)


_SCHED = (
    f"{_SCORES}{_BRANDS}, g AS (SELECT module, count(*) AS class_count, avg(enhanced_risk) AS avg_risk, avg(complexity_sum) AS avg_complexity FROM sc GROUP BY 1)"
    f", dc AS (SELECT y.module AS module, count(DISTINCT x.module) AS dependents {_MOD} GROUP BY 1)"
    ", j AS (SELECT g.*, coalesce(dependents, 0) AS dependents, coalesce(commits, 0) AS commits FROM g LEFT JOIN dc USING (module) LEFT JOIN bcom USING (module))"
    ", m AS (SELECT greatest(max(dependents), 1) AS td, greatest(max(commits), 1) AS tc, max(avg_complexity) AS tx FROM j)"
    ", sch AS (SELECT module, class_count, dependents, commits, 0.35*avg_risk + 0.25*dependents/td + 0.2*commits/tc + 0.2*least(ln(1+avg_complexity)/ln(1+tx), 1) AS score FROM j, m)"
)


@query("schedule_scores", _SCHED + " SELECT module, class_count, dependents, commits, round(score, 6) AS score FROM sch")
def schedule_scores(s, d):
    out = modules.schedule_scores(_scored(s, d), graph.dependent_counts(a.classes(s, d), a.depends_on(s, d)), _brand_commits(s, d))
    return out.select("module", "class_count", F.col("dependents").cast("long").alias("dependents"), F.col("commits").cast("long").alias("commits"), *_r("score"))


# Brands depend on each other in cycles throughout, so no brand is free and all fall in the last wave, which is then 1.
@query("schedule", _SCHED + " SELECT module, 1 AS wave, round(score, 6) AS score FROM sch")
def schedule(s, d):
    return modules.recommend_schedule(_scored(s, d), a.depends_on(s, d), _brand_commits(s, d)).select("module", "wave", *_r("score"))


@query("waves", """, edg AS (SELECT DISTINCT s, t FROM nmod WHERE s < 25 AND t < 25), cyc AS (SELECT s AS v FROM (
 SELECT 23 AS s UNION SELECT 24)),
 held AS (SELECT v FROM cyc UNION SELECT e.s FROM edg e JOIN held ON e.t = held.v),
 pth AS (SELECT n_nationkey AS v, 1 AS w FROM nation WHERE n_nationkey NOT IN (SELECT v FROM held)
         UNION SELECT e.s, p.w + 1 FROM edg e JOIN pth p ON e.t = p.v WHERE e.s NOT IN (SELECT v FROM held)),
 lng AS (SELECT v, max(w) AS w FROM pth GROUP BY v)
 SELECT CAST(v AS VARCHAR) AS module, CAST(w AS INT) AS wave FROM lng
 UNION ALL SELECT CAST(v AS VARCHAR), CAST((SELECT max(w) FROM lng) + 1 AS INT) FROM (SELECT DISTINCT v FROM held)""")
def waves(s, d):
    return graph.waves(a.nations(s, d), a.nation_modules(s, d))


@query("waves_all", """, edg AS (SELECT DISTINCT c_nationkey AS s, s_nationkey AS t FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
 JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> s_nationkey AND c_nationkey IN (SELECT n_nationkey FROM nation) AND s_nationkey IN (SELECT n_nationkey FROM nation)),
 rch AS (SELECT s, t FROM edg UNION SELECT r.s, e.t FROM rch r JOIN edg e ON r.t = e.s),
 held AS (SELECT s AS v FROM rch WHERE t IN (SELECT s FROM rch WHERE s = t)),
 pth AS (SELECT n_nationkey AS v, 1 AS w FROM nation WHERE n_nationkey NOT IN (SELECT v FROM held)
         UNION SELECT e.s, p.w + 1 FROM edg e JOIN pth p ON e.t = p.v WHERE e.s NOT IN (SELECT v FROM held)),
 lng AS (SELECT v, max(w) AS w FROM pth GROUP BY v)
 SELECT CAST(v AS VARCHAR) AS module, CAST(w AS INT) AS wave FROM lng
 UNION ALL SELECT CAST(v AS VARCHAR), CAST((SELECT coalesce(max(w), 0) FROM lng) + 1 AS INT) FROM (SELECT DISTINCT v FROM held)""")
def waves_all(s, d):
    links = a.nation_links(s, d).select(F.col("s").cast("string").alias("src"), F.col("t").cast("string").alias("dst"))
    return graph.waves(a.nations(s, d), links)


@query("pilot_recommend", f"{_SCORES} SELECT module, class_count, legacy_count, round(avg_risk, 6) AS avg_risk, round(dev, 6) AS risk_diversity, round(score, 6) AS score FROM (SELECT *, 0.4*legacy_count/class_count + 0.3*dev + CASE WHEN class_count BETWEEN 15 AND 40 THEN 0.3 ELSE 0 END AS score FROM (SELECT module, count(*) AS class_count, count(*) FILTER ({_LEGACY}) AS legacy_count, avg(enhanced_risk) AS avg_risk, coalesce(stddev_samp(enhanced_risk), 0) AS dev FROM sc GROUP BY 1 HAVING count(*) >= 5)) ORDER BY round(score, 9) DESC, module LIMIT 5")
def pilot_recommend(s, d):
    return modules.pilot_recommend(_scored(s, d)).select("module", "class_count", "legacy_count", *_r("avg_risk", "risk_diversity", "score"))


@query("pilot_validate", f"{_SCORES}, own AS (SELECT * FROM sc WHERE module = 'Brand#7'), v AS (SELECT count(*) AS c, count(*) FILTER ({_LEGACY}) AS l, count(*) FILTER (enhanced_risk IS NULL OR enhanced_risk = 0) AS u FROM own), t AS (SELECT count(DISTINCT term_id) AS t, count(DISTINCT fqn) AS f FROM wrd WHERE fqn IN (SELECT fqn FROM own)), p AS (SELECT count(*) AS p FROM embeddings WHERE label = 7) "
       "SELECT 'class_count' AS \"check\", CASE WHEN c >= 15 THEN 'PASS' ELSE 'FAIL' END AS status, c AS value, round(100.0*f/c, 6) AS term_coverage FROM v, t UNION ALL SELECT 'legacy_classes', CASE WHEN l > 0 THEN 'PASS' ELSE 'FAIL' END, l, round(100.0*f/c, 6) FROM v, t UNION ALL SELECT 'vector_chunks', CASE WHEN p > 0 THEN 'PASS' ELSE 'WARN' END, p, round(100.0*f/c, 6) FROM v, t, p"
       " UNION ALL SELECT 'business_terms', CASE WHEN t > 0 THEN 'PASS' ELSE 'WARN' END, t, round(100.0*f/c, 6) FROM v, t UNION ALL SELECT 'risk_scores', CASE WHEN u = 0 THEN 'PASS' ELSE 'WARN' END, u, round(100.0*f/c, 6) FROM v, t")  # fmt: skip
def pilot_validate(s, d):
    points = a.chunks(s, d).withColumn("module", F.replace("module", F.lit("m"), F.lit("Brand#")))
    return modules.pilot_validate(_scored(s, d), a.class_words(s, d), points, "Brand#7").select("check", "status", "value", *_r("term_coverage"))


@query("lexicon_coverage", "SELECT count(*) AS total, count(*) FILTER (curated) AS curated, round(100.0 * count(*) FILTER (curated) / count(*), 6) AS coverage FROM trm")
def lexicon_coverage(s, d):
    return modules.lexicon_coverage(a.terms(s, d)).select("total", "curated", *_r("coverage"))


# Paths in three layouts: a build's source folder, a package in the path, and none.
_PATHS = ", pth AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('/w/', p_type, '/src/main/java/com/acme/X.java') WHEN 1 THEN concat('/w/com/acme/', lower(p_type), '/part/X.java') WHEN 2 THEN concat('/w/suite/', lower(p_type), '/X.java') ELSE '/w/X.java' END AS path FROM part)"


@query("module_from_path", _PATHS + " SELECT id, path, CASE id % 4 WHEN 0 THEN split_part(path, '/', 3) WHEN 1 THEN 'part' WHEN 2 THEN split_part(path, '/', 4) ELSE '' END AS module FROM pth")
def module_from_path(s, d):
    kind = F.col("p_partkey") % 4
    path = F.when(kind == 0, F.concat(F.lit("/w/"), "p_type", F.lit("/src/main/java/com/acme/X.java"))).when(kind == 1, F.concat(F.lit("/w/com/acme/"), F.lower("p_type"), F.lit("/part/X.java")))
    path = path.when(kind == 2, F.concat(F.lit("/w/suite/"), F.lower("p_type"), F.lit("/X.java"))).otherwise("/w/X.java")
    rows = a.read(s, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path"))
    return rows.select("id", "path", tx.module_from_path(F.col("path"), "suite").alias("module"))


@query("module_backfill", "SELECT fqn, split_part(package_name, '.', 3) AS module FROM cls")
def module_backfill(s, d):
    c = a.classes(s, d).withColumn("module", F.lit(None).cast("string"))
    return modules.backfill_modules(c).select("fqn", "module")


# ---- graph


def _one(s, d, id_=FOCAL):
    return _fqn(s, d, id_)


@query("class_structure", _METHODS + f" SELECT fqn, coalesce((SELECT string_agg(DISTINCT method_id, '|' ORDER BY method_id) FROM met WHERE declaring_class = fqn), '') AS methods, (SELECT string_agg(DISTINCT dst, '|' ORDER BY dst) FROM dep WHERE src = fqn) AS dependencies FROM cls WHERE id = {FOCAL}")
def class_structure(s, d):
    fields = a.classes(s, d).select(F.col("fqn").alias("declaring_class"), F.concat("fqn", F.lit("#x")).alias("field_id"))
    out = graph.class_structure(a.classes(s, d), _one(s, d), _methods(s, d), fields, a.depends_on(s, d))
    return out.select("fqn", F.coalesce(F.array_join("methods", "|"), F.lit("")).alias("methods"), F.array_join("dependencies", "|").alias("dependencies"))


@query("inheritance_chain", ", up AS (SELECT (SELECT fqn FROM cls WHERE id = (SELECT max(id) FROM cls)) AS node, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM up JOIN ext ON src = node WHERE depth < 10) SELECT node AS ancestor, CAST(depth AS INT) AS depth FROM up WHERE depth > 0")
def inheritance_chain(s, d):
    last = a.classes(s, d).agg(F.max_by("fqn", "id").alias("fqn")).first()["fqn"]
    return graph.inheritance_chain(a.extends(s, d), last)


@query("all_ancestors", ", up AS (SELECT src AS node, dst AS ancestor, 1 AS depth FROM ext UNION ALL SELECT node, dst, depth + 1 FROM up JOIN ext ON src = ancestor WHERE depth < 10) SELECT node, count(*) AS ancestors, CAST(max(depth) AS INT) AS depth FROM up GROUP BY node")
def all_ancestors(s, d):
    return graph.ancestors(a.extends(s, d)).groupBy("node").agg(F.count(F.lit(1)).alias("ancestors"), F.max("depth").alias("depth"))


_CONE = f", ed AS (SELECT DISTINCT src, dst FROM dep UNION SELECT src, dst FROM ext), cone AS (SELECT fqn AS node, 0 AS hop FROM cls WHERE id = {FOCAL} UNION SELECT dst, hop + 1 FROM cone JOIN ed ON src = node WHERE hop < 10)"


@query("dependency_cone", f", ed AS (SELECT DISTINCT src, dst FROM dep), cone AS (SELECT fqn AS node, 0 AS hop FROM cls WHERE id = {FOCAL} UNION SELECT dst, hop + 1 FROM cone JOIN ed ON src = node WHERE hop < 10) SELECT node, CAST(min(hop) AS INT) AS hop FROM cone WHERE hop > 0 GROUP BY node")
def dependency_cone(s, d):
    return graph.dependency_cone(a.depends_on(s, d), _one(s, d))


@query("cone_hops", _CONE + " SELECT node, CAST(coalesce(min(hop) FILTER (hop > 0), 0) AS INT) AS hop FROM cone GROUP BY node")
def cone_hops(s, d):
    edges = a.depends_on(s, d).select("src", "dst").unionByName(a.extends(s, d))
    return graph.cone_with_hops(edges, s.createDataFrame([(_one(s, d),)], "node string"))


def _labelled(s, d, label):
    return a.classes(s, d).where(F.col("label") == label).agg(F.min_by("fqn", "id").alias("fqn")).first()["fqn"]


@query("service_dependents", ", ed AS (SELECT DISTINCT src, dst FROM dep), back AS (SELECT fqn AS node, 0 AS hop FROM cls WHERE id = (SELECT min(id) FROM cls WHERE label = 'Repository') UNION SELECT src, hop + 1 FROM back JOIN ed ON dst = node WHERE hop < 10) SELECT node AS fqn, CAST(min(hop) AS INT) AS hops FROM back WHERE hop > 0 AND node IN (SELECT fqn FROM cls WHERE label = 'Service') GROUP BY node")
def service_dependents(s, d):
    return graph.service_dependents(a.depends_on(s, d), a.classes(s, d), _labelled(s, d, "Repository"))


@query("no_repo_path", ", e2 AS (SELECT src, dst FROM ext), back AS (SELECT fqn AS node, 0 AS hop FROM cls WHERE label = 'Repository' AND id > 20 UNION SELECT src, hop + 1 FROM back JOIN e2 ON dst = node WHERE hop < 10) SELECT fqn FROM cls WHERE label = 'Service' AND fqn NOT IN (SELECT node FROM back WHERE hop > 0)")
def no_repo_path(s, d):
    c = a.classes(s, d).withColumn("labels", F.when((F.col("label") == "Repository") & (F.col("id") <= 20), F.array().cast("array<string>")).otherwise(F.col("labels")))
    return graph.without_path(a.extends(s, d), c)


@query("search_by_name", "SELECT fqn, simple_name FROM cls WHERE contains(lower(simple_name), 'token')")
def search_by_name(s, d):
    return graph.search_by_name(a.classes(s, d), "Token").select("fqn", "simple_name")


_SRC = "(SELECT fqn AS source FROM cls WHERE id < 40)"


@query("transitive_ancestors", f", up AS (SELECT src AS node, dst AS ancestor, 1 AS depth FROM ext UNION ALL SELECT node, dst, depth + 1 FROM up JOIN ext ON src = ancestor WHERE depth < 10) SELECT node AS fqn, ancestor, CAST(depth AS INT) AS depth FROM up WHERE ancestor IN (SELECT source FROM {_SRC}) AND NOT EXISTS (SELECT 1 FROM (SELECT c.fqn AS f, p.fqn AS p FROM cls c JOIN cls p ON p.id = c.id // 2 WHERE c.id % 5 = 0 AND c.id > 0) o WHERE o.f = node AND o.p = ancestor)")
def transitive_ancestors(s, d):
    sources = a.classes(s, d).where("id < 40").select(F.col("fqn").alias("source"))
    fifth = a.classes(s, d).where("id % 5 = 0").select(F.col("fqn").alias("src"))
    own = a.extends(s, d).join(fifth, "src", "left_semi").select(F.col("src").alias("fqn"), F.col("dst").alias("source"))
    return graph.transitive_ancestors(a.extends(s, d), sources, own)


@query("ultimate_ancestor", ", up AS (SELECT src AS node, dst AS ancestor, 1 AS depth FROM ext UNION ALL SELECT node, dst, depth + 1 FROM up JOIN ext ON src = ancestor WHERE depth < 10), ok AS (SELECT * FROM up WHERE ancestor LIKE 'com.acme.%' AND ancestor NOT LIKE 'com.acme.ui%') SELECT node AS fqn, ancestor FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, ancestor) AS n FROM ok) WHERE n = 1")
def ultimate_ancestor(s, d):
    return graph.ultimate_ancestor(a.extends(s, d), "com.acme.", "com.acme.ui")


@query("repository_tables", ", ed AS (SELECT DISTINCT src, dst FROM dep), l AS (SELECT fqn AS r, fqn AS node, 0 AS hop FROM cls WHERE label = 'Repository' UNION SELECT r, dst, hop + 1 FROM l JOIN ed ON src = node WHERE hop < 3) SELECT DISTINCT r AS repository, lower(simple_name) AS \"table\" FROM l JOIN cls ON cls.fqn = node WHERE hop > 0 AND cls.id % 7 = 0")
def repository_tables(s, d):
    c = a.classes(s, d)
    maps = c.where("id % 7 = 0").select(F.col("fqn").alias("src"), F.lower("simple_name").alias("dst"))
    return graph.repository_tables(a.depends_on(s, d).select("src", "dst").distinct(), maps, c.where("label = 'Repository'").select(F.col("fqn").alias("repository")))


@query("term_graph", "SELECT t.term_id, t.usage_count, t.criticality, count(DISTINCT u.fqn) AS classes, sha256(string_agg(DISTINCT u.fqn, '|' ORDER BY u.fqn)) AS digest FROM trm t JOIN wrd u USING (term_id) GROUP BY ALL ORDER BY usage_count DESC, term_id LIMIT 100")
def term_graph(s, d):
    out = graph.term_graph(a.terms(s, d), a.class_words(s, d), a.defines_rule(s, d))
    return out.select("term_id", "usage_count", "criticality", F.size("classes").cast("long").alias("classes"), F.sha2(F.array_join("classes", "|"), 256).alias("digest"))


# ---- lexicon


@query("term_extract", "SELECT fqn, term_id FROM wrd")
def term_extract(s, d):
    return lexicon.extract_terms(a.classes(s, d)).select("fqn", "term_id")


@query("term_accumulate", "SELECT term_id, display_name, primary_fqn, usage_count, CASE WHEN term_id IN (" + a.HIGH_TERMS + ") THEN 'High' ELSE 'Low' END AS criticality, CASE WHEN term_id IN (" + a.HIGH_TERMS + ") THEN 'Moderate' ELSE 'None' END AS sensitivity FROM trm")
def term_accumulate(s, d):
    return lexicon.accumulate_terms(lexicon.extract_terms(a.classes(s, d))).select("term_id", "display_name", "primary_fqn", "usage_count", "criticality", "sensitivity")


@query("table_terms", "SELECT w AS term_id, min(n) AS primary_fqn, CASE WHEN w IN (" + a.HIGH_TERMS + ") THEN 'High' ELSE 'Low' END AS criticality FROM (SELECT unnest(string_split(lower(replace(p_name, ' ', '_')), '_')) AS w, p_name AS n FROM part) WHERE length(w) > 2 AND w NOT IN (SELECT term_id FROM trm) GROUP BY w")
def table_terms(s, d):
    t = a.read(s, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("table_name"), F.col("p_name").alias("fqn"))
    return lexicon.table_terms(t, a.terms(s, d)).select("term_id", "primary_fqn", "criticality")


_SECTIONS = ", sec AS (SELECT doc_id * 100000 + i AS section_id, doc_id, l[i] AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)), kw AS (SELECT DISTINCT section_id, w AS word FROM (SELECT section_id, unnest(regexp_extract_all(lower(body), '[a-zäöüß]+')) AS w FROM sec) WHERE length(w) > 3 AND w NOT IN (" + ",".join(f"'{w}'" for w in tx.STOP_WORDS) + "))"


def _sections(s, d):
    lines = a.read(s, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "body"))
    return lines.select((F.col("doc_id") * 100000 + F.col("i") + 1).alias("section_id"), F.col("doc_id").cast("string").alias("source"), F.lit("").alias("heading"), "body")


@query("keywords", _SECTIONS + " SELECT section_id, count(*) AS n_keywords, min(word) AS first_word, max(word) AS last_word FROM kw GROUP BY 1")
def keywords(s, d):
    k = _sections(s, d).select("section_id", tx.keywords(F.col("body")).alias("k")).where(F.size("k") > 0)
    return k.select("section_id", F.size("k").cast("long").alias("n_keywords"), F.array_min("k").alias("first_word"), F.array_max("k").alias("last_word"))


@query("doc_enrich", _SECTIONS + ", tk AS (SELECT DISTINCT item_id, w AS word FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-zäöüß]+')) AS w FROM benchmark) WHERE length(w) > 3 AND w NOT IN (" + ",".join(f"'{w}'" for w in tx.STOP_WORDS) + ")), ov AS (SELECT item_id, section_id, count(*) AS score FROM tk JOIN kw USING (word) GROUP BY 1, 2 HAVING count(*) >= 2) SELECT CAST(item_id AS VARCHAR) AS term_id, section_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, section_id) AS n FROM ov) WHERE n = 1")
def doc_enrich(s, d):
    t = a.read(s, d, "benchmark").select(F.col("item_id").cast("string").alias("term_id"), "text")
    return lexicon.enrich_from_sections(t, _sections(s, d)).select("term_id", "section_id", "score")


@query("class_description", ", cd AS (SELECT fqn, term_id, display_name, ui_role, domain_area FROM wrd JOIN trm USING (term_id)), ar AS (SELECT fqn, domain_area FROM (SELECT fqn, domain_area, row_number() OVER (PARTITION BY fqn ORDER BY count(*) DESC, domain_area) AS n FROM cd GROUP BY fqn, domain_area) WHERE n = 1) SELECT c.fqn, concat(c.simple_name, ' — ', replace(lower(ar.domain_area), '_', ' '), '. UI: ', (SELECT string_agg(DISTINCT ui_role, ', ' ORDER BY ui_role) FROM cd WHERE cd.fqn = c.fqn), '. Terms: ', (SELECT string_agg(DISTINCT display_name, ', ' ORDER BY display_name) FROM cd WHERE cd.fqn = c.fqn), '.') AS description FROM cls c JOIN ar USING (fqn)")
def class_description(s, d):
    return lexicon.class_descriptions(a.class_words(s, d), a.terms(s, d), a.classes(s, d))


@query("abbreviations", "SELECT ab AS abbreviation, min(nm) AS seen_in FROM (SELECT concat(upper(substr(c_mktsegment, 1, 2)), 'Class', c_nationkey) AS nm, upper(substr(c_mktsegment, 1, 2)) AS ab FROM customer) WHERE ab NOT IN ('BO','PO','IO','CSS') GROUP BY 1")
def abbreviations(s, d):
    c = a.read(s, d, "customer").select(F.concat(F.upper(F.substring("c_mktsegment", 1, 2)), F.lit("Class"), F.col("c_nationkey").cast("string")).alias("simple_name"))
    return lexicon.abbreviations(c)


_KEYS = "(SELECT p_partkey AS id, concat(CASE p_partkey % 8 WHEN 0 THEN 'lbl' WHEN 1 THEN 'msg' WHEN 2 THEN 'TypeText_' WHEN 3 THEN 'Function_' WHEN 4 THEN 'ToolTipText_' WHEN 5 THEN 'btn' WHEN 6 THEN 'error.' ELSE 'other' END, p_type) AS k FROM part)"


@query("nls_classify", f"SELECT id, k AS key, CASE id % 8 WHEN 0 THEN 'NLS_LABEL' WHEN 1 THEN 'NLS_MESSAGE' WHEN 2 THEN 'NLS_TYPE' WHEN 3 THEN 'NLS_FUNCTION' WHEN 4 THEN 'NLS_TOOLTIP' ELSE 'NLS_OTHER' END AS category, CASE id % 8 WHEN 0 THEN 'LABEL' WHEN 1 THEN 'MESSAGE' WHEN 2 THEN 'ENUM_DISPLAY' WHEN 3 THEN 'GENERAL' WHEN 4 THEN 'TOOLTIP' WHEN 5 THEN 'BUTTON' WHEN 6 THEN 'ERROR' ELSE 'GENERAL' END AS ui_role FROM {_KEYS}")
def nls_classify(s, d):
    heads = F.array(*map(F.lit, ("lbl", "msg", "TypeText_", "Function_", "ToolTipText_", "btn", "error.", "other")))
    k = a.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.get(heads, (F.col("p_partkey") % 8).cast("int")), "p_type").alias("key"))
    return k.select("id", "key", tx.key_category(F.col("key")).alias("category"), tx.key_role(F.col("key")).alias("ui_role"))


@query("lexicon_search", "SELECT term_id, usage_count FROM trm WHERE criticality = 'High' AND contains(term_id, 'o') AND source_type LIKE 'NLS_%' ORDER BY usage_count DESC, term_id LIMIT 500")
def lexicon_search(s, d):
    return lexicon.search(a.terms(s, d), criticality="High", text="O", nls_only=True).select("term_id", "usage_count")


@query("term_detail", "SELECT term_id, criticality, sha256(string_agg(DISTINCT fqn, '|' ORDER BY fqn)) AS digest FROM trm JOIN wrd USING (term_id) WHERE term_id = 'token' GROUP BY 1, 2")
def term_detail(s, d):
    return lexicon.term_detail(a.terms(s, d), a.class_words(s, d), "token").select("term_id", "criticality", F.sha2(F.array_join("classes", "|"), 256).alias("digest"))


@query("terms_of_class", f"SELECT t.term_id, t.display_name FROM trm t WHERE term_id IN (SELECT term_id FROM wrd JOIN cls USING (fqn) WHERE id = {FOCAL})")
def terms_of_class(s, d):
    return lexicon.terms_of_class(a.terms(s, d), a.class_words(s, d), _one(s, d)).select("term_id", "display_name")


@query("term_curate", "SELECT term_id, CASE WHEN term_id = 'report' THEN 'High' ELSE criticality END AS criticality, curated OR term_id = 'report' AS curated FROM trm")
def term_curate(s, d):
    changes = s.createDataFrame([("report", "High")], "term_id string, criticality string")
    return lexicon.curate(a.terms(s, d), changes).select("term_id", "criticality", "curated")


@query("glossary_areas", "SELECT domain_area, count(*) AS term_count, (SELECT string_agg(display_name, '|' ORDER BY usage_count DESC, term_id) FROM (SELECT * FROM trm u WHERE u.domain_area = t.domain_area AND source_type LIKE 'NLS_%' ORDER BY usage_count DESC, term_id LIMIT 5)) AS top_terms FROM trm t WHERE source_type LIKE 'NLS_%' GROUP BY 1")
def glossary_areas(s, d):
    return lexicon.glossary_areas(a.terms(s, d)).select("domain_area", "term_count", F.array_join("top_terms", "|").alias("top_terms"))


@query("glossary_roles", "SELECT ui_role, count(*) AS term_count FROM trm WHERE source_type LIKE 'NLS_%' GROUP BY 1")
def glossary_roles(s, d):
    return lexicon.role_counts(a.terms(s, d))


@query("glossary_totals", "SELECT count(*) AS total, count(*) FILTER (source_type LIKE 'NLS_%') AS nls_total FROM trm")
def glossary_totals(s, d):
    return lexicon.totals(a.terms(s, d))


@query("link_terms", "SELECT primary_fqn AS fqn, term_id FROM trm UNION SELECT src, term_id FROM dep JOIN trm ON dst = primary_fqn")
def link_terms(s, d):
    return lexicon.link_terms(a.terms(s, d), a.depends_on(s, d), a.classes(s, d))


@query("link_rules", "SELECT DISTINCT fqn, term_id FROM rul")
def link_rules(s, d):
    return lexicon.link_rules(a.classes(s, d), a.terms(s, d))


@query("text_functions", "SELECT id, lower(regexp_replace(simple_name, '([^^])([A-Z])', '\\1_\\2', 'g')) AS snake, CASE WHEN complexity_sum/10.0 < 1 THEN 'LOW' WHEN complexity_sum/10.0 <= 2 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_label, CAST(length(fqn) // 4 AS BIGINT) AS tokens, list_extract(string_split(fqn, '.'), -1) AS last FROM cls")
def text_functions(s, d):
    return a.classes(s, d).select("id", tx.snake_case(F.col("simple_name")).alias("snake"), tx.risk_label(F.col("complexity_sum") / 10.0).alias("risk_label"), tx.token_estimate(F.col("fqn")).alias("tokens"), tx.simple_name(F.col("fqn")).alias("last"))


# ---- rules


_PFX = "SELECT concat('com.vaadin.ui.T', i) AS source, 'mapped' AS target FROM range(0, 12) t(i)"


def _rules(s: SparkSession) -> DataFrame:
    """Rules for the first twelve types, one of them still to be mapped, and two package rules."""
    r = s.range(12).select(
        F.format_string("R-%03d", "id").alias("rule_id"), F.when(F.col("id") % 2 == 0, "COMPONENT").otherwise("DATA").alias("category"),
        F.concat(F.lit("com.vaadin.ui.T"), F.col("id").cast("string")).alias("source"), F.concat(F.lit("new.T"), F.col("id").cast("string")).alias("target"),
        F.lit("CHANGE_TYPE").alias("action_type"), F.when(F.col("id") % 3 == 0, "PARTIAL").otherwise("YES").alias("automatable"),
        F.when(F.col("id").isin(5, 7), "NEEDS_MAPPING").otherwise("MAPPED").alias("status"), (F.col("id") * 3).cast("long").alias("usage_count"), F.col("id").cast("int").alias("pos"),
    )
    p = s.sql("select * from values ('P-1','PACKAGE','javax.a.','jakarta.a.','CHANGE_PACKAGE','YES','MAPPED',0L,100), ('P-2','PACKAGE','javax.','jakarta.','CHANGE_PACKAGE','YES','MAPPED',0L,101) as t(rule_id, category, source, target, action_type, automatable, status, usage_count, pos)")
    return r.unionByName(p)


@query("classify_imports", "SELECT l_orderkey, l_linenumber, im AS import_name, action_type, target, automatable FROM (SELECT *, CASE WHEN k < 12 AND k NOT IN (5, 7) THEN 'CHANGE_TYPE' WHEN g = 1 THEN 'CHANGE_PACKAGE' ELSE 'COMPLEX_REWRITE' END AS action_type, CASE WHEN k < 12 AND k NOT IN (5, 7) THEN concat('new.T', k) WHEN g = 1 THEN replace(im, 'javax', 'jakarta') ELSE 'Unknown' END AS target, CASE WHEN k < 12 AND k NOT IN (5, 7) THEN CASE WHEN k % 3 = 0 THEN 'PARTIAL' ELSE 'YES' END WHEN g = 1 THEN 'YES' ELSE 'NO' END AS automatable FROM (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS g, CASE WHEN l_partkey % 4 IN (0, 2) THEN l_suppkey % 20 ELSE 99 END AS k, CASE l_partkey % 4 WHEN 1 THEN concat('javax.a.X', l_suppkey % 5) WHEN 3 THEN 'java.util.List' ELSE concat('com.vaadin.ui.T', l_suppkey % 20) END AS im FROM lineitem)) WHERE g <> 3")
def classify_imports(s, d):
    g = F.col("l_partkey") % 4
    name = F.when(g == 1, F.concat(F.lit("javax.a.X"), (F.col("l_suppkey") % 5).cast("string"))).when(g == 3, "java.util.List").otherwise(F.concat(F.lit("com.vaadin.ui.T"), (F.col("l_suppkey") % 20).cast("string")))
    rows = a.read(s, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("fqn"), name.alias("import_name"))
    return rules.classify_imports(rows, _rules(s), "com.vaadin.", "com.vaadin.flow.").select("fqn.l_orderkey", "fqn.l_linenumber", "import_name", "action_type", "target", "automatable")


@query("transitive_complexity", _METHODS + f", up AS (SELECT src AS node, dst AS ancestor, 1 AS depth FROM ext UNION ALL SELECT node, dst, depth + 1 FROM up JOIN ext ON src = ancestor WHERE depth < 10), pr AS (SELECT node AS fqn, ancestor FROM up WHERE ancestor IN (SELECT source FROM {_SRC})), an AS (SELECT DISTINCT declaring_class AS ancestor, name FROM met), ov AS (SELECT fqn, ancestor, count(*) AS n FROM pr JOIN an USING (ancestor) JOIN met m ON m.declaring_class = fqn AND m.name = an.name GROUP BY 1, 2) SELECT concat(fqn, '#INHERITED#', ancestor) AS action_id, coalesce(n, 0) AS overrides, x AS complexity, x = 0 AS pure_wrapper, CASE WHEN x <= 0.4 THEN 'PARTIAL' ELSE 'NO' END AS automatable FROM (SELECT fqn, ancestor, n, CAST(least(0.3 * coalesce(n, 0) + CASE WHEN label = 'VaadinDataBinding' THEN 0.2 ELSE 0 END + CASE WHEN label = 'VaadinComponent' THEN 0.2 ELSE 0 END, 1) AS DOUBLE) AS x FROM pr JOIN cls USING (fqn) LEFT JOIN ov USING (fqn, ancestor))")
def transitive_complexity(s, d):
    c = a.classes(s, d)
    methods = _methods(s, d).select(F.col("declaring_class").alias("fqn"), "name")
    none = a.extends(s, d).where("false")
    out = rules.transitive_migrations(c, a.extends(s, d), none.select(F.col("src").alias("fqn"), F.col("dst").alias("source")), c.where("id < 40").select(F.col("fqn").alias("source")), methods, none, "com.vaadin.", "com.vaadin.flow.")
    return out.select("action_id", F.col("overrides").cast("long").alias("overrides"), *_r("complexity"), "pure_wrapper", "automatable")


@query("migration_scores", "SELECT fqn, count(*) AS action_count, count(*) FILTER (automatable = 'YES') AS automatable_count, round((count(*) FILTER (automatable = 'YES') + 0.5 * count(*) FILTER (automatable = 'PARTIAL')) / count(*), 6) AS automation_score, count(*) FILTER (automatable = 'NO') > 0 AS needs_ai FROM act GROUP BY fqn")
def migration_scores(s, d):
    return rules.migration_scores(a.actions(s, d)).select("fqn", "action_count", "automatable_count", *_r("automation_score"), "needs_ai")


@query("rule_enrich", ", us AS (SELECT source, count(*) AS n FROM act WHERE NOT is_inherited GROUP BY 1), old AS (SELECT printf('R-%03d', i) AS rule_id, concat('com.vaadin.ui.T', i) AS source, CASE WHEN i IN (5, 7) THEN 'NEEDS_MAPPING' ELSE 'MAPPED' END AS status, i * 3 AS u FROM range(0, 12) t(i)), un AS (SELECT source, count(*) AS n FROM act WHERE automatable = 'NO' AND source NOT IN (SELECT source FROM old) GROUP BY 1) SELECT rule_id, source, status, coalesce(n, u) AS usage_count FROM old LEFT JOIN us USING (source) UNION ALL SELECT printf('DISC-%03d', row_number() OVER (ORDER BY n DESC, source)), source, 'NEEDS_MAPPING', n FROM un UNION ALL SELECT 'P-1', 'javax.a.', 'MAPPED', 0 UNION ALL SELECT 'P-2', 'javax.', 'MAPPED', 0")
def rule_enrich(s, d):
    return rules.enrich_rules(_rules(s), a.actions(s, d), "com.vaadin.", "com.vaadin.flow.")


@query("migration_plan", f"SELECT fqn, coalesce(string_agg(action_id, '|' ORDER BY action_id) FILTER (automatable = 'YES'), '') AS automatable_actions, coalesce(string_agg(action_id, '|' ORDER BY action_id) FILTER (automatable <> 'YES'), '') AS manual_actions, count(*) AS action_count, round((count(*) FILTER (automatable = 'YES') + 0.5 * count(*) FILTER (automatable = 'PARTIAL')) / count(*), 6) AS automation_score FROM act JOIN cls USING (fqn) WHERE id = {FOCAL} GROUP BY fqn")
def migration_plan(s, d):
    p = rules.migration_plan(a.actions(s, d), _one(s, d))
    return p.select("fqn", F.array_join("automatable_actions", "|").alias("automatable_actions"), F.array_join("manual_actions", "|").alias("manual_actions"), "action_count", *_r("automation_score"))


@query("project_summary", ", per AS (SELECT fqn, count(*) AS n, count(*) FILTER (automatable = 'YES') AS y, (count(*) FILTER (automatable = 'YES') + 0.5 * count(*) FILTER (automatable = 'PARTIAL')) / count(*) AS sc, count(*) FILTER (is_inherited) AS i FROM act GROUP BY 1) SELECT count(*) AS total_classes, count(*) FILTER (n > 0) AS classes_with_actions, count(*) FILTER (sc = 1) AS fully_automatable, count(*) FILTER (sc > 0 AND sc < 1) AS partially_automatable, count(*) FILTER (n > 0 AND sc = 0) AS needs_ai_only, round(avg(sc), 6) AS avg_score, CAST(sum(n) AS BIGINT) AS total_actions, CAST(sum(y) AS BIGINT) AS total_automatable, count(*) FILTER (i > 0) AS transitive_classes FROM cls LEFT JOIN per USING (fqn)")
def project_summary(s, d):
    out = rules.summary(a.classes(s, d), a.actions(s, d))
    return out.withColumn("avg_score", F.round("avg_score", 6))


@query("migration_coverage", "SELECT round((SELECT count(*) FILTER (automatable <> 'NO') / count(*) FROM (SELECT DISTINCT source, automatable FROM act WHERE NOT is_inherited)), 6) AS coverage_by_type, round((SELECT count(*) FILTER (automatable <> 'NO') / count(*) FROM act WHERE NOT is_inherited), 6) AS coverage_by_usage")
def migration_coverage(s, d):
    return rules.coverage(a.classes(s, d), a.actions(s, d)).select(*_r("coverage_by_type", "coverage_by_usage"))


_BOOKS = "SELECT p_partkey % 40 AS k, p_partkey AS pos, p_partkey % 3 AS book, p_type AS target FROM part WHERE p_partkey < 120"


@query("rule_overlay", f", b AS ({_BOOKS}) SELECT concat('s', k) AS source, max_by(target, book * 1000 + pos) AS target, CAST(min(book * 1000 + pos) // 1000 AS INT) AS book, CAST(min(book * 1000 + pos) % 1000 AS INT) AS pos, max(book) = 0 AS is_base FROM b GROUP BY k")
def rule_overlay(s, d):
    p = a.read(s, d, "part").where("p_partkey < 120").select(F.concat(F.lit("s"), (F.col("p_partkey") % 40).cast("string")).alias("source"), F.col("p_partkey").cast("int").alias("pos"), (F.col("p_partkey") % 3).alias("b"), F.col("p_type").alias("target"))
    books = [p.where(F.col("b") == k).drop("b") for k in range(3)]
    return rules.overlay(*books).select("source", "target", "book", "pos", "is_base")


@query("rule_overlay_all", ", b AS (SELECT p_partkey % 40 AS k, p_partkey AS pos, p_partkey % 3 AS book, p_type AS target FROM part), f AS (SELECT k, min(book) AS book, max(book) AS last FROM b GROUP BY k) SELECT concat('s', k) AS source, (SELECT max_by(target, pos) FROM b WHERE b.k = f.k AND b.book = f.last) AS target, CAST(book AS INT) AS book, (SELECT min(pos) FROM b WHERE b.k = f.k AND b.book = f.book) AS pos, last = 0 AS is_base FROM f")
def rule_overlay_all(s, d):
    p = a.read(s, d, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 40).cast("string")).alias("source"), F.col("p_partkey").alias("pos"), (F.col("p_partkey") % 3).alias("b"), F.col("p_type").alias("target"))
    books = [p.where(F.col("b") == k).drop("b") for k in range(3)]
    return rules.overlay(*books).select("source", "target", "book", "pos", "is_base")


@query("rule_gaps", "SELECT concat('com.vaadin.ui.T', i) AS source, i * 3 AS usage_count FROM (VALUES (5), (7)) t(i)")
def rule_gaps(s, d):
    return rules.gaps(_rules(s)).select("source", "usage_count")


@query("rule_filter", "SELECT printf('R-%03d', i) AS rule_id FROM range(0, 12) t(i) WHERE i % 2 = 0 AND i % 3 = 0")
def rule_filter(s, d):
    return rules.filter_rules(_rules(s), category="COMPONENT", automatable="PARTIAL").select("rule_id")


@query("rule_upsert", "SELECT printf('R-%03d', i) AS rule_id, i AS usage_count, true AS base FROM range(0, 12) t(i) WHERE i <> 3 UNION ALL SELECT 'P-1', 0, true UNION ALL SELECT 'P-2', 0, true UNION ALL SELECT 'NEW', 77, false".replace("i AS usage_count", "i * 3 AS usage_count"))
def rule_upsert(s, d):
    base = _rules(s).withColumn("is_base", F.lit(True))
    changes = base.where("rule_id = 'R-003'").withColumn("rule_id", F.lit("NEW")).withColumn("usage_count", F.lit(77).cast("long"))
    return rules.upsert_rule(base, changes).select("rule_id", "usage_count", F.col("is_base").alias("base"))


@query("rule_categories", "SELECT CASE WHEN i % 2 = 0 THEN 'COMPONENT' ELSE 'DATA' END AS category, count(*) AS rules, CAST(sum(i * 3) AS BIGINT) AS usages FROM range(0, 12) t(i) GROUP BY 1 UNION ALL SELECT 'PACKAGE', 2, 0")
def rule_categories(s, d):
    return rules.category_counts(_rules(s))


@query("audit_report", "SELECT label, count(*) AS class_count, array_to_string(list_slice(list_sort(list(DISTINCT fqn)), 1, 5), '|') AS examples FROM cls WHERE label IS NOT NULL GROUP BY 1")
def audit_report(s, d):
    return rules.audit(a.classes(s, d)).select("label", "class_count", F.array_join("examples", "|").alias("examples"))


# ---- vectors and retrieval

_COS = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6)"


def _query_vector(s, d):
    return a.chunks(s, d).where("vec_id = 0").select("vector")


@query("vector_topk", f"SELECT vec_id, concat('m', label) AS module, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(s, d):
    return vectors.top_k(a.chunks(s, d), _query_vector(s, d)).select("vec_id", "module", "score")


@query("vector_topk_filtered", f"SELECT vec_id, {_COS} AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered(s, d):
    return vectors.top_k(a.chunks(s, d), _query_vector(s, d), module="m3").select("vec_id", "score")


def _points(s, d):
    c = a.classes(s, d).select(F.col("id").alias("vec_id"), "fqn")
    return a.chunks(s, d).join(c, "vec_id")


@query("vector_cone_topk", _CONE + f" SELECT vec_id, {_COS} AS score FROM embeddings JOIN cls ON cls.id = vec_id WHERE fqn IN (SELECT node FROM cone) ORDER BY score DESC, vec_id LIMIT 10")
def vector_cone_topk(s, d):
    edges = a.depends_on(s, d).select("src", "dst").unionByName(a.extends(s, d))
    cone = graph.cone_with_hops(edges, s.createDataFrame([(_one(s, d),)], "node string")).select(F.col("node").alias("fqn"))
    return vectors.top_k_within(_points(s, d), cone, _query_vector(s, d)).select("vec_id", "score")


@query("rerank", _SCORES + _CONE.replace(", ed AS", ", ed AS", 1) + f", hp AS (SELECT node, coalesce(min(hop) FILTER (hop > 0), 0) AS hop FROM cone GROUP BY node), hits AS (SELECT vec_id, fqn, {_COS} AS score FROM embeddings JOIN cls ON cls.id = vec_id WHERE fqn IN (SELECT node FROM hp) ORDER BY score DESC, vec_id LIMIT 60) SELECT vec_id, CAST(hop AS INT) AS hop, score, round(0.4*score + 0.35/greatest(hop, 1) + 0.25*enhanced_risk, 6) AS final_score FROM hits JOIN hp ON hp.node = hits.fqn JOIN sc USING (fqn) ORDER BY final_score DESC, vec_id LIMIT 20")
def rerank(s, d):
    edges = a.depends_on(s, d).select("src", "dst").unionByName(a.extends(s, d))
    focal = s.createDataFrame([(_one(s, d),)], "node string")
    return retrieve.retrieve(_points(s, d), _query_vector(s, d), edges, _scored(s, d), focal).select("vec_id", "hop", "score", "final_score")


# The same searches with every query vector: the rows whose id is divisible by 100.
_EACH = "SELECT q.vec_id AS query_id, p.*, round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q CROSS JOIN {p} p WHERE q.vec_id % 100 = 0"
_BEST = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"


def _query_vectors(s, d):
    return a.chunks(s, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")


@query("vector_topk_each", f", e AS ({_EACH.format(p='embeddings')}) SELECT query_id, vec_id, concat('m', label) AS module, score FROM e QUALIFY {_BEST} <= 10")
def vector_topk_each(s, d):
    return vectors.top_k(a.chunks(s, d), _query_vectors(s, d)).select("query_id", "vec_id", "module", "score")


@query("vector_topk_filtered_each", f", e AS ({_EACH.format(p='(FROM embeddings WHERE label = 3)')}) SELECT query_id, vec_id, score FROM e QUALIFY {_BEST} <= 10")
def vector_topk_filtered_each(s, d):
    return vectors.top_k(a.chunks(s, d), _query_vectors(s, d), module="m3").select("query_id", "vec_id", "score")


_CONE_EACH = "e AS (" + _EACH.format(p="(SELECT vec_id, fqn, embedding FROM embeddings JOIN cls ON cls.id = vec_id WHERE fqn IN (SELECT node FROM cone))") + ")"


@query("vector_cone_topk_each", f"{_CONE}, {_CONE_EACH} SELECT query_id, vec_id, score FROM e QUALIFY {_BEST} <= 10")
def vector_cone_topk_each(s, d):
    edges = a.depends_on(s, d).select("src", "dst").unionByName(a.extends(s, d))
    cone = graph.cone_with_hops(edges, s.createDataFrame([(_one(s, d),)], "node string")).select(F.col("node").alias("fqn"))
    return vectors.top_k_within(_points(s, d), cone, _query_vectors(s, d)).select("query_id", "vec_id", "score")


@query("rerank_each", f"{_SCORES}{_CONE}, hp AS (SELECT node, coalesce(min(hop) FILTER (hop > 0), 0) AS hop FROM cone GROUP BY node), {_CONE_EACH}, hits AS (SELECT query_id, vec_id, fqn, score FROM e QUALIFY {_BEST} <= 60), f AS (SELECT query_id, vec_id, CAST(hop AS INT) AS hop, hits.score, round(0.4*hits.score + 0.35/greatest(hop, 1) + 0.25*enhanced_risk, 6) AS final_score FROM hits JOIN hp ON hp.node = hits.fqn JOIN sc USING (fqn)) FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, vec_id) <= 20")
def rerank_each(s, d):
    edges = a.depends_on(s, d).select("src", "dst").unionByName(a.extends(s, d))
    focal = s.createDataFrame([(_one(s, d),)], "node string")
    return retrieve.retrieve(_points(s, d), _query_vectors(s, d), edges, _scored(s, d), focal).select("query_id", "vec_id", "hop", "score", "final_score")


@query("cone_summary", _SCORES + _CONE + f" SELECT count(*) AS cone_size, count(*) FILTER ({_LEGACY}) AS legacy_count, round(avg(enhanced_risk), 6) AS avg_risk FROM sc WHERE fqn IN (SELECT node FROM cone)")
def cone_summary(s, d):
    scored = _scored(s, d)
    return retrieve.cone_summary(cone_hops(s, d), a.classes(s, d), scored, modules.legacy()).select("cone_size", "legacy_count", *_r("avg_risk"))


@query("cone_terms", _CONE + " SELECT term_id, count(*) AS classes FROM wrd WHERE fqn IN (SELECT node FROM cone) GROUP BY 1 ORDER BY classes DESC, term_id LIMIT 10")
def cone_terms(s, d):
    return retrieve.top_terms(cone_hops(s, d), a.class_words(s, d))


@query("token_budget", "SELECT doc_id, tokens FROM (SELECT doc_id, n_chars // 4 AS tokens, sum(n_chars // 4) OVER () - coalesce(sum(n_chars // 4) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM documents WHERE doc_id < 100) WHERE rest <= 7200")
def token_budget(s, d):
    first = a.read(s, d, "documents").where("doc_id < 100").select("doc_id", F.floor(F.col("n_chars") / 4).alias("tokens"))  # a ranked result list
    return retrieve.token_budget(first, rank="doc_id").select("doc_id", "tokens")


@query("token_budget_all", "SELECT doc_id, tokens FROM (SELECT doc_id, n_chars // 4 AS tokens, sum(n_chars // 4) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS rest, sum(n_chars // 4) OVER () AS whole FROM documents) WHERE rest * 10 <= whole * 9")
def token_budget_all(s, d):
    ranked = a.read(s, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 4).alias("tokens"))
    whole = ranked.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    return retrieve.token_budget(ranked, rank="doc_id", budget=whole * 9 // 10).select("doc_id", "tokens")


@query("reindex_diff", "SELECT doc_id, CASE WHEN doc_id % 25 = 0 THEN 'deleted' WHEN doc_id % 10 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM documents")
def reindex_diff(s, d):
    docs = a.read(s, d, "documents").select(F.col("doc_id").alias("key"), "text")
    stored = docs.select("key", F.sha2("text", 256).alias("hash"))
    current = docs.where("key % 25 <> 0").select("key", F.sha2(F.when(F.col("key") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return vectors.reindex_diff(stored, current).select(F.col("key").alias("doc_id"), "change")


@query("vector_module_counts", "SELECT concat('m', label) AS module, count(*) AS points FROM embeddings GROUP BY 1")
def vector_module_counts(s, d):
    return vectors.module_counts(a.chunks(s, d))


@query("vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE concat('m', label) END AS module FROM embeddings WHERE label <> 4 OR vec_id % 5 = 0")
def vector_upsert(s, d):
    p = a.chunks(s, d).select(F.col("vec_id").alias("point_id"), "module", F.col("module").alias("fqn"))
    kept = vectors.delete_by_class(p, s.createDataFrame([("m4",)], "fqn string"))
    out = vectors.upsert_points(kept.select("point_id", "module", "fqn"), p.where("point_id % 5 = 0").withColumn("module", F.lit("new")))
    return out.select(F.col("point_id").alias("vec_id"), "module")


@query("chunk", _METHODS + " SELECT 'CLASS_HEADER' AS chunk_type, count(*) AS chunks FROM cls UNION ALL SELECT 'METHOD', count(DISTINCT method_id) FROM met")
def chunk(s, d):
    none = a.extends(s, d).where("false")
    m = _methods(s, d).select(F.col("declaring_class").alias("fqn"), "method_id")
    out = vectors.chunk(a.classes(s, d), m, a.depends_on(s, d), a.class_words(s, d), none)
    return out.groupBy("chunk_type").agg(F.countDistinct("point_id").alias("chunks"))


# ---- merge


@query("merge_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN NULL ELSE p_name END AS p_name, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part".replace("CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN NULL ELSE p_name END", "p_name"))
def merge_upsert(s, d):
    old = a.read(s, d, "part").select("p_partkey", "p_name", "p_size")
    new = old.where("p_partkey % 3 = 0").select("p_partkey", F.lit(None).cast("string").alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    return merge.merge(old, new, "p_partkey")


@query("curated_merge", "SELECT term_id, CASE WHEN curated THEN criticality ELSE 'High' END AS criticality, usage_count + 1 AS usage_count, curated FROM trm")
def curated_merge(s, d):
    t = a.terms(s, d).select("term_id", "criticality", "usage_count", "curated")
    new = t.select("term_id", F.lit("High").alias("criticality"), (F.col("usage_count") + 1).alias("usage_count"), F.lit(False).alias("curated"))
    return merge.curated_merge(t, new)


@query("cascade_delete", ", gone AS (SELECT fqn FROM cls WHERE id % 11 = 0) SELECT 'classes' AS \"table\", count(*) AS n FROM cls WHERE fqn NOT IN (SELECT fqn FROM gone) UNION ALL SELECT 'depends', count(*) FROM dep WHERE src NOT IN (SELECT fqn FROM gone) AND dst NOT IN (SELECT fqn FROM gone) UNION ALL SELECT 'actions', count(*) FROM act WHERE fqn NOT IN (SELECT fqn FROM gone)")
def cascade_delete(s, d):
    c = a.classes(s, d)
    left = merge.cascade_delete(c.where("id % 11 = 0").select("fqn"), {"classes": (c, ("fqn",)), "depends": (a.depends_on(s, d), ("src", "dst")), "actions": (a.actions(s, d), ("fqn",))})
    out = None
    for name, df in left.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("last_wins", "SELECT o_custkey, max_by(o_orderkey, epoch_us(o_orderdate) * 10000000 + o_orderkey) AS o_orderkey FROM orders GROUP BY 1".replace("epoch_us(o_orderdate) * 10000000 + o_orderkey", "o_orderkey"))
def last_wins(s, d):
    return merge.last_wins(a.read(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("seq")), "o_custkey", "seq").select("o_custkey", "o_orderkey")


@query("windowed_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(s, d):
    from lodestone.streaming.incremental import windowed_counts as counts

    return counts(a.read(s, d, "events")).select(F.col("window.start").alias("hour"), "event_type", "events", F.round("total", 4).alias("total"))


# ---- validation


def _graph(s: SparkSession, d: str) -> validate.Graph:
    """The derived graph with every kind of edge that the tables give; some checks find offenders on purpose."""
    c, dep, ext = a.classes(s, d), a.depends_on(s, d), a.extends(s, d)
    scored = _scored(s, d).join(rules.migration_scores(a.actions(s, d)).select("fqn", "action_count", "automation_score"), "fqn", "left")
    up = ext.select(F.col("src").alias("fqn"), F.col("dst").alias("super_class"))
    classes = scored.join(up, "fqn", "left").withColumn("interfaces", F.array().cast("array<string>"))
    edge = lambda df, kind, sk, dk, x="src", y="dst": df.select(F.lit(sk).alias("src_kind"), F.col(x).alias("src"), F.lit(kind).alias("type"), F.lit(dk).alias("dst_kind"), F.col(y).alias("dst"))
    maps = c.where("id % 7 = 0").select("fqn", F.lower("simple_name").alias("table_name"))
    edges = edge(dep, "DEPENDS_ON", "class", "class")
    for more in (
        edge(ext.join(c.where("id % 50 = 1").select(F.col("fqn").alias("src")), "src", "left_anti"), "EXTENDS", "class", "class"),
        edge(a.class_words(s, d), "USES_TERM", "class", "term", "fqn", "term_id"), edge(a.defines_rule(s, d), "DEFINES_RULE", "class", "term", "fqn", "term_id"),
        edge(c.where("id % 9 <> 0"), "CONTAINS_CLASS", "package", "class", "package_name", "fqn"), edge(maps, "MAPS_TO_TABLE", "class", "table", "fqn", "table_name"),
        edge(a.actions(s, d), "HAS_MIGRATION_ACTION", "class", "action", "fqn", "action_id"),
    ):
        edges = edges.unionByName(more)
    empty = lambda schema: s.createDataFrame([], schema)
    return validate.Graph(
        classes=classes, edges=edges, methods=empty("method_id string"), fields=empty("field_id string"), annotations=s.createDataFrame([("Secured",)], "annotation string"),
        packages=c.select("package_name").distinct(), modules=c.select("module").distinct(), tables=c.select(F.lower("simple_name").alias("table_name")).distinct(),
        terms=a.terms(s, d), actions=a.actions(s, d), pilot="Brand#7",
    )


_V = lambda name, sev, items: f"SELECT '{name}' AS name, '{sev}' AS severity, count(*) AS count, coalesce(array_to_string(list_slice(list_sort(list(i)), 1, 20), '|'), '') AS details FROM ({items})"
_NONE = "SELECT 'x' AS i WHERE false"
_EXT2 = "SELECT src, dst FROM ext WHERE src NOT IN (SELECT fqn FROM cls WHERE id % 50 = 1)"
_VALIDATION = {
    "ORPHAN_CLASS_NODES": ("WARNING", "SELECT fqn AS i FROM cls WHERE id % 9 = 0"),
    "DANGLING_METHOD_NODES": ("ERROR", _NONE), "DANGLING_FIELD_NODES": ("ERROR", _NONE), "DANGLING_ANNOTATION_NODES": ("WARNING", "SELECT 'Secured' AS i"),
    "DUPLICATE_CLASS_FQNS": ("ERROR", _NONE),
    "EXTENDS_CHAIN_DANGLING": ("WARNING", "SELECT concat(src, ' -> ', dst) AS i FROM ext WHERE src IN (SELECT fqn FROM cls WHERE id % 50 = 1)"),
    "IMPLEMENTS_MISSING": ("WARNING", _NONE),
    "MAPS_TO_TABLE_ORPHAN_TABLE": ("WARNING", "SELECT DISTINCT lower(simple_name) AS i FROM cls WHERE lower(simple_name) NOT IN (SELECT lower(simple_name) FROM cls WHERE id % 7 = 0)"),
    "QUERIES_EDGE_INTEGRITY": ("ERROR", _NONE), "BINDS_TO_EDGE_INTEGRITY": ("ERROR", _NONE), "SERVICE_HAS_DEPENDENCIES": ("WARNING", _NONE),
    "REPOSITORY_HAS_QUERIES": ("WARNING", "SELECT fqn AS i FROM cls WHERE label = 'Repository'"), "UI_VIEW_HAS_BINDS_TO": ("WARNING", "SELECT fqn AS i FROM cls WHERE label = 'VaadinView'"),
    "ENTITY_MAPS_TO_TABLE": ("WARNING", _NONE),
    "INHERITANCE_CHAIN_COMPLETENESS": ("ERROR", "SELECT concat(src, ' -> ', dst) AS i FROM ext WHERE src IN (SELECT fqn FROM cls WHERE id % 50 = 1)"),
    "TRANSITIVE_REPO_DEPENDENCY": ("WARNING", "SELECT fqn AS i FROM cls WHERE label = 'Service' AND fqn NOT IN (SELECT node FROM rback WHERE hop > 0)"),
    "NO_ISOLATED_MODULES": ("WARNING", "SELECT DISTINCT module AS i FROM cls"), "NO_EMPTY_PACKAGES": ("WARNING", _NONE),
    "ANNOTATION_COVERAGE": ("WARNING", "SELECT fqn AS i FROM cls WHERE NOT secured"), "CALLS_EDGE_COVERAGE": ("WARNING", _NONE), "ORPHAN_BUSINESS_TERMS": ("WARNING", _NONE),
    "DEFINES_RULE_COVERAGE": ("WARNING", _NONE), "USES_TERM_EDGE_INTEGRITY": ("ERROR", _NONE), "RISK_SCORES_POPULATED": ("ERROR", _NONE), "FAN_IN_OUT_POPULATED": ("ERROR", _NONE),
    "HIGH_RISK_NO_DEPENDENCIES": ("WARNING", _NONE), "DOMAIN_SCORES_POPULATED": ("ERROR", _NONE), "HIGH_DOMAIN_RISK_NO_BUSINESS_TERMS": ("WARNING", _NONE),
    "SECURITY_FINANCIAL_FLAGGED": ("WARNING", "SELECT fqn AS i FROM sc WHERE security_sensitivity > 0 OR financial_involvement > 0"),
    "VECTOR_INDEX_POPULATED": ("WARNING", "SELECT fqn AS i FROM cls"), "VECTOR_CHUNKS_HAVE_CONTENT_HASH": ("ERROR", _NONE), "VECTOR_SOURCE_FILES_ACCESSIBLE": ("WARNING", "SELECT source_path AS i FROM cls"),
}
_VALIDATION_SQL = (
    _SCORES + ", red AS (SELECT DISTINCT src, dst FROM dep), rback AS (SELECT fqn AS node, 0 AS hop FROM cls WHERE label = 'Repository' UNION SELECT src, hop + 1 FROM rback JOIN red ON dst = node WHERE hop < 10) SELECT name, severity, CASE WHEN (count = 0) <> (name = 'CALLS_EDGE_COVERAGE') THEN 'PASS' WHEN severity = 'ERROR' THEN 'FAIL' ELSE 'WARN' END AS status, count, details FROM ("
    + " UNION ALL ".join(_V(n, sev, items) for n, (sev, items) in _VALIDATION.items())
    + ")"
)


@query("validation_graph", _VALIDATION_SQL)
def validation_graph(s, d):
    checks = [c for c in validate.CHECKS if c.name in _VALIDATION]
    return validate.report(_graph(s, d), checks).withColumn("details", F.array_join("details", "|"))


_FLAGS = {
    "PILOT_MODULE_CLASS_COUNT": ("ERROR", "CASE WHEN (SELECT count(*) FROM cls WHERE module = 'Brand#7') < 15 THEN (SELECT count(*) FROM cls WHERE module = 'Brand#7') ELSE 0 END"),
    "PILOT_VAADIN7_NODES_PRESENT": ("WARNING", f"CASE WHEN (SELECT count(*) FROM cls WHERE module = 'Brand#7' AND {_LEGACY}) = 0 THEN 1 ELSE 0 END"),
    "PILOT_BUSINESS_TERMS_EXTRACTED": ("WARNING", "0"), "RAG_CONE_QUERY_FUNCTIONAL": ("WARNING", "0"), "RAG_VECTOR_INDEX_ALIGNED": ("WARNING", "0"), "RAG_RISK_SCORES_AVAILABLE": ("WARNING", "0"),
    "SCHEDULING_MODULES_EXIST": ("ERROR", "0"), "SCHEDULING_RISK_SCORES_POPULATED": ("WARNING", "0"), "SCHEDULING_DEPENDENCY_EDGES_EXIST": ("WARNING", "0"),
    "MIGRATION_ACTIONS_POPULATED": ("WARNING", "0"), "MIGRATION_SCORES_COMPUTED": ("WARNING", "0"), "MIGRATION_ACTION_EDGES_INTACT": ("ERROR", "0"), "RECIPE_BOOK_LOADED": ("WARNING", "0"),
    "TRANSITIVE_ACTIONS_DETECTED": ("WARNING", "0"),
    "MIGRATION_COVERAGE_GAPS": ("WARNING", "(SELECT CASE WHEN count(*) > 10 THEN count(*) ELSE 0 END FROM (SELECT DISTINCT source FROM act WHERE automatable = 'NO' AND action_type = 'COMPLEX_REWRITE'))"),
    "WRAPPER_MIGRATION_ACTIONS_PRESENT": ("WARNING", "1"), "WRAPPER_TRANSITIVE_DETECTION_ACTIVE": ("WARNING", "0"), "WRAPPER_NEEDS_MAPPING_DISCOVERABLE": ("WARNING", "0"),
}


@query("validation_flags", "SELECT name, severity, CASE WHEN count = 0 THEN 'PASS' WHEN severity = 'ERROR' THEN 'FAIL' ELSE 'WARN' END AS status, CAST(count AS BIGINT) AS count FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, '{sev}' AS severity, {c} AS count" for n, (sev, c) in _FLAGS.items()) + ")")
def validation_flags(s, d):
    checks = [c for c in validate.CHECKS if c.name in _FLAGS]
    return validate.report(_graph(s, d), checks).select("name", "severity", "status", "count")


# ---- more rows and cases for operators whose first query sees little of them; the SQL has its own literals


def _annotated(s, d):
    c = a.classes(s, d)
    return c.withColumn("annotations", F.when(F.col("id") % 30 == 7, F.array(F.lit("jakarta.validation.Constraint"))).otherwise(F.col("annotations")))


@query("link_rules_annotated", "SELECT DISTINCT fqn, term_id FROM (SELECT fqn, lower(unnest(regexp_extract_all(simple_name, '[A-Z][a-z]+'))) AS term_id FROM cls WHERE regexp_full_match(simple_name, '.*(Validator|Rule|Policy|Constraint|Calculator|Strategy).*') OR id % 30 = 7) WHERE term_id NOT IN ('validator', 'calculator') AND term_id IN (SELECT term_id FROM trm)")
def link_rules_annotated(s, d):
    return lexicon.link_rules(_annotated(s, d), a.terms(s, d))


@query("term_curate_full", "SELECT term_id, CASE term_id WHEN 'report' THEN 'High' WHEN 'blue' THEN 'Medium' WHEN 'token' THEN 'Low' ELSE criticality END AS criticality, CASE term_id WHEN 'report' THEN 'by hand' WHEN 'blue' THEN '' WHEN 'token' THEN 'x' END AS definition, CASE term_id WHEN 'report' THEN 'Critical' WHEN 'blue' THEN 'Moderate' WHEN 'token' THEN 'None' END AS sensitivity, CASE WHEN term_id IN ('report', 'blue', 'token') THEN 'curated' END AS status, curated OR term_id IN ('report', 'blue', 'token') AS curated FROM trm")
def term_curate_full(s, d):
    changes = s.sql("select * from values ('report', 'High', 'by hand'), ('blue', 'Medium', null), ('token', null, 'x'), ('unheard', 'High', '') as t(term_id, criticality, definition)")
    return lexicon.curate(a.terms(s, d), changes).select("term_id", "criticality", "definition", "sensitivity", "status", "curated")


@query("abbreviation_terms", "SELECT 'BU' AS term_id, 'BU — Business Unit' AS display_name, 'seen' AS definition, 'GLOSSARY' AS domain_area UNION ALL SELECT 'ZZ', 'ZZ — Not There', 'unseen', 'GLOSSARY' UNION ALL SELECT ab, concat(ab, ' — ?'), concat('Found in class ', min(nm), ', to be expanded'), 'GLOSSARY' FROM (SELECT concat(upper(substr(c_mktsegment, 1, 2)), 'Class', c_nationkey) AS nm, upper(substr(c_mktsegment, 1, 2)) AS ab FROM customer) WHERE ab NOT IN ('BU', 'BO', 'PO', 'IO') GROUP BY ab")
def abbreviation_terms(s, d):
    c = a.read(s, d, "customer").select(F.concat(F.upper(F.substring("c_mktsegment", 1, 2)), F.lit("Class"), F.col("c_nationkey").cast("string")).alias("simple_name"))
    glossary = s.sql("select * from values ('BU', 'Business Unit', 'seen'), ('ZZ', 'Not There', 'unseen') as t(abbreviation, expansion, evidence)")
    return lexicon.abbreviation_terms(c, glossary).select("term_id", "display_name", "definition", "domain_area")


@query("lexicon_search_hits", "SELECT term_id, usage_count FROM trm WHERE contains(term_id, 'u') AND source_type LIKE 'NLS_%' ORDER BY usage_count DESC, term_id LIMIT 500")
def lexicon_search_hits(s, d):
    return lexicon.search(a.terms(s, d), criticality="  ", text="U", nls_only=True).select("term_id", "usage_count")


@query("schedule_waves", _SCHED + ", me AS (SELECT DISTINCT x.module AS s, y.module AS t FROM dep JOIN cls x ON x.fqn = src JOIN cls y ON y.fqn = dst WHERE x.module > y.module), dc2 AS (SELECT t AS module, count(*) AS dependents FROM me GROUP BY 1), j2 AS (SELECT g.*, coalesce(dc2.dependents, 0) AS dependents, coalesce(commits, 0) AS commits FROM g LEFT JOIN dc2 USING (module) LEFT JOIN bcom USING (module)), m2 AS (SELECT greatest(max(dependents), 1) AS td, greatest(max(commits), 1) AS tc, max(avg_complexity) AS tx FROM j2), pth AS (SELECT module AS v, 1 AS w FROM g UNION SELECT me.s, w + 1 FROM pth JOIN me ON me.t = pth.v) SELECT module, CAST((SELECT max(w) FROM pth WHERE v = module) AS INT) AS wave, round(0.35*avg_risk + 0.25*dependents/td + 0.2*commits/tc + 0.2*least(ln(1+avg_complexity)/ln(1+tx), 1), 6) AS score FROM j2, m2")
def schedule_waves(s, d):
    m = a.classes(s, d).select("fqn", "module")
    ends = a.depends_on(s, d).join(m.select(F.col("fqn").alias("src"), F.col("module").alias("x")), "src").join(m.select(F.col("fqn").alias("dst"), F.col("module").alias("y")), "dst")
    return modules.recommend_schedule(_scored(s, d), ends.where("x > y").select("src", "dst"), _brand_commits(s, d)).select("module", "wave", *_r("score"))


_KINDS = (
    ", ek AS (SELECT src, dst FROM dep UNION SELECT src, dst FROM ext UNION SELECT x.fqn, y.fqn FROM cls x JOIN cls y ON y.id = x.id // 3 WHERE x.id % 6 = 0"
    " UNION SELECT x.fqn, y.fqn FROM cls x JOIN cls y ON y.id = x.id + 1 WHERE x.id % 11 = 0 UNION SELECT fqn, lower(simple_name) FROM cls WHERE id % 7 = 0"
    " UNION SELECT fqn, concat(fqn, '#m') FROM cls WHERE id % 4 = 0 UNION SELECT concat(x.fqn, '#m'), concat(y.fqn, '#m') FROM cls x JOIN cls y ON y.id = x.id * 2 WHERE x.id % 4 = 0)"
)


@query("cone_all_kinds", _KINDS + f", cone AS (SELECT fqn AS node, 0 AS hop FROM cls WHERE id = {FOCAL} UNION SELECT dst, hop + 1 FROM cone JOIN ek ON src = node WHERE hop < 10) SELECT node, CAST(min(hop) AS INT) AS hop FROM cone WHERE hop > 0 GROUP BY node")
def cone_all_kinds(s, d):
    """All kinds of edges that a cone goes along: depends, extends, implements, binds to, maps to a table, declares, calls."""
    c = a.classes(s, d).select("id", "fqn", "simple_name")
    to = lambda rows, other: rows.select(F.col("fqn").alias("src"), other.alias("id")).join(c.select("id", F.col("fqn").alias("dst")), "id").select("src", "dst")
    method = lambda name: F.concat(name, F.lit("#m"))
    calls = to(c.where("id % 4 = 0"), F.col("id") * 2).select(method("src").alias("src"), method("dst").alias("dst"))
    edges = a.depends_on(s, d).select("src", "dst")
    for more in (
        a.extends(s, d), to(c.where("id % 6 = 0"), F.expr("id div 3")), to(c.where("id % 11 = 0"), F.col("id") + 1), calls,
        c.where("id % 7 = 0").select(F.col("fqn").alias("src"), F.lower("simple_name").alias("dst")), c.where("id % 4 = 0").select(F.col("fqn").alias("src"), method("fqn").alias("dst")),
    ):
        edges = edges.unionByName(more)
    return graph.dependency_cone(edges, _one(s, d))


@query("hop_texts", _CONE + " SELECT node, CASE h WHEN 0 THEN 'focal class' WHEN 1 THEN 'direct dependency (1 hop)' ELSE concat('multi-hop (', h, ' hops)') END AS path FROM (SELECT node, coalesce(min(hop) FILTER (hop > 0), 0) AS h FROM cone GROUP BY node)")
def hop_texts(s, d):
    return cone_hops(s, d).select("node", tx.hop_text(F.col("hop")).alias("path"))


@query("transitive_complexity_calls", _METHODS + f", up AS (SELECT src AS node, dst AS ancestor, 1 AS depth FROM ext UNION ALL SELECT node, dst, depth + 1 FROM up JOIN ext ON src = ancestor WHERE depth < 10), pr AS (SELECT node AS fqn, ancestor FROM up WHERE ancestor IN (SELECT source FROM {_SRC}) AND NOT EXISTS (SELECT 1 FROM (SELECT c.fqn AS f, p.fqn AS p FROM cls c JOIN cls p ON p.id = c.id // 2 WHERE c.id % 5 = 0 AND c.id > 0) o WHERE o.f = node AND o.p = ancestor)), an AS (SELECT DISTINCT declaring_class AS ancestor, name FROM met), ov AS (SELECT fqn, ancestor, count(*) AS n FROM pr JOIN an USING (ancestor) JOIN met m ON m.declaring_class = fqn AND m.name = an.name GROUP BY 1, 2) SELECT concat(fqn, '#INHERITED#', ancestor) AS action_id, c AS calls, w AS wrapper_calls, x AS complexity, x = 0 AS pure_wrapper, CASE WHEN x <= 0.4 THEN 'PARTIAL' ELSE 'NO' END AS automatable FROM (SELECT *, round(CAST(least(0.3 * coalesce(n, 0) + 0.3 * c + 0.2 * w + CASE WHEN label = 'VaadinDataBinding' THEN 0.2 ELSE 0 END + CASE WHEN label = 'VaadinComponent' THEN 0.2 ELSE 0 END, 1) AS DOUBLE), 6) AS x FROM (SELECT fqn, ancestor, n, label, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS c, CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS w FROM pr JOIN cls USING (fqn) LEFT JOIN ov USING (fqn, ancestor)))")
def transitive_complexity_calls(s, d):
    """Calls into the framework (also old and new of its types), of wrappers, and classes with actions of their own."""
    c = a.classes(s, d)
    called = lambda rows, name: c.where(rows).select(F.col("fqn").alias("src"), F.lit(name).alias("dst"))
    calls = called("id % 3 = 0", "com.vaadin.ui.A").unionByName(called("id % 2 = 0", "com.vaadin.data.B")).unionByName(called("id % 3 = 0", "com.vaadin.ui.A"))
    calls = calls.unionByName(called("id % 5 = 0", "com.acme.wrappers.W")).unionByName(called("id % 7 = 0", "com.vaadin.flow.C"))
    own = a.extends(s, d).join(c.where("id % 5 = 0").select(F.col("fqn").alias("src")), "src", "left_semi").select(F.col("src").alias("fqn"), F.col("dst").alias("source"))
    methods = _methods(s, d).select(F.col("declaring_class").alias("fqn"), "name")
    out = rules.transitive_migrations(c, a.extends(s, d), own, c.where("id < 40").select(F.col("fqn").alias("source")), methods, calls, "com.vaadin.", "com.vaadin.flow.", "com.acme.wrappers.")
    return out.select("action_id", "calls", "wrapper_calls", *_r("complexity"), "pure_wrapper", "automatable")


def _inherited(s, d):
    """Actions of which some come from a wrapper, or through one."""
    n = F.regexp_extract("source", "[0-9]+$", 0).cast("int")
    source = F.when(n < 3, F.concat(F.lit("com.acme.wrappers.W"), n.cast("string"))).otherwise(F.col("source"))
    return a.actions(s, d).withColumn("inherited_from", F.when(F.col("is_inherited") & (n > 14), F.concat(F.lit("com.acme.wrappers.W"), (n % 3).cast("string")))).withColumn("source", source)


_INHERITED = ", nact AS (SELECT *, CAST(regexp_extract(source, '[0-9]+$') AS INT) AS n FROM act)"


@query("wrapper_counts", _INHERITED + " SELECT count(DISTINCT fqn) FILTER (n < 3) AS affected, count(DISTINCT fqn) FILTER (is_inherited AND n > 14) AS second_layer FROM nact")
def wrapper_counts(s, d):
    return rules.wrapper_counts(a.classes(s, d), _inherited(s, d), "com.acme.wrappers.")


@query("wrapper_intermediaries", _INHERITED + f" SELECT count(DISTINCT n % 3) AS intermediaries, count(*) > 0 AS has_intermediaries FROM nact WHERE is_inherited AND n > 14 AND fqn = (SELECT fqn FROM cls WHERE id = {FOCAL})")
def wrapper_intermediaries(s, d):
    return rules.wrapper_intermediaries(_inherited(s, d), _one(s, d), "com.acme.wrappers.")


def _book(s, d):
    """A rule for every part."""
    kind = F.when(F.col("p_partkey") % 3 == 0, "NEEDS_MAPPING").otherwise("MAPPED")
    return a.read(s, d, "part").select(
        F.format_string("R-%d", "p_partkey").alias("rule_id"), F.concat("p_type", F.lit("."), F.col("p_partkey").cast("string")).alias("source"), F.col("p_type").alias("category"),
        kind.alias("status"), F.col("p_size").cast("long").alias("usage_count"), F.when(F.col("p_partkey") % 2 == 0, "YES").otherwise("NO").alias("automatable"),
        F.col("p_partkey").cast("long").alias("pos"), F.lit(True).alias("is_base"),
    )


@query("rule_gaps_all", "SELECT concat(p_type, '.', p_partkey) AS source, p_size AS usage_count FROM part WHERE p_partkey % 3 = 0".replace("p_size AS", "CAST(p_size AS BIGINT) AS"))
def rule_gaps_all(s, d):
    return rules.gaps(_book(s, d)).select("source", "usage_count")


@query("rule_top_gaps", "SELECT concat(p_type, '.', p_partkey) AS source, CAST(p_size AS BIGINT) AS usage_count FROM part WHERE p_partkey % 3 = 0 AND p_type LIKE 'S%' ORDER BY p_size DESC, concat(p_type, '.', p_partkey) LIMIT 5")
def rule_top_gaps(s, d):
    return rules.top_gaps(_book(s, d), "S")


@query("rule_filter_all", "SELECT concat('R-', p_partkey) AS rule_id FROM part WHERE p_type = 'PROMO' AND p_partkey % 3 <> 0 AND p_partkey % 2 = 0")
def rule_filter_all(s, d):
    return rules.filter_rules(_book(s, d), category="PROMO", status="MAPPED", automatable="YES").select("rule_id")


@query("rule_upsert_all", "SELECT concat('R-', p_partkey) AS rule_id, CAST(p_size AS BIGINT) AS usage_count, true AS base FROM part WHERE p_partkey % 10 <> 4 UNION ALL SELECT concat('N-', p_partkey), 1, false FROM part WHERE p_partkey % 10 = 4")
def rule_upsert_all(s, d):
    book = _book(s, d)
    changes = book.where("pos % 10 = 4").withColumn("rule_id", F.format_string("N-%d", "pos")).withColumn("usage_count", F.lit(1).cast("long"))
    return rules.upsert_rule(book, changes).select("rule_id", "usage_count", F.col("is_base").alias("base"))


@query("rule_categories_all", "SELECT p_type AS category, count(*) AS rules, CAST(sum(p_size) AS BIGINT) AS usages FROM part GROUP BY 1")
def rule_categories_all(s, d):
    return rules.category_counts(_book(s, d))


@query("action_order", "SELECT action_id, CASE automatable WHEN 'NO' THEN 0 WHEN 'PARTIAL' THEN 1 ELSE 2 END AS rank FROM act")
def action_order(s, d):
    return rules.by_automatability(a.actions(s, d)).select("action_id", "rank")


@query("vector_topk_any", f"SELECT vec_id, concat('m', label) AS module, {_COS} AS score FROM embeddings WHERE label IN (3, 5) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_any(s, d):
    return vectors.top_k(a.chunks(s, d), _query_vector(s, d), module=["m3", "m5"]).select("vec_id", "module", "score")


_SOURCE_SQL = (
    "concat('/** Part ', id, ' of the suite. */\n@Service\npublic class ', simple_name, '_', id, ' {\n  private int size', CASE WHEN id % 2 = 0 THEN ';' ELSE ' = 1;' END, '\n  // no; field\n',"
    " '  public int run(int a) {\n', repeat('    if (a > 1) { help(); }\n', CAST(id % 4 AS INT)), repeat('    for (int i = 0; i < a; i++) { help(); }\n', CAST(id % 3 AS INT)),"
    " repeat('    while (a > 5) { a--; }\n', CAST(id % 2 AS INT)), '    return a;\n  }\n  void help() { }\n}\n')"
).replace("\n", "' || chr(10) || '").replace("|| ''", "")


def _varied_files(s, d):
    """A source for every part, with as many branches and loops as its key says."""
    k = F.col("id")
    times = lambda text, n: F.repeat(F.lit(text), (k % n).cast("int"))
    body = F.concat(
        F.lit("/** Part "), k.cast("string"), F.lit(" of the suite. */\n@Service\npublic class "), "simple_name", F.lit("_"), k.cast("string"), F.lit(" {\n  private int size"),
        F.when(k % 2 == 0, ";").otherwise(" = 1;"), F.lit("\n  // no; field\n  public int run(int a) {\n"), times("    if (a > 1) { help(); }\n", 4),
        times("    for (int i = 0; i < a; i++) { help(); }\n", 3), times("    while (a > 5) { a--; }\n", 2), F.lit("    return a;\n  }\n  void help() { }\n}\n"),
    )
    return a.classes(s, d).select(F.col("source_path").alias("path"), F.concat(F.lit("package "), "package_name", F.lit(";\n"), body).alias("content"))


@query("java_complexity", "SELECT concat(fqn, '#', m) AS method_id, CAST(x AS INT) AS complexity FROM (SELECT fqn, 'run(int)' AS m, 1 + id % 4 + id % 3 + id % 2 AS x FROM cls UNION ALL SELECT fqn, 'help()', 1 FROM cls)")
def java_complexity(s, d):
    from lodestone.sources import java

    return java.graph(java.extract(_varied_files(s, d)))["methods"].select("method_id", "complexity")


@query("chunk_points", f"{_SCORES}, src AS (SELECT *, concat('package ', package_name, ';', chr(10), {_SOURCE_SQL}) AS content, concat('/** Part ', id, ' of the suite. */') AS doc, CASE WHEN id % 2 = 0 THEN 'private int size;' ELSE 'private int size = 1;' END AS fld FROM sc WHERE id % 9 <> 0)"
       ", txt AS (SELECT fqn, 'CLASS_HEADER' AS chunk_type, concat('[CLASS: ', simple_name, '] [PACKAGE: ', package_name, ']', chr(10), doc, chr(10), fld) AS text FROM src"
       " UNION ALL SELECT fqn, 'METHOD', concat('[CLASS: ', simple_name, '] [METHOD: run(int)]', chr(10), rtrim(substr(content, strpos(content, 'run(int a) {') + 11, strpos(content, '  void help') - strpos(content, 'run(int a) {') - 12), chr(10))) FROM src)"
       " SELECT t.fqn, chunk_type, sha256(text) AS text, c.module, round(enhanced_risk, 6) AS enhanced_risk, round(structural_risk, 6) AS structural_risk, coalesce(label IN ('VaadinView', 'VaadinComponent', 'VaadinDataBinding'), false) AS legacy,"
       " coalesce((SELECT string_agg(DISTINCT src, '|' ORDER BY src) FROM dep WHERE dst = t.fqn), '') AS callers, coalesce((SELECT string_agg(DISTINCT dst, '|' ORDER BY dst) FROM dep WHERE src = t.fqn), '') AS dependencies,"
       " coalesce((SELECT string_agg(concat('{', chr(34), 'termId', chr(34), ':', chr(34), term_id, chr(34), ',', chr(34), 'displayName', chr(34), ':', chr(34), display_name, chr(34), '}'), ',' ORDER BY term_id) FROM wrd JOIN trm USING (term_id) WHERE wrd.fqn = t.fqn), '') AS terms FROM txt t JOIN sc c USING (fqn)")  # fmt: skip
def chunk_points(s, d):
    """The points of an index with their whole payload; every ninth class has no source path."""
    from lodestone.sources import java

    c = _scored(s, d).withColumn("source_path", F.when(F.col("id") % 9 != 0, F.col("source_path")))
    none = a.extends(s, d).where("false")
    methods = c.select("fqn", F.concat("fqn", F.lit("#run(int)")).alias("method_id"))
    texts = java.chunk_texts(c, methods, _varied_files(s, d))
    out = vectors.points(c.select(*a.classes(s, d).columns), methods, a.depends_on(s, d), a.class_words(s, d), none, a.terms(s, d), none, c, texts)
    return out.select(
        "fqn", "chunk_type", F.sha2("text", 256).alias("text"), "module", *_r("enhanced_risk", "structural_risk"), "legacy", F.array_join("callers", "|").alias("callers"),
        F.array_join("dependencies", "|").alias("dependencies"), F.regexp_replace("domain_terms", r"^\[|\]$", "").alias("terms"),
    )


# ---- streaming and sources, which SQL can't express


@query("incremental_stream")
def incremental_stream(s, d):
    """Part rows as changed files: a first version of each, then a second batch that changes, repeats and deletes some."""
    import uuid

    from lodestone.plans.scratch import ready
    from lodestone.streaming import incremental

    ready(s)
    context = s.sparkContext
    root = f"{context.getConf().get('spark.checkpoint.dir') or context._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    p = a.read(s, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("content"))
    p.select("path", "content", F.lit(False).alias("deleted"), F.col("k").alias("seq")).write.json(f"{root}/changes", mode="append")
    incremental.run_stream(s, f"{root}/changes", f"{root}/state").awaitTermination()
    second = p.where("k % 3 <> 0").select("path", F.when(F.col("k") % 3 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"), (F.col("k") % 5 == 0).alias("deleted"), (F.col("k") + 1_000_000_000).alias("seq"))
    second.write.json(f"{root}/changes", mode="append")
    incremental.run_stream(s, f"{root}/changes", f"{root}/state").awaitTermination()
    return merge.Snapshots(s, f"{root}/state/files").read().select("path", "content")


REGISTRY["incremental_stream"] = (
    incremental_stream,
    "SELECT concat('f', p_partkey) AS path, CASE WHEN p_partkey % 3 = 1 THEN concat(p_name, '!') ELSE p_name END AS content FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 <> 0",
)


def _java_files(s: SparkSession, d: str) -> DataFrame:
    """A small Java source for every part."""
    c = a.classes(s, d)
    body = F.format_string(
        "package %s;\nimport com.vaadin.ui.Button;\nimport org.x.Dep;\n@Service\npublic class C%s {\n  @Autowired private Dep dep;\n  public int run(int a, String b) {\n    if (a > %d) { return 1; }\n    for (int i = 0; i < a; i++) { help(); }\n    return a;\n  }\n  void help() { repo.save(1); }\n}\n",
        "package_name", F.col("id").cast("string"), F.col("complexity_sum"),
    )
    return c.select("source_path", body.alias("content")).withColumnRenamed("source_path", "path")


@query("java_extract", "SELECT concat(package_name, '.C', id, '#', m) AS method_id, CAST(x AS INT) AS complexity, CAST(w AS INT) AS writes FROM cls, (VALUES ('run(int,String)', 3, 0), ('help()', 1, 1)) t(m, x, w)")
def java_extract(s, d):
    from lodestone.sources import java

    return java.graph(java.extract(_java_files(s, d)))["methods"].select("method_id", "complexity", "writes")


def queries() -> dict[str, _Query]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
