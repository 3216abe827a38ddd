"""The canonical code graph as views of the driver's tables, once as DataFrames and once as DuckDB SQL.

A part is a class, its brand a module, its type a stereotype; line items are migration actions, embeddings are chunks,
events are commits and documents are legacy texts. Every operator takes canonical DataFrames, so it runs on any other
source as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: noun of the part's name -> word of the class name
NOUNS = {
    "ring": "Payment", "bolt": "Auth", "widget": "Invoice", "anvil": "Session", "gear": "Order",
    "gizmo": "TokenValidator", "plate": "PriceCalculator", "rod": "Report",
}
PACKAGES = {"PROMO": "ui", "LARGE": "billing", "ECONOMY": "security", "SMALL": "data", "MEDIUM": "forms", "STANDARD": "core"}
LABELS = {"PROMO": "VaadinView", "LARGE": "VaadinComponent", "ECONOMY": "Service", "SMALL": "Repository", "MEDIUM": "VaadinDataBinding"}
FRAMEWORK = "com.vaadin."
#: Terms that a curator has set to Medium.
MEDIUM_TERMS = ("order", "report", "blue")


_plans: ContextVar[dict | None] = ContextVar("plans", default=None)


@contextmanager
def once() -> Iterator[None]:
    """Inside, every view of the same tables is planned once; a later query reads the tables anew."""
    if _plans.get() is not None:
        yield
        return
    token = _plans.set({})
    try:
        yield
    finally:
        _plans.reset(token)


def shared(view: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(view)
    def get(spark: SparkSession, *names: str) -> DataFrame:
        held = _plans.get()
        if held is None:
            return view(spark, *names)
        key = (view, id(spark), names)
        if key not in held:
            held[key] = view(spark, *names)
        return held[key]

    return get


@shared
def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column, mapping: dict[str, str]):
    out = None
    for k, v in mapping.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out


@shared
def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    simple = F.concat(F.initcap(words[0]), F.coalesce(_case(words[1], NOUNS), F.lit("Thing")))
    package = F.concat(F.lit("com.acme."), F.coalesce(_case(F.col("p_type"), PACKAGES), F.lit("core")))
    fqn = lambda id_, p, s: F.concat(p, F.lit("."), s, F.lit("_"), id_.cast("string"))
    label = _case(F.col("p_type"), LABELS)
    return part.select(
        F.col("p_partkey").alias("id"), fqn(F.col("p_partkey"), package, simple).alias("fqn"), simple.alias("simple_name"),
        package.alias("package_name"), F.col("p_brand").alias("module"), F.col("p_size").alias("complexity_sum"),
        (F.col("p_size") % 10).alias("complexity_max"), (F.col("p_partkey") % 3 == 0).alias("has_db_writes"),
        F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("Secured"))).otherwise(F.array().cast("array<string>")).alias("annotations"),
        F.when(label.isNotNull(), F.array(label)).otherwise(F.array().cast("array<string>")).alias("labels"), label.alias("label"),
        F.concat(F.lit("src/"), package, F.lit("/"), simple, F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("source_path"),
        F.sha2(F.concat_ws("|", "p_name", "p_type", F.col("p_size").cast("string")), 256).alias("content_hash"),
    )


CLASSES = (
    "cls AS (SELECT p_partkey AS id, concat('com.acme.', pk, '.', sn, '_', p_partkey) AS fqn, sn AS simple_name, concat('com.acme.', pk) AS package_name,"
    " p_brand AS module, p_size AS complexity_sum, p_size % 10 AS complexity_max, p_partkey % 3 = 0 AS has_db_writes,"
    " p_partkey % 4 = 0 AS secured, label, concat('src/com.acme.', pk, '/', sn, '_', p_partkey, '.java') AS source_path FROM ("
    "SELECT *, concat(upper(substr(p_name, 1, 1)), substr(split_part(p_name, ' ', 1), 2), CASE split_part(p_name, ' ', 2) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NOUNS.items())
    + " ELSE 'Thing' END) AS sn, CASE p_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PACKAGES.items())
    + " ELSE 'core' END AS pk, CASE p_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())
    + " END AS label FROM part))"
)


@shared
def depends_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind): two dependencies of each class and a parallel one of every tenth; cycles occur."""
    c = classes(spark, sf_dir).select("id", "fqn")
    total = c.agg(F.count(F.lit(1)).alias("total"))
    steps = F.array(
        F.struct(((F.col("id") * 7 + 3) % F.col("total")).alias("to"), F.lit("FIELD").alias("kind")),
        F.struct(((F.col("id") * 13 + 5) % F.col("total")).alias("to"), F.lit("CONSTRUCTOR").alias("kind")),
        F.struct(((F.col("id") * 7 + 3) % F.col("total")).alias("to"), F.when(F.col("id") % 10 == 0, "SETTER").alias("kind")),
    )
    steps = F.filter(steps, lambda s: s["kind"].isNotNull())
    ends = c.select(F.col("id").alias("to"), F.col("fqn").alias("dst"))
    return (
        c.crossJoin(F.broadcast(total))  # one row
        .select(F.col("fqn").alias("src"), F.explode(steps).alias("s"))
        .select("src", "s.to", "s.kind")
        .join(ends.hint("merge"), "to")  # strings made of a few bytes a row, so Spark takes them for smaller than they are
        .select("src", "dst", "kind")
    )


DEPENDS = (
    "dep AS (SELECT s.fqn AS src, t.fqn AS dst, kind FROM (SELECT p_partkey AS a, (p_partkey * 7 + 3) % n AS b, 'FIELD' AS kind FROM part, nn"
    " UNION ALL SELECT p_partkey, (p_partkey * 13 + 5) % n, 'CONSTRUCTOR' FROM part, nn"
    " UNION ALL SELECT p_partkey, (p_partkey * 7 + 3) % n, 'SETTER' FROM part, nn WHERE p_partkey % 10 = 0) e"
    " JOIN cls s ON s.id = e.a JOIN cls t ON t.id = e.b)"
)


@shared
def extends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): a tree deeper than ten levels."""
    c = classes(spark, sf_dir).select("id", "fqn")
    return (
        c.where("id > 0").select(F.col("fqn").alias("src"), F.expr("id div 2").alias("to"))
        .join(c.select(F.col("id").alias("to"), F.col("fqn").alias("dst")).hint("merge"), "to").select("src", "dst")
    )


EXTENDS = "ext AS (SELECT c.fqn AS src, p.fqn AS dst FROM cls c JOIN cls p ON p.id = c.id // 2 WHERE c.id > 0)"


@shared
def class_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fqn, term_id): the domain words of each class name."""
    from lodestone.functions.text import term_words

    return classes(spark, sf_dir).select("fqn", F.explode(term_words(F.col("simple_name"))).alias("term_id"))


WORDS = (
    "wrd AS (SELECT DISTINCT fqn, lower(w) AS term_id FROM (SELECT fqn, unnest(regexp_extract_all(simple_name, '[A-Z][a-z]+')) AS w FROM cls)"
    " WHERE length(w) > 2 AND lower(w) NOT IN ('validator'))"
)


@shared
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted when this is called, so that Spark knows them to be fewer than the words they are joined with."""
    from lodestone.operators.lexicon import seed_criticality
    from lodestone.plans.scratch import cut

    t = cut(class_words(spark, sf_dir).groupBy("term_id").agg(F.count(F.lit(1)).alias("usage_count"), F.min("fqn").alias("primary_fqn")))
    size = F.length("term_id")
    return t.select(
        "term_id", F.initcap("term_id").alias("display_name"), "usage_count", "primary_fqn",
        F.when(F.col("term_id").isin(*MEDIUM_TERMS), "Medium").otherwise(seed_criticality(F.col("term_id"))).alias("criticality"),
        (size % 3 == 0).alias("curated"),
        F.when(size % 2 == 0, "NLS_LABEL").otherwise("CLASS_NAME").alias("source_type"),
        F.when(size <= 4, "LABEL").when(size <= 6, "BUTTON").otherwise("MESSAGE").alias("ui_role"),
        F.when(size <= 5, "ORDER_MANAGEMENT").otherwise("COMMON").alias("domain_area"),
    )


HIGH_TERMS = "'payment','invoice','billing','ledger','transaction','price','cost','fee','amount','currency','refund','credit','debit','auth','login','password','credential','token','session','permission','role','encrypt','decrypt','security','access'"
TERMS = (
    "trm AS (SELECT term_id, concat(upper(substr(term_id, 1, 1)), substr(term_id, 2)) AS display_name, usage_count, primary_fqn,"
    " CASE WHEN term_id IN ('order','report','blue') THEN 'Medium' WHEN term_id IN (" + HIGH_TERMS + ") THEN 'High' ELSE 'Low' END AS criticality,"
    " length(term_id) % 3 = 0 AS curated, CASE WHEN length(term_id) % 2 = 0 THEN 'NLS_LABEL' ELSE 'CLASS_NAME' END AS source_type,"
    " CASE WHEN length(term_id) <= 4 THEN 'LABEL' WHEN length(term_id) <= 6 THEN 'BUTTON' ELSE 'MESSAGE' END AS ui_role,"
    " CASE WHEN length(term_id) <= 5 THEN 'ORDER_MANAGEMENT' ELSE 'COMMON' END AS domain_area"
    " FROM (SELECT term_id, count(*) AS usage_count, min(fqn) AS primary_fqn FROM wrd GROUP BY term_id))"
)


@shared
def defines_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.lexicon import link_rules

    return link_rules(classes(spark, sf_dir), terms(spark, sf_dir))


#: Fixed values of the linking pass, written out here and not taken from the operator that is held against them.
RULES = (
    "rul AS (SELECT DISTINCT fqn, term_id FROM (SELECT fqn, lower(unnest(regexp_extract_all(simple_name, '[A-Z][a-z]+'))) AS term_id FROM cls"
    " WHERE regexp_full_match(simple_name, '.*(Validator|Rule|Policy|Constraint|Calculator|Strategy).*')) WHERE length(term_id) > 1"
    " AND term_id NOT IN ('service','repository','controller','manager','handler','factory','builder','config','configuration','impl','base','abstract',"
    "'helper','util','utils','test','validator','rule','policy','constraint','calculator','strategy','enum','type') AND term_id IN (SELECT term_id FROM trm))"
)


@shared
def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Migration actions: one per line item."""
    c = classes(spark, sf_dir).select(F.col("id").alias("l_partkey"), "fqn")
    return read(spark, sf_dir, "lineitem").join(c, "l_partkey").select(
        F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("action_id"), "fqn",
        F.concat(F.lit("com.vaadin.ui.T"), (F.col("l_suppkey") % 20).cast("string")).alias("source"),
        F.when(F.col("l_returnflag") == "A", "YES").when(F.col("l_returnflag") == "N", "PARTIAL").otherwise("NO").alias("automatable"),
        (F.col("l_linestatus") == "O").alias("is_inherited"),
        F.when(F.col("l_returnflag") == "A", "CHANGE_TYPE").when(F.col("l_returnflag") == "N", "CHANGE_METHOD").otherwise("COMPLEX_REWRITE").alias("action_type"),
    )


ACTIONS = (
    "act AS (SELECT concat(l_orderkey, '#', l_linenumber) AS action_id, fqn, concat('com.vaadin.ui.T', l_suppkey % 20) AS source,"
    " CASE l_returnflag WHEN 'A' THEN 'YES' WHEN 'N' THEN 'PARTIAL' ELSE 'NO' END AS automatable, l_linestatus = 'O' AS is_inherited,"
    " CASE l_returnflag WHEN 'A' THEN 'CHANGE_TYPE' WHEN 'N' THEN 'CHANGE_METHOD' ELSE 'COMPLEX_REWRITE' END AS action_type"
    " FROM lineitem JOIN cls ON cls.id = l_partkey)"
)


@shared
def nation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, t): every link from a customer's nation to another one that supplies it."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("s"))
    i = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    p = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("t"))
    return i.join(p, "l_suppkey").join(o, "o_orderkey").join(c, "o_custkey").where("s <> t").select("s", "t").distinct()


def nation_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): module dependencies between nations of customers and suppliers, thinned, with one cycle at the top."""
    real = nation_links(spark, sf_dir).where("s > t and (s * 5 + t) % 7 = 0")
    cycle = spark.sql("select * from values (23, 24), (24, 23) as x(s, t)")
    return real.unionByName(cycle).distinct().select(F.col("s").cast("string").alias("src"), F.col("t").cast("string").alias("dst"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("module"))


NATION_MODULES = (
    "nmod AS (SELECT DISTINCT s, t FROM (SELECT c_nationkey AS s, s_nationkey AS t FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"
    " JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey) WHERE s > t AND (s * 5 + t) % 7 = 0 UNION SELECT 23, 24 UNION SELECT 24, 23)"
)


@shared
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector points: label is the module, the class is the part of that number."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("module"))


def sql(*views: str) -> str:
    """WITH clause of the views given, in an order that holds."""
    known = {
        "nn": "nn AS (SELECT count(*) AS n FROM part)", "cls": CLASSES, "dep": DEPENDS, "ext": EXTENDS, "wrd": WORDS, "trm": TERMS,
        "rul": RULES, "act": ACTIONS, "nmod": NATION_MODULES,
    }
    return "WITH RECURSIVE " + ", ".join(known[v] for v in (views or known))


#: All views; those that a query doesn't name cost nothing.
WITH = sql()
