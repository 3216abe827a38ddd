"""Risk scores of classes; each is a column over one plan, so the seven passes are one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import fan_in_out

#: Whole-word parts that mark security and money in names, annotations, packages and terms.
SECURITY_NAMES = (
    "auth", "login", "security", "encrypt", "cipher", "credential", "token", "permission", "acl", "oauth", "jwt", "password", "secret",
    "session", "principal", "role", "privilege",
)
SECURITY_ANNOTATIONS = ("secured", "preauthorize", "postauthorize", "rolesallowed", "permitall", "denyall", "withsecuritycontext")
SECURITY_PACKAGES = ("security", "auth", "crypto", "encryption", "authentication", "authorization")
MONEY_NAMES = (
    "payment", "invoice", "billing", "ledger", "account", "transaction", "currency", "tax", "price", "fee", "charge", "refund", "balance",
    "credit", "debit", "wallet", "payable", "receivable",
)
MONEY_PACKAGES = ("payment", "billing", "finance", "accounting", "ledger", "transaction")
MONEY_TERMS = ("payment", "invoice", "billing", "ledger", "transaction", "currency", "tax", "price", "fee", "charge", "refund", "balance", "credit", "debit")
#: Labels that count as stereotypes.
STEREOTYPES = ("Service", "Repository", "VaadinView", "VaadinComponent", "VaadinDataBinding", "Controller", "RestController", "Component", "Configuration")
#: Weights of the parts of a graded score.
NAME, ANNOTATION, BOTH, PACKAGE, TERM = 0.3, 0.5, 0.2, 0.2, 0.2
#: Weights of complexity, fan-in, fan-out and database writes, in the structural and the enhanced score.
STRUCTURAL, ENHANCED = (0.4, 0.2, 0.2, 0.2), (0.24, 0.12, 0.12, 0.12)


def _any(words) -> str:
    return f"^.*({'|'.join(words)}).*$"


def _hit(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _graded(name: Column, annotation: Column, package: Column, term: Column | None = None) -> Column:
    raw = name * NAME + annotation * ANNOTATION + F.when((name == 1) & (annotation == 1), BOTH).otherwise(0.0) + package * PACKAGE
    return F.least(raw + term * TERM if term is not None else raw, F.lit(1.0))


def structural(cc: Column, fan_in: Column, fan_out: Column, writes: Column) -> Column:
    """Unbounded: 0.4 ln(1 + complexity) + 0.2 ln(1 + fan-in) + 0.2 ln(1 + fan-out) + 0.2 if it writes to a database."""
    return _weighted(STRUCTURAL, cc, fan_in, fan_out, writes)


def _weighted(weights, cc: Column, fan_in: Column, fan_out: Column, writes: Column) -> Column:
    a, b, c, d = weights
    return F.log1p(cc) * a + F.log1p(fan_in) * b + F.log1p(fan_out) * c + F.when(writes, d).otherwise(0.0)


def domain_criticality(classes: DataFrame, uses: DataFrame, terms: DataFrame) -> DataFrame:
    """1 for a class that uses a High term, 0.5 for a Medium one, else 0."""
    level = F.max(F.when(F.col("criticality") == "High", 1.0).when(F.col("criticality") == "Medium", 0.5).otherwise(0.0))
    best = uses.join(terms.select("term_id", "criticality"), "term_id").groupBy("fqn").agg(level.alias("domain_criticality"))
    return classes.select("fqn").join(best, "fqn", "left").select("fqn", F.coalesce("domain_criticality", F.lit(0.0)).alias("domain_criticality"))


def security_sensitivity(classes: DataFrame) -> DataFrame:
    return classes.select("fqn", _security().alias("security_sensitivity"))


def _security() -> Column:
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return _graded(
        _hit(lower(F.col("simple_name")).rlike(_any(SECURITY_NAMES))),
        _hit(F.coalesce(F.exists("annotations", lambda a: F.lower(a).rlike(_any(SECURITY_ANNOTATIONS))), F.lit(False))),
        _hit(lower(F.col("package_name")).rlike(_any(SECURITY_PACKAGES))),
    )


def _financial(term_hit: Column) -> Column:
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return _graded(_hit(lower(F.col("simple_name")).rlike(_any(MONEY_NAMES))), F.lit(0), _hit(lower(F.col("package_name")).rlike(_any(MONEY_PACKAGES))), term_hit)


def financial_involvement(classes: DataFrame, uses: DataFrame, terms: DataFrame) -> DataFrame:
    money = terms.where(F.lower("term_id").rlike(_any(MONEY_TERMS)) | F.lower(F.coalesce("display_name", F.lit(""))).rlike(_any(MONEY_TERMS)))
    hit = uses.join(money, "term_id", "left_semi").select("fqn").distinct().withColumn("term_hit", F.lit(1))
    return classes.join(hit, "fqn", "left").select("fqn", _financial(F.coalesce("term_hit", F.lit(0))).alias("financial_involvement"))


def rule_density(classes: DataFrame, rules: DataFrame) -> DataFrame:
    """ln(1 + rules that the class defines)."""
    n = rules.groupBy("fqn").agg(F.count(F.lit(1)).alias("n"))
    return classes.select("fqn").join(n, "fqn", "left").select("fqn", F.log1p(F.coalesce("n", F.lit(0))).alias("business_rule_density"))


def scores(classes: DataFrame, depends: DataFrame, uses: DataFrame, terms: DataFrame, rules: DataFrame) -> DataFrame:
    """All scores of all classes in one plan; term and rule links are folded to a row per class before they join."""
    level = F.max(F.when(F.col("criticality") == "High", 1.0).when(F.col("criticality") == "Medium", 0.5).otherwise(0.0))
    money = F.lower("term_id").rlike(_any(MONEY_TERMS)) | F.lower(F.coalesce("display_name", F.lit(""))).rlike(_any(MONEY_TERMS))
    by_term = uses.join(terms.select("term_id", "criticality", "display_name"), "term_id").groupBy("fqn").agg(
        level.alias("domain_criticality"), F.max(_hit(money)).alias("term_hit")
    )
    by_rule = rules.groupBy("fqn").agg(F.count(F.lit(1)).alias("rule_count"))
    # a row for each class on both sides: never a broadcast, however small Spark takes it for
    joined = classes.hint("merge").join(fan_in_out(classes, depends), "fqn").join(by_term.hint("merge"), "fqn", "left").join(by_rule.hint("merge"), "fqn", "left")
    cc = F.coalesce("complexity_sum", F.lit(0))
    base = joined.select(
        *classes.columns, "fan_in", "fan_out",
        structural(cc, F.col("fan_in"), F.col("fan_out"), F.col("has_db_writes")).alias("structural_risk"),
        F.coalesce("domain_criticality", F.lit(0.0)).alias("domain_criticality"),
        _security().alias("security_sensitivity"),
        _financial(F.coalesce("term_hit", F.lit(0))).alias("financial_involvement"),
        F.log1p(F.coalesce("rule_count", F.lit(0))).alias("business_rule_density"),
    )
    enhanced = (
        _weighted(ENHANCED, cc, F.col("fan_in"), F.col("fan_out"), F.col("has_db_writes"))
        + F.col("domain_criticality") * 0.1 + F.col("security_sensitivity") * 0.1 + F.col("financial_involvement") * 0.1 + F.col("business_rule_density") * 0.1
    )
    return base.withColumn("enhanced_risk", enhanced)


SORTS = {"enhanced": "enhanced_risk", "structural": "structural_risk", "complexity": "complexity_sum", "fan_in": "fan_in", "fan_out": "fan_out"}


def heatmap(
    scored: DataFrame, actions: DataFrame, framework: str, module: str | None = None, package: str | None = None,
    stereotype: str | None = None, limit: int = 50, sort_by: str = "enhanced",
) -> DataFrame:
    """The riskiest classes that have a migration action from the framework; each filter counts only if it is given."""
    out = scored
    if module and module.strip():
        out = out.where(F.col("module") == module)
    if package and package.strip():
        out = out.where(F.col("package_name").startswith(package))
    if stereotype and stereotype.strip():
        out = out.where(F.array_contains("labels", stereotype))
    out = out.join(actions.where(F.col("source").startswith(framework)).select("fqn"), "fqn", "left_semi")
    return out.orderBy(F.desc(SORTS.get(sort_by, SORTS["enhanced"])), "fqn").limit(limit)


def detail(scored: DataFrame, methods: DataFrame, fqn: str) -> DataFrame:
    """One class's scores with its methods' complexities, sorted; no row if unknown."""
    own = methods.where(F.col("declaring_class") == fqn).groupBy(F.col("declaring_class").alias("fqn")).agg(F.array_sort(F.collect_list(F.struct("method_id", "complexity"))).alias("methods"))
    return scored.where(F.col("fqn") == fqn).join(own, "fqn", "left")


def stereotypes(labels: Column) -> Column:
    return F.array_sort(F.array_intersect(labels, F.array(*map(F.lit, STEREOTYPES))))
