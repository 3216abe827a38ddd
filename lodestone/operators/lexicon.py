"""Business terms: extraction, enrichment from documents, search and glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import camel_words, capitalize, enum_words, keywords, link_words, snippet, term_words
from lodestone.operators.graph import first_of

#: Fixed value: names of classes that hold business rules.
RULE_NAME = ".*(Validator|Rule|Policy|Constraint|Calculator|Strategy).*"
#: Annotations of classes that are rules themselves.
RULE_ANNOTATIONS = ("javax.validation.Constraint", "jakarta.validation.Constraint")
#: Fixed value: abbreviations inside class names.
ABBREVIATION = r"(?<=[a-z])[A-Z]{2,4}(?=[A-Z][a-z]|$)|^[A-Z]{2,4}(?=[A-Z][a-z])"
#: Terms that are critical from the start.
MONEY_SEEDS = ("payment", "invoice", "billing", "ledger", "transaction", "price", "cost", "fee", "amount", "currency", "refund", "credit", "debit")
ACCESS_SEEDS = ("auth", "login", "password", "credential", "token", "session", "permission", "role", "encrypt", "decrypt", "security", "access")
#: Technical acronyms, which are no abbreviations of the domain.
ACRONYMS = (
    "BO", "PO", "DTO", "DAO", "API", "URL", "URI", "XML", "JSON", "HTML", "CSS", "HTTP", "HTTPS", "SQL", "JPA", "JMS", "JMX", "JDBC", "JNDI",
    "EJB", "CDI", "REST", "SOAP", "WSDL", "XSLT", "DOM", "SAX", "IO", "NIO", "TCP", "UDP", "SSL", "TLS", "SSH", "FTP", "SMTP", "LDAP", "SSO",
    "JWT", "SAML", "CORS", "CSV", "PDF", "PNG", "GIF", "SVG", "UUID", "ORM", "MVC", "MVP", "MVVM", "GUI", "CLI", "IDE", "SDK", "SPI", "RPC",
    "GRPC", "AMQP", "OIDC",
)
#: Keywords that a term and a section share at least, and tasks that a word's sections are dealt to.
MIN_OVERLAP, WORD_SALTS = 2, 8


def seed_criticality(term: Column) -> Column:
    return F.when(term.isin(*MONEY_SEEDS, *ACCESS_SEEDS), "High").otherwise("Low")


def sensitivity(criticality: Column) -> Column:
    return F.when(criticality == "High", "Moderate").otherwise("None")


def curated_sensitivity(criticality: Column) -> Column:
    """The sensitivity of a term whose criticality is set by hand."""
    return F.when(criticality == "High", "Critical").when(criticality == "Medium", "Moderate").otherwise("None")


def extract_terms(classes: DataFrame) -> DataFrame:
    """(term_id, fqn, source_type) from class names and, where a column constants has them, enum constants."""
    kind = F.when(F.col("is_enum"), "ENUM_NAME").otherwise("CLASS_NAME") if "is_enum" in classes.columns else F.lit("CLASS_NAME")
    out = classes.select("fqn", F.explode(term_words(F.col("simple_name"))).alias("term_id"), kind.alias("source_type"))
    if "constants" in classes.columns:
        constants = classes.select("fqn", F.explode("constants").alias("constant"))
        out = out.unionByName(constants.select("fqn", F.explode(enum_words(F.col("constant"))).alias("term_id"), F.lit("ENUM_CONSTANT").alias("source_type")))
    return out.select("term_id", "fqn", "source_type")


def accumulate_terms(found: DataFrame) -> DataFrame:
    """One row per term: the smallest source is primary, usage counts the distinct sources; criticality is seeded."""
    g = found.groupBy("term_id").agg(F.min("fqn").alias("primary_fqn"), F.countDistinct("fqn").alias("usage_count"), F.min_by("source_type", "fqn").alias("source_type"))
    level = seed_criticality(F.col("term_id"))
    return g.select("term_id", capitalize(F.col("term_id")).alias("display_name"), "primary_fqn", "usage_count", "source_type", level.alias("criticality"), sensitivity(level).alias("sensitivity"))


def table_terms(tables: DataFrame, known: DataFrame) -> DataFrame:
    """tables(table_name, fqn) -> new terms from the parts of table names, those longer than two letters."""
    parts = tables.select(F.explode(F.split(F.lower("table_name"), "_")).alias("term_id"), "fqn").withColumn("term_id", F.trim("term_id")).where(F.length("term_id") > 2)
    new = parts.groupBy("term_id").agg(F.min("fqn").alias("primary_fqn")).join(known.select("term_id"), "term_id", "left_anti")
    return new.withColumn("criticality", seed_criticality(F.col("term_id"))).withColumn("usage_count", F.lit(1).cast("long"))


def enrich_from_sections(terms: DataFrame, sections: DataFrame) -> DataFrame:
    """terms(term_id, text), sections(section_id, source, heading, body) -> (term_id, section_id, score, context, origin).

    The section that shares most keywords with the term, two at least; of equals the first. Keywords are joined by
    equality, so no pairs without a common word arise; each word's sections are dealt to WORD_SALTS tasks, as a common
    word is in many.
    """
    salt = F.pmod(F.hash("section_id"), F.lit(WORD_SALTS))
    t = terms.select("term_id", F.explode(keywords(F.col("text"))).alias("word")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(WORD_SALTS - 1))))
    s = sections.select("section_id", F.explode(keywords(F.concat_ws(" ", "heading", "body"))).alias("word")).withColumn("salt", salt)
    score = t.join(s, ["word", "salt"]).groupBy("term_id", "section_id").agg(F.count(F.lit(1)).alias("score")).where(F.col("score") >= MIN_OVERLAP)
    best = score.groupBy("term_id").agg(F.max(F.struct("score", (-F.col("section_id")).alias("neg"))).alias("b"))
    chosen = best.select("term_id", (-F.col("b.neg")).alias("section_id"), F.col("b.score").alias("score"))
    return chosen.join(sections, "section_id").select("term_id", "section_id", "score", snippet(F.col("body")).alias("context"), F.concat_ws(" § ", "source", "heading").alias("origin"))


def class_descriptions(uses: DataFrame, terms: DataFrame, classes: DataFrame, longest: int = 300) -> DataFrame:
    """One sentence per class: its commonest area, up to four roles, up to five terms (by name, for a fixed order)."""
    j = uses.join(terms.select("term_id", "display_name", "ui_role", "domain_area"), "term_id")
    areas = j.where("trim(domain_area) <> ''").groupBy("fqn", "domain_area").agg(F.count(F.lit(1)).alias("n"))
    area = first_of(areas, ["fqn"], [F.desc("n"), F.col("domain_area")]).select("fqn", F.lower(F.replace("domain_area", F.lit("_"), F.lit(" "))).alias("area"))
    roles = F.when(~F.col("ui_role").isin("GENERAL", "LOG_MESSAGE"), F.col("ui_role"))
    names = F.when(F.length("display_name") > 2, F.col("display_name"))
    g = j.groupBy("fqn").agg(F.slice(F.array_sort(F.collect_set(roles)), 1, 4).alias("roles"), F.slice(F.array_sort(F.collect_set(names)), 1, 5).alias("names"))
    d = classes.select("fqn", "simple_name").join(g, "fqn").join(area, "fqn", "left")
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", "), F.lit("."))).otherwise("")
    whole = F.concat("simple_name", F.coalesce(F.concat(F.lit(" — "), "area", F.lit(".")), F.lit("")), part(" UI: ", F.col("roles")), part(" Terms: ", F.col("names")))
    return d.select("fqn", F.when(F.length(whole) > longest, F.concat(F.substring(whole, 1, longest - 3), F.lit("..."))).otherwise(whole).alias("description"))


def abbreviations(classes: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """(abbreviation, seen_in): runs of two to four capitals inside class names, without technical acronyms and what the glossary has."""
    found = classes.select("simple_name", F.explode(F.regexp_extract_all("simple_name", F.lit(ABBREVIATION), F.lit(0))).alias("abbreviation"))
    out = found.where(~F.col("abbreviation").isin(*ACRONYMS)).groupBy("abbreviation").agg(F.min("simple_name").alias("seen_in"))
    return out if glossary is None else out.join(glossary.select("abbreviation"), "abbreviation", "left_anti")


def abbreviation_terms(classes: DataFrame, glossary: DataFrame) -> DataFrame:
    """Terms of the glossary (abbreviation, expansion, evidence), and of the abbreviations in class names that it lacks.

    Those of the glossary come first, whether a class has them or not; of several classes the first by name is told.
    """
    known = glossary.select(F.col("abbreviation").alias("term_id"), F.concat("abbreviation", F.lit(" — "), "expansion").alias("display_name"), F.col("evidence").alias("definition"), F.lit(True).alias("known"))
    new = abbreviations(classes, glossary).select(
        F.col("abbreviation").alias("term_id"), F.concat("abbreviation", F.lit(" — ?")).alias("display_name"),
        F.concat(F.lit("Found in class "), "seen_in", F.lit(", to be expanded")).alias("definition"), F.lit(False).alias("known"),
    )
    fixed = {"source_type": "ABBREVIATION", "criticality": "Low", "sensitivity": "None", "status": "auto", "domain_area": "GLOSSARY"}
    return known.unionByName(new).withColumns({k: F.lit(v) for k, v in fixed.items()} | {"curated": F.lit(False), "usage_count": F.lit(0).cast("long")})


def search(
    terms: DataFrame, criticality: str | None = None, curated: bool | None = None, text: str | None = None, source_type: str | None = None,
    ui_role: str | None = None, domain_area: str | None = None, nls_only: bool = False, limit: int = 500,
) -> DataFrame:
    """Terms by usage; each filter counts only if it is given."""
    out = terms
    for column, value in (("criticality", criticality), ("source_type", source_type), ("ui_role", ui_role), ("domain_area", domain_area)):
        if value and value.strip():
            out = out.where(F.col(column) == value)
    if curated is not None:
        out = out.where(F.col("curated") == curated)
    if text and text.strip():
        out = out.where(F.lower("term_id").contains(text.lower()) | F.lower("display_name").contains(text.lower()))
    if nls_only:
        out = out.where(F.col("source_type").startswith("NLS_"))
    return out.orderBy(F.desc("usage_count"), "term_id").limit(limit)


def term_detail(terms: DataFrame, uses: DataFrame, term_id: str) -> DataFrame:
    own = uses.where(F.col("term_id") == term_id).groupBy("term_id").agg(F.array_sort(F.collect_set("fqn")).alias("classes"))
    return terms.where(F.col("term_id") == term_id).join(own, "term_id", "left")


def terms_of_class(terms: DataFrame, uses: DataFrame, fqn: str) -> DataFrame:
    return terms.join(uses.where(F.col("fqn") == fqn).select("term_id"), "term_id", "left_semi").orderBy("term_id")


def curate(terms: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(term_id, criticality, definition, synonyms), unique by term, set by hand: the rows become curated, their
    sensitivity follows the criticality, and columns that terms lacks (status, sensitivity, definition, synonyms) are added.

    A null criticality is Low, a null definition empty, null synonyms none; a column that changes lacks stays as it is.
    Changes of unknown terms do nothing.
    """
    none = {"criticality": F.lit("Low"), "definition": F.lit(""), "synonyms": F.array().cast("array<string>")}
    given = [c for c in none if c in changes.columns]
    new = changes.select("term_id", *(F.coalesce(c, none[c]).alias(f"__{c}") for c in given), F.lit(True).alias("__hit"))
    out = terms.join(new, "term_id", "left")
    hit, held = F.col("__hit"), set(terms.columns)
    old = lambda c, kind="string": F.col(c) if c in held else F.lit(None).cast(kind)
    values = {c: F.when(hit, F.col(f"__{c}")).otherwise(old(c, "array<string>" if c == "synonyms" else "string")) for c in given}
    level = F.col("__criticality") if "criticality" in given else F.col("criticality")
    values |= {
        "curated": F.coalesce(hit, F.col("curated")), "status": F.when(hit, "curated").otherwise(old("status")),
        "sensitivity": F.when(hit, curated_sensitivity(level)).otherwise(old("sensitivity")),
    }
    names = [*terms.columns, *(c for c in values if c not in held)]
    return out.select(*(values[c].alias(c) if c in values else F.col(c) for c in names))


def glossary_areas(terms: DataFrame, top: int = 5) -> DataFrame:
    """Per area of the text terms: how many, and the names of the five most used in that order."""
    nls = terms.where(F.col("source_type").startswith("NLS_") & F.col("domain_area").isNotNull())
    counts = nls.groupBy("domain_area").agg(F.count(F.lit(1)).alias("term_count"))
    from pyspark.sql import Window as W

    ranked = nls.withColumn("rank", F.row_number().over(W.partitionBy("domain_area").orderBy(F.desc("usage_count"), "term_id"))).where(F.col("rank") <= top)
    names = ranked.groupBy("domain_area").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "display_name"))), lambda x: x["display_name"]).alias("top_terms"))
    return counts.join(names, "domain_area")


def role_counts(terms: DataFrame) -> DataFrame:
    return terms.where(F.col("source_type").startswith("NLS_") & F.col("ui_role").isNotNull()).groupBy("ui_role").agg(F.count(F.lit(1)).alias("term_count"))


def totals(terms: DataFrame) -> DataFrame:
    return terms.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("source_type").startswith("NLS_")).alias("nls_total"))


def link_terms(terms: DataFrame, depends: DataFrame, classes: DataFrame) -> DataFrame:
    """(fqn, term_id): each term's primary source and those that depend on it outside tests; a null path counts as a test."""
    primary = terms.select(F.col("primary_fqn").alias("fqn"), "term_id")
    outside = classes.where(~F.lower("source_path").contains("/test/")).select("fqn")
    back = depends.select(F.col("src").alias("fqn"), F.col("dst").alias("of")).join(primary.select(F.col("fqn").alias("of"), "term_id"), "of").join(outside, "fqn", "left_semi")
    return primary.unionByName(back.select("fqn", "term_id")).distinct()


def link_rules(classes: DataFrame, terms: DataFrame) -> DataFrame:
    """(fqn, term_id): classes named like a rule, or annotated as one, and the terms among their words."""
    rule = F.col("simple_name").rlike(f"^(?:{RULE_NAME})$")
    if "annotations" in classes.columns:
        rule = rule | F.coalesce(F.arrays_overlap("annotations", F.array(*map(F.lit, RULE_ANNOTATIONS))), F.lit(False))
    words = classes.where(rule).select("fqn", F.explode(link_words(F.col("simple_name"))).alias("term_id"))
    return words.join(terms.select("term_id"), "term_id", "left_semi").select("fqn", "term_id").distinct()


def split_names(classes: DataFrame) -> DataFrame:
    return classes.select("fqn", F.posexplode(camel_words(F.col("simple_name"))).alias("position", "word"))
