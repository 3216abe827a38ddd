"""File sources and sinks: code, text resources, documents, rule books, build files and commit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import file_area, key_category, key_role, keywords

RULE_SCHEMA = (
    "id string, category string, source string, target string, actionType string, automatable string, context string, "
    "migrationSteps array<string>, status string, usageCount int, discoveredAt string, isBase boolean"
)


def whole_files(spark: SparkSession, root: str, pattern: str = "*.java") -> DataFrame:
    """(path, content, content_hash) of every file below root whose name fits."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.sha2("value", 256).alias("content_hash"))


def text_resources(spark: SparkSession, path: str, areas: dict[str, str] | None = None) -> DataFrame:
    """Language entries of XML resources: (key, english, german, category, ui_role, domain_area, source_file).

    English texts that are blank, up to two characters or xxx are dropped; of a key in several files the last file's
    entry stays.
    """
    rows = spark.read.format("xml").option("rowTag", "NLSResource").schema("_key string, NLSMapping array<struct<_language: string, _value: string>>").load(path)
    of = lambda lang: F.get(F.filter("NLSMapping", lambda m: F.lower(m["_language"]).startswith(lang)), F.lit(0)).getField("_value")
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    e = rows.select(F.col("_key").alias("key"), of("en").alias("english"), of("de").alias("german"), file.alias("source_file"))
    e = e.where("key is not null and length(trim(english)) > 2 and lower(trim(english)) <> 'xxx'")
    last = e.groupBy("key").agg(F.max_by(F.struct("english", "german", "source_file"), "source_file").alias("r")).select("key", "r.*")
    key = F.col("key")
    return last.select("key", "english", "german", key_category(key).alias("category"), key_role(key).alias("ui_role"), file_area(F.col("source_file"), areas or {}).alias("domain_area"), "source_file")


def document_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections of legacy documents in JSON ({source, sections: [{heading, body}]}) with three keywords or more."""
    docs = spark.read.option("multiLine", "true").schema("source string, sections array<struct<heading: string, body: string>>").json(path)
    rows = docs.select("source", F.posexplode("sections").alias("pos", "s")).select("source", "pos", F.col("s.heading").alias("heading"), F.coalesce("s.body", F.lit("")).alias("body"))
    return rows.withColumn("keywords", keywords(F.concat_ws(" ", "heading", "body"))).where(F.size("keywords") >= 3)


def split_sections(lines: DataFrame) -> DataFrame:
    """lines(doc, pos, line) -> (doc, section, heading, body): sections begin at numbered or all-capital headings."""
    from pyspark.sql import Window as W

    head = F.col("line").rlike(r"^\s*\d+(\.\d+)*\.?\s+\p{Lu}") | F.col("line").rlike(r"^[\p{Lu}][\p{Lu}\s\d\-/]{4,}$")
    w = W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = lines.withColumn("is_head", head).withColumn("section", F.sum(F.col("is_head").cast("int")).over(w))
    rows = marked.groupBy("doc", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "is_head", "line"))).alias("l"))
    body = F.array_join(F.transform(F.filter("l", lambda x: ~x["is_head"]), lambda x: x["line"]), "\n")
    return rows.select("doc", "section", F.get(F.filter("l", lambda x: x["is_head"]), F.lit(0)).getField("line").alias("heading"), body.alias("body"))


def rule_book(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON book ({rules: [...]}) with their order pos."""
    book = spark.read.option("multiLine", "true").schema(f"rules array<struct<{RULE_SCHEMA.replace(' string', ': string').replace(' array<', ': array<').replace(' int', ': int').replace(' boolean', ': boolean').replace('array<: string>', 'array<string>')}>>").json(path)
    r = book.select(F.posexplode("rules").alias("pos", "r"))
    return r.select(
        F.col("r.id").alias("rule_id"), "r.category", "r.source", "r.target", F.col("r.actionType").alias("action_type"), "r.automatable", "r.context",
        "r.status", F.coalesce("r.usageCount", F.lit(0)).alias("usage_count"), "pos",
    )


def write_rule_book(rules: DataFrame, path: str) -> None:
    """One JSON file of a book; a rule book is some hundred rows. The path is new: swap it in when it is complete."""
    one = rules.coalesce(1).orderBy("pos").agg(F.collect_list(F.struct(*rules.columns)).alias("rules"))
    one.write.mode("overwrite").json(path)


def build_modules(files: DataFrame) -> DataFrame:
    """files(path, content) of settings.gradle, build.gradle and pom.xml -> (kind, file, value): modules included and projects depended on."""
    grab = lambda pattern: F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))
    name = F.element_at(F.split("path", "/"), -1)
    includes = files.where(name.startswith("settings.gradle")).select(F.lit("module").alias("kind"), F.col("path").alias("file"), grab(r"""['"]:?([\w:.-]+)['"]""").alias("value"))
    depends = files.where(name.startswith("build.gradle")).select(F.lit("dependency").alias("kind"), F.col("path").alias("file"), grab(r"""project\s*\(\s*(?:path\s*:\s*)?['"]:?([\w:.-]+)['"]""").alias("value"))
    maven = files.where(name == "pom.xml").select(F.lit("module").alias("kind"), F.col("path").alias("file"), grab(r"<module>\s*([^<\s]+)\s*</module>").alias("value"))
    same = F.concat(F.lit(r"(?s)<dependency>\s*<groupId>\s*"), F.regexp_extract("content", r"<groupId>\s*([^<\s]+)", 1), F.lit(r"\s*</groupId>\s*<artifactId>\s*([^<\s]+)"))
    own = files.where(name == "pom.xml").select(F.lit("dependency").alias("kind"), F.col("path").alias("file"), F.explode(F.regexp_extract_all("content", same, F.lit(1))).alias("value"))
    return includes.unionByName(depends).unionByName(maven).unionByName(own)


def git_log(spark: SparkSession, root: str, days: int, timeout: float = 30) -> DataFrame:
    """(value): file names of the commits of the last days; empty if git fails in any way."""
    import subprocess

    try:
        done = subprocess.run(["git", "-C", root, "log", f"--since={days} days ago", "--name-only", "--pretty=format:", "--"], capture_output=True, text=True, timeout=timeout, check=True)
        lines = [(x,) for x in done.stdout.splitlines() if x.strip()]
    except (OSError, subprocess.SubprocessError):
        lines = []
    return spark.createDataFrame(lines, "value string")


def source_root(mounted: str | None, url: str | None, target: str) -> str:
    """The folder to read: the one mounted, or a clone of url in target (cloned anew if it holds another url, else pulled)."""
    import shutil
    import subprocess
    from pathlib import Path

    if not url:
        if not mounted:
            raise ValueError("neither a folder nor an address is given")
        return mounted
    if (Path(target) / ".git").exists():
        held = subprocess.run(["git", "-C", target, "remote", "get-url", "origin"], capture_output=True, text=True).stdout.strip()
        if held == url:
            subprocess.run(["git", "-C", target, "pull", "-q"], check=True)
            return target
        shutil.rmtree(target)
    subprocess.run(["git", "clone", "-q", url, target], check=True)
    return target
