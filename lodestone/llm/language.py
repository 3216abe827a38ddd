"""Language identification by Bayesian evidence fusion.

For each language: the likelihood of the text (byte trigrams), the likelihood of the declared markup language, and a
prior for the host that is smoothed towards the prior of the address suffix and that towards the whole corpus. The
priors come from a grouped aggregation over all rows of a first pass by text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import salted_join, short_batches, store, table
from lodestone.llm.urls import host_of

#: Rows of the fit sample for each declared language, characters of each, and languages fitted in one pass.
FIT_ROWS, FIT_CHARS, FIT_BLOCK = 400, 20_000, 16
#: Trigram hash buckets and additive smoothing.
BUCKETS, SMOOTHING = 1 << 16, 0.2
#: Trigrams are no independent witnesses: a text weighs as so many of them at most.
TEXT_WEIGHT = 40.0
#: Chance that a declared language is the true one.
DECLARED_RIGHT = 0.9
#: Rows that the prior above weighs as, for a host and for a suffix.
HOST_STRENGTH, SUFFIX_STRENGTH = 20.0, 100.0
#: A language is accepted from this posterior on.
ACCEPT = 0.5
_RUN_BYTES = 1 << 19


def _codes(raw):
    """Trigram buckets of an array of bytes."""
    import numpy as np

    x = raw.astype(np.uint32)
    return (((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def padded(text: str) -> bytes:
    return b"  " + text.lower().encode("utf-8", "replace") + b"  "


def fit(sample: list[tuple[str, str]]):
    """(languages, log probabilities of the buckets by language) from (language, text) rows; needs no order."""
    import numpy as np

    languages = sorted({lang for lang, _ in sample})
    counts = np.zeros((len(languages), BUCKETS))
    for lang, text in sample:
        counts[languages.index(lang)] += np.bincount(_codes(np.frombuffer(padded(text), np.uint8)), minlength=BUCKETS)
    counts += SMOOTHING
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def likelihoods(found: list[str], table) -> list[list[float]]:
    """Mean log likelihood of each text's trigrams by language; each text by itself, whatever its neighbours are."""
    import numpy as np

    out: list[list[float]] = []
    run: list[bytes] = []

    def close() -> None:
        raw = np.frombuffer(b"".join(run), np.uint8)
        codes = _codes(raw)
        ends = np.cumsum([len(x) for x in run])
        starts = ends - [len(x) for x in run]
        sizes = ends - 2 - starts
        cuts = np.column_stack([starts, np.minimum(ends - 2, len(codes))]).reshape(-1)
        cuts = cuts[:-1] if cuts[-1] >= len(codes) else cuts
        sums = [np.add.reduceat(row[codes], cuts, dtype=np.float64)[::2] / sizes for row in table]
        out.extend(np.column_stack(sums).tolist())

    size = 0
    for x in found:
        run.append(padded(x))
        size += len(run[-1])
        if size > _RUN_BYTES:
            close()
            run, size = [], 0
    if run:
        close()
    return out


def fit_samples(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Iterator[tuple[bool, list[tuple[str, str]]]]:
    """Bounded samples of rows(id, text, declared) with about fit_rows of each declared language, by the hash of id; a
    (is the last, sample) for each block of FIT_BLOCK languages in alphabetical order, so every declared language is in one."""
    labelled = rows.where("declared is not null and declared <> '' and text <> ''")
    counts = labelled.groupBy("declared").count().collect()  # a row a language
    counts.sort(key=lambda r: r["declared"])
    for at in range(0, len(counts), FIT_BLOCK):
        share = F.create_map(*(F.lit(x) for r in counts[at : at + FIT_BLOCK] for x in (r["declared"], min(1.0, fit_rows / r["count"]))))
        drawn = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1_000_000)) < F.try_element_at(share, F.col("declared")) * 1_000_000
        yield at + FIT_BLOCK >= len(counts), [(r["declared"], r["text"]) for r in labelled.where(drawn).select("declared", F.substring("text", 1, FIT_CHARS).alias("text")).collect()]


def evidence(rows: DataFrame, model, last: bool) -> DataFrame:
    """rows(id, text, declared, host, suffix, ll), ll followed by the likelihoods of the languages of model; the last model
    leaves of the text its length (n) and whether it has letters."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # at most FIT_BLOCK x BUCKETS floats

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = batch.column("text").to_pylist()
            # 0.0 letters: the text is no evidence
            values = likelihoods(found, held.value) if found and len(held.value) else [[]] * len(found)
            values = [a + b for a, b in zip(batch.column("ll").to_pylist(), values)]
            kept = {c: batch.column(c) for c in ("id", "declared", "host", "suffix")}
            if last:
                kept |= {"n": pa.array([len(x) for x in found], pa.int64()), "letters": pa.array([any(map(str.isalpha, x)) for x in found], pa.bool_())}
            else:
                kept["text"] = batch.column("text")
            yield pa.RecordBatch.from_arrays([*kept.values(), pa.array(values, pa.list_(pa.float64()))], names=[*kept, "ll"])

    text = "n long, letters boolean" if last else "text string"
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, declared string, host string, suffix string, {text}, ll array<double>")


def identify(rows: DataFrame, accepted=None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """rows(id, text, declared, host, suffix) -> id, language, confidence, text_language, accepted; one row per row.

    Null or letterless text has no language ("und") and isn't accepted; null declared, host or suffix are no evidence.
    A row is accepted if its language is among accepted (all languages of the model if None) with a posterior of ACCEPT
    or more. Equal posteriors take the alphabetically first language. If no row declares a language there is no model:
    every row with letters is "und" and accepted. Repeated rows come out repeated.
    """
    spark = rows.sparkSession
    short_batches(spark)
    rows = rows.select(
        "id", F.coalesce("text", F.lit("")).alias("text"), F.lower(F.trim("declared")).alias("declared"),
        F.coalesce("host", F.lit("")).alias("host"), F.coalesce("suffix", F.lit("")).alias("suffix"),
    ).withColumn("declared", F.regexp_extract("declared", "^[a-z]+", 0))
    letters = F.col("text").rlike(r"\p{L}")
    languages: list[str] = []
    first = rows.withColumn("ll", F.array().cast("array<double>"))
    for last, sample in fit_samples(rows, fit_rows):
        more, model = fit(sample)
        languages += more
        first = store(evidence(first, model, last), "evidence")
    if not languages:
        return rows.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_language"), letters.alias("accepted"))
    k = len(languages)
    best = F.array_position("ll", F.array_max("ll")).cast("int")
    by_host = store(first.where("letters").groupBy("suffix", "host", best.alias("best")).agg(F.count(F.lit(1)).cast("double").alias("n")), "host-counts")
    seen = dict(map(tuple, by_host.groupBy("best").agg(F.sum("n")).collect()))
    total = [seen.get(i + 1, 0.0) for i in range(k)]
    whole = sum(total) + k
    top = [(x + 1) / whole for x in total]
    tops, order = F.array(*map(F.lit, top)), F.sequence(F.lit(1), F.lit(k))
    tally = lambda df, keys, name: df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias(name), F.sum("n").alias(f"{name}_sum"))
    count = lambda name, i: F.coalesce(F.try_element_at(F.col(name), i), F.lit(0.0))
    suffixes = tally(by_host.groupBy("suffix", "best").agg(F.sum("n").alias("n")), ["suffix"], "s")
    suffix_prior = suffixes.select("suffix", F.transform(order, lambda i: (count("s", i) + SUFFIX_STRENGTH * F.element_at(tops, i)) / (F.col("s_sum") + SUFFIX_STRENGTH)).alias("p"))
    host_prior = tally(by_host, ["suffix", "host"], "c").join(suffix_prior, "suffix").select(
        F.concat_ws("\t", "suffix", "host").alias("site"),
        F.transform(order, lambda i: F.ln((count("c", i) + HOST_STRENGTH * F.element_at("p", i)) / (F.col("c_sum") + HOST_STRENGTH))).alias("prior"),
    )
    import math

    names = F.array(*map(F.lit, languages))
    fallback = F.array(*(F.lit(math.log(x)) for x in top))
    wrong = math.log((1 - DECLARED_RIGHT) / max(1, k - 1)) if k > 1 else 0.0
    says = F.when(
        F.array_contains(names, F.col("declared")),
        F.transform(names, lambda x: F.when(x == F.col("declared"), math.log(DECLARED_RIGHT)).otherwise(wrong)),
    ).otherwise(F.array_repeat(F.lit(0.0), k))
    text = F.transform("ll", lambda x: x * F.least(F.col("n").cast("double"), F.lit(TEXT_WEIGHT)))
    joined = salted_join(first.withColumn("site", F.concat_ws("\t", "suffix", "host")), host_prior, "site", F.col("id"))
    joined = joined.withColumn("post", F.zip_with(F.zip_with(text, says, lambda a, b: a + b), F.coalesce("prior", fallback), lambda a, b: a + b))
    joined = joined.withColumn("top", F.array_max("post"))
    confidence = 1.0 / F.aggregate(F.transform("post", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    language: Column = F.element_at(names, F.array_position("post", F.col("top")).cast("int"))
    allowed = language.isin(list(accepted)) if accepted is not None else F.lit(True)
    return joined.select(
        "id",
        F.when(F.col("letters"), language).otherwise("und").alias("language"),
        F.when(F.col("letters"), confidence).otherwise(0.0).alias("confidence"),
        F.when(F.col("letters"), F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int"))).otherwise("und").alias("text_language"),
        (F.col("letters") & allowed & (confidence >= ACCEPT)).alias("accepted"),
    )


def document_rows(docs: DataFrame, id_type: str = "long") -> DataFrame:
    """Documents as evidence: the lang column is what was declared, the source is the host; there is no address suffix."""
    return docs.select(F.col("doc_id").cast(id_type).alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit("").alias("suffix"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as evidence: the html element's lang attribute, the host and its last label; text is the page without markup."""
    host = host_of(F.col("url"))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("id"), text.alias("text"),
        F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1).alias("declared"),
        host.alias("host"), F.regexp_extract(host, r"[^.]*$", 0).alias("suffix"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(document_rows(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "language", F.round("confidence", 6).alias("confidence"), "text_language", "accepted")


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(page_rows(table(spark, sf_dir, "pages")))
    return found.select(F.col("id").alias("page_id"), "language", F.round("confidence", 6).alias("confidence"), "text_language", "accepted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; those without letters or of no clear language go.

    Rows that share an id, or have none, are judged each by its own text and evidence.
    """
    evidence_of = [F.col(c) for c in ("text", "lang", "source")]
    key = F.xxhash64(*(x for c in evidence_of for x in (c.isNull(), c)))
    rows = document_rows(docs.withColumn("doc_id", F.struct(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"))), "struct<doc_id: bigint, key: bigint>")
    gone = identify(rows).where("not accepted").select(F.col("id.doc_id").alias("__id"), F.col("id.key").alias("__key")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__id"]) & (key == gone["__key"]), "left_anti").select(docs.columns)
