"""Benchmark decontamination by winnowing.

Of every W neighbouring k-grams the smallest hash is a fingerprint, W + k - 1 being the shortest span that counts, so
each shared span of that length has the fingerprint of its own window in common. Windows of documents whose fingerprint
is among the benchmark's are extended word by word against the benchmark's windows, so a hit is exact.

A benchmark of at most BLOCK_BYTES is broadcast, and documents meet its fingerprints in one Arrow stage without a
shuffle. A larger one stays distributed: its fingerprints and windows are a table, a bit map of fixed size of the
fingerprints holds back most windows of the documents, and the rest are joined to the table by their hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm.common import hub_join, keep_rows, short_batches, store, table, texts
from lodestone.llm.words import NORMAL, words

#: Words of a window, the span that winnowing must not miss.
WINDOW = 10
#: Words of a k-gram of the full window.
GRAM = 5
#: Bytes of benchmark text that are broadcast at most; their tables take some 50 times that in a Python worker.
BLOCK_BYTES = 1 << 21
#: Bits of the map of a larger benchmark's fingerprints, 16 MB whatever the benchmark, and of each of its pieces.
SIEVE_BITS, PIECE_BITS = 1 << 27, 1 << 15
#: Texts are hashed in runs of about so many bytes.
RUN_BYTES = 1 << 19
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Hasher:
    """Vectorised word hashes (a random weight per byte times powers of an odd base) and k-gram hashes."""

    def __init__(self) -> None:
        import numpy as np

        rng = np.random.default_rng(20240229)
        self.weights = rng.integers(1, 1 << 63, 256, np.uint64)
        self.weights[0x20] = 0
        self.gram_weights = rng.integers(1, 1 << 63, WINDOW, np.uint64) | np.uint64(1)
        self._grow(RUN_BYTES * 2)

    def _grow(self, n: int) -> None:
        import numpy as np

        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        self.powers = np.full(n, _MULTIPLIER, np.uint64)
        self.inverses = np.full(n, inverse, np.uint64)
        self.powers[0] = self.inverses[0] = 1
        np.multiply.accumulate(self.powers, out=self.powers)
        np.multiply.accumulate(self.inverses, out=self.inverses)

    def words(self, normal: bytes):
        """(starts, ends, hashes) of the words in a run of normalised bytes."""
        import numpy as np

        raw = np.frombuffer(normal, np.uint8)
        if len(raw) > len(self.powers):
            self._grow(len(raw) * 2)
        letter = np.zeros(len(raw) + 2, np.int8)
        letter[1:-1] = raw != 0x20
        edge = np.diff(letter)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.weights[raw] * self.powers[: len(raw)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverses[starts]
        return starts, ends, (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def minima(self, hashes, k: int, w: int):
        """The smallest of each w neighbouring k-gram hashes: entry i belongs to the words i to i + w + k - 2."""
        import numpy as np

        n = len(hashes) - k + 1
        if n < w:
            return np.zeros(0, np.uint64)
        grams = hashes[:n] * self.gram_weights[0]
        for j in range(1, k):
            grams = grams + hashes[j : n + j] * self.gram_weights[j]
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0x94D049BB133111EB)
        low = grams[: n - w + 1].copy()
        for j in range(1, w):
            np.minimum(low, grams[j : n - w + 1 + j], out=low)
        return low


class Block:
    """Windows, fingerprints and items of a benchmark of bounded size."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        import numpy as np

        hasher = Hasher()
        self.windows: dict[int, dict[bytes, list[int]]] = {}
        prints: dict[int, set[int]] = {}
        for item, text in items:
            own = words(text)
            if not own:
                continue
            span = min(WINDOW, len(own))
            k, w = scheme(span)
            _, _, hashes = hasher.words(b" ".join(own))
            prints.setdefault(span, set()).update(hasher.minima(hashes, k, w).tolist())
            seen = self.windows.setdefault(span, {})
            for i in range(len(own) - span + 1):
                held = seen.setdefault(b" ".join(own[i : i + span]), [])
                if not held or held[-1] != item:
                    held.append(item)
        self.prints = {span: np.array(sorted(x), np.uint64) for span, x in prints.items()}
        self.sieves = {}
        for span, x in self.prints.items():
            self.sieves[span] = sieve = np.zeros(1 << 20, np.bool_)
            sieve[(x >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, span: int, low):
        """Positions whose window minimum is a fingerprint of this block."""
        import numpy as np

        at = np.flatnonzero(self.sieves[span][(low >> np.uint64(44)).view(np.int64)])
        if not len(at):
            return at
        known, got = self.prints[span], low[at]
        i = np.minimum(np.searchsorted(known, got), len(known) - 1)
        return at[known[i] == got]


def scheme(span: int) -> tuple[int, int]:
    """k and W for the shortest span that counts: W + k - 1 = span."""
    k = GRAM if span == WINDOW else (span + 1) // 2
    return k, span - k + 1


def runs(found: list[bytes]) -> Iterator[tuple[int, int]]:
    """Slices of a batch with about RUN_BYTES of text each; a longer text is a slice of its own."""
    begin = size = 0
    for i, x in enumerate(found):
        if size and size + len(x) > RUN_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(x) + 1
    if begin < len(found):
        yield begin, len(found)


def scan(found: list[bytes], block: Block, hasher: Hasher) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
    """Per text: its number of words, the (first word, words) of each window of the block in it, the items of those."""
    import numpy as np

    out: list[tuple[int, list[tuple[int, int]], set[int]]] = []
    for begin, end in runs(found):
        normal = [x.translate(NORMAL) for x in found[begin:end]]
        joined = b" ".join(normal)
        offsets = np.cumsum([0, *(len(x) + 1 for x in normal)])
        starts, ends, hashes = hasher.words(joined)
        first = np.searchsorted(starts, offsets)
        rows = [(int(n), [], set()) for n in np.diff(first)]
        for span in block.windows:
            for i in block.candidates(span, hasher.minima(hashes, *scheme(span))).tolist():
                row = int(np.searchsorted(first, i, side="right")) - 1
                if i + span > first[row + 1]:
                    continue
                key = b" ".join(joined[starts[i] : ends[i + span - 1]].split())
                if items := block.windows[span].get(key):
                    rows[row][1].append((i - int(first[row]), span))
                    rows[row][2].update(items)
        out += rows
    return out


def covered(spans) -> int:
    """Words inside any of the (start, words) spans."""
    n = reach = 0
    for start, size in sorted(spans):
        n += max(0, start + size - max(start, reach))
        reach = max(reach, start + size)
    return n


def bench_items(benchmark: DataFrame) -> DataFrame:
    return texts(benchmark.select(F.col("item_id").alias("doc_id"), "text")).where("doc_id is not null")


def bounded(items: DataFrame, block_bytes: int) -> list[tuple[int, bytes]] | None:
    """The benchmark's items if their texts take at most block_bytes (64 more for each), else None."""
    total = items.agg(F.sum(F.length("text") + 64).alias("n")).first()["n"] or 0
    return None if total > block_bytes else [(r["doc_id"], bytes(r["text"])) for r in items.collect()]


_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    An item's windows are its runs of 10 words, or all its words if it has fewer but some. A document's word inside any
    occurrence of a window is hit. Null text has no words; items with a null id or without words are passed over; a
    repeated item counts once. items_sha256 is of the item ids as strings, sorted and comma-joined (of nothing, if none
    occurs). Repeated documents come out repeated, null ids stay null. An empty benchmark contaminates nothing.
    """
    items = bench_items(benchmark)
    held = bounded(items, block_bytes)
    return _joined(docs, items) if held is None else texts(docs).mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(held)), _OUT)


def _judge(held):
    def run(batches) -> Iterator:
        import pyarrow as pa

        block, hasher = Block(held.value), Hasher()
        for batch in batches:
            rows = scan(batch.column("text").to_pylist(), block, hasher)
            hit = [covered(spans) for _, spans, _ in rows]
            ids = [sorted(map(str, x)) for _, _, x in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([n for n, _, _ in rows], pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, ids), pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([x > 0 for x in hit], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def _windows(batches) -> Iterator:
    """(item, span, print, window) of every window of the items."""
    import pyarrow as pa

    hasher = Hasher()
    for batch in batches:
        for item, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            own = words(text)
            if not own:
                continue
            span = min(WINDOW, len(own))
            _, _, hashes = hasher.words(b" ".join(own))
            low = hasher.minima(hashes, *scheme(span))
            for at in range(0, len(low), RUN_BYTES):
                part = low[at : at + RUN_BYTES]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * n, pa.int64()), pa.array([span] * n, pa.int32()), pa.array(part.view("<i8"), pa.int64()),
                        pa.array([b" ".join(own[i : i + span]) for i in range(at, at + n)], pa.binary()),
                    ],
                    names=["item", "span", "print", "window"],
                )


def _place(print_: Column) -> Column:
    return F.shiftrightunsigned(print_, 64 - (SIEVE_BITS - 1).bit_length())


def _sieve(windows: DataFrame) -> bytes:
    """A map of the fingerprints' upper bits; its pieces are made where the fingerprints are and have a fixed size."""

    def piece(pdf):
        import numpy as np
        import pandas as pd

        bits = np.zeros(PIECE_BITS, np.uint8)
        bits[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"piece": [int(pdf["piece"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    places = windows.select(_place(F.col("print")).alias("p")).distinct()
    split = places.select(F.expr(f"cast(p div {PIECE_BITS} as int)").alias("piece"), (F.col("p") % PIECE_BITS).cast("int").alias("bit"))
    out = bytearray(SIEVE_BITS // 8)
    for row in split.groupBy("piece").applyInPandas(piece, "piece int, bits binary").toLocalIterator():
        out[row["piece"] * PIECE_BITS // 8 : (row["piece"] + 1) * PIECE_BITS // 8] = row["bits"]
    return bytes(out)


def _candidates(held, spans: list[int]):
    """Of every document a row without a window, with its number of words, and its windows that the sieve lets through."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hasher, sieve = Hasher(), np.frombuffer(held.value, np.uint8)
        shift = np.uint64(64 - (SIEVE_BITS - 1).bit_length())
        names = ["doc_id", "key", "n_words", "start", "span", "print", "window"]

        def rows(id_, key, n, starts, span, prints, found):
            k = len(found)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([id_] * k, pa.int64()), pa.array([key] * k, pa.int64()), pa.array([n] * k, pa.int64()), pa.array(starts, pa.int64()),
                    pa.array([span] * k, pa.int32()), pa.array(prints, pa.int64()), pa.array(found, pa.binary()),
                ],
                names=names,
            )

        for batch in batches:
            for id_, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
                normal = text.translate(NORMAL)
                starts, ends, hashes = hasher.words(normal)
                yield rows(id_, key, len(starts), [None], None, [None], [None])
                for span in spans:
                    low = hasher.minima(hashes, *scheme(span))
                    p = low >> shift
                    at = np.flatnonzero(sieve[(p >> np.uint64(3)).view(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1)
                    for i in range(0, len(at), RUN_BYTES):
                        part = at[i : i + RUN_BYTES]
                        found = [b" ".join(normal[starts[j] : ends[j + span - 1]].split()) for j in part.tolist()]
                        yield rows(id_, key, len(starts), part, span, low[part].view("<i8"), found)

    return run


def _hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates with one row per document, (doc_id, key, start, span, at) of every occurrence of a window, (at, window, item)).

    key tells documents that share an id apart, at is the hash of a window.
    """
    spark = docs.sparkSession
    short_batches(spark)
    at = F.xxhash64("span", "print", "window").alias("at")
    windows = store(items.mapInArrow(_windows, "item long, span int, print long, window binary"), "windows")
    owners = windows.select(at, "window", "item").distinct()
    spans = sorted(r["span"] for r in windows.select("span").distinct().collect())  # WINDOW of them at most
    held = spark.sparkContext.broadcast(_sieve(windows))
    rows = texts(docs).withColumn("key", F.xxhash64("text"))
    found = store(rows.mapInArrow(_candidates(held, spans), "doc_id long, key long, n_words long, start long, span int, print long, window binary"), "candidates")
    seek = found.where("start is not null").select("doc_id", "key", "start", "span", "window", at)
    hubs = store(seek.groupBy("at").count().where(F.col("count") > common.HUB).select("at"), "hubs")
    table_ = windows.select(at, F.col("window").alias("own")).distinct()
    hits = hub_join(seek, table_, "at", F.col("doc_id"), hubs).where("window = own")
    return found, store(hits.select("doc_id", "key", "start", "span", "at", "window").distinct(), "hits"), owners


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """decontaminate with a benchmark of any size: no part of it is ever on the driver."""
    found, hits, owners = _hits(docs, items)
    mine = ["doc_id", "key"]
    order = Window.partitionBy(*mine).orderBy("start", "span").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.greatest(F.col("start"), F.coalesce(F.max(F.col("start") + F.col("span")).over(order), F.lit(0)))
    hit = hits.select(*mine, F.greatest(F.lit(0), F.col("start") + F.col("span") - ahead).alias("new")).groupBy(*mine).agg(F.sum("new").alias("n_hit"))
    ids = (
        hits.select(*mine, "at", "window").distinct().join(owners.withColumnRenamed("window", "own"), "at").where("window = own")
        .select(*mine, F.col("item").cast("string").alias("item")).distinct()
        .groupBy(*mine).agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    )
    known = hit.join(ids, [hit["doc_id"].eqNullSafe(ids["doc_id"]), hit["key"] == ids["key"]]).select(
        hit["doc_id"].alias("__id"), hit["key"].alias("__key"), "n_hit", "n_items", "items_sha256"
    )
    rows = found.where("start is null").select("doc_id", "key", "n_words")
    return rows.join(known, [rows["doc_id"].eqNullSafe(known["__id"]), rows["key"] == known["__key"]], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH upper_lower AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
b AS (SELECT item_id, regexp_extract_all(translate(text, u, l), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
      FROM benchmark, upper_lower WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS span,
              array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
spans AS (SELECT DISTINCT span FROM bw),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
      FROM documents, upper_lower),
dg AS (SELECT doc_id, span, i, array_to_string(list_slice(w, i, i + span - 1), ' ') AS g
       FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, spans WHERE len(w) >= span)),
hits AS (SELECT dg.doc_id, dg.i, dg.span, bw.item_id FROM dg JOIN bw USING (span, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + span)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                     array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids
              FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that share no window with the benchmark; all columns as they are.

    Rows that share an id are judged each by its own text.
    """
    short_batches(spark)
    items = bench_items(table(spark, sf_dir, "benchmark"))
    found = bounded(items, block_bytes)
    if found is None:
        gone = _hits(docs, items)[1].select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
        key = F.xxhash64(F.coalesce(docs["text"], F.lit("")).cast("binary"))
        return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__id"]) & (key == gone["__key"]), "left_anti").select(docs.columns)
    held = spark.sparkContext.broadcast(found)
    state: dict = {}

    def judge(texts_: list[bytes]) -> list[bool]:
        if not state:
            state.update(block=Block(held.value), hasher=Hasher())
        return [not spans for _, spans, _ in scan(texts_, **state)]

    return keep_rows(docs, judge)
