"""Toxic passages by maximum-scoring segment search.

Every word scores its log-odds of toxic against clean text. The odds are posterior means under Dirichlet priors that are
nested by word beginnings, over the number of texts that hold it: a word's prior is its first six bytes' posterior, theirs that of the first five, and so on up
to even odds, so unseen forms of a toxic stem score too. A linear scan finds all maximal segments; extreme-value theory
(the tail of such segments in clean text) turns their scores into nats beyond chance, which a logistic curve fitted on
the training rows turns into a document's score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import short_batches, table
from lodestone.llm.words import NORMAL

#: Labelled rows of each class in the fit sample, on average, and the characters of each that are read.
FIT_ROWS, FIT_CHARS = 3000, 30_000
#: Strength of the prior at each level.
PRIOR = 10.0
PREFIXES = (4, 5, 6)
#: Taken off every word's log-odds, so that a word without a sign counts against a segment; floor and ceiling of scores.
OFFSET, FLOOR, CEILING = 0.8, -0.8, 5.0
#: Score from which a document is predicted to be toxic.
THRESHOLD = 0.7
CACHE_WORDS = 300_000


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(NORMAL).split()


def segments(scores: list[tuple[int, float, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in time linear in the runs given.

    scores has (position, what all words before it since the last entry add up to (at most 0), its own score above 0).
    Returns (first position, last position, score) of each segment, by the stack of candidates with their left and right
    cumulative sums. Every candidate names the nearest one below it with a smaller left sum, so that a search leaps over
    those that can't be one; where there is none, all candidates are final.
    """
    total, done, stack = 0.0, [], []  # of (left sum, right sum, first, last, place in the stack of the one with a smaller left sum)
    for at, before, own in scores:
        total += before
        left, right, first = total, total + own, at
        total = right
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0:
                done += stack
                stack.clear()
                break
            if stack[j][1] >= right:
                break
            left, _, first, _, below = stack[j]
            del stack[j:]
            j = below
        stack.append((left, right, first, at, j))
    return [(first, last, right - left) for left, right, first, last, _ in done + stack]


class Scores(dict):
    """Scores of words, filled as words come; what the model doesn't know is scored by its beginning."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = x = self.model.word_score(word)
        return x


def unlike(found: list[str]) -> Iterator[list[bytes]]:
    """The words of each text whose smallest three-word hash no earlier text has; near copies mostly share it."""
    import xxhash

    seen = set()
    for text in found:
        words = tokens(text)
        key = min((xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)
        if key not in seen:
            seen.add(key)
            yield words


class Model:
    def __init__(self, toxic: list[str], clean: list[str]) -> None:
        import numpy as np

        # Odds come from two thirds of the sample; chance in clean text and the curve from the rest, which the odds haven't seen.
        part = lambda found, rest: [x for i, x in enumerate(found) if (i % 3 == 2) == rest] if len(found) > 2 else found
        seen, (toxic, clean) = (part(toxic, False), part(clean, False)), (part(toxic, True), part(clean, True))
        counts = [Counter(), Counter()]
        for side, found in enumerate(seen):
            for words in unlike(found):  # copies, near ones too, and repeats within a text are no further evidence
                counts[side].update(set(words))
        sums = [sum(c.values()) for c in counts]
        ratio = sums[0] / sums[1] if sums[1] else 1.0
        self.share: dict[bytes, float] = {}
        nodes = [{}, *({} for _ in PREFIXES)]
        for side, weight in ((0, 1.0), (1, ratio)):
            for word, n in counts[side].items():
                for level, key in enumerate([*(word[:p] for p in PREFIXES if len(word) >= p), word]):
                    level = level if key is not word or len(word) in PREFIXES else len(PREFIXES)
                    nodes[level].setdefault(key, [0.0, 0.0])[side] += n * weight
        for level in nodes:
            for key, (t, c) in level.items():
                self.share[key] = (t + PRIOR * self._above(key)) / (t + c + PRIOR)
        # Words of too little weight to differ from their beginnings are left to those.
        self.share = {k: x for k, x in self.share.items() if abs(math.log(x / (1 - x)) - math.log((a := self._above(k)) / (1 - a))) > 0.3}
        self.scores = Scores(self)
        values = np.concatenate([np.array([self.scores[w] for w in tokens(x)]) for x in clean] or [np.zeros(0)])
        self.decay = self._decay(values)
        self.volume = 1.0
        tails = [(len(w), max((s for _, _, s in self.find(w)), default=0.0)) for w in map(tokens, clean)]
        # Method of moments: the expected largest score is (ln(volume n) + 0.5772) / decay.
        logs = [self.decay * s - 0.5772 - math.log(n) for n, s in tails if s > 0 and n]
        self.volume = math.exp(max(-12.0, min(0.0, sum(logs) / len(logs)))) if logs else math.exp(-4.0)
        self.a, self.b = 1.0, -2.0
        x = np.array([self.nats(tokens(t)) for t in toxic + clean])
        self._calibrate(x, np.array([1.0] * len(toxic) + [0.0] * len(clean)))

    def _above(self, key: bytes) -> float:
        for p in sorted(PREFIXES, reverse=True):
            if p < len(key) and (x := self.share.get(key[:p])) is not None:
                return x
        return 0.5

    def word_score(self, word: bytes) -> float:
        x = self.share.get(word)
        x = self._above(word) if x is None else x
        return min(CEILING, max(FLOOR, math.log(x / (1 - x)) - OFFSET))

    @staticmethod
    def _decay(values) -> float:
        """The positive root of mean(exp(root * score)) = 1 in clean text; 10 if it lies beyond, so one word can't say it all."""
        import numpy as np

        if not len(values) or values.max() <= 0 or values.mean() >= 0:
            return 1.0
        lo, hi = 1e-3, 10.0
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.exp(mid * values).mean() < 1 else (lo, mid)
        return lo

    def find(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Maximal scoring segments as (first word, last word, score); a word said again at once adds nothing."""
        import numpy as np

        values = np.fromiter(map(self.scores.__getitem__, words), np.float64, len(words))
        up = np.flatnonzero(values > 0)
        if len(again := [i for i in up.tolist() if i and words[i] == words[i - 1]]):
            values[again] = 0
            up = np.flatnonzero(values > 0)
        if not len(up):
            return []
        sums = np.concatenate([[0.0], np.cumsum(values)])
        before = sums[up] - np.concatenate([[0.0], sums[up[:-1] + 1]])
        return segments(list(zip(up.tolist(), before.tolist(), values[up].tolist())))

    def passages(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Segments beyond chance in a clean text of that length, scored in nats beyond it."""
        chance = math.log(1 + self.volume * len(words))
        return [(a, b, x) for a, b, s in self.find(words) if (x := self.decay * s - chance) > 0]

    def nats(self, words: list[bytes]) -> float:
        """Of all passages, the same words counting once."""
        return self._sum(words, self.passages(words))

    @staticmethod
    def _sum(words: list[bytes], found: list[tuple[int, int, float]]) -> float:
        return sum({tuple(words[a : b + 1]): x for a, b, x in found}.values())

    def _calibrate(self, x, y) -> None:
        """Logistic curve over log(1 + nats) by a few damped Newton steps."""
        import numpy as np

        z = np.column_stack([np.log1p(x), np.ones(len(x))])
        w = np.array([1.0, -2.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + 1e-2 * w
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), grad)
        self.a, self.b = map(float, w)

    def score(self, text: str) -> tuple[float, int]:
        words = tokens(text)
        found = self.passages(words)
        nats = self._sum(words, found)
        return 1 / (1 + math.exp(min(700.0, -self.a * math.log1p(nats) - self.b))), len(found)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def fit_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], list[str]]:
    """Texts of about fit_rows toxic and as many clean documents, by the hash of doc_id; never of held-out rows.

    A doc_id labelled twice counts as toxic if any label says so; null ids or labels are passed over.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") > 0, min(1.0, fit_rows / max(1, counts.get(1, 0)))).otherwise(min(1.0, fit_rows / max(1, counts.get(0, 0))))
    ids = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # About 2 * fit_rows ids, whatever the size of the tables.
    rows = docs.select("doc_id", F.substring("text", 1, FIT_CHARS).alias("text")).join(F.broadcast(ids), "doc_id").orderBy("doc_id").collect()
    return [r["text"] or "" for r in rows if r["toxic"] > 0], [r["text"] or "" for r in rows if r["toxic"] <= 0]


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.7), n_passages.

    The score depends on the text alone; null counts as empty, and without words nothing exceeds chance. Repeated rows
    come out repeated; a null doc_id isn't held out. If the labels hold no toxic training row, every score is 0.
    """
    spark = docs.sparkSession
    toxic, clean = fit_sample(docs, labels, fit_rows)
    model = spark.sparkContext.broadcast(Model(toxic, clean) if toxic and clean else None)
    short_batches(spark)

    def run(batches) -> Iterator:
        import pyarrow as pa

        m = model.value
        for batch in batches:
            rows = [m.score(x) if m else (0.0, 0) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in rows], pa.float64()), pa.array([n for _, n in rows], pa.int64())],
                names=["doc_id", "held_out", "score", "n_passages"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, n_passages long")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
