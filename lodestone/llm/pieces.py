"""SentencePiece encoding and decoding by a max-plus scan over chunks of a document.

The model is byte-pair encoded, so a text's encoding isn't the path of largest piece scores but the one path on which
every two neighbouring pieces are, put together, encoded as just these two (the pieces of any other path would have been
merged across one of its boundaries). Such a pair weighs 0 and any other -inf; the max-plus product of the chunks'
transfer matrices then has exactly one path that is not -inf. A state at a chunk boundary is the piece that covers or
ends at the boundary and how much of it lies before. No piece goes on into a word mark, so at a word mark the only state
is "a piece ends here" and a chunk cut there has a 1 x 1 matrix; only runs without any white space need the rest.

Short documents are one chunk. Long ones are cut into rows that any executor can take; the matrices of a document, which
are small, are combined by an associative scan, and each chunk is then traced back by itself from its two states.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import short_batches, store, table

MODEL = "piece_bpe_32k.model"
#: Characters of a chunk, and chunks whose matrices are multiplied in one task.
CHUNK_CHARS, BLOCK_CHUNKS = 16_384, 64
MARK = "▁"
NO = float("-inf")


class Model:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank, self.ids, self.bytes = {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.rank[piece], self.ids[piece] = sp.get_score(i), i
        self.reach = max(map(len, self.ids), default=1)
        self.marks_cut = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.fits = lru_cache(1 << 18)(self._fits)

    def merged(self, text: str) -> list[str]:
        """The encoding of a short run: join the neighbours whose piece scores highest, leftmost first, until none join."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: str, right: str) -> bool:
        return self.merged(left + right) == ([left, right] if left else [right])

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes.get(b, self.sp.unk_id()) for b in piece.encode()]

    def whole(self, marked: str) -> list[int]:
        """Ids of a run that begins with a word mark and ends where a piece must end; the library adds the mark itself."""
        return self.sp.encode(marked[1:].replace(MARK, " ")) if marked[:1] == MARK else self.sp.encode(marked)

    def states(self, text: str, at: int) -> list[tuple[str, int]]:
        """All (piece, characters before the boundary) that can cover or end at text[at]."""
        out = []
        for begin in range(max(0, at - self.reach), at):
            for end in range(at, min(len(text), begin + self.reach) + 1):
                piece = text[begin:end]
                if piece in self.ids or len(piece) == 1:
                    out.append((piece, at - begin))
        return out

    def walk(self, text: str, start: tuple[str, int] | None, begin: int, end: int) -> dict[int, str]:
        """For every position up to end that pieces can end at, coming from start: the piece that ends there."""
        if start is None:
            last = {begin: ""}
        else:
            begin = begin - start[1] + len(start[0])
            last = {begin: start[0]}
        for i in range(begin + 1, end + 1):
            for j in range(max(begin, i - self.reach), i):
                if j in last and ((piece := text[j:i]) in self.ids or i - j == 1) and self.fits(last[j], piece):
                    last[i] = piece
                    break
        return last


def cut(text: str, size: int, model: Model) -> list[tuple[int, int, bool, bool]]:
    """(begin, end, begin is at a word mark, end is at a word mark or the end of text) of the chunks of marked text."""

    def mark(lo: int, hi: int, first: bool) -> int:
        find = text.find if first else text.rfind
        i = find(MARK, lo, hi) if model.marks_cut else -1
        while i > 0 and text[i - 1] == MARK:
            i = find(MARK, i + 1, hi) if first else find(MARK, lo, i)
        return i

    out, begin, free = [], 0, True
    while begin < len(text):
        limit = begin + size
        if limit >= len(text):
            at = mark(begin + 1, len(text), True) if not free else -1
            end, ends_free = (at, True) if at > 0 else (len(text), True)
        else:
            at = mark(begin + 1, limit + 1, not free)
            end, ends_free = (at, True) if at > 0 else (limit, False)
        out.append((begin, end, free, ends_free))
        begin, free = end, ends_free
    return out


def product(a, b):
    """Max-plus matrix product."""
    import numpy as np

    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def prefixes(ms: list) -> list:
    """All products m0, m0 m1, m0 m1 m2, ... by pairwise combination, in depth log n."""
    if len(ms) <= 1:
        return list(ms)
    pairs = prefixes([product(ms[i], ms[i + 1]) for i in range(0, len(ms) - 1, 2)])
    out = []
    for i, m in enumerate(ms):
        out.append(m if i == 0 else pairs[i // 2] if i % 2 else product(pairs[i // 2 - 1], m))
    return out


def choose(ms: list, a: int = 0, b: int = 0) -> list[int]:
    """The state at each inner boundary on the path from state a to state b that isn't -inf, from the matrices in order."""
    ahead = prefixes(ms)
    behind = [m.T for m in prefixes([m.T for m in reversed(ms)])][::-1]
    return [int((ahead[i][a] + behind[i + 1][:, b]).argmax()) for i in range(len(ms) - 1)]


def dense(rows: int, cols: int, pairs):
    import numpy as np

    out = np.full(rows * cols, NO)
    out[np.asarray(pairs, np.int64)] = 0
    return out.reshape(rows, cols)


def _multiply(pdf):
    """The product of a block's matrices, as one matrix of the same kind."""
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values("no")
    out = None
    for m in map(dense, pdf["rows"], pdf["cols"], pdf["pairs"]):
        out = m if out is None else product(out, m)
    return pd.DataFrame({"key": pdf["key"].iloc[:1], "no": pdf["block"].iloc[:1], "rows": [out.shape[0]], "cols": [out.shape[1]], "pairs": [np.flatnonzero(out.reshape(-1) == 0)]})


def _choose_all(pdf):
    """The states at both ends of each matrix of a document or block, entered by state a0 and left by state b0."""
    import pandas as pd

    pdf = pdf.sort_values("no")
    a0, b0 = int(pdf["a0"].iloc[0]), int(pdf["b0"].iloc[0])
    at = [a0, *choose(list(map(dense, pdf["rows"], pdf["cols"], pdf["pairs"])), a0, b0), b0]
    return pd.DataFrame({"key": pdf["key"].to_numpy(), "no": pdf["no"].to_numpy(), "a": at[:-1], "b": at[1:]})


class Chunk:
    """A chunk with as much of its surroundings as a piece is long."""

    def __init__(self, model: Model, before: str, core: str, after: str, free: bool, ends_free: bool) -> None:
        self.m, self.text, self.free, self.ends_free, self.core = model, before + core + after, free, ends_free, core
        self.begin, self.end = len(before), len(before) + len(core)
        self.enter = [None] if free else model.states(self.text, self.begin)
        self.leave = [None] if ends_free else model.states(self.text, self.end)

    def matrix(self) -> tuple[int, int, list[tuple[int, int]]]:
        """Numbers of states before and after, and the pairs that weigh 0."""
        if self.free and self.ends_free:
            return 1, 1, [(0, 0)]
        pairs = []
        for a, start in enumerate(self.enter):
            last = self.m.walk(self.text, start, self.begin, self.end)
            if self.ends_free:
                pairs += [(a, 0)] if self.end in last else []
            else:
                pairs += [(a, b) for b, (piece, o) in enumerate(self.leave) if (j := self.end - o) in last and self.m.fits(last[j], piece)]
        return len(self.enter), len(self.leave), pairs

    def trace(self, a: int, b: int) -> list[int]:
        """Ids of the pieces that begin in this chunk, entered by state a and left by state b."""
        if self.free and self.ends_free:
            return self.m.whole(self.core)
        last = self.m.walk(self.text, self.enter[a], self.begin, self.end)
        start = self.enter[a]
        origin = self.begin if start is None else self.begin - start[1] + len(start[0])
        at, found = self.end, []
        if not self.ends_free:
            piece, o = self.leave[b]
            found.append(piece)
            at = self.end - o
        while at > origin:
            found.append(last[at])
            at -= len(last[at])
        return [i for piece in reversed(found) for i in self.m.piece_ids(piece)]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def encode_text(text: str, model: Model, size: int = CHUNK_CHARS) -> list[int]:
    """One text by the chunked method in one process."""
    import numpy as np

    full, ms, chunks = marked(text), [], []
    for begin, end, free, ends_free in cut(full, size, model):
        chunks.append(Chunk(model, full[max(0, begin - model.reach) : begin], full[begin:end], full[end : end + model.reach], free, ends_free))
        n, m, pairs = chunks[-1].matrix()
        ms.append(np.full((n, m), NO))
        for a, b in pairs:
            ms[-1][a, b] = 0
    at = [0, *choose(ms), 0]
    return [i for k, c in enumerate(chunks) for i in c.trace(at[k], at[k + 1])]


def encode(docs: DataFrame, model_path: str, chunk_chars: int = CHUNK_CHARS, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """One row per document: doc_id, n_chunks, ids (array of int).

    Null text counts as empty and has no ids. Repeated rows come out repeated, other columns are ignored.
    """
    short_batches(docs.sparkSession)
    rows = _rows(docs)

    def short(batches) -> Iterator:
        model = Model(model_path)
        for batch in batches:
            yield _whole(model, batch)

    short_rows = rows.where(F.length("text") <= chunk_chars).mapInArrow(short, "doc_id long, n_chunks int, ids array<int>")
    return short_rows.unionByName(_encode_long(rows.where(F.length("text") > chunk_chars), model_path, chunk_chars, block_chunks))


def round_trip(docs: DataFrame, model_path: str, with_ids: bool = False, chunk_chars: int = CHUNK_CHARS, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """decode(encode(docs)), short documents in one Python step."""
    short_batches(docs.sparkSession)
    rows = _rows(docs)

    def short(batches) -> Iterator:
        model = Model(model_path)
        for batch in batches:
            yield _decoded(model, _whole(model, batch), with_ids)

    long = _encode_long(rows.where(F.length("text") > chunk_chars), model_path, chunk_chars, block_chunks)
    return rows.where(F.length("text") <= chunk_chars).mapInArrow(short, _decoded_schema(with_ids)).unionByName(decode(long, model_path, with_ids))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _whole(model: Model, batch):
    """The ids of short texts, each one chunk."""
    import pyarrow as pa

    found = [model.whole(marked(x)) if x else [] for x in batch.column("text").to_pylist()]
    n = pa.array([int(len(x) > 0) for x in found], pa.int32())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "n_chunks", "ids"])


def _encode_long(long: DataFrame, model_path: str, chunk_chars: int, block_chunks: int) -> DataFrame:
    """encode for texts of more than a chunk."""
    spark = long.sparkSession

    def split(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        model, key = Model(model_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for number, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                full = marked(text)
                chunks = cut(full, chunk_chars, model)
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "key": key, "doc_id": number, "no": no, "n": len(chunks), "before": full[max(0, a - model.reach) : a],
                            "core": full[a:b], "after": full[b : b + model.reach], "free": free, "ends_free": ends,
                        }
                        for no, (a, b, free, ends) in enumerate(chunks)
                    ],
                    pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("no", pa.int32()), ("n", pa.int32()), ("before", pa.string()), ("core", pa.string()), ("after", pa.string()), ("free", pa.bool_()), ("ends_free", pa.bool_())]),
                )
                key += 1

    chunks = store(
        long.mapInArrow(split, "key long, doc_id long, no int, n int, before string, core string, after string, free boolean, ends_free boolean"),
        "chunks",
    )

    def weigh(batches) -> Iterator:
        import pyarrow as pa

        model = Model(model_path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n, m, pairs = Chunk(model, r["before"], r["core"], r["after"], r["free"], r["ends_free"]).matrix()
                out.append({"key": r["key"], "no": r["no"], "rows": n, "cols": m, "pairs": [a * m + b for a, b in pairs]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.int64()), ("no", pa.int32()), ("rows", pa.int32()), ("cols", pa.int32()), ("pairs", pa.list_(pa.int32()))]))

    # Only documents that some chunk of can't be cut at a word mark have anything to combine. Blocks of chunks are
    # multiplied where they are, a document's blocks are scanned, and each block then finds its inner states.
    kind, states = "key long, no int, rows int, cols int, pairs array<int>", "key long, no int, a int, b int"
    bound = chunks.where("not free or not ends_free").select("key").distinct()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, as few bytes take long here
    matrices = chunks.join(bound, "key", "left_semi").repartition(tasks, "key", "no").mapInArrow(weigh, kind)
    matrices = store(matrices.withColumn("block", F.expr(f"no div {block_chunks}").cast("int")), "matrices")
    blocks = matrices.groupBy("key", "block").applyInPandas(_multiply, kind)
    ends = blocks.withColumns({"a0": F.lit(0), "b0": F.lit(0)}).groupBy("key").applyInPandas(_choose_all, states)
    inner = matrices.join(ends.select("key", F.col("no").alias("block"), F.col("a").alias("a0"), F.col("b").alias("b0")), ["key", "block"])
    chosen = inner.groupBy("key", "block").applyInPandas(_choose_all, states)

    def trace(batches) -> Iterator:
        import pyarrow as pa

        model = Model(model_path)
        for batch in batches:
            ids = [
                Chunk(model, r["before"], r["core"], r["after"], r["free"], r["ends_free"]).trace(r["a"] or 0, r["b"] or 0)
                for r in batch.select(["before", "core", "after", "free", "ends_free", "a", "b"]).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "doc_id", "no", "n")] + [pa.array(ids, pa.list_(pa.int32()))], names=["key", "doc_id", "no", "n", "ids"])

    traced = chunks.join(chosen, ["key", "no"], "left").mapInArrow(trace, "key long, doc_id long, no int, n int, ids array<int>")
    joined = traced.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts")
    )
    return joined.select("doc_id", "n_chunks", F.flatten(F.col("parts.ids")).alias("ids"))


def decode(encoded: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """encoded(doc_id, n_chunks, ids) -> doc_id, n_chunks, n_pieces, ids_crc32 (of little-endian uint32), decoded_sha256 of
    the text that the ids give, and the ids themselves if with_ids; no ids give the empty text."""

    def run(batches) -> Iterator:
        model = Model(model_path)
        for batch in batches:
            yield _decoded(model, batch, with_ids)

    return encoded.mapInArrow(run, _decoded_schema(with_ids))


def _decoded_schema(with_ids: bool) -> str:
    return f"doc_id long, n_chunks int, n_pieces long, {'ids array<int>, ' if with_ids else ''}ids_crc32 long, decoded_sha256 string"


def _decoded(model: Model, batch, with_ids: bool):
    import hashlib

    import pyarrow as pa

    column = batch.column("ids")
    values, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    parts = [values[a:b] for a, b in zip(bounds, bounds[1:])]
    digests = [hashlib.sha256(model.sp.decode(x.tolist()).encode() if len(x) else b"").hexdigest() for x in parts]
    arrays = [
        batch.column("doc_id"), batch.column("n_chunks"), pa.array([len(x) for x in parts], pa.int64()), *([column] if with_ids else []),
        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64()), pa.array(digests, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_chunks", "n_pieces", *(["ids"] if with_ids else []), "ids_crc32", "decoded_sha256"])


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), _path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus: doc_id, ids and their digests."""
    return round_trip(docs, _path(), with_ids=True)
