"""Token ids in fixed-width bit-packed shards.

A shard holds whole documents: a header, block offsets, the documents' ids and starts, then the payload. Every id takes
the vocabulary's minimum number of bits; BLOCK ids make a block that starts at a byte offset of its own, so any range of
ids is unpacked by numpy from the blocks it touches. Shards are the rows of a Parquet table, which gives them Spark's
commit protocol (a lost executor leaves no half-written shard) and any file system that Spark reads.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import scratch, short_batches, table, texts

MAGIC = b"LSTOKEN1"
BLOCK = 4096
#: A shard is closed after so many ids or documents.
SHARD_IDS, SHARD_DOCS = 1 << 20, 8192
#: Pieces of words in one generation of a worker's memory.
CACHE_PIECES = 400_000
#: Texts are cut into pieces in runs of so many bytes and on to the next white space.
RUN_BYTES = 1 << 19
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
_SPACE = re.compile(rb"[\t-\r ]")
_HEAD = struct.Struct("<8sIIQI")  # magic, bits, block, ids, documents


def pack(ids, bits: int) -> bytes:
    """64 ids become `bits` 64-bit words; the last group is filled with zeros."""
    import numpy as np

    n = -(-len(ids) // 64)
    rows = np.zeros((n, 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((n, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, n: int, bits: int):
    import numpy as np

    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    mask, out = np.uint64((1 << bits) - 1), np.empty((len(words), 64), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = x & mask
    return out.reshape(-1)[:n].astype("<u4")


def write_shard(doc_ids: list, lengths: list[int], ids, bits: int) -> bytes:
    """ids: uint32 of all documents, one after the other. A null doc_id is kept as null."""
    import numpy as np

    parts = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, parts)]).astype("<u8")
    starts = np.cumsum([0, *lengths]).astype("<u8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, bits, BLOCK, len(ids), len(doc_ids))
    return b"".join([head, offsets.tobytes(), numbers.tobytes(), known.tobytes(), starts.tobytes(), *parts])


class Shard:
    """Random access to a shard's documents."""

    def __init__(self, data: bytes) -> None:
        import numpy as np

        magic, self.bits, self.block, self.n_ids, self.n_docs = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size
        n = -(-self.n_ids // self.block) + 1
        self.offsets = np.frombuffer(data, "<u8", n, at)
        at += 8 * n
        self.numbers = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.known = np.frombuffer(data, np.uint8, self.n_docs, at)
        at += self.n_docs
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (self.n_docs + 1) :]

    def doc_id(self, i: int) -> int | None:
        return int(self.numbers[i]) if self.known[i] else None

    def range(self, begin: int, end: int):
        """Ids from begin up to end, reading only the blocks they lie in."""
        if begin >= end:
            return unpack(b"", 0, self.bits)
        first, last = begin // self.block, (end - 1) // self.block
        got = unpack(self.payload[int(self.offsets[first]) : int(self.offsets[last + 1])], (last + 1 - first) * self.block, self.bits)
        return got[begin - first * self.block : end - first * self.block]

    def doc(self, i: int):
        return self.range(int(self.starts[i]), int(self.starts[i + 1]))


class Recent:
    """A memory of two generations: what was used since the older one filled up stays, so common words always do."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys) -> list:
        """Those of distinct keys that aren't known; known ones are young from now on."""
        out, young, old = [], self.young, self.old
        for k in keys:
            if k not in young:
                if (v := old.get(k)) is None:
                    out.append(k)
                else:
                    young[k] = v
        return out

    def age(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class Encoder:
    """Ids of whole texts by the tokenizers library.

    This vocabulary's pre-tokenizer drops white space and never joins across it, so a text's ids are its words' ids.
    Words of ASCII and composed Latin letters are lower-cased and cut by numpy into the pieces that it would cut them
    into (contractions, runs of letters, single digits, runs of other signs); any other word, and one that could hold a
    special token, is a piece by itself as it stands. Arrow numbers a batch's distinct pieces; those that the worker
    doesn't remember go to the library: pieces to its model, other words to all of it, so that normalising comes first.
    """

    #: Composed Latin letters of two bytes, with their lower case: of these normalising changes nothing else.
    _LETTERS = [c for c in map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x180)])]
    _CONTRACTIONS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
    _SPECIAL = b"<|"

    def __init__(self, path: str) -> None:
        import os

        import numpy as np
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, np.bool_)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.known = Recent(CACHE_PIECES)
        # Kinds of bytes: 0 white space, 1 letter, 2 digit, 3 other sign, 4 beginning or rest of a character that isn't ASCII, 5 control.
        self.kinds = np.full(256, 5, np.uint8)
        self.kinds[0x21:0x7F] = 3
        self.kinds[[0x20, *range(0x09, 0x0E)]] = 0
        self.kinds[0x30:0x3A] = 2
        self.kinds[0x80:] = 4
        self.lower = np.arange(256, dtype=np.uint8)
        for first, last in (b"az", b"AZ"):
            self.kinds[first : last + 1] = 1
        self.lower[0x41:0x5B] += 0x20
        self.pairs = np.zeros(1 << 16, np.uint16)  # of the letters above: their lower case, as two bytes; else 0
        for c in self._LETTERS:
            self.pairs[int.from_bytes(c.encode(), "big")] = int.from_bytes(c.lower().encode(), "big")

    def _encode_pieces(self, found: list[str]) -> list[bytes]:
        """Ids of lower-case pieces; every piece ends with a token that ends a word."""
        import numpy as np

        out = []
        for i in range(0, len(found), 2000):
            part = found[i : i + 2000]
            ids = np.array(self.bare.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            raw, at = ids.tobytes(), [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            if len(at) != len(part) + 1 or at[-1] != len(raw):
                raise ValueError("this vocabulary doesn't mark the ends of words")
            out += [raw[a:b] for a, b in zip(at, at[1:])]
        return out

    def _encode_words(self, found: list[bytes]) -> list[bytes]:
        texts_ = [x.decode("utf-8", "replace") for x in found]
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False))]

    def _cut(self, data: bytes):
        """(bytes without white space, starts of the pieces in data, lengths of the pieces, which ones are whole other words)."""
        import numpy as np

        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        kind, low = self.kinds[raw], self.lower[raw]
        at = np.flatnonzero(kind == 4)
        if len(at):
            at = at[at + 1 < n]
            pair = self.pairs[(raw[at].astype(np.uint16) << 8) | raw[at + 1]]
            at, pair = at[pair != 0], pair[pair != 0]
            kind[at] = kind[at + 1] = 1
            low[at], low[at + 1] = pair >> 8, pair & 0xFF
        odd = [np.flatnonzero(kind >= 4)]
        special = data.find(self._SPECIAL)
        while special >= 0:
            odd.append(np.array([special]))
            special = data.find(self._SPECIAL, special + 1)
        odd = np.concatenate(odd)
        begins = np.ones(n, np.bool_)  # of pieces
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == 2
        quotes = np.flatnonzero(raw == 0x27)
        quotes = quotes[(quotes == 0) | (kind[quotes - 1] != 3)]  # else it goes on a run of signs
        if len(quotes):
            ahead = low[np.minimum(quotes[:, None] + [1, 2], n - 1)]
            ahead[quotes + 1 >= n, 0] = ahead[quotes + 2 >= n, 1] = 0x20
            size = np.zeros(len(quotes), np.int64)
            for x in self._CONTRACTIONS:
                size[(ahead[:, : len(x)] == list(x)).all(axis=1)] = len(x)
            quotes, size = quotes[size > 0], size[size > 0]
            begins[quotes + 1] = False
            after = quotes + size + 1
            begins[after[after < n]] = True
        space = kind == 0
        if len(odd):  # whole words, as they stand
            ends = np.flatnonzero(space)
            first = np.searchsorted(ends, odd)
            first, last = np.where(first > 0, ends[first - 1] + 1, 0), np.append(ends, n)[first]
            first, i = np.unique(first, return_index=True)
            last = last[i]
            inside = np.zeros(n + 1, np.int8)
            inside[first] += 1
            inside[last] -= 1
            inside = np.cumsum(inside[:n], dtype=np.int8).astype(np.bool_)
            begins[inside] = False
            begins[first] = True
            begins[last[last < n]] = True
            low[inside] = raw[inside]
        begins &= ~space
        starts = np.flatnonzero(begins)
        kept = low[~space]
        places = np.cumsum(~space) - 1
        sizes = np.diff(places[starts], append=len(kept))
        return kept, starts, sizes, inside[starts] if len(odd) else np.zeros(len(starts), np.bool_)

    def encode(self, found: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        ids, sizes = self.ids(found)
        raw, ends = ids.tobytes(), (sizes.cumsum() * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def ids(self, found: list[bytes]):
        """(ids of all texts, one after the other, as uint32; number of ids of each text)."""
        import numpy as np
        import pyarrow as pa

        data = b"\n".join([*found, b""])
        parts, at = [], 0
        while at < len(data):  # in runs that end behind white space, so that numpy's arrays stay small
            end = min(at + RUN_BYTES, len(data))
            if end < len(data):
                end = _SPACE.search(data, end).end()
            kept, starts, sizes, other = self._cut(data[at:end])
            parts.append((kept, starts + at, sizes, other))
            at = end
        if not parts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        kept, starts, sizes, other = map(np.concatenate, zip(*parts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        numbered = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
        index = numbered.indices.to_numpy()
        _, at, held = numbered.dictionary.buffers()
        at, held = np.frombuffer(at, np.int64, len(numbered.dictionary) + 1).tolist(), held.to_pybytes()
        pieces = [held[a:b] for a, b in zip(at, at[1:])]
        new = self.known.missing(pieces)
        if new:
            whole = {pieces[i] for i in np.unique(index[other])}
            words, new = [x for x in new if x in whole], [x for x in new if x not in whole]
            self.known.young.update(zip(words, self._encode_words(words)))
            self.known.young.update(zip(new, self._encode_pieces([x.decode() for x in new])))
        ids_of = list(map(self.known.young.__getitem__, pieces))
        table = np.frombuffer(b"".join(ids_of), "<u4")
        size_of = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) // 4
        self.known.age()
        first = np.cumsum(size_of) - size_of
        n = size_of[index]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = table[np.repeat(first[index] - (ends - n), n) + np.arange(total)]
        limits = np.cumsum([len(x) + 1 for x in found])
        behind = np.searchsorted(starts, limits)  # pieces before the end of each text
        return ids, np.diff(np.concatenate([[0], ends])[behind], prepend=0)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per worker process, so what it remembers outlives a task."""
    return Encoder(path)


_SHARDS = "part int, seq long, n_ids long, n_docs int, shard binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode every document, ids in ascending doc_id order (null first), and write the shards to path.

    Null text counts as empty and gives the end id alone. Rows that share an id are all kept, next to each other.
    """
    order = [F.col("doc_id"), F.xxhash64("text")]  # so rows that share an id, or have none, are dealt to many tasks
    ranged = texts(docs).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        own, part, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        bits = max(own.bits, end_id.bit_length())
        doc_ids, lengths, chunks, size = [], [], [], 0

        def close():
            ids = np.concatenate(chunks)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()),
                    pa.array([len(doc_ids)], pa.int32()), pa.array([write_shard(doc_ids, lengths, ids, bits)], pa.binary()),
                ],
                names=["part", "seq", "n_ids", "n_docs", "shard"],
            )

        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            ids, sizes = own.ids(batch.column("text").to_pylist())
            ended = np.full(len(ids) + len(sizes), end_id, "<u4")
            ended[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
            ends = np.cumsum(sizes + 1)
            begin, limits = 0, ends.tolist()
            while begin < len(limits):
                before = limits[begin - 1] if begin else 0
                # up to the document that fills the shard
                last = min(int(np.searchsorted(ends, before + SHARD_IDS - size)), begin + SHARD_DOCS - len(doc_ids) - 1, len(limits) - 1)
                doc_ids += numbers[begin : last + 1]
                lengths += (sizes[begin : last + 1] + 1).tolist()
                chunks.append(ended[before : limits[last]])
                size += limits[last] - before
                begin = last + 1
                if size >= SHARD_IDS or len(doc_ids) >= SHARD_DOCS:
                    yield close()
                    seq += 1
                    doc_ids, lengths, chunks, size = [], [], [], 0
        if doc_ids:
            yield close()

    ranged.mapInArrow(run, _SHARDS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the shards at path: doc_id, start, n_tokens, ids_crc32."""
    short_batches(spark)
    shards = spark.read.schema(_SHARDS).parquet(path)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part, seq, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "shard"))):
                shard = Shard(data)
                ids = shard.range(0, shard.n_ids)
                raw, at = memoryview(ids.tobytes()), (shard.starts * 4).tolist()
                n = shard.n_docs
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int64()),
                        pa.array([shard.doc_id(i) for i in range(n)], pa.int64()), pa.array(shard.starts[:-1], pa.int64()),
                        pa.array([(b - a) // 4 for a, b in zip(at, at[1:])], pa.int64()),
                        pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "own_start", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "seq", "shard").mapInArrow(
        run, "part int, seq long, doc_id long, own_start long, n_tokens long, ids_crc32 long"
    )
    counts = shards.select("part", "seq", "n_ids")
    ahead = counts.groupBy("part").agg(F.sum("n_ids").alias("n")).select(  # one row per range of documents
        "part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead")
    )
    base = counts.join(ahead, "part").select(
        "part",
        "seq",
        (F.col("ahead") + F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("base"),
    )
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return read_tokens(spark, path)
