import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import token_store
from lodestone.llm.common import scratch

PATH = public_tokenizers.path(token_store.VOCABULARY)


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    r = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = r.integers(0, 1 << bits, n, np.uint64).astype("<u4")
        packed = token_store.pack(ids, bits)
        assert len(packed) == -(-n // 64) * bits * 8 and (token_store.unpack(packed, n, bits) == ids).all()


def test_shard_random_access():
    r = np.random.default_rng(0)
    lengths = [0, 5, 9000, 1, 4096, 3]
    ids = r.integers(0, 49408, sum(lengths), np.uint64).astype("<u4")
    shard = token_store.Shard(token_store.write_shard([3, None, -7, 9, 10, 11], lengths, ids, 16))
    at = np.cumsum([0, *lengths])
    for i in range(6):
        assert (shard.doc(i) == ids[at[i] : at[i + 1]]).all()
    assert (shard.range(4000, 9100) == ids[4000:9100]).all() and [shard.doc_id(i) for i in range(3)] == [3, None, -7]


def test_against_the_library(spark, docs, awkward):
    path = scratch(spark, "tokens")
    token_store.write_tokens(docs, path, PATH)
    got = [tuple(r) for r in token_store.read_tokens(spark, path).collect()]
    tokenizer, start, want = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(awkward, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want


def test_words_encode_like_texts():
    tokenizer, encoder = Tokenizer.from_file(PATH), token_store.Encoder(PATH)
    found = ["I'm here, aren't we?  'tis \u00a0 x\u2003y", "A\u0301 e\u0301 \u1e9e", "<|endoftext|> in <|startoftext|>text", "\x1c a\x1db", "100% of 3.14", "ǅ İ ς Σ", "né\u0301e\n\n--\t!!"]
    for text, raw in zip(found, encoder.encode([x.encode() for x in found])):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def same_as_the_library(found):
    tokenizer, encoder = Tokenizer.from_file(PATH), token_store.Encoder(PATH)
    want = [e.ids for e in tokenizer.encode_batch_fast(found, add_special_tokens=False)]
    for text, raw, ids in zip(found, encoder.encode([x.encode() for x in found]), want):
        assert np.frombuffer(raw, "<u4").tolist() == ids, text


def test_letters_with_combining_marks():
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzÄÖÜẞß"
    same_as_the_library([a + chr(m) + b for a in letters for m in range(0x300, 0x370) for b in ("", "x")])


@pytest.mark.parametrize("run", [1, 7, 64, 1 << 19])
def test_random_texts(monkeypatch, run):
    monkeypatch.setattr(token_store, "RUN_BYTES", run)
    r = random.Random(run)
    pools = [
        "abcxyzABCXYZ", "0123456789", " \t\n\r\x0b\x0c", "'’.,!?-_\"", "streveml'STREVEMLd'", "".join(map(chr, range(0xA0, 0x180))),
        "".join(map(chr, range(0x300, 0x370))), "\x00\x01\x1c\x1d\x1e\x1f\x7f\x85\u00a0\u2003\u3000", "日本語한글😀İıſ", "<|>",
    ]
    one = lambda: r.choice(["<|endoftext|>", "<|startoftext|>", "<|", "'s", "''s", "'re", "'r"]) if r.random() < 0.05 else r.choice(r.choice(pools))
    same_as_the_library(["".join(one() for _ in range(r.randint(0, 60))) for _ in range(1500)])


def test_a_very_long_text_and_a_very_long_word(spark):
    r = random.Random(3)
    long = " ".join("".join(r.choice("abcdeéÄß.,'") for _ in range(r.randint(1, 9))) for _ in range(300_000))
    same_as_the_library([long, "x" * 300_000, "\u00a0" * 100_000])


def test_rows_without_words_and_shared_ids(spark):
    path = scratch(spark, "tokens")
    d = spark.createDataFrame([(None, "b a"), (None, None), (7, ""), (7, "x"), (8, " ")], "doc_id long, text string")
    token_store.write_tokens(d, path, PATH)
    got = sorted(map(tuple, token_store.read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 7, 7, 8] and sorted(r[2] for r in got[:2]) == [1, 3]
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(5)]


def test_empty(spark, empty):
    path = scratch(spark, "tokens")
    token_store.write_tokens(empty, path, PATH)
    assert token_store.read_tokens(spark, path).collect() == []
