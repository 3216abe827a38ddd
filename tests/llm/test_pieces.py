import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import pieces

PATH = public_tokenizers.path(pieces.MODEL)


@pytest.fixture(scope="module")
def model():
    return pieces.Model(PATH)


def samples():
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzäöüß"
    out = ["", " ", "a", "hello world", "  two  spaces ", "x" * 500, "ab" * 300, "internationalization" * 20, "日本語" * 50, "😀a" * 40, "\n\t" * 30, "1234567890" * 30, "a▁b ▁▁ c"]
    out += ["".join(r.choice(letters) for _ in range(r.randint(1, 400))) for _ in range(15)]
    out += [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(40)) for _ in range(8)]
    out += ["theinternationalcommunication" * 8 + " of " + "representations" * 6]
    return out


@pytest.mark.parametrize("size", [20, 37, 64, 10_000])
def test_chunked_encoding_is_the_librarys(model, size):
    for text in samples():
        assert pieces.encode_text(text, model, size) == model.sp.encode(text), text[:60]


def test_scan_is_associative():
    r = np.random.default_rng(1)
    ms = [np.where(r.random((3, 3)) < 0.6, 0.0, pieces.NO) for _ in range(9)]
    want, at = [], None
    for m in ms:
        at = m if at is None else pieces.product(at, m)
        want.append(at)
    assert all((a == b).all() for a, b in zip(pieces.prefixes(ms), want))


def test_spark_encoding_and_decoding(spark, docs, awkward, model):
    for size in (50, 16_384):
        out = pieces.decode(pieces.encode(docs, PATH, size), PATH, with_ids=True).collect()
        assert sorted(map(repr, pieces.round_trip(docs, PATH, True, size).collect())) == sorted(map(repr, out))
        assert len(out) == len(awkward)
        by = {}
        for r in out:
            by.setdefault(r["doc_id"], []).append(r)
        for i, text in awkward:
            ids = model.sp.encode(text or "")
            for r in by[i]:
                assert r["ids"] == ids and r["n_pieces"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
                assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 3, 64])
def test_blocks_of_chunks_without_white_space(spark, model, block):
    r = random.Random(block)
    texts = ["".join(r.choice(["inter", "nation", "al", "ization", "re", "present", "q", "ü"]) for _ in range(n)) for n in (3, 40, 150)]
    texts += ["theinternational" * 30 + " of " + "representations" * 20, "日本語" * 120, "word " * 90 + "x" * 200]
    d = spark.createDataFrame([(i % 4, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, no int")
    got = [(x["doc_id"], list(x["ids"])) for x in pieces.encode(d, PATH, 40, block).collect()]
    assert sorted(got) == sorted((i % 4, model.sp.encode(t)) for i, t in enumerate(texts))


def test_stage_keeps_every_row_and_its_ids(spark, docs, awkward, model):
    got = sorted(((r["doc_id"], r["n_pieces"]) for r in pieces.stage(spark, docs, "").collect()), key=repr)
    assert got == sorted(((i, len(model.sp.encode(t or ""))) for i, t in awkward), key=repr)


def test_empty(empty):
    assert pieces.decode(pieces.encode(empty, PATH), PATH).collect() == []
