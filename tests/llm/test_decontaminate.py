import hashlib
import random
import re

import pytest

from lodestone.llm import decontaminate

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return _WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def plain(documents, items):
    out = []
    for doc_id, text in documents:
        w, hit, ids = split(text), set(), set()
        for item, t in items:
            v = split(t)
            size = min(10, len(v))
            if item is None or not size:
                continue
            grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    ids.add(str(item))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def case(awkward):
    r = random.Random(3)
    word = lambda: r.choice("abcde") * r.randint(1, 2)
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 4, 7, 9, 10, 11, 15, 40])))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "..."), (None, "a b c"), (5, items[5][1]), (103, awkward[0][1]), (104, "Äpfel ÖL über")]
    documents = list(awkward)
    for i in range(80):
        body = [word() for _ in range(r.randint(0, 200))]
        if r.random() < 0.5:
            v = (r.choice(items)[1] or "").split()
            at = r.randint(0, len(body))
            body[at:at] = v[r.randint(0, 3) :]
        documents.append((1000 + i, r.choice([" ", "  ", "-", "\n"]).join(body)))
    return documents, items


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 400])
def test_against_brute_force(spark, awkward, block_bytes):
    documents, items = case(awkward)
    d, b = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.decontaminate(d, b, block_bytes).collect()]
    assert sorted(got, key=repr) == plain(documents, items)


def test_joined_with_hubs_and_shared_ids(spark, monkeypatch):
    from lodestone.llm import common

    monkeypatch.setattr(common, "HUB", 3)
    passage = "one two three four five six seven eight nine ten eleven twelve"
    documents = [(i, f"{i} {passage} {i}") for i in range(12)] + [(1, "clean"), (None, passage), (None, "clean too"), (3, f"3 {passage} 3")]
    items = [(i, passage) for i in range(5)] + [(9, "five six")]
    d, b = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.decontaminate(d, b, 1).collect()]
    assert sorted(got, key=repr) == plain(documents, items)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 1])
def test_a_very_long_text(spark, block_bytes):
    r = random.Random(4)
    long = [r.choice("abcdefgh") * r.randint(1, 5) for _ in range(120_000)]
    span = [f"w{i}" for i in range(15)]
    documents = [(1, " ".join(long[:60_000] + span + long[60_000:])), (2, " ".join(long))]
    d, b = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(span))], "item_id long, text string")
    assert sorted(tuple(r)[:4] for r in decontaminate.decontaminate(d, b, block_bytes).collect()) == [(1, 120_015, 15, 1), (2, 120_000, 0, 0)]


def test_a_large_benchmark_stays_off_the_driver(spark, monkeypatch):
    """A benchmark a hundred times the bound: nothing but counts, spans and the sieve of fixed size comes to the driver."""
    r = random.Random(5)
    items = [(i, " ".join(f"{r.randrange(10**6)}" for _ in range(40))) for i in range(800)]
    documents = [(i, items[i * 7][1] if i % 2 else "nothing of it " * 9) for i in range(60)]
    d, b = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows, collect = [], type(d).collect
    monkeypatch.setattr(type(d), "collect", lambda self: (got := collect(self), rows.append(len(got)))[0])
    size = sum(len(t) + 64 for _, t in items)
    found = decontaminate.decontaminate(d, b, size // 100)
    assert max(rows, default=0) <= 10
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(documents, items)


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(empty, none).collect() == []
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, none).collect())


def test_every_long_shared_span_shares_a_fingerprint():
    hasher, r = decontaminate.Hasher(), random.Random(1)
    span = [b"%d" % r.randrange(50) for _ in range(10)]
    for _ in range(50):
        a = [b"%d" % r.randrange(50) for _ in range(30)] + span + [b"%d" % r.randrange(50) for _ in range(30)]
        _, _, ha = hasher.words(b" ".join(a))
        _, _, hs = hasher.words(b" ".join(span))
        assert set(hasher.minima(hs, *decontaminate.scheme(10)).tolist()) <= set(hasher.minima(ha, *decontaminate.scheme(10)).tolist())


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 1])
def test_stage_judges_rows(spark, tmp_path, block_bytes):
    spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "x a b c d e f g h i j y"), (1, "clean"), (None, "a b c d e f g h i j"), (None, None), (2, "a b c")]
    d = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, key long")
    out = decontaminate.stage(spark, d, str(tmp_path), block_bytes)
    assert out.columns == d.columns and sorted((tuple(r)[:2] for r in out.collect()), key=repr) == sorted([rows[1], rows[3], rows[4]], key=repr)


def test_stage(spark, docs, awkward, tmp_path):
    spark.createDataFrame([(1, awkward[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = decontaminate.stage(spark, docs, str(tmp_path))
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and not {1, 2, 3, 10} & set(ids) and {4, 5, 6, 7, 8, 9, 12, None} <= set(ids)
