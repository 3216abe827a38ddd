import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import components, simhash


def plain_fingerprint(text):
    words, word = [], b""
    for byte in (text or "").encode():
        if byte == 0x20 or 9 <= byte <= 13:
            if word:
                words.append(word)
            word = b""
        else:
            word += bytes([byte + 32 if 65 <= byte <= 90 else byte])
    if word:
        words.append(word)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)]
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items):
    """items: (doc_id, fingerprint); smallest doc_id reachable at 3 bits or fewer, by all pairs."""
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def test_against_brute_force(docs, awkward):
    got = [tuple(r)[:3] for r in simhash.near_duplicates(docs).collect()]
    known = {i: plain_fingerprint(t) for i, t in awkward if i is not None}
    part = plain_components(sorted(known.items()))
    assert sorted((i, f, c) for i, f, c in got if i is not None) == sorted((i, f"{known[i]:016x}", part[i]) for i, _ in awkward if i is not None)
    assert [(f, c) for i, f, c in got if i is None] == [(f"{plain_fingerprint('no id here'):016x}", None)]


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("hot_bucket", [256, 2])
def test_links_join_all_that_any_link_joins(spark, hot_bucket):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(6)]
    fps = set(seeds)
    for x in seeds:
        for _ in range(60):
            y = x
            for _ in range(r.randint(1, 5)):
                y ^= 1 << r.randrange(64)
            fps.add(y)
    signed = {x - (1 << 64) if x >> 63 else x: x for x in fps}
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot_bucket)
    pairs = {(signed[a], signed[b]) for a, b in found.collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    order = sorted(fps)
    want = plain_components(list(enumerate(fps[0] for fps in zip(order))))
    root = list(range(len(order)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(order.index(a)), find(order.index(b))))
        root[y] = x
    assert {i: find(i) for i in range(len(root))} == want
    if hot_bucket > 100:
        assert pairs == {(a, b) if signed_less(a, b) else (b, a) for i, a in enumerate(order) for b in order[i + 1 :] if (a ^ b).bit_count() <= 3}


def signed_less(a, b):
    s = lambda x: x - (1 << 64) if x >> 63 else x
    return s(a) < s(b)


def test_spanning_forest():
    x = np.array([0, 1, 3, 7, 15, 0xFFFFFFFF << 32], np.uint64)
    assert len(simhash.spanning(x)) == 4


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1201)}


def test_stage_keeps_one_of_each_group(spark, docs):
    kept = [r["doc_id"] for r in simhash.stage(spark, docs, "").collect()]
    assert 1 in kept and 2 not in kept and None in kept and simhash.stage(spark, docs, "").columns == docs.columns


def test_hubs_are_dealt_to_many_tasks(spark, monkeypatch):
    from lodestone.llm import common

    monkeypatch.setattr(common, "HUB", 20)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 1100 + i) for i in range(150)] + [(900, 5000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 900 for i in [900, *range(1000, 1250), 5000] if i <= 1200 or 1100 <= i < 1250 or i == 5000}


def test_stage_tells_rows_that_share_an_id_apart(spark):
    near = "one two three four five six seven eight nine ten"
    rows = [
        (1, near), (2, near), (2, "quite another text that stays as it is here"), (3, "the same row twice of words"), (3, "the same row twice of words"),
        (None, near), (None, "no id and no partner whatever happens"), (None, "twice without an id though"), (None, "twice without an id though"), (4, None), (5, ""),
    ]
    d = spark.createDataFrame([(*r, "k", -1) for r in rows], "doc_id long, text string, key string, fp long")
    got = sorted((tuple(r)[:2] for r in simhash.stage(spark, d, "").collect()), key=repr)
    want = [(1, near), (2, rows[2][1]), (3, rows[3][1]), (None, rows[6][1]), (None, rows[7][1]), (4, None)]
    assert got == sorted(want, key=repr)
    assert simhash.stage(spark, d.limit(0), "").collect() == []
