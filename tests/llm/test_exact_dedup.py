import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup
from lodestone.llm.common import scratch


def plain(awkward):
    groups = defaultdict(list)
    for i, t in awkward:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max(ids, key=lambda x: (x is not None, x or 0))
        left = True
        for i in sorted(ids, key=lambda x: (x is not None, x or 0), reverse=True):
            out.append((i, keep, len(ids), left and i == keep, hashlib.sha256(t.encode()).hexdigest()))
            left = left and i != keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)])
def test_against_brute_force(docs, awkward, digest):
    """With one hex digit as the digest most texts collide, and only the bytes tell them apart."""
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(docs, digest).collect()), key=repr) == plain(awkward)


def test_empty(empty):
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_state_goes_on_with_later_arrivals(spark):
    path, state = scratch(spark, "in"), scratch(spark, "state")
    schema = "digest string, doc_id long, seq long, locator string"
    stream = lambda: spark.readStream.schema(schema).parquet(path)
    spark.createDataFrame([("a", 1, 0, "f"), ("b", 2, 1, "f")], schema).write.parquet(path, mode="append")
    assert {r["digest"]: (r["head"]["doc_id"], r["n"]) for r in exact_dedup.fold(stream(), state).collect()} == {"a": (1, 1), "b": (2, 1)}
    spark.createDataFrame([("a", 9, 2, "g"), ("c", 3, 3, "g")], schema).write.parquet(path, mode="append")
    assert {r["digest"]: (r["head"]["doc_id"], r["n"]) for r in exact_dedup.fold(stream(), state).collect()} == {"a": (9, 2), "b": (2, 1), "c": (3, 1)}


def test_main_path_is_native(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_stage(spark, docs, awkward):
    out = exact_dedup.stage(spark, docs, "")
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert out.columns == docs.columns
    assert sorted({t or "" for _, t in got}) == sorted({t or "" for _, t in awkward}) and len(got) == len({t or "" for _, t in awkward})
    assert (2, awkward[0][1]) in got and (1, awkward[0][1]) not in got
