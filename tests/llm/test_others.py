import json
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.llm import html_text, language, licences, toxicity, urls
from lodestone.llm.gbdt import Boosted

SF = "/root/testdata/sf0.01"


# ---- licences


def plain_base(text):
    w = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    at = sorted((i, label) for phrase, label in licences.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == [x.encode() for x in phrase.split()])
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


TEXTS = [
    "All rights reserved. CC-BY; cc by cc by", "the General  Public\nLicense and all rights reserved all rights", "xcc by", "cc byx", "", None, "cc", "ALL-RIGHTS-RESERVED",
    "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause",
]


def test_licences_against_brute_force(spark, docs, awkward):
    more = [(100 + i, t) for i, t in enumerate(TEXTS)]
    d = spark.createDataFrame(more + [(i, t) for i, t in awkward], "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in licences.scan_licences(d).collect()}
    for i, t in more + list(awkward):
        n, base, first, last, labels = plain_base(t)
        r = got[i, n]
        assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (base, first, last, labels), t
        assert set(filter(None, labels.split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got.values()}
    assert by[108]["labels"] == "apache-2.0" and by[109]["labels"] == "bsd-3-clause,gpl,mit".replace("bsd-3-clause", "bsd")
    assert licences.scan_licences(docs.limit(0)).collect() == []


def test_shunting_yard():
    p = licences.parse
    assert p("MIT OR Apache-2.0 AND BSD-3-Clause") == ("or", "mit", ("and", "apache-2.0", "bsd-3-clause"))
    assert p("(MIT or GPL-2.0 with X) and ISC") == ("and", ("or", "mit", ("with", "gpl-2.0", "x")), "isc")
    assert p("MIT OR") == "mit" and p("") is None and p(")(") is None and p("((MIT") == "mit" and p("AND MIT") is None and p("MIT */ more") == "mit"
    assert licences.freedom(p("GPL-3.0 OR MIT")) == 1 and licences.freedom(p("GPL-3.0 AND MIT")) == 0.5


def test_licence_expressions_are_read_whole():
    names = " AND ".join(f"LicenseRef-part-of-the-whole-{i}" for i in range(50))
    for line in (f"SPDX-License-Identifier: {names} AND GPL-3.0\nMIT", f'"license-expression": "{names} AND GPL-3.0", MIT'):
        labels, score = licences.scan(line.encode(), licences.automaton())[5:]
        assert set(labels.split(",")) == {f"licenseref-part-of-the-whole-{i}" for i in range(50)} | {"gpl"} and score == 0.5
    line = "SPDX-License-Identifier: MIT so far " + "x " * 20 + "SPDX-License-Identifier: GPL-3.0 then 'SPDX-License-Identifier: ISC'"
    assert licences.scan(line.encode(), licences.automaton())[5:] == ("gpl,isc,mit", 1.0)
    deep = "(" * 5000 + "MIT" + " AND MIT)" * 5000
    assert licences.scan(f"SPDX-License-Identifier: {deep} AND GPL-2.0".encode(), licences.automaton())[5:] == ("gpl,mit", 0.5)
    right = "MIT AND (" * 5000 + "GPL-2.0 OR ISC" + ")" * 5000
    assert licences.scan(f"SPDX-License-Identifier: {right}".encode(), licences.automaton())[5:] == ("gpl,isc,mit", 1.0)


# ---- url filters


def plain_rule(host, path):
    fits = [(len(h) + len(p), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits) if fits else None


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


URLS = [
    "http://A.Example.COM/en/7x", "https://www.example.com/en/8?x=/en/7", "http://com/en/", "http://xcom/en/", "//no", None, "", "http://a.net/de/8", "http://example.net/de/8",
    "http://x.org#/es/", "http://x.org/es/?a", "http://spam-farm.example.com/fr/1", "ftp://É.org/es/", "http://x.org?/es/", "a://b://c/de/",
]


def test_urls_against_brute_force(spark):
    d = spark.createDataFrame([(i, u, None, "r", "v") for i, u in enumerate(URLS)], "page_id long, url string, html string, rule string, verdict string")
    for r in urls.judge(d).collect():
        host, path = plain_split(URLS[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        rule = plain_rule(host, path)
        assert r["rule"] == (rule[1] if rule else None)
        assert r["verdict"] == (rule[2] if rule else "block" if host.endswith("spam-farm.example.com") else "allow"), URLS[r["page_id"]]
    assert urls.judge(d.limit(0)).collect() == []


#: The contract's list, written out here and not taken from the operator.
CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_urls_have_the_rules_of_the_contract(spark):
    assert {h + p: action for action, h, p in urls.RULES} == CONTRACT
    made = ["http://net/de/", "http://a.net/de/8", "http://example.net/de/7", "http://example.net/de/8", "http://m.example.net/de/81", "http://x.com/en/7", "http://example.com/en/7", "http://x.org/es/"]
    d = spark.createDataFrame([(i, u, None) for i, u in enumerate(made)], "page_id long, url string, html string")
    got = [(r["rule"], r["verdict"]) for r in urls.judge(d).orderBy("page_id").collect()]
    assert got == [(x, CONTRACT[x]) for x in ("net/de/", "net/de/", "net/de/", "example.net/de/8", "example.net/de/8", "com/en/", "example.com/en/7", "org/es/")]


def test_pagerank_against_plain_loops(spark):
    r = random.Random(2)
    edges = sorted({(f"h{r.randrange(12)}", f"h{r.randrange(12)}") for _ in range(40)})
    edges = [(x, y) for x, y in edges if x != y]
    got = {x["host"]: x["score"] for x in urls.pagerank(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("h0",), ("h1",)], "host string")).collect()}
    out = {x: [b for a, b in edges if a == x] for x, _ in edges}
    score = start = {"h0": 0.15, "h1": 0.15}
    for _ in range(urls.ROUNDS):
        nxt = dict(start)
        for x, v in score.items():
            for y in out.get(x, []):
                nxt[y] = nxt.get(y, 0) + 0.85 * v / len(out[x])
        score = nxt
    assert got.keys() == score.keys() and all(abs(got[k] - score[k]) < 1e-12 for k in got)


def test_pagerank_with_hubs_and_without_seeds(spark, monkeypatch):
    from lodestone.llm import common

    edges = spark.createDataFrame([("hub", f"h{i}") for i in range(50)] + [("h1", "hub"), ("h2", "hub"), ("h2", "hub"), (None, "hub")], "src string, dst string")
    seeds = spark.createDataFrame([("hub",), ("alone",)], "host string")
    plain = {x["host"]: round(x["score"], 12) for x in urls.pagerank(edges, seeds).collect()}
    monkeypatch.setattr(common, "HUB", 10)
    assert {x["host"]: round(x["score"], 12) for x in urls.pagerank(edges, seeds).collect()} == plain and len(plain) == 52
    assert abs(plain["alone"] - 0.15) < 1e-12 and urls.pagerank(edges, seeds.limit(0)).collect() == []


def test_distrust_reaches_those_that_link_to_bad_hosts(spark):
    link = '<a href="http://m.casino-win.example.com/x">x</a>'
    d = spark.createDataFrame([(1, "http://friend.test/", link), (2, "http://other.test/", '<a href="/own">y</a>'), (2, "http://other.test/", "")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["verdict"]) for r in urls.judge(d).collect()) == [(1, "block"), (2, "allow"), (2, "allow")]


def test_urls_with_links_against_sql(spark, tmp_path):
    r = random.Random(6)
    hosts = [f"h{i}.test" for i in range(12)] + ["x.casino-win.example.com", "a.example.com"]
    link = lambda: r.choice(['<a href="http://%s/p">', "<A class=x HREF='//%s'>", '<a href="HTTPS://%s?q">', '<a href="/%s">']) % r.choice(hosts)
    pages = [(i, f"http://{r.choice(hosts)}/{r.choice(['en/7', 'x', ''])}", "".join(link() + "t</a>" for _ in range(r.randint(0, 3)))) for i in range(60)] + [(5, None, None)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    d.write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want, got = c.sql(urls.sql()).df(), urls.judge(d).toPandas()
    cols = sorted(want.columns)
    assert sorted(map(repr, got[cols].astype(object).where(got[cols].notna(), None).values.tolist())) == sorted(map(repr, want[cols].astype(object).where(want[cols].notna(), None).values.tolist()))
    assert (want.distrust > 0).sum() > 5 and want.verdict.nunique() == 2


# ---- language


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.document_rows(docs)
    blind = rows.withColumn("declared", F.when(F.col("id") % 2 == 0, F.col("declared")))
    got = language.identify(blind, fit_rows=60).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").where("id % 2 = 1")
    n, right = got.count(), got.where("language = lang").count()
    assert right / n > 0.98


def test_language_edge_cases(spark, docs, awkward, empty):
    got = language.identify(language.document_rows(docs)).collect()
    assert len(got) == len(awkward) and language.identify(language.document_rows(empty)).collect() == []
    by = {r["id"]: r for r in got}
    assert by[4]["language"] == by[6]["language"] == "und" and not by[4]["accepted"] and by[9]["accepted"]
    none = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    assert {r["id"] for r in language.identify(language.document_rows(none)).collect() if not r["accepted"]} == {4, 5, 6}
    out = language.stage(spark, docs, "")
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {i for i, _ in awkward} - {4, 5, 6}


def test_language_stage_tells_rows_that_share_an_id_apart(spark):
    rows = [(1, "real words that are kept", "en"), (1, "1234 5678", "en"), (1, "real words that are kept", "en"), (None, "real words again", "en"), (None, "!!!", "en"), (2, "0", None)]
    d = spark.createDataFrame([(*r, "src", "x") for r in rows], "doc_id long, text string, lang string, source string, key string")
    got = sorted((tuple(r)[:2] for r in language.stage(spark, d, "").collect()), key=repr)
    assert got == sorted([rows[0][:2], rows[2][:2], rows[3][:2]], key=repr)


def test_every_declared_language_is_fitted(spark):
    import string

    r, rows = random.Random(8), []
    for k in range(70):
        name = string.ascii_lowercase[k // 26] + string.ascii_lowercase[k % 26]
        words = ["".join(r.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(6)]
        rows += [(k * 10 + i, " ".join(r.choice(words) for _ in range(30)), name if i else None, name) for i in range(4 if k else 5)]
    d = spark.createDataFrame(rows, "id long, text string, declared string, want string")
    d = d.withColumn("host", F.lit(None).cast("string")).withColumn("suffix", F.lit(None).cast("string"))
    got = {x["id"]: (x["text_language"], x["language"]) for x in language.identify(d).collect()}
    assert got == {i: (want, want) for i, _, _, want in rows}


def test_pages_bring_markup_and_suffix_as_evidence(spark, tmp_path):
    page = lambda i, host, lang, text: (i, f"https://{host}/p{i}", f"<html{lang}><head><title>no</title></head><body><p>{text}</p><script>no</script></body></html>")
    rows = [page(i, f"h{i % 3}.{'fr' if i % 2 else 'uk'}", f" lang='{'fr-FR' if i % 2 else 'en'}'", "xxx yyy zzz" if i % 2 else "aaa bbb ccc") for i in range(60)]
    # neither text nor markup tells: the suffix of an unseen host does; and markup alone, where nothing else does
    rows += [page(100, "new.fr", "", "q7"), page(101, "new.uk", "", "q7"), page(102, "new.org", ' lang="fr"', "q7"), page(103, "new.org", ' lang="en"', "q7")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    first = {r["id"]: r for r in language.page_rows(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect()}
    assert (first[1]["declared"], first[1]["host"], first[1]["suffix"], first[1]["text"].split()) == ("fr", "h1.fr", "fr", ["xxx", "yyy", "zzz"])
    got = {r["page_id"]: r["language"] for r in language.pages_query(spark, str(tmp_path)).collect()}
    assert {i: got[i] for i in (0, 1, 100, 101, 102, 103)} == {0: "en", 1: "fr", 100: "fr", 101: "en", 102: "fr", 103: "en"}


def plain_language(rows):
    """(id, language, confidence) from the definition, with every row in the fit sample."""
    import math
    from collections import Counter

    def codes(text):
        x = b"  " + text.lower().encode() + b"  "
        return [((((a << 16) | (b << 8) | c) * 2654435761) & 0xFFFFFFFF) >> 16 for a, b, c in zip(x, x[1:], x[2:])]

    names = sorted({r["declared"] for r in rows if r["declared"] and r["text"]})
    counts = {n: Counter(c for r in rows if r["declared"] == n and r["text"] for c in codes(r["text"])) for n in names}
    size = {n: sum(counts[n].values()) + language.SMOOTHING * language.BUCKETS for n in names}
    mean = lambda text, n: sum(math.log((counts[n][c] + language.SMOOTHING) / size[n]) for c in codes(text)) / len(codes(text))
    ll = {r["id"]: [mean(r["text"] or "", n) for n in names] for r in rows}
    letters = {r["id"]: any(map(str.isalpha, r["text"] or "")) for r in rows}
    best = {i: x.index(max(x)) for i, x in ll.items()}
    host, suffix, whole = Counter(), Counter(), Counter()
    for r in rows:
        if letters[r["id"]]:
            for c, key in ((host, (r["suffix"], r["host"], best[r["id"]])), (suffix, (r["suffix"], best[r["id"]])), (whole, best[r["id"]])):
                c[key] += 1
    k, out = range(len(names)), []
    top = [(whole[i] + 1) / (sum(whole.values()) + len(names)) for i in k]
    for r in rows:
        s, h = r["suffix"], r["host"]
        s_sum, h_sum = sum(suffix[s, i] for i in k), sum(host[s, h, i] for i in k)
        above = [(suffix[s, i] + language.SUFFIX_STRENGTH * top[i]) / (s_sum + language.SUFFIX_STRENGTH) for i in k]
        prior = [(host[s, h, i] + language.HOST_STRENGTH * above[i]) / (h_sum + language.HOST_STRENGTH) for i in k] if h_sum else top
        said = [0.0] * len(names)
        if r["declared"] in names:
            said = [math.log(language.DECLARED_RIGHT if n == r["declared"] else (1 - language.DECLARED_RIGHT) / (len(names) - 1)) for n in names]
        post = [x * min(len(r["text"] or ""), language.TEXT_WEIGHT) + a + math.log(p) for x, a, p in zip(ll[r["id"]], said, prior)]
        e = [math.exp(x - max(post)) for x in post]
        out.append((r["id"], names[post.index(max(post))] if letters[r["id"]] else "und", round(1 / sum(e), 6) if letters[r["id"]] else 0.0))
    return sorted(out)


def test_language_against_brute_force(spark):
    r = random.Random(12)
    words = {"en": ["the", "thing", "with", "other"], "de": ["der", "schön", "nicht", "auch"], "fr": ["le", "être", "avec", "aussi"]}
    rows = []
    for i in range(90):
        n = r.choice(list(words))
        text = r.choice([None, "", "12", "q"]) if i % 15 == 0 else " ".join(r.choice(words[n if r.random() < 0.8 else r.choice(list(words))]) for _ in range(r.randint(1, 12)))
        rows.append({"id": i, "text": text, "declared": r.choice([n, n, None, "en", "xx" if not text else n]), "host": f"h{r.randrange(4)}", "suffix": r.choice(["com", "fr"])})
    got = language.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string"), fit_rows=10_000)
    got, want = sorted((x["id"], x["language"], round(x["confidence"], 6)) for x in got.collect()), plain_language(rows)
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 2e-5 for a, b in zip(got, want))


def test_blocks_of_languages_change_nothing(spark, monkeypatch):
    rows = language.document_rows(spark.read.parquet(f"{SF}/documents.parquet"))
    whole = sorted(map(tuple, language.identify(rows).collect()))
    monkeypatch.setattr(language, "FIT_BLOCK", 3)
    assert sorted(map(tuple, language.identify(rows).collect())) == whole


def test_likelihoods_do_not_depend_on_neighbours():
    _, table = language.fit([("a", "aaa aba"), ("b", "bbb bab")])
    found = ["aab", "", "x" * 2000, "Bba", "ab"]
    assert language.likelihoods(found, table) == [language.likelihoods([x], table)[0] for x in found]


def test_priors_of_hosts_decide_between_equal_texts(spark):
    rows = [(i, "aaa bbb ccc" if i % 2 else "xxx yyy zzz", "en" if i % 2 else "fr", "one" if i % 2 else "two", "t") for i in range(60)]
    rows += [(100, "q7", None, "one", "t"), (101, "q7", None, "two", "t")]
    d = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    got = {r["id"]: r["language"] for r in language.identify(d).collect()}
    assert got[100] == "en" and got[101] == "fr"


# ---- toxicity


def test_segments_are_maximal():
    """All maximal scoring segments as the recursive definition gives them: the best segment, then left and right of it."""

    def plain(values, offset=0):
        best = max(((sum(values[i:j]), -(j - i), i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        s, _, i, j = best
        return plain(values[:i], offset) + [(offset + i, offset + j - 1, s)] + plain(values[j:], offset + j)

    r = random.Random(9)
    for _ in range(200):
        values = [r.choice([-3, -2, -1, 1, 2, 3]) + r.random() / 100 for _ in range(r.randint(0, 14))]
        runs, before = [], 0.0
        for i, v in enumerate(values):
            if v > 0:
                runs.append((i, before, v))
                before = 0.0
            else:
                before += v
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(runs)]
        assert got == [(a, b, round(s, 6)) for a, b, s in plain(values)]


@pytest.mark.parametrize("kind", ["even", "rising", "falling", "random"])
def test_segments_take_linear_time(kind):
    import time

    r = random.Random(1)
    before = {"even": lambda i: -1.0, "rising": lambda i: -0.5, "falling": lambda i: -2.0, "random": lambda i: -2 * r.random()}[kind]
    runs = [(2 * i, before(i), 1.0 + 1e-9 * i) for i in range(200_000)]
    began = time.perf_counter()
    assert toxicity.segments(runs)
    assert time.perf_counter() - began < 2


def test_whole_small_corpus_scores_like_plain_code():
    """The scores of a corpus from the definition: odds by nested priors, best segments by recursion, chance, curve."""
    import math

    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9))) for _ in range(120)]
    nasty = ["toxic", "toxical", "toxicity", "vilest", "vilely"]
    clean = [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 60))) for _ in range(60)]
    toxic = [" ".join([*(r.choice(vocabulary) for _ in range(20)), *(r.choice(nasty) for _ in range(4)), *(r.choice(vocabulary) for _ in range(20))]) for _ in range(60)]
    m = toxicity.Model(toxic, clean)

    def plain_share(word):
        x = 0.5
        for p in (*toxicity.PREFIXES, len(word)):
            if p < len(word):
                x = m.share.get(word[:p], x)
        return m.share.get(word, x)

    def best(values, at=0):
        top = max(((sum(values[i:j]), i - j, i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), default=(0,))
        if top[0] <= 0:
            return []
        s, _, i, j = top
        return [*best(values[:i], at), (at + i, at + j, s), *best(values[j:], at + j)]

    for text in [*toxic[:12], *clean[:12], "", "toxic toxic toxic", "toxicity vilest toxic"]:
        words = text.lower().encode().split()
        values = [min(toxicity.CEILING, max(toxicity.FLOOR, math.log(plain_share(w) / (1 - plain_share(w))) - toxicity.OFFSET)) for w in words]
        values = [0.0 if i and words[i] == words[i - 1] and v > 0 else v for i, v in enumerate(values)]
        beyond = {tuple(words[a:b]): m.decay * s - math.log(1 + m.volume * len(words)) for a, b, s in best(values)}
        nats = sum(x for x in beyond.values() if x > 0)
        assert abs(m.score(text)[0] - 1 / (1 + math.exp(-m.a * math.log1p(nats) - m.b))) < 1e-9, text
    assert min(m.score(x)[0] for x in toxic) > max(m.score(x)[0] for x in clean)


def test_a_very_long_text_is_scored():
    m = toxicity.Model(["toxic words here"] * 9, ["plain words there"] * 9)
    assert 0 <= m.score("plain words toxic there " * 100_000)[0] <= 1


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score_documents(docs, labels).where("held_out").join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").toPandas()
    hit, said, all_ = ((got.predicted == 1) & (got.toxic == 1)).sum(), (got.predicted == 1).sum(), (got.toxic == 1).sum()
    assert hit / said > 0.9 and hit / all_ > 0.9


def test_toxicity_edge_cases(spark, docs, awkward, empty):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(1, 15)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    import zlib

    assert len(got) == len(awkward) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert toxicity.score_documents(empty, labels).collect() == [] and {r["score"] for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}


# ---- html


def plain_article(source):
    import html

    inner = re.search(r"<article>(.*)</article>", source, re.S)[1].replace("<br>", " ")
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in parts if x)


def test_html_of_the_given_pages():
    pages = duckdb.sql(f"select html from '{SF}/pages.parquet'").fetchall()
    assert html_text.extract_many([x for (x,) in pages], html_text.model()) == [plain_article(x) for (x,) in pages]


def test_html_held_out_accuracy():
    rng, trees, right, total, exact = random.Random(99), html_text.model(), 0, 0, 0
    for _ in range(150):
        nodes, texts, marks = html_text.labelled(html_text.compose(rng))
        keep = html_text.decode(nodes, trees.logits(pd.DataFrame(html_text.features(nodes, texts)).to_numpy(float)))
        want = [t for i, t in texts if i and marks[i]]
        got = [t for i, t in texts if i and keep[i]]
        right += len(set(want) & set(got))
        total += len(set(want) | set(got))
        exact += want == got
    assert right / total > 0.95 and exact / 150 > 0.8


def test_html_hierarchy_and_parts():
    nodes, texts = html_text.parse("<body><!-- <p>no --><div><p>one<p>two &amp; three<br>four&nbsp;five<script>var a='<p>x</p>'</script></div><ul><li>a<li>b</ul>tail</body>")
    assert [t for _, t in texts] == ["one", "two & three four five", "a", "b", "tail"]
    keep = html_text.decode(nodes, [5, 5, -9, 5, 5, 1, 1, 1])
    assert all(keep[x.parent] for x, k in zip(nodes, keep) if k and x.parent >= 0)
    assert html_text.extract_many(["", "<", "<p", "<<>>", "<!--", "<script>", "<p>" * 3000, "plain"], html_text.model())[0] == ""


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>t</title><body><article><p>main text", ["main text"]),
        ("<html><head><title>t</title><p>main text", ["main text"]),
        ("<html><head><title>t</title><script>'<p>'</script>main <b>text</b><p>more", ["main text", "more"]),
        ("<head><title>t</title></head><body><p>main text", ["main text"]),
        ("<article><p>a</p><iframe src=x/><p>b", ["a", "b"]),
        ("<p>a</p><svg/><p>b</p><svg><text>no</text></svg><p>c", ["a", "b", "c"]),
        ("<p>a</p><button class=x><p>b</p><button>no</button><p>c", ["a", "b", "c"]),
        ("<p>a</p><object>no<object>no</object>no</object><p>b", ["a", "b"]),
        ("<p>a</p><select><p>b", ["a", "b"]),
        ("<p>a</p><style>no", ["a"]),
    ],
)
def test_html_open_elements_swallow_nothing(page, want):
    assert [t for _, t in html_text.parse(page)[1]] == want


def test_html_keeps_formulas():
    page = "<article><p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation encoding='application/x-tex'>no</annotation></math> be it.</p></article>"
    assert [t for _, t in html_text.parse(page)[1]] == ["Let x+1 be it."]


def test_html_takes_a_very_long_page():
    page = "<html><body><article>" + "<p>Some words of a paragraph, and more of them.</p>" * 20_000 + "</article></body></html>"
    assert html_text.extract_many([page], html_text.model())[0].count("\n") == 19_999


def test_licences_of_a_very_long_text():
    text = "plain words " * 200_000 + "All rights reserved. " + "more words " * 200_000 + "cc by"
    n, base, first, last, labels, _, _ = licences.scan(text.encode(), licences.automaton())
    assert (n, base, first, last, labels) == (800_005, 2, 400_000, 800_003, "cc-by,reserved")


def test_html_text_without_a_block_stays():
    got = html_text.extract_many(["plain <b>text</b>", "<html><head><title>t</title>plain text", "<!-- x -->"], html_text.model())
    assert got == ["plain text", "plain text", ""]


def test_html_edge_cases(spark):
    d = spark.createDataFrame([(1, None, None, "t"), (1, "u", "", "t"), (None, "u", "<article><p>Some words here, and more of them.</p></article>", "t")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["n_chars"] == len(r["text"])) for r in html_text.extract(d).collect())
    assert got == [(0, True), (1, True), (1, True)] and html_text.extract(d.limit(0)).collect() == []


def test_boosted_trees_learn_an_interaction():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted(x[:3000], y[:3000])
    assert ((m.logits(x[3000:]) > 0) == y[3000:]).mean() > 0.95


# ---- pipeline


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id").collect()}
    from tests.llm.test_decontaminate import plain
    from tests.llm.test_simhash import plain_components, plain_fingerprint

    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))]
    last = {}
    for i, t in rows:
        last[t] = max(i, last.get(t, -1))
    rows = sorted((i, t) for t, i in last.items())
    part = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    rows = [(i, t) for i, t in rows if part[i] == i]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    assert got == {x[0] for x in plain(rows, items) if not x[-1]}


def test_scratch_is_released(spark):
    import os

    from lodestone.llm import common

    held = common._made[:]
    common._made.clear()
    common.store(spark.range(3), "x")
    path = common._made[0].removeprefix("file:")
    assert os.path.exists(path)
    common.release(spark)
    assert not os.path.exists(path) and not common._made
    common._made.extend(held)


def test_entry_lists_all(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    json.dumps(e.oracle_sql())


@pytest.mark.parametrize("name", ["op2_decontaminate", "op4_url_filter", "op8_exact_dedup"])
def test_sql(spark, name):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = c.sql(e.oracle_sql()[name]).df()
    got = e.queries()[name](spark, d).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(repr, got[cols].astype(object).values.tolist())) == sorted(map(repr, want[cols].astype(object).values.tolist()))
