"""Hand-made graphs with values worked out by hand, and random ones against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, lexicon, merge, modules, retrieve, risk, rules, validate, vectors


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def classes(spark, rows):
    """rows: (fqn, label, module, risk, complexity)"""
    return spark.createDataFrame(
        [(f, f.split(".")[-1], ".".join(f.split(".")[:-1]), m, [x] if x else [], r, c, False, []) for f, x, m, r, c in rows],
        "fqn string, simple_name string, package_name string, module string, labels array<string>, enhanced_risk double, complexity_sum int, has_db_writes boolean, annotations array<string>",
    )


def plain_bfs(pairs, starts, most=10):
    hop, frontier = {}, set(starts)
    for k in range(1, most + 1):
        frontier = {b for a, b in pairs if a in frontier} - hop.keys()
        hop |= dict.fromkeys(frontier, k)
    return hop


@pytest.mark.parametrize("seed", [1, 2])
def test_bfs_against_plain_loops(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(45)]
    starts = spark.createDataFrame([("n0",), ("n1",)], "node string")
    assert {x["node"]: x["hop"] for x in graph.bfs(edges(spark, pairs), starts).collect()} == plain_bfs(pairs, {"n0", "n1"})


def test_cone(spark):
    e = edges(spark, [("Service", "Base"), ("Service", "Repo"), ("Repo", "Service")])
    assert {r["node"]: r["hop"] for r in graph.dependency_cone(e, "Service").collect()} == {"Base": 1, "Repo": 1, "Service": 2}
    assert graph.dependency_cone(e, "Isolated").count() == 0
    hops = graph.cone_with_hops(edges(spark, [("a", "b")]), spark.createDataFrame([("a",)], "node string"))
    assert {r["node"]: r["hop"] for r in hops.collect()} == {"a": 0, "b": 1}


def test_depth_is_capped_at_ten(spark):
    chain = edges(spark, [(f"c{i}", f"c{i + 1}") for i in range(15)])
    assert graph.inheritance_chain(chain, "c0").agg(F.max("depth")).first()[0] == 10
    assert graph.ancestors(chain).where("node = 'c0'").count() == 10 and graph.inheritance_chain(chain, "unknown").count() == 0


def test_waves_with_a_cycle(spark):
    mods = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "module string")
    got = lambda pairs: {r["module"]: r["wave"] for r in graph.waves(mods, edges(spark, pairs)).collect()}
    assert got([("beta", "alpha"), ("gamma", "beta"), ("beta", "beta"), ("beta", "unknown")]) == {"alpha": 1, "beta": 2, "gamma": 3}
    assert got([("beta", "alpha"), ("alpha", "beta")]) == {"gamma": 1, "alpha": 2, "beta": 2}
    assert graph.waves(mods.limit(0), edges(spark, [])).count() == 0


def test_service_dependents_need_the_label(spark):
    c = classes(spark, [("S", "Service", "m", 0.0, 1), ("T", "Service", "m", 0.0, 1), ("R", "Repository", "m", 0.0, 1), ("X", None, "m", 0.0, 1)])
    e = edges(spark, [("S", "X"), ("X", "R"), ("T", "X")])
    assert sorted(map(tuple, graph.service_dependents(e, c, "R").collect())) == [("S", 2), ("T", 2)]
    assert graph.service_dependents(e, c, "X").count() == 0
    assert [r["fqn"] for r in graph.without_path(edges(spark, [("S", "R")]), c).collect()] == ["T"]


def test_scores(spark):
    c = classes(spark, [("p.PaymentService", "Service", "m", 0.0, 10), ("p.Plain", None, "m", 0.0, 0)])
    dep = edges(spark, [("p.Plain", "p.PaymentService"), ("p.Plain", "p.PaymentService")])
    terms = spark.createDataFrame([("payment", "Payment", "High"), ("thing", "Thing", "Low")], "term_id string, display_name string, criticality string")
    uses = spark.createDataFrame([("p.PaymentService", "payment"), ("p.Plain", "thing")], "fqn string, term_id string")
    rule = spark.createDataFrame([("p.Plain", x) for x in "abc"], "fqn string, term_id string")
    got = {r["fqn"]: r for r in risk.scores(c, dep, uses, terms, rule).collect()}
    a, b = got["p.PaymentService"], got["p.Plain"]
    import math

    assert (a["fan_in"], a["fan_out"], b["fan_out"]) == (2, 0, 2)
    assert a["domain_criticality"] == 1.0 and b["domain_criticality"] == 0.0
    assert a["financial_involvement"] == pytest.approx(0.5) and b["financial_involvement"] == 0.0
    assert b["business_rule_density"] == pytest.approx(math.log(4))
    assert a["structural_risk"] == pytest.approx(0.4 * math.log(11) + 0.2 * math.log(3))
    assert a["enhanced_risk"] == pytest.approx(0.24 * math.log(11) + 0.12 * math.log(3) + 0.1 + 0.05)


def test_security_is_capped(spark):
    c = classes(spark, [("x.security.AuthToken", None, "m", 0.0, 1)]).withColumn("annotations", F.array(F.lit("Secured")))
    assert risk.security_sensitivity(c).first()["security_sensitivity"] == 1.0


def test_schedule_parts_add_up(spark):
    rows = [(f"a.{m}.C{i}", None, m, r, c) for m, v in {"alpha": [(0.1, 2), (0.2, 3)], "beta": [(0.5, 10), (0.6, 15)], "gamma": [(0.2, 3)]}.items() for i, (r, c) in enumerate(v)]
    c = classes(spark, rows)
    dep = edges(spark, [("a.beta.C0", "a.alpha.C0"), ("a.gamma.C0", "a.alpha.C0")])
    commits = spark.createDataFrame([("beta", 4)], "module string, commits long")
    got = {r["module"]: r for r in modules.recommend_schedule(c, dep, commits).collect()}
    assert {m: r["wave"] for m, r in got.items()} == {"alpha": 1, "beta": 2, "gamma": 2}
    for r in got.values():
        assert r["score"] == pytest.approx(r["risk_part"] + r["dependents_part"] + r["commits_part"] + r["complexity_part"])
    assert got["alpha"]["dependents"] == 2 and got["beta"]["commits_part"] == pytest.approx(0.2)
    assert modules.recommend_schedule(c.limit(0), dep, commits).count() == 0


def test_module_summary_and_pilot(spark):
    c = classes(spark, [(f"p.C{i}", "VaadinView" if i < 3 else None, "pilot", i / 10, 1) for i in range(16)])
    s = modules.module_summary(c).first()
    assert (s["class_count"], s["legacy_count"], s["high_risk_count"]) == (16, 3, 8) and s["heat"] == pytest.approx(3 / 16 * s["avg_risk"])
    p = modules.pilot_recommend(c).first()
    assert p["score"] == pytest.approx(0.4 * 3 / 16 + 0.3 * p["risk_diversity"] + 0.3) and "ideal size" in p["rationale"]
    uses = spark.createDataFrame([("p.C1", "x")], "fqn string, term_id string")
    checks = {r["check"]: r["status"] for r in modules.pilot_validate(c, uses, spark.createDataFrame([], "module string"), "pilot").collect()}
    assert checks == {"class_count": "PASS", "legacy_classes": "PASS", "vector_chunks": "WARN", "business_terms": "PASS", "risk_scores": "WARN"}
    assert "READY" in modules.pilot_report(modules.pilot_validate(c, uses, spark.createDataFrame([], "module string"), "pilot"), "pilot").first()[0]


def test_transitive_migrations(spark):
    c = classes(spark, [("a.Old", None, "m", 0.0, 1), ("a.My", None, "m", 0.0, 1), ("a.Special", "VaadinComponent", "m", 0.0, 1), ("a.Pure", None, "m", 0.0, 1)])
    ext = edges(spark, [("a.My", "a.Old"), ("a.Special", "a.My"), ("a.Pure", "a.Old")])
    methods = spark.createDataFrame([("a.Old", "init"), ("a.Old", "set"), ("a.My", "init"), ("a.My", "own")], "fqn string, name string")
    calls = edges(spark, [("a.Special", "com.vaadin.ui.Button")])
    none = spark.createDataFrame([], "fqn string, source string")
    rule = spark.createDataFrame([("a.Old",)], "source string")
    got = {r["fqn"]: r for r in rules.transitive_migrations(c, ext, none, rule, methods, calls, "com.vaadin.", "com.vaadin.flow.").collect()}
    assert got["a.My"]["complexity"] == pytest.approx(0.3) and got["a.My"]["automatable"] == "PARTIAL"
    assert got["a.Special"]["complexity"] == pytest.approx(0.5) and got["a.Special"]["automatable"] == "NO"
    assert got["a.Pure"]["pure_wrapper"] and got["a.Pure"]["automatable"] == "PARTIAL" and got["a.My"]["action_id"] == "a.My#INHERITED#a.Old"
    done = spark.createDataFrame([(x["fqn"], "a.Old") for x in got.values()], "fqn string, source string")
    assert rules.transitive_migrations(c, ext, done, rule, methods, calls, "com.vaadin.", "com.vaadin.flow.").count() == 0


def test_imports_are_not_shuffled_by_common_names(spark):
    i = spark.createDataFrame([(f"c{k}", f"com.vaadin.ui.T{k % 2}") for k in range(50)], "fqn string, import_name string")
    r = spark.createDataFrame([("com.vaadin.ui.T0", "new.T0", "CHANGE_TYPE", "YES", "MAPPED", "TYPE", 0)], "source string, target string, action_type string, automatable string, status string, category string, pos int")
    df = rules.classify_imports(i, r, "com.vaadin.", "com.vaadin.flow.")
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((x["import_name"], x["target"]) for x in df.collect()) == [("com.vaadin.ui.T0", "new.T0")] * 25 + [("com.vaadin.ui.T1", "Unknown")] * 25


def test_classify_imports_in_order(spark):
    r = spark.createDataFrame(
        [("javax.a.B", "X", "t.B", "CHANGE_TYPE", "PARTIAL", "MAPPED", 0), ("javax.", "PACKAGE", "jakarta.", "CHANGE_PACKAGE", "YES", "MAPPED", 1), ("com.vaadin.N", "X", "t", "CHANGE_TYPE", "YES", "NEEDS_MAPPING", 2)],
        "source string, category string, target string, action_type string, automatable string, status string, pos int",
    )
    i = spark.createDataFrame([("f", x) for x in ("javax.a.B", "javax.a.C", "com.vaadin.N", "com.vaadin.flow.X", "java.util.List", "com.wrap.Y")], "fqn string, import_name string")
    got = {x["import_name"]: (x["action_type"], x["target"], x["automatable"]) for x in rules.classify_imports(i, r, "com.vaadin.", "com.vaadin.flow.", "com.wrap.").collect()}
    assert got == {
        "javax.a.B": ("CHANGE_TYPE", "t.B", "PARTIAL"), "javax.a.C": ("CHANGE_PACKAGE", "jakarta.a.C", "YES"),
        "com.vaadin.N": ("COMPLEX_REWRITE", "Unknown", "NO"), "com.wrap.Y": ("COMPLEX_REWRITE", "Unknown", "NO"),
    }


def test_rule_book_operations(spark):
    book = lambda rows: spark.createDataFrame(rows, "source string, pos int, target string")
    got = {r["source"]: (r["target"], r["book"], r["is_base"]) for r in rules.overlay(book([("a", 0, "1"), ("b", 1, "1")]), book([("b", 0, "2"), ("c", 1, "2")]), book([("c", 0, "3")])).collect()}
    assert got == {"a": ("1", 0, True), "b": ("2", 0, False), "c": ("3", 1, False)}
    base = book([("a", 0, "1"), ("b", 1, "1")]).withColumn("is_base", F.col("source") == "a")
    assert {r["source"] for r in rules.delete_rule(base, "a").collect()} == {"a", "b"} and {r["source"] for r in rules.delete_rule(base, "b").collect()} == {"a"}


def test_rewrite(spark):
    src = spark.createDataFrame([("A.java", "import com.old.Button;\nclass A { Button b; MyButton c; }\n")], "path string, content string")
    ren = spark.createDataFrame([("A.java", "com.old.Button", "new.Knob")], "path string, old string, new string")
    r = rules.rewrite(src, ren).first()
    assert r["after"] == "import new.Knob;\nclass A { Knob b; MyButton c; }\n" and "+import new.Knob;" in r["diff"]


def test_lexicon(spark):
    c = classes(spark, [("p.XMLPaymentService", None, "m", 0.0, 1), ("p.InvoicePayment", None, "m", 0.0, 1)])
    t = {r["term_id"]: r for r in lexicon.accumulate_terms(lexicon.extract_terms(c)).collect()}
    assert set(t) == {"xml", "payment", "invoice"} and t["payment"]["usage_count"] == 2 and t["payment"]["criticality"] == "High" and t["xml"]["sensitivity"] == "None"
    a = {r["abbreviation"] for r in lexicon.abbreviations(spark.createDataFrame([("SCList",), ("HtmlDTO",), ("FooBPEntry",), ("XMLThing",)], "simple_name string")).collect()}
    assert a == {"SC", "BP"}
    e = c.withColumn("constants", F.array(F.lit("OPEN_ORDER"), F.lit("ACTIVE")))
    assert {"open", "order"} <= {r["term_id"] for r in lexicon.extract_terms(e).collect()} and "active" not in {r["term_id"] for r in lexicon.extract_terms(e).collect()}


def test_sections_match_by_two_words_and_the_first_wins(spark):
    t = spark.createDataFrame([("t", "order management system"), ("u", "order alone")], "term_id string, text string")
    s = spark.createDataFrame([(1, "d", "", "order only here"), (2, "d", "h", "management of order data"), (3, "d", "h", "order management again")], "section_id long, source string, heading string, body string")
    assert [(r["term_id"], r["section_id"], r["score"]) for r in lexicon.enrich_from_sections(t, s).collect()] == [("t", 2, 2)]


def test_vectors(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [1.0, 1.0], "b"), (4, [0.0, 0.0], "b")], "vec_id long, vector array<double>, module string")
    q = spark.createDataFrame([([1.0, 0.0],)], "vector array<double>")
    assert [(r["vec_id"], r["score"]) for r in vectors.top_k(p, q, 2).collect()] == [(1, 1.0), (3, 0.707107)]
    assert [r["vec_id"] for r in vectors.top_k(p, q, 5, module="a").collect()] == [1, 2]
    d = vectors.embed(spark.createDataFrame([("a b b",), ("",)], "text string"), size=16).collect()
    assert sum(x * x for x in d[0]["vector"]) == pytest.approx(1.0) and set(d[1]["vector"]) == {0.0}


def test_every_query_vector_gets_its_own_best(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "POINT_BLOCK", 7)
    r = random.Random(3)
    p = spark.createDataFrame([(i, [float(r.randint(-3, 3)) for _ in range(3)]) for i in range(200)] + [(200, [0.0] * 3), (201, None)], "vec_id long, vector array<double>")
    q = p.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    got = vectors.top_k(p, q, 6).collect()
    assert len(got) == 11 * 6
    for i, v in map(tuple, q.collect()):
        want = vectors.top_k(p, spark.createDataFrame([(v,)], "vector array<double>"), 6).select("vec_id", "score").collect()
        assert sorted(map(str, want)) == sorted(str(x) for x in map(lambda x: type(want[0])(**{"vec_id": x["vec_id"], "score": x["score"]}), (x for x in got if x["query_id"] == i)))
    with pytest.raises(Exception, match="several query vectors"):
        vectors.top_k(p, q.drop("query_id")).collect()


def test_uuid5_is_the_standards(spark):
    import uuid

    from lodestone.functions.text import uuid5

    names = ["com.acme.A#CLASS_HEADER", "x", "ä#run(int)"]
    got = spark.createDataFrame([(x,) for x in names], "n string").select(uuid5(F.col("n")).alias("u")).collect()
    assert [r["u"] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, x)) for x in names]


def test_token_budget_drops_the_tail(spark):
    d = spark.createDataFrame([(1, 50), (2, 30), (3, 40)], "rank int, tokens long")
    kept = lambda budget, **k: sorted(r["rank"] for r in retrieve.token_budget(d, budget=budget, **k).collect())
    assert kept(120) == [1, 2, 3] and kept(119) == [1, 2] and kept(80) == [1, 2] and kept(79) == [1] and kept(10) == [] and kept(100, others=50) == [1]


def test_token_budget_is_dealt_by_ranges(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("rank"), (F.col("id") % 5).alias("tokens"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    got = retrieve.token_budget(d, budget=1500).select("rank", "tokens", F.spark_partition_id().alias("p")).collect()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    left, want = 0, []
    for rank, tokens in sorted(map(tuple, d.select("rank", "tokens").collect())):
        left += tokens
        want += [(rank, tokens)] if left <= 1500 else []
    assert sorted((r["rank"], r["tokens"]) for r in got) == want and len({r["p"] for r in got}) > 1


def test_whole_tables_enter(spark, tmp_path):
    from lodestone.queries import queries

    spark.range(300).select(F.col("id").alias("doc_id"), F.lit(40).cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(300).select(F.col("id").alias("p_partkey"), F.concat(F.lit("t"), F.col("id")).alias("p_type")).write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(r["doc_id"] for r in queries()["token_budget_all"](spark, str(tmp_path)).collect()) == list(range(270))
    assert max(int(r["target"][1:]) for r in queries()["rule_overlay_all"](spark, str(tmp_path)).collect()) == 299


def test_waves_keep_every_link(spark, tmp_path):
    from lodestone.queries import queries

    pairs = [(0, 1), (1, 2), (2, 3), (9, 4), (4, 9), (5, 9)]
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("nation", [(i,) for i in (0, 1, 2, 3, 4, 5, 9)], "n_nationkey int")
    put("customer", [(i, s) for i, (s, _) in enumerate(pairs)], "c_custkey long, c_nationkey int")
    put("orders", [(i, i) for i in range(len(pairs))], "o_orderkey long, o_custkey long")
    put("supplier", [(i, t) for i, (_, t) in enumerate(pairs)], "s_suppkey long, s_nationkey int")
    put("lineitem", [(i, i) for i in range(len(pairs))], "l_orderkey long, l_suppkey long")
    got = {r["module"]: r["wave"] for r in queries()["waves_all"](spark, str(tmp_path)).collect()}
    assert got == {"3": 1, "2": 2, "1": 3, "0": 4, "4": 5, "9": 5, "5": 5}


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, x string, y int")
    once = merge.merge(old, new, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)] == sorted(map(tuple, merge.merge(once, new, "k").collect()))
    t = spark.createDataFrame([("t", "High", 1, True), ("u", "Low", 1, False)], "term_id string, criticality string, usage_count int, curated boolean")
    n = spark.createDataFrame([("t", "Low", 5, False), ("u", "High", 6, False), ("v", "Low", 7, False)], "term_id string, criticality string, usage_count int, curated boolean")
    assert sorted(map(tuple, merge.curated_merge(t, n).collect())) == [("t", "High", 5, True), ("u", "High", 6, False), ("v", "Low", 7, False)]


def test_snapshots_never_overwrite_what_is_read(spark, tmp_path):
    s = merge.Snapshots(spark, str(tmp_path / "t"))
    assert s.read() is None
    s.write(spark.range(3))
    s.write(s.read().unionByName(spark.range(10, 12)))
    s.write(s.read().where("id > 1"))
    assert sorted(r["id"] for r in s.read().collect()) == [2, 10, 11] and s.versions() == [2, 3]


def test_validation_statuses(spark):
    c = classes(spark, [("p.A", "Service", "m", 0.5, 1), ("p.B", None, "m", 0.5, 1)])
    for column, kind in (("structural_risk", "double"), ("domain_criticality", "double"), ("security_sensitivity", "double"), ("financial_involvement", "double"), ("automation_score", "double"), ("super_class", "string"), ("source_path", "string"), ("content_hash", "string")):
        c = c.withColumn(column, F.lit(None).cast(kind))
    c = c.withColumn("fan_in", F.lit(1)).withColumn("fan_out", F.lit(1)).withColumn("action_count", F.lit(0).cast("long")).withColumn("interfaces", F.array().cast("array<string>"))
    e = spark.createDataFrame([("class", "p.A", "CALLS", "class", "p.B"), ("class", "p.A", "QUERIES", "class", "p.B")], "src_kind string, src string, type string, dst_kind string, dst string")
    none = lambda s: spark.createDataFrame([], s)
    g = validate.Graph(c, e, none("method_id string"), none("field_id string"), none("annotation string"), none("package_name string"), none("module string"), none("table_name string"), none("term_id string"), none("fqn string, source string, automatable string, action_type string, is_inherited boolean"))
    got = {r["name"]: (r["status"], r["count"]) for r in validate.report(g).collect()}
    assert len(got) == 50
    assert got["CALLS_EDGE_COVERAGE"] == ("PASS", 1) and got["QUERIES_EDGE_INTEGRITY"] == ("FAIL", 1) and got["SERVICE_HAS_DEPENDENCIES"] == ("WARN", 1)
    assert got["RISK_SCORES_POPULATED"] == ("FAIL", 2) and got["PILOT_MODULE_CLASS_COUNT"] == ("PASS", 0) and got["MIGRATION_ACTIONS_POPULATED"] == ("WARN", 1)


def test_parents_from_text(spark):
    s = spark.createDataFrame([("p.A", "package p; import q.Base; class A extends Base {}"), ("p.B", "class B extends Near {}"), ("p.C", "class C {}"), ("p.D", "class D extends x.Y {}")], "fqn string, content string")
    c = spark.createDataFrame([("p.A", None), ("p.B", "<unknown>"), ("p.C", None), ("p.D", "known.Z"), ("p.Near", None)], "fqn string, super_class string")
    assert sorted(map(tuple, graph.resolve_parents(s, c).collect())) == [("p.A", "q.Base", True), ("p.B", "p.Near", False)]
