"""Readers, the source parser and the change stream on small files."""

import json
import subprocess

import pytest

from lodestone.sources import files, java
from lodestone.streaming import incremental

SOURCE = '''package com.acme.shop;

import com.vaadin.ui.CustomComponent;
import com.acme.data.OrderRepository;
import javax.persistence.Entity;

/** A view; class Fake { } */
@Service
public class OrderPanel extends CustomComponent implements Runnable {
    @Autowired private OrderRepository orders;
    private final String name = "if (x) { }";

    public OrderPanel(OrderRepository orders) { this.orders = orders; }

    public int run(int a, String b) {
        // if (never) { }
        if (a > 1 && b != null) { return 1; } else if (a < 0) { return 2; }
        for (int i = 0; i < a; i++) { help(i); }
        switch (a) { case 1: return 3; case 2: return 4; default: return 5; }
    }

    void help(int i) { try { orders.save(i); } catch (Exception e) { log(); } int y = i > 0 ? 1 : 2; }

    enum Kind { OPEN_ORDER, CLOSED; }
}
'''


def test_parser():
    rows = java.parse("OrderPanel.java", SOURCE)
    of = lambda k: [r for r in rows if r[0] == k]
    assert {r[1] for r in of("class")} == {"com.acme.shop.OrderPanel", "com.acme.shop.OrderPanel.Kind"}
    panel = next(r for r in of("class") if r[3] == "OrderPanel")
    assert panel[4] == "com.vaadin.ui.CustomComponent" and panel[5] == ["class", "Service", "VaadinComponent"]
    m = {r[3]: (r[1], r[6], r[5][0]) for r in of("method")}
    assert m["run"] == ("com.acme.shop.OrderPanel#run(int,String)", 6, "0") and m["help"] == ("com.acme.shop.OrderPanel#help(int)", 3, "1")
    assert {(r[3], r[4]) for r in of("depends")} == {("com.acme.data.OrderRepository", "FIELD"), ("com.acme.data.OrderRepository", "CONSTRUCTOR")}
    assert [r[3] for r in of("constant")] == ["OPEN_ORDER", "CLOSED"] and "com.vaadin.ui.CustomComponent" in {r[3] for r in of("import")}
    assert java.parse("x", "") == [] and java.method_body(SOURCE, "help").startswith("void help(int i)")


def test_extraction_to_tables(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "OrderPanel.java").write_text(SOURCE)
    (tmp_path / "a" / "Order.java").write_text('package com.acme.data;\n@Entity @Table(name = "T_ORDER")\nclass Order { }\n')
    (tmp_path / "a" / "OrderRepository.java").write_text("package com.acme.data;\n@Repository\ninterface OrderRepository { Order findByName(String n); void save(int i); }\n")
    g = java.graph(java.extract(files.whole_files(spark, str(tmp_path))))
    assert {r["fqn"]: r["labels"] for r in g["classes"].collect()}["com.acme.data.OrderRepository"] == ["Repository"]
    assert {tuple(r) for r in g["depends"].collect()} == {("com.acme.shop.OrderPanel", "com.acme.data.OrderRepository", k) for k in ("FIELD", "CONSTRUCTOR")}
    assert ("com.acme.shop.OrderPanel#help(int)", "com.acme.data.OrderRepository#save(int)") in {tuple(r) for r in g["calls"].collect()}
    assert {tuple(r) for r in g["tables"].collect()} == {("com.acme.data.Order", "t_order")}
    assert [r["method_id"] for r in g["queries"].collect()] == ["com.acme.data.OrderRepository#findByName(String)"]


def test_text_resources(spark, tmp_path):
    entry = lambda k, e, g="x": f'<NLSResource key="{k}"><NLSMapping language="en" value="{e}"/><NLSMapping language="de" value="{g}"/></NLSResource>'
    (tmp_path / "A.xml").write_text(f"<r>{entry('lblName', 'Name', 'Name')}{entry('msgBad', 'xxx')}{entry('btnOk', 'ok')}{entry('Error1', 'first')}</r>")
    (tmp_path / "Order.xml").write_text(f"<r>{entry('Error1', 'second one')}</r>")
    got = {r["key"]: (r["english"], r["category"], r["ui_role"], r["domain_area"]) for r in files.text_resources(spark, str(tmp_path), {"Order": "ORDERS"}).collect()}
    assert got == {"lblName": ("Name", "NLS_LABEL", "LABEL", "OTHER"), "Error1": ("second one", "NLS_OTHER", "ERROR", "ORDERS")}


def test_documents_and_sections(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"source": "manual", "sections": [{"heading": "Intro", "body": "orders invoices payments contracts"}, {"heading": "x", "body": "too few"}]}))
    assert [r["heading"] for r in files.document_sections(spark, str(tmp_path)).collect()] == ["Intro"]
    lines = ["before", "1. First Part", "text a", "text b", "SECOND PART", "more"]
    d = spark.createDataFrame([("doc", i, x) for i, x in enumerate(lines)], "doc string, pos int, line string")
    assert [(r["heading"], r["body"]) for r in files.split_sections(d).orderBy("section").collect()] == [(None, "before"), ("1. First Part", "text a\ntext b"), ("SECOND PART", "more")]


def test_rule_book_round_trip(spark, tmp_path):
    rule = {"id": "R1", "category": "X", "source": "a.B", "target": "c.D", "actionType": "CHANGE_TYPE", "automatable": "YES", "status": "MAPPED", "usageCount": 3}
    (tmp_path / "book.json").write_text(json.dumps({"rules": [rule, rule | {"id": "R2", "source": "a.C"}]}))
    book = files.rule_book(spark, str(tmp_path / "book.json"))
    assert [(r["rule_id"], r["source"], r["action_type"], r["usage_count"], r["pos"]) for r in book.orderBy("pos").collect()] == [("R1", "a.B", "CHANGE_TYPE", 3, 0), ("R2", "a.C", "CHANGE_TYPE", 3, 1)]
    files.write_rule_book(book, str(tmp_path / "new"))
    again = spark.read.json(str(tmp_path / "new")).selectExpr("inline(rules)")
    assert sorted(r["source"] for r in again.collect()) == ["a.B", "a.C"]


def test_build_files(spark):
    f = spark.createDataFrame(
        [("/r/settings.gradle", "include 'core', ':web'"), ("/r/web/build.gradle", "implementation project(':core')"),
         ("/r/pom.xml", "<project><groupId>g.x</groupId><modules><module>m1</module></modules><dependencies><dependency><groupId>g.x</groupId><artifactId>m2</artifactId></dependency><dependency><groupId>other</groupId><artifactId>no</artifactId></dependency></dependencies></project>")],
        "path string, content string",
    )
    assert sorted((r["kind"], r["value"]) for r in files.build_modules(f).collect()) == [("dependency", "core"), ("dependency", "m2"), ("module", "core"), ("module", "m1"), ("module", "web")]


def test_git_log(spark, tmp_path):
    assert files.git_log(spark, str(tmp_path / "none"), 30).count() == 0
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.txt").write_text("x")
    run("add", ".")
    run("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "m")
    assert [r["value"] for r in files.git_log(spark, str(tmp_path), 30).collect()] == ["a.txt"]
    assert files.source_root("/x", None, "/y") == "/x"
    with pytest.raises(ValueError):
        files.source_root(None, None, "/y")


def test_change_stream(spark, tmp_path):
    changes, state = str(tmp_path / "in"), str(tmp_path / "state")
    put = lambda rows: spark.createDataFrame(rows, incremental.SCHEMA).coalesce(1).write.json(changes, mode="append")
    calls = []

    def after(df, epoch):
        calls.append((epoch, df.count()))
        raise ValueError("not fatal")

    put([("a", "1", False, 1), ("b", "1", False, 2), ("a", "2", False, 3)])
    incremental.run_stream(spark, changes, state, after).awaitTermination()
    put([("b", None, True, 4), ("c", "1", False, 5), ("a", "2", False, 6)])
    q = incremental.run_stream(spark, changes, state, after)
    q.awaitTermination()
    from lodestone.operators.merge import Snapshots

    assert sorted((r["path"], r["content"]) for r in Snapshots(spark, f"{state}/files").read().collect()) == [("a", "2"), ("c", "1")]
    assert calls == [(0, 2), (1, 2)] and spark.read.json(f"{state}/failures").count() == 2
    assert incremental.progress(q)["batch"] == 1


CHUNKED = """package com.acme;

/** Not this one. */
import x.Y;

/** Keeps
 * orders. */
@Service
public class Orders {
  private int size;
  // no; field
  private String name = call();

  public int run(int a) {
    if (a > 1) { return 1; }
    return a;
  }
}
"""


def test_chunk_texts(spark):
    from lodestone.sources import java

    assert java.header_text("Orders", "com.acme", CHUNKED) == "[CLASS: Orders] [PACKAGE: com.acme]\n/** Keeps\n * orders. */\nprivate int size;\n  private String name = call();"
    assert java.header_text("X", "p", "nothing declared") == "[CLASS: X] [PACKAGE: p]" and java.header_text("X", "p", "a class X") == "[CLASS: X] [PACKAGE: p]"
    assert java.method_text("Orders", "run(int)", CHUNKED) == "[CLASS: Orders] [METHOD: run(int)]\n{\n    if (a > 1) { return 1; }\n    return a;\n  }"
    assert java.method_text("Orders", "gone()", CHUNKED).endswith("[source not found]")
    c = spark.createDataFrame([("a.X", "X", "a", "x.java"), ("a.NoPath", "NoPath", "a", None), ("a.Ghost", "Ghost", "a", "ghost.java"), ("a.Bare", "Bare", "a", "b.java")], "fqn string, simple_name string, package_name string, source_path string")
    m = spark.createDataFrame([("a.X", "a.X#run(int)"), ("a.X", "a.X#run(int)"), ("a.Ghost", "a.Ghost#g()")], "fqn string, method_id string")
    f = spark.createDataFrame([("x.java", CHUNKED), ("b.java", ""), ("null.java", None)], "path string, content string")
    got = sorted(((r["fqn"], r["method_id"]) for r in java.chunk_texts(c, m, f).collect()), key=repr)
    assert got == [("a.Bare", None), ("a.X", "a.X#run(int)"), ("a.X", None)]


def test_points_carry_their_payload(spark):
    from lodestone.operators import vectors
    from lodestone.sources import java

    c = spark.createDataFrame([("a.View", "View", "com.acme.shop.ui", None, ["VaadinView", "Service"], "x.java", "h"), ("a.Plain", "Plain", "a", "own", [], "x.java", "h"), ("a.None", "None", "a", "own", [], None, "h")],
        "fqn string, simple_name string, package_name string, module string, labels array<string>, source_path string, content_hash string")
    two = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    m = spark.createDataFrame([("a.View", "a.View#run(int)")], "fqn string, method_id string")
    uses = spark.createDataFrame([("a.View", "t1")], "fqn string, term_id string")
    terms = spark.createDataFrame([("t1", "Order")], "term_id string, display_name string")
    scores = spark.createDataFrame([("a.View", 1.5, 2.5, 0.8, 0.6, 0.4, 0.3)], "fqn string, " + ", ".join(f"{x} double" for x in vectors.SCORES))
    texts = java.chunk_texts(c, m, spark.createDataFrame([("x.java", CHUNKED)], "path string, content string"))
    rows = vectors.points(c, m, two([("a.Plain", "a.View")]), uses, two([("a.View", "a.Target")]), terms, two([("a.View", "a.IFoo")]), scores, texts).collect()
    by = {(r["fqn"], r["chunk_type"]): r for r in rows}
    assert sorted(by) == [("a.Plain", "CLASS_HEADER"), ("a.View", "CLASS_HEADER"), ("a.View", "METHOD")] and len(rows) == 3
    v = by["a.View", "METHOD"]
    assert [v[x] for x in vectors.SCORES] == [1.5, 2.5, 0.8, 0.6, 0.4, 0.3] and v["legacy"] and v["legacy_labels"] == ["VaadinView"]
    assert (v["callers"], v["implementors"], v["callees"], v["module"]) == (["a.Plain"], ["a.IFoo"], ["a.Target"], "ui")
    assert v["domain_terms"] == '[{"termId":"t1","displayName":"Order"}]' and v["header_id"] == by["a.View", "CLASS_HEADER"]["point_id"] and v["text"].startswith("[CLASS: View] [METHOD: run(int)]")
    p = by["a.Plain", "CLASS_HEADER"]
    assert (p["enhanced_risk"], p["legacy"], p["domain_terms"], p["module"], p["dependencies"]) == (0.0, False, "[]", "own", ["a.View"])


def test_context_tells_what_failed_and_is_cut(spark):
    from lodestone.operators import retrieve

    one = lambda n, cols="hop int, node string": lambda: spark.createDataFrame([(i, f"node{i:04d}") for i in range(n)], cols)
    chunks = lambda: spark.createDataFrame([(i, "x" * 397) for i in range(1, 9)], "rank int, text string")

    def fails():
        raise RuntimeError("the store is away\nand more")

    c = retrieve.assemble({"cone": one(3), "risk": one(0), "terms": one(0), "rules": fails, "chunks": chunks}, budget=10_000)
    assert c.warnings == [("risk", "nothing found for risk"), ("rules", "the store is away")] and c.completeness == 0.7 and not c.truncated
    assert c.parts.keys() == {"cone", "risk", "terms", "chunks"} and c.parts["chunks"].count() == 8
    c = retrieve.assemble({"cone": one(3), "chunks": chunks}, budget=500)
    kept = sorted(r["rank"] for r in c.parts["chunks"].collect())
    own, cone = len('{"rank":1,"text":"' + "x" * 397 + '"}'), 3 * len('{"hop":0,"node":"node0000"}') + 4
    total, n = (8 * own + 9) // 4 + cone // 4, 8
    while total > 500:
        total, n = total - own // 4, n - 1
    assert kept == list(range(1, n + 1)) and c.truncated and c.truncated_items == 8 - n
    c = retrieve.assemble({"cone": one(120), "chunks": chunks}, budget=100)
    assert c.truncated_items == 8 and c.parts["chunks"].count() == 0 and c.parts["cone"].count() == retrieve.CONE_NODES


def test_changes_are_applied_to_a_copy(spark, tmp_path):
    from lodestone.operators import rules

    files = spark.createDataFrame([("a.java", "import old.T;\nclass A { T t; }\n"), ("b.java", "class B { }\n")], "path string, content string")
    renames = spark.createDataFrame([("a.java", "old.T", "fresh.U"), ("b.java", "old.T", "fresh.U")], "path string, old string, new string")
    got = rules.apply_changes(files, renames, f"{tmp_path}/out").collect()
    assert [r["path"] for r in got] == ["a.java"] and "+import fresh.U;" in got[0]["diff"]
    assert [r["content"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["import fresh.U;\nclass A { U t; }\n"]
    a = spark.createDataFrame([("1", "s", "YES"), ("2", "s", "NO"), ("3", "a", "PARTIAL")], "action_id string, source string, automatable string")
    assert [r["action_id"] for r in rules.by_automatability(a).collect()] == ["2", "3", "1"]


def test_link_words_and_percent(spark):
    from pyspark.sql import functions as F

    from lodestone.functions import text as tx

    d = spark.createDataFrame([("XMLPriceCalculatorDTO", 0.125), ("Go4It", 1.0)], "name string, share double")
    got = d.select(tx.link_words(F.col("name")), tx.camel_words(F.col("name")), tx.percent(F.col("share"))).collect()
    assert [tuple(r) for r in got] == [(["xml", "price", "dto"], ["XML", "Price", "Calculator", "DTO"], "12.5%"), (["go4it"], ["Go4", "It"], "100.0%")]


def test_sources_are_dealt_to_many_tasks(spark):
    from lodestone.sources import java

    files = spark.createDataFrame([(f"f{i}", f"class C{i} {{ void m() {{ if (a) {{ }} }} }}") for i in range(40)], "path string, content string").coalesce(1)
    rows = java.extract(files)
    assert rows.rdd.getNumPartitions() >= 4
    assert sorted(r["number"] for r in rows.where("kind = 'method'").collect()) == [2] * 40
