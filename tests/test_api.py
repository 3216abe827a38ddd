"""The engine object over the derived graph of the smallest tables."""

import pytest
from pyspark.sql import functions as F

from lodestone import api
from lodestone import queries as q
from lodestone.plans import adapters as a

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    c = a.classes(spark, D)
    return api.Engine(
        spark, c, a.depends_on(spark, D), a.extends(spark, D), q._methods(spark, D), c.select(F.col("fqn").alias("declaring_class"), F.concat("fqn", F.lit("#x")).alias("field_id")),
        a.class_words(spark, D), a.defines_rule(spark, D), a.terms(spark, D), a.actions(spark, D), q._points(spark, D), q._rules(spark).withColumn("is_base", F.col("pos") < 3), q._brand_commits(spark, D),
    )


def test_questions(spark, engine):
    fqn = engine.classes.where("id = 17").first()["fqn"]
    v = engine.points.where("vec_id = 0").select("vector")
    assert engine.class_structure(fqn).count() == 1 and engine.dependency_cone(fqn).count() > 1 and engine.search("token").count() > 0
    with pytest.raises(api.NotFound):
        engine.dependency_cone("no.Such")
    assert engine.risk_heatmap(limit=3).count() == 3 and engine.risk_detail(fqn).count() == 1
    assert engine.glossary()["totals"].first()["total"] > 0 and engine.term("token").count() == 1
    assert engine.curate_term("token", "Low").terms.where("term_id = 'token'").first()["criticality"] == "Low"
    assert engine.describe_class(fqn, "by hand").classes.where("curated_description = 'by hand'").count() == 1
    assert engine.vector_search(v, 5).count() == 5 and engine.index().where("chunk_type = 'CLASS_HEADER'").count() == engine.classes.count()
    assert engine.context(fqn, v, 5).count() <= 5 and engine.context("what is a payment", v, 5).count() <= 5
    name = engine.classes.groupBy("simple_name").count().where("count > 1").first()["simple_name"]
    assert len(engine.context(name, v)) > 1
    assert set(engine.migration_context(fqn, v)) == {"cone", "risk", "chunks", "structure", "inheritance", "terms", "rules"}
    assert engine.schedule().count() == engine.module_summary().count() and engine.pilot_validate("Brand#7").count() == 5
    assert engine.summary("Brand#7").first()["total_classes"] < engine.summary().first()["total_classes"]
    assert engine.gaps().count() == 2 and engine.rules_by(category="PACKAGE").count() == 2


def test_changes(spark, engine):
    with pytest.raises(api.NotFound):
        engine.delete_rule("none")
    with pytest.raises(api.Forbidden):
        engine.delete_rule("com.vaadin.ui.T0")
    assert engine.delete_rule("com.vaadin.ui.T9").book.count() == engine.book.count() - 1
    gone = engine.classes.where("id = 17").select("fqn")
    left = engine.remove(gone)
    assert left.classes.count() == engine.classes.count() - 1 and left.depends.join(gone, F.col("dst") == F.col("fqn")).count() == 0
    src = engine.classes.where("id < 50").select(F.col("source_path").alias("path"), F.lit("import com.vaadin.ui.T4;\nclass A { T4 x; }").alias("content"))
    assert set(engine.preview(src).where("diff <> ''").select("after").distinct().toPandas().after) <= {"import new.T4;\nclass A { T4 x; }"}


def test_whole_context_and_points(spark, engine):
    fqn = engine.classes.where("id = 17").first()["fqn"]
    v = engine.points.where("vec_id = 0").select("vector")
    c = engine.whole_context(fqn, v)
    assert c.parts.keys() == {"structure", "inheritance", "cone", "risk", "terms", "rules", "chunks"} and not c.warnings and c.completeness == 1.0
    small = engine.whole_context(fqn, v, budget=50)
    assert small.truncated and small.truncated_items == c.parts["chunks"].count() and small.parts["chunks"].count() == 0
    gone = engine.whole_context("no.Such", v)
    assert {name for name, _ in gone.warnings} == {"cone", "risk"} and gone.completeness == 0.25
    src = engine.classes.where("id < 20").select(F.col("source_path").alias("path"), F.lit("class A { int x; }").alias("content"))
    points = engine.index_points(src)
    assert points.where("chunk_type = 'CLASS_HEADER'").count() == src.count() and points.where("text is null").count() == 0
    t = engine.curate_term("token", "High", "by hand").terms.where("term_id = 'token'").first()
    assert (t["definition"], t["sensitivity"], t["status"], t["curated"], t["synonyms"]) == ("by hand", "Critical", "curated", True, [])
    assert engine.top_gaps().count() == 2
    engine.release()
