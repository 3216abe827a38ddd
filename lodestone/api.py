"""One object with every question the engine answers, over the tables of a code graph.

Each method returns a DataFrame (a plan) unless it says otherwise. A parameter that is None or blank drops its condition.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import graph, lexicon, merge, modules, retrieve, risk, rules, validate, vectors
from lodestone.plans import scratch
from lodestone.sources import java


class NotFound(KeyError):
    """No such class, term or rule."""


class Forbidden(PermissionError):
    """A base rule can't be deleted."""


@dataclass(frozen=True)
class Engine:
    """classes, depends, extends, methods, fields, uses, defines, terms, actions, points, rule book and commits."""

    spark: SparkSession
    classes: DataFrame
    depends: DataFrame
    extends: DataFrame
    methods: DataFrame
    fields: DataFrame
    uses: DataFrame
    defines: DataFrame
    terms: DataFrame
    actions: DataFrame
    points: DataFrame
    book: DataFrame
    commits: DataFrame
    framework: str = "com.vaadin."
    modern: str = "com.vaadin.flow."
    #: Edges (src, dst) of other kinds that a cone goes along: implements, binds to, maps to a table, declares, calls.
    links: DataFrame | None = None

    @cached_property
    def scored(self) -> DataFrame:
        return risk.scores(self.classes, self.depends, self.uses, self.terms, self.defines)

    @cached_property
    def edges(self) -> DataFrame:
        out = self.depends.select("src", "dst").unionByName(self.extends.select("src", "dst"))
        return out if self.links is None else out.unionByName(self.links.select("src", "dst"))

    def _known(self, fqn: str) -> None:
        if self.classes.where(F.col("fqn") == fqn).limit(1).isEmpty():
            raise NotFound(fqn)

    # graph
    def class_structure(self, fqn: str) -> DataFrame:
        return graph.class_structure(self.classes, fqn, self.methods, self.fields, self.depends)

    def inheritance(self, fqn: str) -> DataFrame:
        return graph.inheritance_chain(self.extends, fqn)

    def dependency_cone(self, fqn: str) -> DataFrame:
        """Raises NotFound for an unknown class; an isolated one has an empty cone."""
        self._known(fqn)
        return graph.dependency_cone(self.edges, fqn)

    def service_dependents(self, repository: str) -> DataFrame:
        return graph.service_dependents(self.depends, self.classes, repository)

    def search(self, name: str) -> DataFrame:
        return graph.search_by_name(self.classes, name)

    def validation(self, tables: validate.Graph) -> DataFrame:
        return validate.report(tables)

    # risk
    def risk_heatmap(self, module: str | None = None, package: str | None = None, stereotype: str | None = None, limit: int = 50, sort_by: str = "enhanced") -> DataFrame:
        return risk.heatmap(self.scored, self.actions, self.framework.rstrip("."), module, package, stereotype, limit, sort_by)

    def risk_detail(self, fqn: str) -> DataFrame:
        return risk.detail(self.scored, self.methods, fqn)

    # lexicon
    def lexicon(self, **filters) -> DataFrame:
        return lexicon.search(self.terms, **filters)

    def glossary(self) -> dict[str, DataFrame]:
        nls = self.terms.where(F.col("source_type").startswith("NLS_"))
        return {
            "areas": lexicon.glossary_areas(self.terms), "roles": lexicon.role_counts(self.terms), "top": nls.orderBy(F.desc("usage_count"), "term_id").limit(30),
            "abbreviations": self.terms.where("source_type = 'ABBREVIATION'").orderBy("term_id"), "totals": lexicon.totals(self.terms),
        }

    def term(self, term_id: str) -> DataFrame:
        return lexicon.term_detail(self.terms, self.uses, term_id)

    def terms_of(self, fqn: str) -> DataFrame:
        return lexicon.terms_of_class(self.terms, self.uses, fqn)

    def curate_term(self, term_id: str, criticality: str, definition: str | None = None, synonyms: list[str] | None = None) -> Engine:
        """A definition or synonyms that aren't given become empty, as in the service whose questions these are."""
        change = self.spark.createDataFrame([(term_id, criticality, definition, synonyms)], "term_id string, criticality string, definition string, synonyms array<string>")
        return replace(self, terms=lexicon.curate(self.terms, change))

    def ingest_documents(self, sections: DataFrame) -> DataFrame:
        texts = self.terms.select("term_id", F.concat_ws(" ", "display_name", *(["definition"] if "definition" in self.terms.columns else [])).alias("text"))
        return lexicon.enrich_from_sections(texts, sections)

    def describe_class(self, fqn: str, text: str) -> Engine:
        column = F.when(F.col("fqn") == fqn, text).otherwise(F.col("curated_description") if "curated_description" in self.classes.columns else F.lit(None).cast("string"))
        return replace(self, classes=self.classes.withColumn("curated_description", column))

    def class_descriptions(self) -> DataFrame:
        return lexicon.class_descriptions(self.uses, self.terms, self.classes)

    # vectors and retrieval
    def vector_search(self, query: DataFrame, limit: int = 10, **equals) -> DataFrame:
        return vectors.top_k(self.points, query, limit, **equals)

    def index(self) -> DataFrame:
        calls = self.methods.select(F.col("method_id").alias("src"), F.col("method_id").alias("dst")).where("false")
        return vectors.chunk(self.classes, self.methods.select(F.col("declaring_class").alias("fqn"), "method_id"), self.depends, self.uses, calls)

    def index_points(self, sources: DataFrame, calls: DataFrame | None = None, implements: DataFrame | None = None) -> DataFrame:
        """The points of an index with texts from sources(path, content); calls and implements are (src, dst) of classes."""
        none = self.extends.select("src", "dst").where("false")
        methods = self.methods.select(F.col("declaring_class").alias("fqn"), "method_id")
        texts = java.chunk_texts(self.classes, methods, sources)
        return vectors.points(self.classes, methods, self.depends, self.uses, none if calls is None else calls, self.terms, none if implements is None else implements, self.scored, texts)

    def reindex(self, stored: DataFrame, current: DataFrame) -> DataFrame:
        return vectors.reindex_diff(stored, current)

    def reindex_modules(self, names: list[str]) -> DataFrame:
        """The chunks of these modules, to replace what is stored of them."""
        return self.index().where(F.col("module").isin(*names))

    def context(self, text: str, query: DataFrame, limit: int = 20) -> DataFrame | list[str]:
        """Chunks for a class (by full or simple name) or a question; the candidates' names if the name is ambiguous."""
        kind, names = retrieve.resolve(self.classes, text)
        if kind == "ambiguous":
            return names
        focal = self.spark.createDataFrame([(names[0],)], "node string") if kind == "fqn" else None
        return retrieve.retrieve(self.points, query, self.edges, self.scored, focal, limit)

    def migration_context(self, fqn: str, query: DataFrame) -> dict[str, DataFrame]:
        self._known(fqn)
        parts = retrieve.context(self.points, query, self.edges, self.scored, fqn)
        return parts | {"structure": self.class_structure(fqn), "inheritance": self.inheritance(fqn), "terms": self.terms_of(fqn), "rules": self.defines.where(F.col("fqn") == fqn)}

    def whole_context(self, fqn: str, query: DataFrame, budget: int = retrieve.BUDGET) -> retrieve.Context:
        """Structure, inheritance, cone, risk, terms, rules and chunks of a class within a token budget; a part that can't be
        read is a warning."""
        focal = self.spark.createDataFrame([(fqn,)], "node string")

        def chunks() -> DataFrame:
            found = retrieve.retrieve(self.points, query, self.edges, self.scored, focal)
            return found.drop("vector").withColumn("rank", F.row_number().over(W.orderBy(F.desc("final_score"), "vec_id")))  # at most 20 rows

        def cone() -> DataFrame:
            known = self.classes.where(F.col("fqn") == fqn).select(F.col("fqn").alias("node"))
            return graph.cone_with_hops(self.edges, known)

        return retrieve.assemble({
            "structure": lambda: self.class_structure(fqn), "inheritance": lambda: self.inheritance(fqn), "cone": cone, "risk": lambda: self.scored.where(F.col("fqn") == fqn),
            "terms": lambda: self.terms_of(fqn), "rules": lambda: self.defines.where(F.col("fqn") == fqn), "chunks": chunks,
        }, budget)

    def cone_summary(self, fqn: str) -> DataFrame:
        focal = self.spark.createDataFrame([(fqn,)], "node string")
        return retrieve.cone_summary(graph.cone_with_hops(self.edges, focal), self.classes, self.scored, modules.legacy())

    # modules
    def module_summary(self) -> DataFrame:
        return modules.module_summary(self.scored).orderBy(F.desc("legacy_share"), "module")

    def risk_clusters(self) -> DataFrame:
        return modules.risk_clusters(self.scored).orderBy(F.desc("avg_risk"), "module")

    def module_edges(self) -> DataFrame:
        return graph.module_edges(self.classes, self.depends)

    def classes_in_module(self, module: str) -> DataFrame:
        return graph.classes_in_module(self.classes, self.depends, self.scored, module)

    def term_graph(self) -> DataFrame:
        return graph.term_graph(self.terms, self.uses, self.defines)

    def lexicon_coverage(self) -> DataFrame:
        return modules.lexicon_coverage(self.terms)

    def schedule(self) -> DataFrame:
        return modules.recommend_schedule(self.scored, self.depends, self.commits)

    def pilot_recommend(self) -> DataFrame:
        return modules.pilot_recommend(self.scored)

    def pilot_validate(self, module: str) -> DataFrame:
        return modules.pilot_validate(self.scored, self.uses, self.points, module)

    def backfill_modules(self, by_path: DataFrame | None = None) -> Engine:
        return replace(self, classes=modules.backfill_modules(self.classes, by_path))

    # migration
    def plan(self, fqn: str) -> DataFrame:
        return rules.migration_plan(self.actions, fqn)

    def summary(self, module: str | None = None) -> DataFrame:
        own = self.classes.where(F.col("module") == module) if module and module.strip() else self.classes
        return rules.summary(own, self.actions)

    def coverage(self) -> DataFrame:
        return rules.coverage(self.classes, self.actions)

    def preview(self, sources: DataFrame, fqn: str | None = None, module: str | None = None) -> DataFrame:
        """sources(path, content) rewritten by the automatable type and package changes of a class or module, with diffs."""
        return rules.rewrite(sources, self._renames(fqn, module))

    def apply(self, sources: DataFrame, path: str, fqn: str | None = None, module: str | None = None) -> DataFrame:
        """preview, with the files that change written as a table at path; their (path, diff)."""
        return rules.apply_changes(sources, self._renames(fqn, module), path)

    def _renames(self, fqn: str | None, module: str | None) -> DataFrame:
        own = self.classes
        for column, value in (("fqn", fqn), ("module", module)):
            if value:
                own = own.where(F.col(column) == value)
        fit = self.actions.where(F.col("automatable").isin("YES") & F.col("action_type").isin("CHANGE_TYPE", "CHANGE_PACKAGE"))
        pairs = fit.join(own.select("fqn", F.col("source_path").alias("path")), "fqn").join(self.book.select("source", F.col("target").alias("new")), "source")
        return pairs.select("path", F.col("source").alias("old"), "new").distinct()

    def top_gaps(self, begins: str = "") -> DataFrame:
        return rules.top_gaps(self.book, begins)

    def release(self) -> None:
        """Delete the tables that traversals and checks have written so far; plans that read them can't run any more."""
        scratch.release(self.spark)

    def rules_by(self, **filters) -> DataFrame:
        return rules.filter_rules(self.book, **filters)

    def gaps(self, fqn: str | None = None) -> DataFrame:
        return rules.gaps(self.book, self.actions, fqn)

    def put_rules(self, changes: DataFrame) -> Engine:
        return replace(self, book=rules.upsert_rule(self.book, changes))

    def delete_rule(self, source: str) -> Engine:
        """Raises NotFound for an unknown rule and Forbidden for a base rule."""
        found = self.book.where(F.col("source") == source).select("is_base").first()
        if found is None:
            raise NotFound(source)
        if found["is_base"]:
            raise Forbidden(source)
        return replace(self, book=rules.delete_rule(self.book, source))

    # incremental runs
    def remove(self, gone: DataFrame) -> Engine:
        """Without the classes gone(fqn), their methods, fields and edges."""
        left = merge.cascade_delete(gone, {
            "classes": (self.classes, ("fqn",)), "methods": (self.methods, ("declaring_class",)), "fields": (self.fields, ("declaring_class",)),
            "depends": (self.depends, ("src", "dst")), "extends": (self.extends, ("src", "dst")), "uses": (self.uses, ("fqn",)), "defines": (self.defines, ("fqn",)),
            "actions": (self.actions, ("fqn",)), "points": (self.points, ("fqn",)),
        })
        return replace(self, **left)
