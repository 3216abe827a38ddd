"""Graph operators: bounded traversal, structure look-ups, roll-ups of edges and topological waves.

Edges are (src, dst) rows. A traversal is a loop of joins that the optimizer plans level by level; each level is written
to the checkpoint folder, so the plan stays short and a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.plans.scratch import Table, cut, release, table

#: Hops that a variable-length path goes at most.
MAX_HOPS = 10
#: A written level of up to so many bytes is broadcast, so the edges stay where they are; a larger one is joined by
#: shuffle. Of a graph whose edges take no more, STRIDE levels are walked in one job.
SMALL_BYTES, STRIDE = 8 << 20, 5


def _side(t: Table, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if t.size <= SMALL_BYTES else df


def bfs(edges: DataFrame, starts: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(node, hop): every node that an edge path from any start reaches, with the fewest hops, 1 to max_hops.

    A start is reached only if it lies on a cycle, so it isn't marked as visited beforehand. starts has one column node.
    The levels are walked when this is called, one job for each, or for STRIDE of them where all edges are few; nulls
    are no nodes.
    """
    spark = edges.sparkSession
    links = table(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    stride = STRIDE if links.size <= SMALL_BYTES else 1
    frontier, held, levels, hop = starts.select("node").distinct(), None, [], 0
    while hop < max_hops:
        walked, at = [], frontier
        for k in range(1, min(stride, max_hops - hop) + 1):
            side = at.withColumnRenamed("node", "src")
            side = _side(held, side) if held is not None and k == 1 else side
            at = links.df.join(side, "src").select(F.col("dst").alias("node")).distinct()
            walked.append(at.withColumn("hop", F.lit(hop + k)))
        found = walked[0]
        for more in walked[1:]:
            found = found.unionByName(more)
        if len(walked) > 1:
            found = found.groupBy("node").agg(F.min("hop").alias("hop"))
        for level in levels:
            found = found.join(_side(level, level.df.select("node")), "node", "left_anti")
        held = table(found)
        hop += len(walked)
        if not held.rows:
            break
        levels.append(held)
        frontier = held.df.where(F.col("hop") == hop).select("node")
    release(spark, links)
    if not levels:
        return spark.createDataFrame([], "node string, hop int")
    out = levels[0].df
    for level in levels[1:]:
        out = out.unionByName(level.df)
    return out


def ancestors(extends: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(node, ancestor, depth) for all nodes at once; extends is a forest, so paths don't multiply.

    Paths of up to k steps go on from those of exactly k steps, so reach doubles with every job; all are run when this is
    called.
    """
    out = cut(extends.select(F.col("src").alias("node"), F.col("dst").alias("ancestor"), F.lit(1).alias("depth")))
    reach = 1
    while reach < max_hops:
        above = out.where(F.col("depth") <= max_hops - reach).select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), F.col("depth").alias("more"))
        longer = out.where(F.col("depth") == reach).join(above, "ancestor").select("node", F.col("above").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        found = table(longer)
        if not found.rows:
            break
        out = out.unionByName(found.df)
        reach = min(2 * reach, max_hops)
    return out


def inheritance_chain(extends: DataFrame, fqn: str, max_hops: int = MAX_HOPS) -> DataFrame:
    """(ancestor, depth) upwards from one class; empty for an unknown class."""
    start = extends.where(F.col("src") == fqn).select(F.col("src").alias("node")).distinct()
    return bfs(extends, start, max_hops).select(F.col("node").alias("ancestor"), F.col("hop").alias("depth"))


def interfaces_in_order(chain: DataFrame, classes: DataFrame) -> DataFrame:
    """(interface, first): interfaces of the classes of a chain(fqn, depth) in the order met, without repeats."""
    met = chain.join(classes.select("fqn", "interfaces"), "fqn").select("depth", F.posexplode("interfaces").alias("pos", "interface"))
    return met.groupBy("interface").agg(F.min(F.struct("depth", "pos")).alias("first")).orderBy("first")


def dependency_cone(edges: DataFrame, fqn: str, max_hops: int = MAX_HOPS) -> DataFrame:
    """(node, hop) of everything reachable over the edge kinds given in edges."""
    start = edges.select(F.lit(fqn).alias("node")).limit(1)
    return bfs(edges, start, max_hops)


def cone_with_hops(edges: DataFrame, starts: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(node, hop) with the starts at hop 0 unless a cycle reaches them again; several starts keep the smallest hop."""
    found = bfs(edges, starts, max_hops)
    alone = starts.select("node").distinct().join(found, "node", "left_anti").select("node", F.lit(0).alias("hop"))
    return found.unionByName(alone)


def service_dependents(edges: DataFrame, classes: DataFrame, repository: str, max_hops: int = MAX_HOPS) -> DataFrame:
    """(fqn, hops): services with a path of dependencies to a class that carries the Repository label."""
    start = classes.where((F.col("fqn") == repository) & F.array_contains("labels", "Repository")).select(F.col("fqn").alias("node"))
    back = bfs(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, max_hops)
    services = classes.where(F.array_contains("labels", "Service")).select(F.col("fqn").alias("node"))
    return back.join(services, "node", "left_semi").select(F.col("node").alias("fqn"), F.col("hop").alias("hops"))


def without_path(edges: DataFrame, classes: DataFrame, label: str = "Service", target: str = "Repository", max_hops: int = MAX_HOPS) -> DataFrame:
    """Classes of one label from which no class of the other can be reached: one backward search from all targets."""
    starts = classes.where(F.array_contains("labels", target)).select(F.col("fqn").alias("node"))
    near = bfs(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, max_hops)
    return classes.where(F.array_contains("labels", label)).select("fqn").join(near.select(F.col("node").alias("fqn")), "fqn", "left_anti")


def search_by_name(classes: DataFrame, text: str) -> DataFrame:
    """Classes whose simple name contains the text, whatever the case; % and _ mean themselves."""
    return classes.where(F.lower("simple_name").contains(text.lower())).orderBy("simple_name", "fqn")


def fan_in_out(classes: DataFrame, depends: DataFrame) -> DataFrame:
    """(fqn, fan_in, fan_out): edges counted, parallel ones each."""
    incoming = depends.groupBy(F.col("dst").alias("fqn")).agg(F.count(F.lit(1)).alias("fan_in"))
    outgoing = depends.groupBy(F.col("src").alias("fqn")).agg(F.count(F.lit(1)).alias("fan_out"))
    return (
        classes.select("fqn").join(incoming.hint("merge"), "fqn", "left").join(outgoing.hint("merge"), "fqn", "left")
        .select("fqn", F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in"), F.coalesce("fan_out", F.lit(0)).cast("long").alias("fan_out"))
    )


def _with_modules(classes: DataFrame, depends: DataFrame) -> DataFrame:
    s = classes.select(F.col("fqn").alias("src"), F.col("module").alias("source_module"))
    t = classes.select(F.col("fqn").alias("dst"), F.col("module").alias("target_module"))
    return depends.join(s, "src").join(t, "dst")


def module_edges(classes: DataFrame, depends: DataFrame, limit: int = 200) -> DataFrame:
    """Weights of dependencies between different modules, the heaviest first."""
    w = _with_modules(classes, depends).where("source_module <> target_module and source_module <> '' and target_module <> ''")
    return w.groupBy("source_module", "target_module").agg(F.count(F.lit(1)).alias("weight")).orderBy(F.desc("weight"), "source_module", "target_module").limit(limit)


def module_dependencies(classes: DataFrame, depends: DataFrame) -> DataFrame:
    """Distinct (source_module, target_module), different ones."""
    return _with_modules(classes, depends).where("source_module <> target_module").select("source_module", "target_module").distinct()


def dependent_counts(classes: DataFrame, depends: DataFrame) -> DataFrame:
    """(module, dependents): distinct other modules that depend on each module."""
    return module_dependencies(classes, depends).groupBy(F.col("target_module").alias("module")).agg(F.count(F.lit(1)).alias("dependents"))


def classes_in_module(classes: DataFrame, depends: DataFrame, risk: DataFrame, module: str) -> DataFrame:
    """Classes of a module with their risk, labels and distinct dependencies inside the module."""
    own = classes.where(F.col("module") == module).select("fqn", "simple_name", "labels")
    inside = depends.join(own.select(F.col("fqn").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("fqn")).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    return own.join(risk.select("fqn", "enhanced_risk"), "fqn", "left").join(inside, "fqn", "left").withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))


def class_structure(classes: DataFrame, fqn: str, methods: DataFrame, fields: DataFrame, depends: DataFrame) -> DataFrame:
    """One class with its distinct methods, fields and dependencies; no row if unknown. Each list is gathered by itself, so they don't multiply."""
    own = classes.where(F.col("fqn") == fqn)
    gather = lambda df, key, value, name: df.where(F.col(key) == fqn).groupBy(F.col(key).alias("fqn")).agg(F.array_sort(F.collect_set(value)).alias(name))
    out = own.join(gather(methods, "declaring_class", "method_id", "methods"), "fqn", "left")
    out = out.join(gather(fields, "declaring_class", "field_id", "fields"), "fqn", "left")
    return out.join(gather(depends, "src", "dst", "dependencies"), "fqn", "left")


def transitive_ancestors(extends: DataFrame, rule_sources: DataFrame, actions: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(fqn, ancestor, depth): classes below an ancestor that a rule names (rule_sources.source) without an own action from it."""
    found = ancestors(extends, max_hops).join(rule_sources.select(F.col("source").alias("ancestor")).distinct(), "ancestor", "left_semi")
    own = actions.select(F.col("fqn").alias("node"), F.col("source").alias("ancestor"))
    return found.join(own, ["node", "ancestor"], "left_anti").select(F.col("node").alias("fqn"), "ancestor", "depth")


def ultimate_ancestor(extends: DataFrame, prefix: str, modern: str, max_hops: int = MAX_HOPS) -> DataFrame:
    """(fqn, ancestor): the nearest ancestor whose name begins with prefix but not with modern; of equals the first name."""
    old = ancestors(extends, max_hops).where(F.col("ancestor").startswith(prefix) & ~F.col("ancestor").startswith(modern))
    return old.groupBy(F.col("node").alias("fqn")).agg(F.min(F.struct("depth", "ancestor")).getField("ancestor").alias("ancestor"))


def repository_tables(links: DataFrame, maps_to: DataFrame, repositories: DataFrame, max_hops: int = 3) -> DataFrame:
    """(repository, table): tables mapped by entities within max_hops dependency or implements links of a repository."""
    level = repositories.select("repository", F.col("repository").alias("at"))
    out = None
    for _ in range(max_hops):
        level = level.join(links.select(F.col("src").alias("at"), F.col("dst").alias("next")), "at").select("repository", F.col("next").alias("at")).distinct()
        out = level if out is None else out.unionByName(level)
    return out.join(maps_to.select(F.col("src").alias("at"), F.col("dst").alias("table")), "at").select("repository", "table").distinct()


def term_graph(terms: DataFrame, uses: DataFrame, rules: DataFrame, limit: int = 100) -> DataFrame:
    """The most used terms with the sorted classes that use them or define rules by them."""
    links = uses.select("term_id", "fqn").unionByName(rules.select("term_id", "fqn"))
    top = terms.orderBy(F.desc("usage_count"), "term_id").limit(limit)
    held = links.join(F.broadcast(top.select("term_id")), "term_id", "left_semi")  # at most `limit` ids
    linked = held.groupBy("term_id").agg(F.array_sort(F.collect_set("fqn")).alias("classes"))
    return top.join(linked, "term_id", "left").withColumn("classes", F.coalesce("classes", F.array().cast("array<string>")))


def resolve_parents(sources: DataFrame, classes: DataFrame) -> DataFrame:
    """sources(fqn, content) -> (fqn, super_class, stub): parent names read from the text.

    The simple name behind `extends` is looked up among the imports, else taken to be in the class's own package. Only
    classes whose known super_class is null, empty or an unresolved <...> are patched; stub tells that the parent is no
    known class, so that a node has to be made for it.
    """
    name = F.regexp_extract("content", r"class\s+\w+(?:<[^{]*?>)?\s+extends\s+([\w.]+)", 1)
    imports = F.regexp_extract_all("content", F.lit(r"import\s+([\w.]+)\s*;"), F.lit(1))
    parsed = sources.select("fqn", name.alias("name"), imports.alias("imports")).where("name <> ''")
    match = F.get(F.filter("imports", lambda i: i.endswith(F.concat(F.lit("."), F.col("name")))), F.lit(0))
    package = F.regexp_replace("fqn", r"\.?[^.]+$", "")
    parent = F.when(F.col("name").contains("."), F.col("name")).otherwise(F.coalesce(match, F.when(package == "", F.col("name")).otherwise(F.concat_ws(".", package, F.col("name")))))
    open_ = classes.where("super_class is null or super_class = '' or super_class like '<%'").select("fqn")
    known = classes.select(F.col("fqn").alias("super_class"), F.lit(True).alias("known"))
    return parsed.select("fqn", parent.alias("super_class")).join(open_, "fqn", "left_semi").join(known, "super_class", "left").select("fqn", "super_class", F.col("known").isNull().alias("stub"))


def waves(modules: DataFrame, depends: DataFrame) -> DataFrame:
    """(module, wave): a module's wave comes after those of all it depends on; what cycles hold up is the last wave.

    Each round, one job, takes the modules of which no dependency is left. Edges to unknown modules and to itself don't
    count. The rounds are run when this is called.
    """
    nodes = table(modules.select("module").distinct())
    known = nodes.df
    edges = depends.where("src <> dst").select("src", "dst").distinct()
    edges = edges.join(known.select(F.col("module").alias("src")), "src", "left_semi").join(known.select(F.col("module").alias("dst")), "dst", "left_semi")
    edges, left, out, rows = table(edges).df, known, None, nodes.rows
    open_ = edges
    for wave in range(1, nodes.rows + 1):
        ready = table(left.join(open_.select(F.col("src").alias("module")), "module", "left_anti").withColumn("wave", F.lit(wave)))
        rows -= ready.rows
        if ready.rows:
            out = ready.df if out is None else out.unionByName(ready.df)
            left = known.join(out, "module", "left_anti")
            open_ = edges.join(out.select(F.col("module").alias("dst")), "dst", "left_anti")
        if not ready.rows or not rows:
            break
    else:
        wave = 1
    rest = left.withColumn("wave", F.lit(wave))
    return rest if out is None else out.unionByName(rest) if rows else out


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
