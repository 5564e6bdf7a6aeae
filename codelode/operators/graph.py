"""Graph operators over edge tables (G1-G6, G8, J10, A15, A16). Edges: src, dst and, where graded, confidence."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.operators.iterate import settle

MAX_DEPTH = 6


def module_edges(imports: DataFrame) -> DataFrame:
    """Distinct (src, dst) of imports between different modules, with their number (G1)."""
    return imports.filter("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("imports"))


def used_exports(imports: DataFrame) -> DataFrame:
    """Per target: names that others import, and modules that do."""
    return imports.filter("src != dst").groupBy("dst").agg(F.count_distinct("name").alias("used_exports"), F.count_distinct("src").alias("imported_by"))


def mutual_cycles(edges: DataFrame) -> DataFrame:
    """Pairs of modules that import each other, each once and sorted (G2: only cycles of two)."""
    e = edges.filter("src != dst").select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_semi").filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def deep_imports(imports: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Imports of a foreign module's inner file where the module has an interface file; target is the file, interface its index."""
    return imports.filter("src != dst").join(interfaces.select(F.col("module").alias("dst"), F.col("file").alias("interface")), "dst").filter("target != interface").select("src", "dst", "target").distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH, reverse: bool = False) -> DataFrame:
    """(node, depth, confidence) reached from ``starts`` (node): callees, or callers with ``reverse``.

    Breadth first to six levels; a node has the depth of its first visit and the best weakest link over its shortest paths, so
    the answer doesn't depend on edge order. The start is left out. Only the frontier is joined at each level.
    """
    e = edges.select(F.col("dst").alias("f"), F.col("src").alias("t"), "confidence") if reverse else edges.select(F.col("src").alias("f"), F.col("dst").alias("t"), "confidence")
    e = settle(e.filter("f != t").groupBy("f", "t").agg(F.max("confidence").alias("confidence")))
    seen = starts.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"))
    frontier = seen = settle(seen)
    for level in range(1, depth + 1):
        step = frontier.join(e.withColumnRenamed("confidence", "link"), F.col("node") == F.col("f")).select(F.col("t").alias("node"), F.least("confidence", "link").alias("confidence"))
        step = step.groupBy("node").agg(F.max("confidence").alias("confidence")).join(seen.select("node"), "node", "left_anti")
        frontier = settle(step.select("node", F.lit(level).alias("depth"), "confidence"))
        if not frontier.limit(1).count():
            break
        seen = settle(seen.unionByName(frontier))
    return seen.filter("depth > 0")


def impact(edges: DataFrame, starts: DataFrame, modules: DataFrame, depth: int = 3) -> DataFrame:
    """Per start: transitive callers, the modules they are in, and a bucket: isolated, local, moderate, wide.

    All starts walk at once: the frontier is keyed by (start, node).
    """
    e = settle(edges.select(F.col("dst").alias("f"), F.col("src").alias("t")).filter("f != t").distinct())
    seen = settle(starts.select(F.col("node").alias("start"), "node").distinct())
    frontier = seen
    for _ in range(depth):
        step = frontier.join(e, F.col("node") == F.col("f")).select("start", F.col("t").alias("node")).distinct()
        frontier = settle(step.join(seen, ["start", "node"], "left_anti"))
        if not frontier.limit(1).count():
            break
        seen = settle(seen.unionByName(frontier))
    hit = seen.filter("start != node").join(modules, "node", "left").groupBy("start").agg(F.count(F.lit(1)).alias("callers"), F.count_distinct("module").alias("modules"))
    out = starts.select(F.col("node").alias("start")).distinct().join(hit, "start", "left").select("start", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("modules", F.lit(0)).alias("modules"))
    n = F.col("callers")
    return out.withColumn("bucket", F.when(n == 0, "isolated").when(n <= 3, "local").when(n <= 10, "moderate").otherwise("wide"))


def affected(edges: DataFrame, changed: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(node, depth, confidence): callers that changed nodes (node) reach, changed ones among them.

    Each changed node walks by itself, all at once: the frontier is keyed by (start, node), and a node counts where another's walk meets it.
    """
    e = settle(edges.filter("src != dst").groupBy(F.col("dst").alias("f"), F.col("src").alias("t")).agg(F.max("confidence").alias("link")))
    frontier = seen = settle(changed.select("node").distinct().select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence")))
    for level in range(1, depth + 1):
        step = frontier.join(e, F.col("node") == F.col("f")).select("start", F.col("t").alias("node"), F.least("confidence", "link").alias("confidence"))
        step = step.groupBy("start", "node").agg(F.max("confidence").alias("confidence")).join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = settle(step.select("start", "node", F.lit(level).alias("depth"), "confidence"))
        if not frontier.limit(1).count():
            break
        seen = settle(seen.unionByName(frontier))
    least = seen.filter("depth > 0").groupBy("node").agg(F.min(F.struct("depth", (-F.col("confidence")).alias("c"))).alias("m"))
    return least.select("node", F.col("m.depth").alias("depth"), (-F.col("m.c")).alias("confidence"))


def shortest_path(edges: DataFrame, start, goal) -> DataFrame:
    """(hops, path, direction): the least of the shortest paths along callees, or if there is none along callers; same node: 0 hops.

    The search goes on until the goal is met or nothing new is.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    for direction, (f, t) in (("callees", ("src", "dst")), ("callers", ("dst", "src"))):
        e = settle(edges.select(F.col(f).alias("f"), F.col(t).alias("t")).filter("f != t").distinct())
        frontier = spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.array(F.lit(start).cast(kind)).alias("path"))
        seen = frontier.select("node")
        for hops in count():
            found = frontier.filter(F.col("node") == F.lit(goal).cast(kind))
            if found.limit(1).count():
                return found.select(F.lit(hops).alias("hops"), "path", F.lit(direction).alias("direction"))
            step = frontier.join(e, F.col("node") == F.col("f")).select(F.col("t").alias("node"), F.concat("path", F.array("t")).alias("path"))
            frontier = settle(step.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti"))
            if not frontier.limit(1).count():
                break
            seen = settle(seen.union(frontier.select("node")))
    return spark.createDataFrame([], f"hops int, path array<{kind}>, direction string")


def bypasses(imports: DataFrame) -> DataFrame:
    """Imports (from_file, to_file, ...) of a file below a folder ``internal`` from outside the folder that holds it (G1).

    The innermost such folder counts; one at the top of the tree is open to all.
    """
    holder = F.regexp_extract("to_file", "^(.+)/internal/(?!(?:.*/)?internal/)", 1)
    return imports.withColumn("holder", holder).filter((F.col("holder") != "") & ~F.col("from_file").startswith(F.concat("holder", F.lit("/")))).drop("holder")


def languages(files: DataFrame, k: int = 6) -> DataFrame:
    """File endings by their number of files, the first k with the total of endings."""
    ending = F.when(F.col("path").contains("."), F.element_at(F.split("path", r"\."), -1)).otherwise("other")
    return ranked(files.groupBy(ending.alias("ending")).agg(F.count(F.lit(1)).alias("files")), [F.desc("files"), F.col("ending")], k)


def introduced(current: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that the earlier table lacks."""
    return current.join(before.select(*keys).distinct(), keys, "left_anti")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes and edges by kind."""
    n = nodes.groupBy(F.concat(F.lit("node:"), "kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(edges.groupBy(F.concat(F.lit("edge:"), "kind").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def to_json(df: DataFrame, version: int = 1) -> Column:
    """A row as a node-link JSON object (K2)."""
    return F.to_json(F.struct(F.lit(version).alias("version"), *[F.col(c) for c in df.columns]))


def fan_in(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count_distinct("src").alias("fan_in"))


def ranked(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows, each with the total before the cut and whether there was one: capped answers carry their totals."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    top = df.orderBy(*order).limit(k)
    return top.join(F.broadcast(total), F.lit(True)).withColumn("truncated", F.col("total") > k)


def ranked_within(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys)
    out = df.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(*order)))
    return out.filter(F.col("rank") <= k).withColumn("truncated", F.col("total") > k)
