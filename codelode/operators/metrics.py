"""Module scores (A1-A10, D13, D14). A score that was not measured is NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.numeric import clamp, round_half_up

#: Weights of the composite, and the bands of a score.
WEIGHTS = {"depth": 0.25, "seams": 0.2, "leverage": 0.25, "locality": 0.15, "contamination": 0.15}
BANDS = ((80, "Strong"), (60, "Moderate"), (40, "Shallow"), (0, "Weak"))


def band(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit("n/a"))
    for least, name in BANDS:
        out = out.when(score >= least, name)
    return out


def depth(m: DataFrame) -> DataFrame:
    """Implementation behind the interface (A2). Columns: module, source_files, functions, types, consts, reexports, required_params, private_functions, loc."""
    iface = F.col("functions") + F.col("types") + 0.5 * F.col("consts") + 0.5 * F.col("required_params") + 0.25 * F.col("reexports")
    impl = F.col("loc") + 5 * F.col("private_functions")
    raw = impl / F.nullif(iface, F.lit(0.0))
    base = round_half_up(100 * (raw / (raw + 18)))
    ratio = F.col("reexports") / F.greatest(F.lit(1), F.col("functions") + F.col("types") + F.col("consts") + F.col("reexports"))
    score = F.when(F.col("source_files") == 0, None).when(iface == 0, 75).when((ratio > 0.8) & (F.col("loc") < 30), F.least(base, F.lit(25))).otherwise(base)
    return m.select("module", score.cast("long").alias("depth")).withColumn("label", band(F.col("depth")))


def seams(m: DataFrame) -> DataFrame:
    """How well the boundary holds (A3). Columns: module, needs_interface, has_interface, deep, in_cycle, tested."""
    score = 100 - F.when(F.col("needs_interface") & ~F.col("has_interface"), 35).otherwise(0) - F.least(8 * F.col("deep"), F.lit(30)) - F.when(F.col("in_cycle"), 25).otherwise(0) - F.when(F.col("tested"), 0).otherwise(10)
    return m.select("module", F.greatest(F.lit(0), score).cast("long").alias("seams")).withColumn("label", band(F.col("seams")))


def leverage(m: DataFrame, modules: Column) -> DataFrame:
    """How much others use it (A4). Columns: module, exported, used, callers."""
    reach = F.least(F.lit(1.0), F.col("callers") / F.least(F.greatest(modules - 1, F.lit(1)), F.lit(6)))
    x = 0.55 * reach + 0.45 * F.least(F.lit(1.0), F.col("used") / F.nullif(F.col("exported"), F.lit(0))) - 0.15 * F.least(F.lit(1.0), F.col("exported") / 25)
    score = F.when(F.col("exported") == 0, None).when(F.col("callers") == 0, 10).otherwise(round_half_up(clamp(x, 0, 1) * 100))
    return m.select("module", score.cast("long").alias("leverage")).withColumn("label", band(F.col("leverage")))


def cochange(touched: DataFrame) -> DataFrame:
    """Per module: commits, and the means of distinct directories and files of the commits that touch it (A6). touched: commit, module, dir, file."""
    per = touched.groupBy("commit").agg(F.count_distinct("dir").alias("dirs"), F.count_distinct("file").alias("files"))
    return touched.select("commit", "module").distinct().join(per, "commit").groupBy("module").agg(F.count(F.lit(1)).alias("commits"), F.avg("dirs").alias("mean_dirs"), F.avg("files").alias("mean_files"))


def locality(c: DataFrame) -> DataFrame:
    """How local its changes are; NULL under two commits (A5)."""
    scatter = 0.7 * F.least(F.greatest(F.col("mean_dirs") - 1, F.lit(0.0)) / 4, F.lit(1.0)) + 0.3 * F.least(F.col("mean_files") / 12, F.lit(1.0))
    return c.withColumn("locality", F.when(F.col("commits") >= 2, round_half_up(100 * (1 - scatter))))


def ownership(touched: DataFrame) -> DataFrame:
    """Per module: commits, authors, the top author and share, bus factor, owner and risk (A7, A8). touched: commit, author, module.

    The bus factor is the smallest number of authors, by commits, who made four fifths of them, in integers.
    """
    per = touched.select("commit", "author", "module").distinct().groupBy("module", "author").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("module").orderBy(F.desc("n"), "author")
    per = per.withColumn("rank", F.row_number().over(order)).withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    per = per.withColumn("total", F.sum("n").over(Window.partitionBy("module")))
    m = per.groupBy("module").agg(F.max("total").alias("commits"), F.count(F.lit(1)).alias("authors"), F.min(F.when(5 * F.col("upto") >= 4 * F.col("total"), F.col("rank"))).cast("long").alias("bus_factor"), F.min(F.struct("rank", "author", "n")).alias("top"))
    share = F.col("top.n") / F.col("commits")
    m = m.select("module", "commits", "authors", "bus_factor", F.col("top.author").alias("top_author"), share.alias("top_share"))
    risk = F.when(F.col("commits") >= 3, F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(25 * F.least("bus_factor", F.lit(4)) - F.greatest(F.col("top_share") - 0.5, F.lit(0.0)) * 100))))
    return m.withColumn("owner", F.when((F.col("commits") >= 3) & (F.col("top_share") >= 0.5), F.col("top_author"))).withColumn("risk", risk.cast("long"))


def composite(m: DataFrame) -> DataFrame:
    """Health: the weighted mean of what was measured, contamination inverted, weights renormalised over it; NULL without any."""
    parts = {k: (100 - F.col(k) if k == "contamination" else F.col(k)) for k in WEIGHTS}
    total = sum((F.when(v.isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0) for k, v in parts.items()), F.lit(0.0))
    value = sum((F.coalesce(v * WEIGHTS[k], F.lit(0.0)) for k, v in parts.items()), F.lit(0.0))
    return m.withColumn("health", round_half_up(value / F.nullif(total, F.lit(0.0)))).withColumn("band", band(F.col("health")))


def opportunities(m: DataFrame) -> DataFrame:
    """What to improve, in four passes (D14). Columns: module, depth, leverage, exports, seams, risk."""
    passes = [(0, "deepen", F.col("depth") < 40, "depth"), (1, "trim-surface", (F.col("leverage") < 40) & (F.col("exports") >= 8), "leverage"), (2, "harden-boundary", F.col("seams") < 60, "seams"), (3, "spread-knowledge", F.col("risk") < 40, "risk")]
    rows = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(k).alias("pass"), F.lit(kind).alias("kind"), F.col(c).alias("score"))) for k, kind, test, c in passes])
    return m.select("module", F.inline(F.filter(rows, lambda x: x.isNotNull())))


def evidence(facts: DataFrame, cap: int = 12) -> DataFrame:
    """Facts (module, kind, text) capped per module and kind, with one overflow row that says how many more there are."""
    w = Window.partitionBy("module", "kind")
    f = facts.withColumn("ord", F.row_number().over(w.orderBy("text"))).withColumn("total", F.count(F.lit(1)).over(w))
    shown = f.filter(F.col("ord") <= cap).select("module", "kind", "ord", "text")
    more = f.filter((F.col("ord") == 1) & (F.col("total") > cap)).select("module", F.concat("kind", F.lit("-overflow")).alias("kind"), F.lit(cap + 1).alias("ord"), F.concat((F.col("total") - cap).cast("string"), F.lit(" more")).alias("text"))
    return shown.unionByName(more)
