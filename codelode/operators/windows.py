"""Window-shaped operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.numeric import round_half_up
from codelode.operators.iterate import settle


def islands(df: DataFrame, keys: list[str], at: str, gap: Column | int | float = 2) -> DataFrame:
    """Runs of rows: a new one where ``at`` is more than ``gap`` after the one before."""
    w = Window.partitionBy(*keys).orderBy(at)
    starts = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    runs = df.withColumn("_s", starts).withColumn("run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))


def coverage(spans: DataFrame, keys: list[str], total: Column | None = None) -> DataFrame:
    """Lines that intervals [start, end] cover together, and their share in whole percent."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start") - 1, F.coalesce(upto, F.col("start") - 1)))
    s = spans.withColumn("_new", new).groupBy(*keys).agg(F.sum("_new").alias("covered"), F.max("end").alias("last"))
    return s.withColumn("percent", round_half_up(100 * F.col("covered") / F.nullif(total if total is not None else F.col("last"), F.lit(0))))


def first_distinct(df: DataFrame, keys: list[str], value: str, pos: str, most: int) -> DataFrame:
    """The first ``most`` distinct values in order of first appearance."""
    g = df.groupBy(*keys, value).agg(F.min(pos).alias("pos"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("pos", value))).filter(F.col("rank") <= most)


def receipts(df: DataFrame, key: list[str], order: list[str], digest: str) -> DataFrame:
    """Whether an answer repeats the previous answer of its key.

    Rows are dealt out by ranges of key and order, so one busy key is many partitions; what the first answer of a key in a
    partition follows is the last one of the partitions before it, a row for each key and partition.
    """
    parts = settle(df.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part", *key).orderBy(*order)
    d = parts.withColumn("_before", F.lag(digest).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = parts.groupBy(*key, "_part").agg(F.max(F.struct(*order, digest)).alias("_l")).withColumn("_l", F.col("_l")[digest])
    last = last.withColumn("_carried", F.lag("_l").over(Window.partitionBy(*key).orderBy("_part"))).drop("_l")
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"l.{k}")) for k in [*key, "_part"]]
    before = F.when(F.col("d._first"), F.col("l._carried")).otherwise(F.col("d._before"))
    return d.alias("d").join(last.alias("l"), on).select(*[F.col(f"d.{c}") for c in df.columns], F.coalesce(before == F.col(f"d.{digest}"), F.lit(False)).alias("repeat"))


def capped(df: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group and one overflow row with the number of the rest."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(w))
    return d.filter(F.col("rank") <= cap + 1).withColumn("more", F.when(F.col("rank") == cap + 1, F.col("total") - cap))


def budgeted(df: DataFrame, keys: list[str], order: str, chars: Column, budget: int) -> DataFrame:
    """The longest prefix of lines whose token estimates, ceil((length + 1) / 4), fit a budget."""
    cost = F.ceil((chars + 1) / 4)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("upto", F.sum(cost).over(w)).withColumn("shown", F.col("upto") <= budget)


def render_budgeted(sections: list[tuple[str, list[str]]], budget: int) -> list[tuple[str, list[str], int]]:
    """Across sections, on the driver: each takes what is left after one line is reserved for those behind it."""
    cost = lambda line: -(-(len(line) + 1) // 4)
    left, out = budget, []
    for k, (title, lines) in enumerate(sections):
        reserve = sum(cost(t) for t, _ in sections[k + 1 :])
        room, shown = left - reserve - cost(title), []
        for line in lines:
            if cost(line) > room:
                break
            room -= cost(line)
            shown.append(line)
        left -= cost(title) + sum(map(cost, shown))
        out.append((title, shown, len(lines) - len(shown)))
    return out


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles, the ceil(p n)-th least value; the last is NULL where it is the maximum.

    Values are counted map-side first, so what meets for one key is its different values, not its rows.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy(F.col(value)))
    d = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_k").over(Window.partitionBy(*keys)))
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(p) - F.lit(1e-9)))
    parts = [F.min(F.when((F.col("_upto") >= rank(p)) & (F.col("_upto") - F.col("_k") < rank(p)), F.col(value))).alias(f"p{round(p * 100)}") for p in shares]
    out = d.groupBy(*keys).agg(F.max("_n").alias("n"), F.max(value).alias("most"), *parts)
    last = f"p{round(shares[-1] * 100)}"
    return out.withColumn(last, F.when(F.col(last) < F.col("most"), F.col(last)))
