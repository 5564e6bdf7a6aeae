"""Operator 1: mixing sources to target weights by a low-discrepancy schedule (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Cuts, column, near, text_of

#: Bits of a shuffle key and of a schedule point.
BITS = 48


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The words each source gives: (source, source_size, weight, target).

    Sources in code-point order, null last, take the weights in turn and share ``share`` times all words by weight; a
    target stops at ``most`` times its source's size and the excess is shared again by weight. That settles where the capped
    sources are those of least cap per weight, so two running sums over the table of sources (one row each) solve it.
    """
    n = len(weights)
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(n))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("w_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.col("w_left")).withColumn("open", F.col("ratio") >= F.col("level"))
    level = F.min(F.when(F.col("open"), F.struct("ratio", "level"))).over(everything)
    s = s.withColumn("first", level)
    return s.select("source", "source_size", "weight", F.when(F.col("open") & F.col("first").isNotNull(), F.col("first.level") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def _point(k):
    """van der Corput: the bits of k mirrored behind the point, as an integer below 2**BITS."""
    return F.conv(F.rpad(F.reverse(F.bin(k)), BITS, "0"), 2, 10).cast("long")


def _upto(runs: DataFrame, value: str, name: str, width: int = 4096) -> DataFrame:
    """Runs (source, run, value) with the sum of the same source's earlier runs as ``name``.

    Two steps: sums over groups of ``width`` runs, then within each group; a source's runs never meet in one task.
    """
    runs = runs.withColumn("group", F.floor(F.col("run") / width))
    before = lambda *by: Window.partitionBy("source", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = runs.groupBy("source", "group").agg(F.sum(value).alias("v")).withColumn("far", F.coalesce(F.sum("v").over(before("group")), F.lit(0)))
    runs = runs.withColumn("close", F.coalesce(F.sum(value).over(before("group", "run")), F.lit(0)))
    met = runs.alias("r").join(groups.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")) & (F.col("r.group") == F.col("g.group")))
    return met.select("r.source", "r.run", f"r.{value}", (F.col("g.far") + F.col("r.close")).alias(name))


def schedule(quota: DataFrame, block_words: int, buckets: int = 4096, cut: Cuts | None = None) -> DataFrame:
    """The mix in order: (slot, source, rank), slots 0, 1, ... dealt to sources by cumulative weight of the targets.

    Slot k has the k-th van der Corput point; the source whose interval of the cumulative targets holds the point gets it.
    Intervals are cut along a fixed grid, so points meet them by an equi-join. Ranks within a source come from counts per
    run of slots plus places within the run: no source's slots meet in one task. Slots past a source's target stay unused;
    a sixteenth more points than needed are dealt. A source that still has fewer slots than its target needs, as small ones
    among many have, gets the missing ones after the last point, in the sources' order: every source reaches its target.
    """
    spark, cut = quota.sparkSession, cut or Cuts(quota)
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    q = quota.filter("target > 0").withColumn("all", F.sum("target").over(total))
    q = q.withColumn("lo", F.coalesce(F.sum("target").over(upto), F.lit(0.0)) / F.col("all"))
    edge = F.lead("lo").over(Window.orderBy(F.col("source").isNull(), "source"))
    q = q.withColumn("hi", F.coalesce(edge, F.lit(1.0)))
    whole = float(1 << BITS)
    q = q.withColumn("lo", F.floor(F.col("lo") * whole)).withColumn("hi", F.floor(F.col("hi") * whole))
    cell = (1 << BITS) // buckets
    q = cut(q.select("source", "source_size", "target", "lo", "hi", "all"))
    words = q.agg(F.max("all")).first()[0] or 0.0
    needed = int(words // block_words) + 1 if words else 0
    count = needed + needed // 16 + 64 if words else 0
    grid = q.filter("hi > lo").select("source", "target", "source_size", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("cell"))
    slots = spark.range(count).select(F.col("id").alias("slot"), _point(F.col("id")).alias("at")).withColumn("cell", F.floor(F.col("at") / cell))
    dealt = slots.join(grid, "cell").filter("at >= lo and at < hi").withColumn("run", F.floor(F.col("slot") / 4096))
    dealt = cut(dealt.select("slot", "source", "target", "source_size", "run"))
    runs = cut(_upto(dealt.groupBy("source", "run").agg(F.count(F.lit(1)).alias("n")), "n", "base"))
    place = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    named = dealt.withColumn("place", place).alias("d").join(runs.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.run") == F.col("r.run")))
    rank = (F.col("r.base") + F.col("d.place")).cast("long")
    used = named.select("d.slot", "d.source", "d.target", "d.source_size", rank.alias("rank")).filter(F.col("rank") * F.lit(block_words) < F.col("target"))
    have = runs.groupBy(F.col("source").alias("of")).agg(F.sum("n").alias("have"))
    short = q.join(have, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("have", F.coalesce("have", F.lit(0)))
    short = short.withColumn("missing", F.ceil(F.col("target") / block_words) - F.col("have")).filter("missing > 0")
    short = short.withColumn("slot", F.lit(count) + F.coalesce(F.sum("missing").over(upto), F.lit(0)))
    short = short.select("slot", "source", "target", "source_size", "have", F.posexplode(F.sequence(F.col("have"), F.col("have") + F.col("missing") - 1)).alias("k", "rank"))
    return used.unionByName(short.select((F.col("slot") + F.col("k")).alias("slot"), "source", "target", "source_size", "rank"))


def shuffled(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, cut: Cuts, size_bits: int = 9) -> tuple[DataFrame, DataFrame]:
    """Documents with the place of their first word in their source's shuffled stream; and the sources' sizes.

    The order within a source is that of a keyed digest of id and text. Places are running sums in three steps: within runs of
    the digest's leading bits, of about 512 documents each, within groups of runs, and over groups. Rows that tie are the same
    row twice.
    """
    text = text_of(text_col)
    digest = F.md5(F.concat_ws("\u0001", F.lit(str(seed)), column(id_col).cast("string"), text))
    key = F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")
    base = cut(docs.select(column(id_col).alias("doc"), column(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key")))
    n = base.count()
    bits = max(0, (max(n, 1) >> size_bits).bit_length())
    d = base.withColumn("run", F.floor(F.col("key") / float(1 << (BITS - bits))).cast("long"))
    runs = _upto(d.groupBy("source", "run").agg(F.sum("size").alias("words")), "words", "base")
    order = Window.partitionBy("source", "run").orderBy("key", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0)))
    d = d.alias("d").join(runs.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.run") == F.col("r.run")))
    placed = cut(d.select("d.doc", "d.source", "d.size", (F.col("r.base") + F.col("d.within")).alias("start")))
    return placed, base.groupBy("source").agg(F.sum("size").alias("source_size"))


def blocks(placed: DataFrame, block_words: int) -> DataFrame:
    """The parts of documents in their source's equal blocks: (source, block, start, size, words)."""
    d = placed.filter("size > 0")
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    d = d.select("source", "doc", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)).alias("block"))
    lo, hi = F.greatest("start", F.col("block") * block_words), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return d.select("source", "block", "doc", "start", "size", (hi - lo).alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 64, seed: int = 1, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How many words the mix takes of each document: (doc_id, source, size, source_size, target, taken).

    The source's blocks are taken in the order of the ranks, over and over; used slots never pass ``most`` = 2 rounds, so no
    document exceeds twice its size. A null text has no words; a null source is a source of its own; documents without
    words take nothing; repeated rows each have their own place. An empty table gives an empty result. Columns other than
    the three named are not read.
    """
    cut = Cuts(docs.select(column(id_col), column(text_col), column(source_col)))
    placed, sizes = shuffled(docs, id_col, text_col, source_col, seed, cut)
    quota = cut(targets(sizes, weights, share, most))
    used = schedule(quota, block_words, cut=cut)
    number = F.ceil(F.col("source_size") / block_words)
    taken = used.withColumn("block", F.pmod(F.col("rank"), number)).groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    parts = blocks(placed, block_words)
    met = parts.alias("p").join(taken.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block")), "left")
    per = met.groupBy(F.col("p.source").alias("source"), F.col("p.start").alias("start"), F.col("p.doc").alias("doc"), F.col("p.size").alias("size"))
    per = per.agg(F.sum(F.col("p.words") * F.coalesce("t.times", F.lit(0))).cast("long").alias("taken")).drop("start")
    bare = placed.filter("size = 0").select("source", "doc", "size", F.lit(0).cast("long").alias("taken"))
    rows = per.unionByName(bare).alias("a").join(near(quota).alias("q"), F.col("a.source").eqNullSafe(F.col("q.source")))
    out = rows.select(F.col("a.doc").alias(id_col), F.col("a.source").alias(source_col), "a.size", "q.source_size", F.round("q.target", 6).alias("target"), "a.taken")
    return cut.done(out)
