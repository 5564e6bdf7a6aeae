"""Operator 2: exact deduplication by deterministic block naming (native)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts, column, lower_az, text_of


def _named(rows: DataFrame, keys: list[str], cut: Cuts) -> DataFrame:
    """Sort the distinct keys and give each an integer name, its place in that order.

    Distinct keys are found with map-side partial aggregation, so a key that a third of the rows share is one row per
    task. Names are unique by construction, and the table is written before it is used, so no retry renames.
    """
    order = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys)
    return cut(order.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()))


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096, key_bits: int = 64, cut: Cuts | None = None) -> DataFrame:
    """One row per document: _rid, _id, sha (of the normalised text), n_blocks and name, equal for equal texts only.

    The normalised text is cut into blocks of ``block_chars`` characters. A block is sorted by (64-bit key, content): the
    content crosses the network once, to prove which keys stand for one content; where a key stands for several, their rank
    within the key completes it. Then adjacent names are paired and the pairs named, level by level, until each document
    has one name. ``key_bits`` below 64 makes keys collide (for tests).
    """
    cut = cut or Cuts(docs)
    key = (lambda c: F.xxhash64(c)) if key_bits >= 64 else (lambda c: F.pmod(F.xxhash64(c), F.lit(1 << key_bits)))
    text = lower_az(text_of(text_col))
    norm = docs.select(column(id_col).alias("_id"), text.alias("_t"))
    blocks = F.regexp_extract_all("_t", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))

    rows = norm.select(F.monotonically_increasing_id().alias("_rid"), "_id", F.sha2(F.col("_t"), 256).alias("sha"), blocks.alias("_b"))
    rows = cut(rows.select("_rid", "_id", "sha", F.size("_b").alias("n_blocks"), F.transform("_b", key).alias("keys")))

    content = norm.select(F.explode(blocks).alias("b")).select(key(F.col("b")).alias("k"), "b").groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"))
    shared = cut(content.groupBy("k").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("k"))
    at = rows.select("_rid", F.posexplode("keys").alias("pos", "k")).withColumn("sub", F.lit(0).cast("long"))
    if shared.limit(1).count():  # keys that stand for several contents: these blocks need their content told apart
        ids = docs.select(column(id_col).alias("_id"), text.alias("_t"), F.sha2(text, 256).alias("sha"))
        odd = ids.dropDuplicates(["sha", "_t"]).select("sha", F.posexplode(blocks).alias("pos", "b")).withColumn("k", key(F.col("b"))).join(shared, "k", "left_semi")
        subs = _named(odd, ["k", "b"], cut).withColumnRenamed("name", "sub2")
        odd = cut(odd.join(subs, ["k", "b"]).select("sha", "pos", "sub2"))
        at = rows.select("_rid", "sha", F.posexplode("keys").alias("pos", "k")).join(odd, ["sha", "pos"], "left")
        at = at.select("_rid", "pos", "k", F.coalesce(F.col("sub2") + 1, F.lit(0)).alias("sub"))

    most = rows.agg(F.max("n_blocks")).first()[0] or 0
    at = cut(at.join(_named(at, ["k", "sub"], cut), ["k", "sub"]).select("_rid", F.col("pos").cast("long").alias("pos"), "name"))
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        at, last = cut(_paired(at, cut)), at
        cut.drop(last)
    return rows.drop("keys").join(at.select("_rid", "name"), "_rid", "left").withColumn("name", F.coalesce("name", F.lit(-1)))


def _paired(at: DataFrame, cut: Cuts) -> DataFrame:
    """One level: name the pairs of adjacent names; a last one without neighbour pairs with -1."""
    half = F.floor(F.col("pos") / 2)
    side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
    pairs = at.groupBy("_rid", half.alias("pos")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
    return pairs.join(_named(pairs, ["a", "b"], cut), ["a", "b"]).select("_rid", "pos", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096, key_bits: int = 64) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id stays. A null text is
    empty; empty texts are equal to each other. A null id ranks below all others. Of repeated rows with one id and one text
    exactly one is kept. An empty table gives an empty result; other columns of the input are not read.
    """
    cut = Cuts(docs.select(column(id_col), column(text_col)))
    named = block_names(docs, id_col, text_col, block_chars, key_bits, cut)
    named = cut(named.select("_rid", F.col("_id").alias("id"), F.col("sha").alias("text_sha256"), "n_blocks", "name"))
    group = cut(named.groupBy("n_blocks", "name").agg(F.max(F.struct("id", "_rid")).alias("last"), F.count(F.lit(1)).alias("group_size")))
    out = named.join(group, ["n_blocks", "name"])
    return cut.done(out.select(F.col("id").alias(id_col), F.col("last.id").alias("keep_id"), "group_size", (F.col("_rid") == F.col("last._rid")).alias("kept"), "text_sha256"))
