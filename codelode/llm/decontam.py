"""Operator 6: benchmark decontamination by spaced-seed hashing (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cuts, column, key_of, let, near, text_of, whole

#: Fixed masks: the token places of a seed that count (1) and that may differ (0). Whatever 10 of 13 places agree, one mask
#: of the first fits into them; whatever 75 % of 8 to 12 places agree, one of the second.
MASKS = ("1101011", "11100101", "110100011")
SHORT_MASKS = ("1101011", "11100101", "10111", "11000011")


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _seeds(h, mask: str, k: int) -> Column:
    on = [i for i, c in enumerate(mask) if c == "1"]
    seed = lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(h, i + F.lit(o)) for o in on[1:]])
    return F.slice(F.transform(h, seed), F.lit(1), F.greatest(F.size(h) - len(mask) + 1, F.lit(0)))


def seeds(h: Column, masks: tuple[str, ...] = MASKS) -> Column:
    """All masks' seeds of a token array, one mask's after the other's; where a seed starts follows from its place."""
    return let(h, lambda x: F.concat(*[_seeds(x, m, k) for k, m in enumerate(masks)]))


def _start(place: Column, n: Column, masks: tuple[str, ...]) -> Column:
    out, base = None, F.lit(0)
    edges = []
    for m in masks:
        edges.append(base)
        base = base + F.greatest(n - len(m) + 1, F.lit(0))
    for e in edges:
        out = place if out is None else F.when(place >= e, place - e).otherwise(out)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, agree: float = 0.75, shortest: int = 8, masks: tuple[str, ...] = MASKS, short_masks: tuple[str, ...] = SHORT_MASKS, cut: Cuts | None = None) -> DataFrame:
    """Verified overlaps (k1, k2, item, matches, length): the best aligned window of a text, by its key, with a benchmark item.

    A seed hit fixes an alignment. Along it, of every ``window`` tokens (all of an item that is shorter) the share ``agree``
    must be the same words in the same places, and all of an item of fewer than ``shortest`` tokens, which is its own seed.
    The masks are those that the benchmark's lengths need. An item's text that repeats counts once, as its lowest id (of any
    type that has an order). Copies of a text are one text here: they meet the benchmark while they are read, and their hits
    are summed map-side and verified once.
    """
    cut = cut or Cuts(docs)
    b = benchmark.select(column(item_col).alias("item"), token_hashes(column(item_text_col)).alias("bh")).filter(F.size("bh") > 0)
    b = cut(b.groupBy("bh").agg(F.min("item").alias("item")))
    widths = [r[0] for r in b.select(F.least(F.size("bh"), F.lit(window)).alias("w")).distinct().collect()]
    uses = {w: ("1" * w,) if w < shortest else masks if w == window else short_masks for w in widths}
    masks = tuple(dict.fromkeys(m for w in sorted(uses) for m in uses[w])) or masks
    bs = None
    for k, m in enumerate(masks):
        of = b.filter(F.least(F.size("bh"), F.lit(window)).isin([w for w in uses if m in uses[w]]))
        of = of.select("item", F.posexplode(_seeds(F.col("bh"), m, k)).alias("ipos", "seed"))
        bs = of if bs is None else bs.unionByName(of)
    bs = cut(bs)

    d = docs.select(*key_of(text_of(text_col)), token_hashes(column(text_col)).alias("h"))
    s = d.select("k1", "k2", let(F.col("h"), lambda x: F.struct(F.size(x).alias("n"), seeds(x, masks).alias("s"))).alias("x"))
    s = s.select("k1", "k2", F.col("x.n").alias("n"), F.posexplode("x.s").alias("place", "seed"))
    hits = s.join(near(bs), "seed").select("k1", "k2", "item", (_start(F.col("place"), F.col("n"), masks) - F.col("ipos")).alias("shift"))
    hits = cut(hits.groupBy("k1", "k2", "item", "shift").agg(F.count(F.lit(1)).alias("seeds")))

    keys = cut(hits.select("k1", "k2").distinct())
    found = docs.select(*key_of(text_of(text_col)), column(text_col).alias("t")).join(near(keys), ["k1", "k2"], "left_semi")
    found = found.groupBy("k1", "k2").agg(F.first("t").alias("t")).select("k1", "k2", token_hashes(F.col("t")).alias("h"))
    at = hits.join(found, ["k1", "k2"]).join(near(b), "item")
    lo = F.greatest(F.col("shift"), F.lit(0))
    skip = F.greatest(-F.col("shift"), F.lit(0))
    n = F.least(F.size("h") - lo, F.size("bh") - skip)
    same = F.zip_with(F.slice("h", lo + 1, n), F.slice("bh", skip + 1, n), lambda x, y: F.when(x == y, 1).otherwise(0))
    width = F.least(F.lit(window), F.size("bh"))
    at = at.filter(n >= width).select("k1", "k2", "item", width.alias("length"), same.alias("same"))
    total = lambda f, k, w: F.aggregate(F.slice(f, k, w), F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("length") + 1), lambda k: total(F.col("same"), k, F.col("length"))))
    at = at.select("k1", "k2", "item", "length", best.alias("matches")).filter(F.col("matches") >= F.when(F.col("length") < shortest, F.col("length")).otherwise(F.ceil(F.col("length") * F.lit(agree))))
    return at.groupBy("k1", "k2", "item").agg(F.max("matches").alias("matches"), F.max("length").alias("length"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """One row per input row: its id, contaminated, n_items, item_id (the best, lowest of equals), matches and length.

    A null text is empty and clean, as is every document where the benchmark is empty; a null id is kept; repeated rows get the
    same answer each; ids of documents and items may be of any type. Documents meet the benchmark's seeds while they are read;
    what is shuffled is the hits, keyed by text, so neither a common passage nor a frequent word gathers in one task. Other
    columns are not read.
    """
    cut = Cuts(docs.select(column(id_col), column(text_col)))
    found = leaks(docs, benchmark, text_col, item_col, item_text_col, cut=cut, **options)
    order = F.struct((-F.col("matches")).alias("low"), "item", "matches", "length")
    per = cut(found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_items"), F.min(order).alias("b")))
    rows = docs.select(column(id_col).alias("id"), *key_of(text_of(text_col))).join(near(per), ["k1", "k2"], "left")
    return cut.done(rows.select(F.col("id").alias(id_col), F.col("b").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("b.item").alias(item_col), F.col("b.matches").alias("matches"), F.col("b.length").alias("length")))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """The input's rows, all columns, that hold no benchmark item (see ``decontaminate``).

    Columns of any name pass through. A null or empty text is clean, all rows are where the benchmark is empty, repeated rows
    stay or go together, null ids stay, and an empty table gives an empty result.
    """
    cut = Cuts(docs)
    gone = cut(leaks(docs, benchmark, text_col, item_col, item_text_col, cut=cut, **options).select("k1", "k2").distinct())
    out = docs.select(whole(docs), *key_of(text_of(text_col))).join(near(gone), ["k1", "k2"], "left_anti")
    return cut.done(out.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
