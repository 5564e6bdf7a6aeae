"""Operator 3: near-duplicate classes by DartMinHash signatures."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cuts, column, key_of, near, sliced, text_of, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a shingle, bands and rows of the signature: a pair of similarity 0.8 meets in a band but for 15 cases in a million.
SHINGLE, BANDS, ROWS = 5, 28, 5
#: Rounds in which a bucket's smaller classes meet members drawn from its largest, and members drawn each time.
SAMPLES, DRAWN = 1, 3
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingles(texts: pa.Array | list[str | None], width: int = SHINGLE, counted: bool = False) -> list[np.ndarray] | list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingles as 64-bit hashes, ascending; with ``counted``, also how often each occurs.

    Words are runs of characters other than ASCII white space, lower-cased. A text of fewer words than ``width`` is one
    shingle of all its words; a text without words has none.
    """
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")))
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    hashes = pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)
    codes = flat.indices.to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    word = np.array([bool(w) for w in words], bool)[codes] if words else np.zeros(0, bool)
    upto = np.concatenate([[0], np.cumsum(word)])[offsets]
    h = hashes[codes[word]] if words else np.zeros(0, np.uint64)
    roll = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        roll = mix(roll + h[k : k + len(roll)] + np.uint64(k + 1))
    out = []
    for a, b in zip(upto, upto[1:], strict=False):
        if b - a >= width:
            s = roll[a : b - width + 1]
        else:
            s = np.zeros(1 if b > a else 0, np.uint64)
            for k in range(a, b):
                s = mix(s + h[k] + np.uint64(k - a + 1))
        out.append(np.unique(s, return_counts=True) if counted else np.unique(s))
    return out


def throw(sets: list[np.ndarray], weights: list[np.ndarray] | None, k: int, scale: np.ndarray) -> np.ndarray:
    """One throw of darts: (sets, k) of (rank bits << 32 | dart), the earliest per coordinate; the largest value where none fell.

    Every element owns a strip of the plane (weight, rank), cut at the weights 1, 2, 4, ...; darts fall on a cell of a strip as
    a Poisson process along the rank, drawn from hashes of the element, the cell and the dart's number alone. A set takes
    the darts below its elements' weights and of ranks up to its ``scale`` over its total weight.
    """
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    own = np.repeat(np.arange(len(sets)), sizes)
    w = np.concatenate(weights).astype(float) if weights else np.ones(len(x))
    most = scale / np.maximum(1e-12, np.bincount(own, w, len(sets)))
    out = np.full(len(sets) * k, np.iinfo(np.uint64).max, np.uint64)
    cell = 0
    while len(x):
        low, width = (0.0, 1.0) if cell == 0 else (2.0 ** (cell - 1), 2.0 ** (cell - 1))
        rank, number, live = np.zeros(len(x)), 0, np.arange(len(x))
        while len(live):
            e = mix(mix(x[live] + np.uint64(cell * 0x9E37 + 1)) + np.uint64(number + 1))
            u = ((e >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
            r = rank[live] - np.log(u) / width
            rank[live] = r
            near = r <= most[own[live]]
            live, e, r = live[near], e[near], r[near]
            if width > 1 or weights:
                hit = low + width * ((mix(e + np.uint64(7)) >> np.uint64(11)).astype(float) * 2.0**-53) < w[live]
            else:
                hit = slice(None)
            dart, o = mix(e + np.uint64(3)), own[live]
            value = (r.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart >> np.uint64(32))
            at = o * k + (dart & np.uint64(0xFFFFFFFF)).astype(np.int64) % k
            np.minimum.at(out, at[hit], value[hit])
            number += 1
        cell += 1
        on = w > (2.0 ** (cell - 1))
        x, own, w = x[on], own[on], w[on]
    return out.reshape(len(sets), k)


def signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """(sets, k) 32-bit darts. k ln k + 2 k darts are expected at first; sets with an empty coordinate throw twice as far again."""
    out = np.zeros((len(sets), k), np.uint32)
    todo = np.array([i for i, s in enumerate(sets) if len(s)], int)
    scale = k * math.log(k) + 2 * k
    while len(todo):
        got = throw([sets[i] for i in todo], [weights[i] for i in todo] if weights else None, k, np.full(len(todo), scale))
        full = (got != np.iinfo(np.uint64).max).all(1)
        out[todo[full]] = (got[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        todo, scale = todo[~full], 2 * scale
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(sets, bands) 64-bit keys, one band's never equal another's but by a hash collision."""
    rows = sig.shape[1] // bands
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        key = mix(key * np.uint64(31) + sig[:, r::rows][:, :bands].astype(np.uint64) + np.uint64(1))
    return key.view(np.int64)


def parities(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, bits: int = 1024) -> np.ndarray:
    """(sets, bits / 64) words: how many elements, by count, fall on each bit, modulo 2. One element more or less flips one bit."""
    out = np.zeros((len(sets), bits), np.uint8)
    for i, s in enumerate(sets):
        at = (mix(s + np.uint64(11)) >> np.uint64(40)).astype(np.int64) % bits
        out[i] = np.bincount(at, weights[i] if weights else None, bits).astype(np.int64) & 1
    return np.packbits(out, axis=1).view(np.int64)


def text_key(text: Column) -> Column:
    """A text's node: 128 bits of SHA-256 of its lower-cased form."""
    return F.unhex(F.substring(F.sha2(F.lower(F.coalesce(text, F.lit(""))), 256), 1, 32))


def _sign(counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 2 << 20):
            got = shingles(part.column(1), counted=counted)
            sets, weights = ([g[0] for g in got], [g[1] for g in got]) if counted else (got, None)
            n = [int(g.sum()) for g in weights] if weights else [len(g) for g in sets]
            keys = band_keys(signatures(sets, weights))
            some = [list(map(int, row)) if m else [] for row, m in zip(keys, n, strict=True)]
            yield pa.RecordBatch.from_pydict({"node": part.column(0), "n": pa.array(n, pa.int64()), "bands": pa.array(some, pa.list_(pa.int64())), "parity": pa.array(parities(sets, weights).tolist(), pa.list_(pa.int64()))})

    return run


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending distinct arrays; 0 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser over sum of the greater counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    less = int(np.minimum(a[1][i], b[1][j]).sum())
    return less / (int(a[1].sum()) + int(b[1].sum()) - less) if less else 0.0


def _verify(least: float, counted: bool):
    """Pairs (a, b) whose texts ta and tb are alike; a text that repeats in a batch is cut into shingles once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = weighted_similarity if counted else similarity
        for rb in sliced(batches):
            sides = []
            for k in (2, 3):
                d = rb.column(k).dictionary_encode()
                of = shingles(d.dictionary, counted=counted)
                sides.append([of[i] for i in d.indices.to_pylist()])
            yield rb.select([0, 1]).filter(pa.array([same(a, b) >= least for a, b in zip(*sides, strict=True)], pa.bool_()))

    return run


def verified(pairs: DataFrame, signed: DataFrame, texts: DataFrame, least: float, counted: bool, cut: Cuts) -> DataFrame:
    """Those pairs (a, b) of nodes whose texts are at least so similar, each computed once from both whole texts.

    Texts are fetched only for pairs that sizes and parity maps leave possible. The text of the node with fewer pairs travels
    with the pair and the other's meets it there, so a hub's text is not copied for each of its pairs.
    """
    side = lambda c, n, p: signed.select(F.col("node").alias(c), F.col("n").alias(n), F.col("parity").alias(p))
    pairs = cut(pairs.join(side("a", "na", "pa"), "a").join(side("b", "n", "parity"), "b").filter(_possible(least)).select("a", "b"))
    if not pairs.limit(1).count():
        return pairs
    used = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("k")))
    few = near(used)
    t = cut(texts.join(few.select("node"), "node", "left_semi").groupBy("node").agg(F.first("t").alias("t")), "zstd")
    of = lambda c: few.select(F.col("node").alias(c), F.col("k").alias(f"k{c}"))
    two = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("turn", F.col("ka") > F.col("kb"))
    two = two.select(F.when(F.col("turn"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("turn"), F.col("a")).otherwise(F.col("b")).alias("b"))
    two = two.join(t.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
    two = two.join(t.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    out = cut(two.select("a", "b", "ta", "tb").mapInArrow(_verify(least, counted), "a binary, b binary"))
    cut.drop(pairs, used, t)
    return out


def components(links: DataFrame, cut: Cuts) -> DataFrame:
    """(node, label), the least node of each component with a link: large-star and small-star steps until nothing changes.

    Every step is a grouped minimum, summed map-side, and a join that deals out a hub's neighbours; each round's edges are
    written to the shared folder, and only their number and digest come to the driver.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        return both.filter("v > u").join(low, "u").filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def little(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = cut(down.groupBy("u").agg(F.min("v").alias("m")))
        moved = down.join(low, "u").filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.union(low.select(F.col("u"), F.col("m"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())

    before, mine = None, False
    while (now := state(links)) != before and now[0]:
        before, last = now, links
        wide = cut(large(links))
        links = cut(little(wide))
        cut.drop(wide, *[last] * mine)
        mine = True
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).union(links.select("b", "b").distinct())


def _sized(least: float) -> Column:
    """Sizes n and na are near enough for a similarity of ``least``."""
    return F.least("na", "n") >= F.greatest("na", "n") * F.lit(least)


def _apart(a: str, b: str) -> Column:
    """Bits in which two parity maps differ: at most the size of the sets' difference."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def _possible(least: float) -> Column:
    """Whether sets of sizes n and na may be ``least`` similar: then they differ in (1 - least) / (1 + least) of both at most."""
    return _apart("pa", "parity") <= (F.col("n") + F.col("na")) * F.lit((1 - least) / (1 + least)) + F.lit(1e-9)


def _ordered(met: DataFrame) -> DataFrame:
    """Each pair of a and node once, as a < b."""
    return met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame, cut: Cuts) -> DataFrame:
    """Labels after more links: the links join labels, and the labels' components rename them."""
    if not links.limit(1).count():
        return labels
    alone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    every = cut(labels.union(alone.select("node", F.col("node").alias("label"))))
    of = lambda c: every.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    between = cut(links.join(of("a"), "a").join(of("b"), "b").filter("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    renamed = cut(components(between, cut)).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return cut(every.join(renamed, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def _rung(n: str, least: float) -> Column:
    """The rung of a size on a ladder of ratio ``least``: sizes that may belong together are on one rung or on neighbours."""
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(-math.log(least)) + F.lit(1e-9)).cast("int")


def labelled(docs: DataFrame, id_col: str, text_col: str, least: float, weighting: str, cut: Cuts) -> DataFrame:
    """(i, node, label) of every row: its id, its text's node and its class's least node."""
    counted = weighting == "count"
    rows = docs.select(column(id_col).alias("i"), text_key(column(text_col)).alias("node"))
    texts = docs.select(text_key(column(text_col)).alias("node"), text_of(text_col).alias("t"))
    raw = cut(texts.mapInArrow(_sign(counted), "node binary, n long, bands array<long>, parity array<long>"))
    signed = cut(raw.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("parity").alias("parity")))
    cut.drop(raw)
    all_members = cut(signed.select("node", "n", F.explode("bands").alias("key")))
    ends = all_members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lo"), F.max(F.struct("node", "n")).alias("hi")).filter("lo != hi")
    pivots = cut(ends.select("key", F.explode(F.array("lo", "hi")).alias("p")).select("key", F.col("p.node").alias("a"), F.col("p.n").alias("na")))
    members = cut(all_members.join(pivots.select("key").distinct(), "key", "left_semi"))
    cut.drop(all_members)
    pairs = cut(_ordered(members.join(pivots, "key").filter("node != a").filter(_sized(least))))
    links = verified(pairs, signed, texts, least, counted, cut)
    labels = cut(components(links, cut))
    cut.drop(pivots)

    for seed in [*range(SAMPLES), None]:
        named = cut(members.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label")))
        mixed = cut(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key"))
        if not mixed.limit(1).count():  # every bucket is one class
            break
        still = cut(named.join(mixed, "key", "left_semi"))
        major = still.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "label")).alias("m")).select("key", F.col("m.label").alias("major"))
        open_ = cut(still.join(cut(major), "key"))
        cut.drop(named, mixed, still)
        minor = open_.filter("label != major").select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
        others = open_.select("key", "node", "n", "label")
        if seed is not None:
            drawn = [F.min_by(F.struct("node", "n", "label"), F.xxhash64("node", "key", F.lit(DRAWN * seed + k))) for k in range(DRAWN)]
            others = open_.filter("label = major").groupBy("key").agg(F.array_distinct(F.array(*drawn)).alias("d")).select("key", F.explode("d").alias("d")).select("key", "d.*")
            met = minor.join(cut(others), "key").filter("label != la").filter(_sized(least))
        else:  # every pair that is left, but for those that sizes, by their rungs in the join's key, and parities rule out
            maps = signed.select("node", "parity")
            minor = cut(minor.join(maps.select(F.col("node").alias("a"), F.col("parity").alias("pa")), "a"))
            others = cut(others.join(maps, "node").withColumn("rung", _rung("n", least)))
            up = _rung("na", least)
            minor = minor.withColumn("rung", F.explode(F.array(up - 1, up, up + 1)))
            met = minor.join(others, ["key", "rung"]).filter("label != la").filter(_sized(least)).filter(_possible(least))
        new = cut(_ordered(met).join(pairs, ["a", "b"], "left_anti"))
        more = verified(new, signed, texts, least, counted, cut)
        pairs = pairs.union(new)
        labels = _merged(labels, more, cut)

    return cut(rows.join(labels, "node", "left").select("i", "node", F.coalesce("label", "node").alias("label")))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, weighting: str = "set") -> DataFrame:
    """One row per input row: its id, class_id (the least id of its class), class_size, kept and class_key.

    Rows are in one class if a chain of texts of similarity ``least`` or more on five-word shingles leads from one to the
    other; identical texts (but for letter case) always are, empty ones too. ``weighting`` is "set" (every shingle weighs 1) or
    "count" (as often as it occurs). A null text is empty; texts without words have no shingles and equal only each other.
    ``kept`` is true for the row of the least id (null ids rank last; of repeated rows of that id, all say so and share a class_key).

    Copies are one node from the start. In each band's bucket all nodes are tested against the bucket's least and greatest.
    After that only nodes whose classes still differ meet: those outside the bucket's largest class, first some rounds against
    a few drawn from that class, so that what belongs to it joins it at a few tests a member, and then against all the rest.
    So every pair that shares a bucket ends in one class or has been tested. Only the two columns named are read.
    """
    cut = Cuts(docs.select(column(id_col), column(text_col)))
    rows = labelled(docs, id_col, text_col, least, weighting, cut)
    groups = cut(rows.groupBy("label").agg(F.min("i").alias("least"), F.count(F.lit(1)).alias("class_size")))
    out = rows.join(groups, "label")
    return cut.done(out.select(F.col("i").alias(id_col), F.col("least").alias("class_id"), "class_size", F.col("i").eqNullSafe(F.col("least")).alias("kept"), F.lower(F.hex("label")).alias("class_key")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, weighting: str = "set") -> DataFrame:
    """The input's rows, all columns, one of each class of near_classes: that of the least id (nulls last); of repeated rows, one.

    Columns of any name pass through. A null text is empty, and all empty texts are one class. Of rows that tie (one id, one
    text) any one stays. An empty table gives an empty result. A keyed semi-join picks the rows, so only this join moves texts.
    """
    cut = Cuts(docs)
    rows = labelled(docs, id_col, text_col, least, weighting, cut)
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("i").isNull().alias("z"), "i", "node")).alias("f"))
    first = cut(first.select(*key_of(F.col("f.i")), F.col("f.node").alias("node")))
    keyed = docs.select(whole(docs), *key_of(column(id_col)), text_key(column(text_col)).alias("node"))
    out = keyed.join(near(first), ["k1", "k2", "node"], "left_semi").dropDuplicates(["k1", "k2", "node"])
    return cut.done(out.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
