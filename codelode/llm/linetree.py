"""Operator 4: line deduplication by a log-template tree."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Cuts, column, key_of, let, near, sliced, text_of, whole
from .dart import shingles, similarity

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Leading tokens on the path to a leaf; fields that a longer line is divided into; the share of a line's fields that may vary.
DEPTH, FIELDS, VARIES = 3, 8, 0.25
#: Similarity on five-word shingles from which a text is a copy of another; characters in shared templates from which that is looked at.
COPY, SHARED = 0.8, 0.2
_SPACE = r"[\x20\x09-\x0D]+"
_NUMBER = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*"
_F = [f"f{k}" for k in range(FIELDS)]


def parse(docs: DataFrame, id_col: str, text_col: str, cut: Cuts) -> DataFrame:
    """The lines that hold a token: their text's key, place and size, the masked line's key, its leaf and its fields' keys.

    A token with a digit is masked as variable, where these are a quarter of the line's tokens at most. The leaf is the token count and the leading tokens, each masked alike. A line
    of FIELDS tokens and more is divided into FIELDS runs of tokens; a shorter one has its tokens as fields.
    """
    few = lambda c: c.rlike("[0-9]") & (F.regexp_count(c, F.lit(_NUMBER)) <= F.regexp_count(c, F.lit(WORD)) * VARIES)
    masked = lambda c: F.when(few(c), F.regexp_replace(c, _NUMBER, "<*>")).otherwise(c)
    text = text_of(text_col)
    d = docs.select(column(id_col).alias("doc"), *key_of(text), F.length(text).alias("size"), text.alias("t"))  # once a text, not once a line
    d = d.select("doc", "k1", "k2", "size", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    tokens = F.split(F.btrim(masked(F.col("line")), F.lit(" \t\n\x0b\f\r")), _SPACE)

    def parsed(t):
        n = F.size(t)
        edge = lambda k: F.shiftright(n * k, FIELDS.bit_length() - 1)  # noqa: E731  of n tokens in FIELDS, a power of two, runs
        run = lambda k: F.when(n >= FIELDS, F.slice(t, edge(k) + 1, edge(k + 1) - edge(k))).otherwise(F.slice(t, k + 1, 1))
        fields = [F.when(n > k, F.xxhash64(run(k))).alias(c) for k, c in enumerate(_F)]
        return F.struct(F.when(F.get(t, F.lit(0)) == "", 0).otherwise(n).alias("n"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit("second"), t).alias("h2"), F.xxhash64(n, F.slice(t, 1, DEPTH)).alias("leaf"), *fields)

    place = ["doc", "k1", "k2", "size", "pos"]
    lines = d.select(*place, F.length("line").alias("chars"), let(tokens, parsed).alias("x")).select(*place, "chars", "x.*")
    # filtered after it is written: a filter below would parse every line a second time
    return cut(lines).filter("n > 0")


#: SQL: the first field that may vary (those before it hold leading tokens only), and how many may.
_FIRST = f"CASE WHEN n < {FIELDS} THEN {DEPTH} ELSE CAST(ceil({(DEPTH + 1) * FIELDS} / n) AS INT) - 1 END"
_MAY = f"CASE WHEN n < {FIELDS} THEN 1 ELSE {int(FIELDS * VARIES)} END"


def _groups() -> Column:
    """Keys of groups of fields, one more than may vary: lines of one template agree in one group at least (of n, leaf, first, may)."""
    of = lambda g, k, c: f"CASE WHEN pmod({k} - first, may + 1) = {g} THEN {c} END"
    keys = [f"CASE WHEN {g} <= may THEN xxhash64(leaf, {g}, {', '.join(of(g, k, c) for k, c in enumerate(_F))}) END" for g in range(int(FIELDS * VARIES) + 1)]
    return F.expr(f"filter(array({', '.join(keys)}), x -> x IS NOT NULL)")


def _patterns() -> Column:
    """Keys of a line's templates: its fields without a quarter of them, in every way that leaves the leading tokens (of n, leaf, first)."""
    keys = []
    for out in [*itertools.combinations(range(FIELDS), int(FIELDS * VARIES)), *[(k,) for k in range(DEPTH, FIELDS - 1)]]:
        fixed = ", ".join(c for k, c in enumerate(_F) if k not in out)
        own = f"n >= {FIELDS} AND first <= {out[0]}" if len(out) > 1 else f"n < {FIELDS} AND n > {out[0]}"
        name = "'" + "-".join(map(str, out)) + "'"
        keys.append(f"CASE WHEN {own} THEN named_struct('p1', xxhash64(leaf, {name}, {fixed}), 'p2', xxhash64({name}, {fixed}, leaf)) END")
    return F.expr(f"filter(array({', '.join(keys)}), x -> x IS NOT NULL)")


def templates(lines: DataFrame, cut: Cuts) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, p1, p2): the templates, shared by several texts or several different lines, of every line; and the lines in their leaves.

    A template is named by the set of its masked lines. Only leaves that two texts share are looked at, and of their lines
    only those that agree with another in a whole group of fields are spelled out in all their patterns.
    """
    two = lambda c: F.min(c) != F.max(c)
    leaves = cut(lines.groupBy("leaf").agg(two("k1").alias("on")).filter("on").select("leaf"))
    some = cut(lines.join(near(leaves), "leaf", "left_semi"))
    kinds = cut(some.groupBy("h1", "h2").agg(F.min("n").alias("n"), F.min("leaf").alias("leaf"), *[F.min(c).alias(c) for c in _F], two("k1").alias("again")))
    long = kinds.filter(F.col("n") > DEPTH).selectExpr("*", f"{_FIRST} AS first", f"{_MAY} AS may")
    groups = long.select("h1", "h2", F.explode(_groups()).alias("g"))
    agree = groups.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("g")
    alike = groups.join(agree, "g", "left_semi").select("h1", "h2").distinct()
    spelled = cut(long.join(alike, ["h1", "h2"], "left_semi").select("h1", "h2", F.explode(_patterns()).alias("p")).select("h1", "h2", "p.*"))
    sets = spelled.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("m"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2")).filter("m > 1")
    named = spelled.join(sets, ["p1", "p2"]).select("h1", "h2", F.xxhash64("m", "x1", "x2").alias("p1"), F.xxhash64("x2", "x1", "m").alias("p2")).distinct()
    own = kinds.filter("again").select("h1", "h2", F.col("h1").alias("p1"), F.col("h2").alias("p2"))
    found = cut(named.union(own))
    cut.drop(leaves, kinds, spelled)
    return found, some


def _same(least: float):
    """Pairs (k1, k2, f1, f2, w) whose texts t and ft are alike; a text that repeats in a batch is cut into shingles once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in sliced(batches):
            sets = []
            for name in ("t", "ft"):
                d = rb.column(rb.schema.get_field_index(name)).dictionary_encode()
                of = shingles(d.dictionary)
                sets.append([of[k] for k in d.indices.to_pylist()])
            keep = pa.array([similarity(a, b) >= least for a, b in zip(*sets, strict=True)], pa.bool_())
            yield rb.select(["k1", "k2", "f1", "f2", "w"]).filter(keep)

    return run


def copies(docs: DataFrame, text_col: str, at: DataFrame, cut: Cuts) -> DataFrame:
    """(k1, k2, r1, r2): of each text that is a near copy of an earlier one, the first text of its chain of copies.

    A text is held against the texts where its lines' templates first occur, as far as they share SHARED of the longer one's
    characters that way: a few pairs for each text. It is a copy where both whole texts are COPY similar.
    """
    line = at.groupBy("k1", "k2", "pos").agg(F.min("first").alias("f"), F.max("chars").alias("chars"), F.max("size").alias("size"))
    pairs = line.filter("not (k1 = f.k1 and k2 = f.k2)").groupBy("k1", "k2", F.col("f.k1").alias("f1"), F.col("f.k2").alias("f2")).agg(F.sum("chars").alias("w"), F.max("size").alias("s"), F.max("f.size").alias("fs"))
    pairs = cut(pairs.filter(F.col("w") >= SHARED * F.greatest("s", "fs")).select("k1", "k2", "f1", "f2", "w"))
    used = cut(pairs.select(F.explode(F.array(F.struct("k1", "k2"), F.struct(F.col("f1").alias("k1"), F.col("f2").alias("k2")))).alias("x")).select("x.*").distinct())
    texts = docs.select(*key_of(text_of(text_col)), text_of(text_col).alias("t")).join(near(used), ["k1", "k2"], "left_semi")
    texts = cut(texts.groupBy("k1", "k2").agg(F.first("t").alias("t")), "zstd")
    two = pairs.join(texts, ["k1", "k2"]).join(texts.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("t").alias("ft")), ["f1", "f2"])
    same = two.select("k1", "k2", "f1", "f2", "w", "t", "ft").mapInArrow(_same(COPY), "k1 long, k2 long, f1 long, f2 long, w long")
    of = at.select("k1", "k2", "z", "doc").distinct().groupBy("k1", "k2").agg(F.min(F.struct("z", "doc")).alias("p"))
    same = same.join(of.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), "p"), ["f1", "f2"])
    up = cut(same.groupBy("k1", "k2").agg(F.min(F.struct((-F.col("w")).alias("w"), "p", "f1", "f2")).alias("m")).select("k1", "k2", F.col("m.f1").alias("r1"), F.col("m.f2").alias("r2")))
    cut.drop(pairs, used, texts)
    for _ in range(64):  # every text's first copy comes before it, so chains end; each round halves them
        higher = up.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("r1").alias("u1"), F.col("r2").alias("u2"))
        if not up.join(higher, ["r1", "r2"]).limit(1).count():
            break
        last, up = up, cut(up.join(higher, ["r1", "r2"], "left").select("k1", "k2", F.coalesce("u1", "r1").alias("r1"), F.coalesce("u2", "r2").alias("r2")))
        cut.drop(last)
    return up


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 2, cut: Cuts | None = None) -> DataFrame:
    """(k1, k2, dropped): of each text, by its key, the numbers of the lines to drop.

    Two lines have one template if they have as many tokens, the same leading tokens and at most a quarter of their fields
    differ (tokens with digits, a quarter of a line's at most, count as equal). A template recurs if it occurs in ``least_docs`` texts and more, where a text and its exact and near copies are one.
    It stays at its first place (lowest id, nulls last, then line number), in the copies of that text at theirs, and goes elsewhere.
    """
    cut = cut or Cuts(docs)
    lines = parse(docs, id_col, text_col, cut)
    found, some = templates(lines, cut)
    at = some.join(near(found), ["h1", "h2"]).withColumn("z", F.col("doc").isNull())
    at = cut(at.groupBy("p1", "p2", "k1", "k2", "pos").agg(F.min(F.struct("z", "doc")).alias("d"), F.max("size").alias("size"), F.max("chars").alias("chars")).select("p1", "p2", "k1", "k2", "pos", "d.z", "d.doc", "size", "chars"))
    place = F.struct("z", "doc", "k1", "k2", "size")
    firsts = cut(at.groupBy("p1", "p2").agg(F.min(place).alias("first"), (F.min("k1") != F.max("k1")).alias("on")).filter("on").drop("on"))
    up = copies(docs, text_col, at.join(near(firsts), ["p1", "p2"]), cut)
    classed = at.join(near(up), ["k1", "k2"], "left").select("p1", "p2", "k1", "k2", "pos", "z", "doc", F.coalesce("r1", "k1").alias("c1"), F.coalesce("r2", "k2").alias("c2"))
    per = classed.groupBy("p1", "p2", "c1", "c2").agg(F.min(F.struct("z", "doc", "k1", "k2")).alias("first"))
    again = per.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("first", "c1", "c2")).alias("f")).filter(F.col("m") >= least_docs)
    again = cut(again.select("p1", "p2", F.col("f.c1").alias("g1"), F.col("f.c2").alias("g2")))
    own = classed.groupBy("p1", "p2", "k1", "k2").agg(F.min("pos").alias("own"))
    gone = classed.join(near(again), ["p1", "p2"]).join(own, ["p1", "p2", "k1", "k2"]).filter("not (c1 = g1 and c2 = g2 and pos = own)")
    return cut(gone.select("k1", "k2", "pos").distinct().groupBy("k1", "k2").agg(F.collect_list("pos").alias("dropped")))


def _without(text: Column, dropped: Column) -> Column:
    """A text without the lines of these numbers."""
    rows = F.split(text, "\n")
    stay = lambda r: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(r) - 1), dropped), lambda k: F.get(r, k)), "\n")
    return F.when(dropped.isNull(), text).otherwise(let(rows, stay))


def _deduped(docs: DataFrame, id_col: str, text_col: str, least_docs: int, never_empty: bool = False) -> tuple[DataFrame, Cuts]:
    """(row, text, n_lines, n_dropped) of every input row; with ``never_empty``, texts that would lose all their lines keep them."""
    cut = Cuts(docs)
    drop = recurring(docs, id_col, text_col, least_docs, cut)
    out = docs.select(whole(docs), column(text_col).alias("t"), *key_of(text_of(text_col))).join(near(drop), ["k1", "k2"], "left")
    if never_empty:
        rest = F.size(F.filter(F.split(text_of("t"), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")) > F.size("dropped")
        out = out.withColumn("dropped", F.when(rest, F.col("dropped")))
    lines = (F.length(text_of("t")) - F.length(F.replace(text_of("t"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    return out.select("row", _without(F.col("t"), F.col("dropped")).alias("text"), lines.alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped")), cut


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 2) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped and the text without its dropped lines (see ``recurring``).

    Lines end at a line feed; lines without a token never recur. A null text stays null (one line, none dropped), a text that
    loses all its lines is empty, and no row goes. Repeated rows and rows of one text lose the same lines. A null id comes
    last. An empty table gives an empty result; other columns are not read. A frequent line or leaf is summed map-side; lines
    meet templates in joins that Spark can split.
    """
    out, cut = _deduped(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), "id", "text", least_docs)
    return cut.done(out.select(F.col("row.id").alias(id_col), "n_lines", "n_dropped", "text"))


def rewrite_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", least_docs: int = 2, never_empty: bool = False) -> DataFrame:
    """The input's rows, all columns, with the texts that ``dedup_lines`` leaves; ``length_col``, where there is one, follows.

    Columns of any name pass through; the length changes only where lines went. With ``never_empty`` a text all of whose lines
    would go keeps them, so that no document is emptied. Else the same edge cases as in ``dedup_lines``.
    """
    out, cut = _deduped(docs, id_col, text_col, least_docs, never_empty)
    of = lambda c: F.col("text") if c == text_col else F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]) if c == length_col else F.col("row")[c]
    return cut.done(out.select(*[of(c).alias(c) for c in docs.columns]))
