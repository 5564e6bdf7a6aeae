"""Operator 8: secret scanning by character Markov models beside fixed patterns (native)."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Cuts, column, let, text_of

#: The base patterns (Java and RE2 read them alike), in the order of the kinds.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ of 32 and more: a run is taken whole, so the shorter ones only fall away
#: Candidates of the Markov test: runs of characters that keys and identifiers are made of.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: Labelled samples: what ordinary identifiers and words are put together from, in English, German, French, Spanish and Italian.
PARTS = """account active address after agent amount archive array author average backup balance before binary block border branch
bucket buffer button cache calendar cancel category change channel character check client cluster collection column command
comment common component config connection constant container content context control count create current customer database
default delivery description detail device directory display document domain download driver editor element enable engine
environment error event example exception export factory feature field filter folder format function generate global handler
height history identifier image import index information input install interface invoice iterator journal keyboard language
layout length library location manager message method module network number object option package parameter password payment
permission picture policy position process product project property protocol question record reference request response
Entwicklung Gesellschaft Verwaltung Geschwindigkeit Zusammenfassung Krankenhaus Wissenschaft Freundschaft Bedingungen Rechnung
Schule Zeitung Strasse Versicherung Ausbildung gouvernement recherche traitement anciennement directeur utilisateur bibliotheque
developpement toujours beaucoup adresse vraisemblable mouvement conocimiento desarrollo universidad responsable trabajadores
internacional administracion usuario biblioteca mensaje palabra direzione conoscenza amministrazione messaggio biblioteche""".split()
#: Labelled samples: alphabets that keys are drawn from, by their names.
DIGITS, SMALL, LARGE = "0123456789", LOWER, UPPER
ALPHABETS = {"base64": LARGE + SMALL + DIGITS + "+/", "base62": LARGE + SMALL + DIGITS, "lower36": SMALL + DIGITS, "upper36": LARGE + DIGITS, "lower": SMALL, "upper": LARGE, "letters": LARGE + SMALL}


def default_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled strings (text, label): ``ordinary`` ones put together from PARTS, and random ones of each alphabet by its name.

    ``n`` strings of either sort, a fixed bound, drawn by hashes of their numbers; nothing of any corpus is read.
    """
    i = F.col("id")
    parts = F.array(*[F.lit(x) for x in PARTS])
    at = lambda k: F.lower(F.get(parts, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(PARTS))).cast("int")))
    four = [at(k) for k in range(4)]
    style = F.pmod(F.xxhash64(i, F.lit("style")), F.lit(8))
    number = F.pmod(F.xxhash64(i, F.lit("number")), F.lit(10**9)).cast("string")
    plain = (
        F.when(style == 0, F.concat_ws("_", *four))
        .when(style == 1, F.concat(four[0], *[F.initcap(x) for x in four[1:]]))
        .when(style == 2, F.upper(F.concat_ws("_", *four)))
        .when(style == 3, F.concat_ws("/", *four))
        .when(style == 4, F.concat_ws("-", four[0], four[1], number))
        .when(style == 5, F.concat(number, number, F.lit("00")))
        .when(style == 6, F.initcap(F.concat(*four)))
        .otherwise(F.concat(*four))
    )
    ids, each = spark.range(0, n, 1, 1), -(-n // len(ALPHABETS))
    out = ids.select(plain.alias("text"), F.lit("ordinary").alias("label"))
    for name, alphabet in ALPHABETS.items():
        drawn = [F.substring(F.lit(alphabet), F.pmod(F.xxhash64(i, F.lit(name), F.lit(k)), F.lit(len(alphabet))).cast("int") + 1, F.lit(1)) for k in range(32)]
        out = out.unionByName(spark.range(0, each, 1, 1).select(F.concat(*drawn).alias("text"), F.lit(name).alias("label")))
    return out


def train(samples: DataFrame) -> dict[str, list[float]]:
    """Of each label but ``ordinary``, log-likelihood ratios of character pairs over ordinary, indexed by 128 * first + second.

    First-order Markov chains over ASCII, from the pair counts of the labelled samples; a pair's probability is mixed from its
    own count, its second character's share of the chain, and a uniform floor. A null string or label, a string of less than
    two characters and pairs beyond ASCII teach nothing; a label without pairs, and an empty table, give the floor. At most
    128 * 128 counts a label are collected.
    """
    d = samples.filter("text is not null and label is not null")
    pairs = d.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda k: F.substring("text", k, F.lit(2)))).alias("p"))
    pairs = pairs.filter(F.length("p") == 2).groupBy("label", F.ascii("p").alias("a"), F.ascii(F.substring("p", 2, 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, dict[tuple[int, int], int]] = {"ordinary": {}}
    for r in pairs.filter("a < 128 and b < 128").collect():
        counts.setdefault(r["label"], {})[r["a"], r["b"]] = r["n"]

    def chain(label: str) -> list[float]:
        first, second = [0] * 128, [0] * 128
        for (a, b), n in counts[label].items():
            first[a] += n
            second[b] += n
        total = sum(second) or 1
        return [0.75 * counts[label].get((a, b), 0) / (first[a] or 1) + 0.23 * second[b] / total + 0.02 / 95 for a in range(128) for b in range(128)]

    plain = chain("ordinary")
    return {label: [round(math.log(x / y), 4) for x, y in zip(chain(label), plain, strict=True)] for label in sorted(counts) if label != "ordinary"}


def ratio(text: Column, table: Column) -> Column:
    """The greatest sum, over the labels' tables, of the pairs' log-likelihood ratios along an ASCII string."""
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c))
    along = lambda c, t: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda acc, k: acc + F.get(t, F.get(c, k - 1) * 128 + F.get(c, k)))
    return let(codes, lambda c: F.when(F.size(c) > 1, F.array_max(F.transform(table, lambda t: along(c, t)))).otherwise(F.lit(0.0)))


_SPANS = "array<struct<s:int,k:int,e:int>>"


def running(lengths: Column) -> Column:
    """Of an integer array, the sums before each place: in runs of the root of its size, so n of them cost n times that root."""

    def runs(x):
        w = F.ceil(F.sqrt(F.size(x))).cast("int")
        total = lambda a: F.aggregate(a, F.lit(0), lambda acc, y: acc + y)
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / w).cast("int")), lambda k: F.slice(x, k * w + 1, w))
        sums = lambda p: F.transform(p, total)
        inner = lambda part, base: F.transform(part, lambda _, i: base + total(F.slice(part, F.lit(1), i)))
        both = lambda p: let(sums(p), lambda q: F.flatten(F.transform(p, lambda part, k: inner(part, total(F.slice(q, F.lit(1), k))))))
        return let(parts, both)

    return F.when(F.size(lengths) > 0, let(lengths, runs)).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans (s, k, e) of a pattern's matches that ``keep`` accepts; places come from the lengths of pieces and matches.

    Splitting at a pattern and extracting it walk the same leftmost non-overlapping matches, in time linear in the text.
    """

    def placed(x):
        steps = F.zip_with(F.slice(x["p"], F.lit(1), F.size(x["f"])), x["f"], lambda p, f: F.length(p) + F.length(f))
        of = lambda ends: F.transform(
            F.sequence(F.lit(0), F.size(x["f"]) - 1),
            lambda k: F.when(keep(F.get(x["f"], k), F.get(x["m"], k)), let(F.get(ends, k) + F.length(F.get(x["p"], k)), lambda s: F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + F.length(F.get(x["f"], k))).alias("e")))),
        )
        return F.filter(let(running(steps), of), lambda y: y.isNotNull()).cast(_SPANS)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(F.split(text, pattern, -1).alias("p"), found.alias("f"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == 0 else found).alias("m"))
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(F.array().cast(_SPANS))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None, threshold: float = 12.0, least: int = 20) -> DataFrame:
    """One row per input row: its id, base and added spans as arrays of (s, k, e), places in code points, end exclusive.

    Base spans are the three patterns' matches that are long enough. A run of ``least`` and more key characters that overlaps
    none of them is added where a random string, of any alphabet of the samples, explains it better than an ordinary identifier
    does, by a log-likelihood ratio above ``threshold``. A null text is empty and has no spans; repeated rows give the same
    spans each; an empty table gives an empty result; a null id is kept; other columns are not read. The scan is one narrow
    stage, whatever the skew; only the spans found are written.
    """
    cut = Cuts(docs.select(column(id_col), column(text_col)))
    tables = train(samples if samples is not None else default_samples(docs.sparkSession))
    table = F.from_json(F.lit(json.dumps(list(tables.values()))), "array<array<double>>")
    d = docs.select(column(id_col).alias("id"), text_of(text_col).alias("t"))
    t = F.col("t")
    base = F.concat(_spans(t, ASSIGN, 0, lambda m, v: F.length(v) >= 8), _spans(t, ACCESS, 1, lambda m, v: F.length(m) >= 16), _spans(t, HEX, 2, lambda m, v: F.length(m) >= 32))
    more = _spans(t, CANDIDATE.replace("20", str(least)), 3, lambda m, v: ratio(m, table) > threshold)
    spans = cut(d.select("id", base.alias("base"), more.alias("more")))
    apart = lambda m: ~F.exists("base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"]))
    return cut.done(spans.select(F.col("id").alias(id_col), F.array_sort("base").alias("base"), F.filter("more", apart).alias("added")))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
