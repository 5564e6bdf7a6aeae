"""Operator 7: language identification by hierarchical discrimination."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, crc_mod, sliced, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Families of languages; a language not named here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk".split(),
    "uralic": "fi et hu".split(),
    "indic": "hi mr ne bn pa gu ur".split(),
    "turkic": "tr az kk uz tk".split(),
    "semitic": "ar he am mt".split(),
}
DIM_BITS = 13
#: The share of a trigram that a language never had; its logarithm is the least familiarity.
UNSEEN = 1e-6
_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def family(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), f"={lang}")


def grams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the whole text, lower-cased, everything but letters made one space."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split()) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    return (((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(32 - DIM_BITS)).astype(np.int64)


def vector(text: str) -> np.ndarray:
    g = grams(text)
    return (np.bincount(g, minlength=1 << DIM_BITS) / max(1, len(g))).astype(np.float32)


def linear_svm(x1: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent over these rows of x1, whose last column is the bias' 1; y is +1 or -1. Deterministic."""
    norm, w, a = np.array([x1[r] @ x1[r] for r in rows]) + 1e-12, np.zeros(x1.shape[1], np.float32), np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            row = x1[rows[i]]
            step = min(max(a[i] + (1 - y[i] * float(row @ w)) / norm[i], 0.0), cost) - a[i]
            if step:
                a[i] += step
                w += np.float32(step * y[i]) * row
    return w[:-1], float(w[-1])


class Model:
    """Family classifiers (one against the rest), then a classifier for each pair of languages within a family."""

    def __init__(self, langs: list[str], x: np.ndarray, labels: np.ndarray):
        self.langs = langs
        self.families = sorted({family(k) for k in langs})
        self.members = [[i for i, k in enumerate(langs) if family(k) == f] for f in self.families]
        # the one copy of the texts' vectors, scaled, with the bias' column; the driver has little memory
        x1 = np.ones((len(x), x.shape[1] + 1), np.float32)
        x1[:, :-1] = x
        x = x1[:, :-1]
        scale = float(1 / max(1e-9, np.mean([np.sqrt(v @ v) for v in x]))) if len(x) else 1.0
        x *= np.float32(scale)
        every, columns = np.arange(len(x)), []
        fam = np.array([self.families.index(family(langs[i])) for i in labels], int)
        for f in range(len(self.families)):
            columns.append(linear_svm(x1, every, np.where(fam == f, 1.0, -1.0)) if len(self.families) > 1 else (np.zeros(x.shape[1], np.float32), 1.0))
        self.pairs = [(a, b) for m in self.members for k, a in enumerate(m) for b in m[k + 1 :]]
        for a, b in self.pairs:
            on = (labels == a) | (labels == b)
            columns.append(linear_svm(x1, every[on], np.where(labels[on] == a, 1.0, -1.0)))
        self.weights = np.stack([w for w, _ in columns], 1) * np.float32(scale) if columns else np.zeros((1 << DIM_BITS, 0), np.float32)
        self.bias = np.array([b for _, b in columns])
        share = lambda on: np.stack([x[on & (labels == k)].sum(0) / scale / max(1, (on & (labels == k)).sum()) for k in range(len(langs))], 1)
        held = np.arange(len(x)) % 4 == 3
        self.shares = np.log(share(np.ones(len(x), bool)) + UNSEEN).astype(np.float32) if langs else np.zeros((1 << DIM_BITS, 1), np.float32)
        least = (x[held] / scale @ np.log(share(~held) + UNSEEN)).max(1).min() if held.any() else None
        #: Halfway between the least familiarity of the held-out quarter and that of a text of unseen trigrams.
        self.bound = -np.inf if least is None else float((least + np.log(UNSEEN)) / 2)

    def familiar(self, text: str | None) -> float:
        """Mean log share of the text's trigrams in the language where it is greatest: low where no language is known."""
        g = grams(text or "")
        total = sum((self.shares[g[i : i + 65536]].sum(0, dtype=np.float64) for i in range(0, len(g), 65536)), np.zeros(self.shares.shape[1]))
        return float(total.max() / len(g)) if len(g) else float(np.log(UNSEEN))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):  # Unicode's letters: no ², ½ or Ⅷ
            return "und", 0.0
        g = grams(text)
        # grams are summed in blocks, so that a very long text needs no more memory than a short one
        total = sum((self.weights[g[i : i + 65536]].sum(0, dtype=np.float64) for i in range(0, len(g), 65536)), np.zeros(len(self.bias)))
        m = total / max(1, len(g)) + self.bias
        nf = len(self.families)
        f = int(np.argmax(m[:nf]))
        rest = np.delete(m[:nf], f)
        sure = 1 / (1 + np.exp(-2.0 * (m[f] - rest.max()))) if nf > 1 else 1.0
        members = self.members[f]
        votes = dict.fromkeys(members, 0.0)
        least = dict.fromkeys(members, 1.0)
        for (a, b), d in zip(self.pairs, m[nf:], strict=True):
            if a in votes and b in votes:
                win, p = (a if d >= 0 else b), 1 / (1 + np.exp(-2.0 * d))
                votes[win] += 1 + 1e-6 * abs(float(d))
                least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        best = max(members, key=lambda k: (votes[k], -k))
        return self.langs[best], float(min(1.0, max(0.0, sure * least[best])))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 1600) -> Model:
    """Learn from labelled rows: about ``sample`` of them, equally many of each language, those of least id hash.

    The rows a language gives are found by counting it and then keeping a hash range; no task sorts a language. Each
    sampled text is read whole and becomes one vector of 2**13 trigram shares on its executor. Rows without a text or a
    language teach nothing; an empty table gives a model without languages. Rows that tie in their hash are taken in the order
    of their vectors, so the model does not depend on the order of rows. Only the three columns named are read.
    """
    d = docs.select(column(id_col).alias("i"), column(text_col).alias("t"), column(lang_col).alias("k")).filter("k is not null and t is not null")
    counts = {r["k"]: r["n"] for r in d.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, 1 << DIM_BITS), np.float32), np.zeros(0, int))
    each = max(20, sample // len(langs))
    top = 1 << 40
    h = F.pmod(F.xxhash64("i", F.length("t")), F.lit(top))
    limit = F.lit(0)
    for k in langs:
        limit = F.when(F.col("k") == k, F.lit(min(top, int(top * 1.5 * each / counts[k]) + 1))).otherwise(limit)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in sliced(batches):
            v = pa.array([vector(t.as_py()).astype(np.float16).tobytes() for t in rb.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), v], names=["k", "h", "v"])

    got = d.withColumn("h", h).filter(F.col("h") < limit).select("k", "h", "t").mapInArrow(vectors, "k string, h long, v binary").collect()
    got = sorted((langs.index(r["k"]), r["h"], bytes(r["v"])) for r in got)
    kept, seen = [], dict.fromkeys(range(len(langs)), 0)
    for k, _, v in got:
        if seen[k] < each:
            seen[k] += 1
            kept.append((k, v))
    x, labels = np.stack([np.frombuffer(v, np.float16) for _, v in kept]), np.array([k for k, _ in kept])
    del got, kept
    return Model(langs, x, labels)


def _said(docs: DataFrame, model: Model, carried, text_col: str, known: bool) -> DataFrame:
    """(row, lang_pred, score, known) of every row: ``carried`` as row, and whether the text is familiar enough, if ``known`` asks."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in sliced(batches):
            texts = [t.as_py() for t in rb.column(1)]
            said = [model.predict(t) for t in texts]
            fam = [model.familiar(t) >= model.bound if known else None for t in texts]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([k for k, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64()), pa.array(fam, pa.bool_())], names=["row", "lang_pred", "score", "known"])

    rows = docs.select(carried.alias("row"), column(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.BooleanType())])
    return rows.mapInArrow(predict, schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred and score of every row; ``und`` with score 0 where the text is null or has no letter.

    One narrow pass; texts of any length are read whole; a model without languages says ``und``; repeated rows, null ids
    and an empty table pass through; other columns are not read. The score is the family's and the closest pair's certainty
    multiplied: it weighs the learned languages against each other. Languages that tie go to the first by code point.
    """
    said = _said(docs, model, column(id_col), text_col, False)
    return said.select(F.col("row").alias(id_col), "lang_pred", "score")


def recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's rows, all columns, whose text has a letter and is as familiar as the model's bound at least.

    Null and empty texts go, and all rows where the model has no language. Columns of any name pass through; repeated rows
    stay or go together; null ids stay; an empty table gives an empty result.
    """
    said = _said(docs, model, whole(docs), text_col, True).filter((F.col("lang_pred") != "und") & F.col("known"))
    return said.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def train_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from rows whose id's crc32 modulo 3 is not 1 and predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(crc_mod(column(id_col), 3) != 1), id_col, text_col, lang_col)
    out = identify(docs, model, id_col, text_col)
    return out.select(id_col, (crc_mod(F.col(id_col), 3) == 1).alias("held_out"), "lang_pred", "score")
