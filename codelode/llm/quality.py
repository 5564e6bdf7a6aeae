"""Operator 5: a quality classifier, a byte-level convolutional network in numpy."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, crc_mod, sliced

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a chunk and between chunk starts (chunks overlap by a quarter), bytes a filter sees and moves, filters, hidden units.
CHUNK, HOP, WIDTH, STRIDE, FILTERS, HIDDEN = 256, 192, 8, 2, 24, 16


def chunk_starts(n: int) -> list[int]:
    """Starts of the chunks that cover n bytes; the last one ends with the text."""
    return [0] if n <= CHUNK else [*range(0, n - CHUNK, HOP), n - CHUNK]


def chunks(raw: bytes) -> np.ndarray:
    """(chunks, CHUNK) bytes of the whole text, zero-padded."""
    starts = chunk_starts(len(raw))
    padded = np.frombuffer(raw.ljust(CHUNK, b"\0"), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[starts]


class Network:
    """Filters over bytes, the most of each over a chunk, a hidden layer; chunks' logits are averaged."""

    def __init__(self, seed: int = 5, tilt: float = 3.0):
        self.tilt = tilt  # how much more a mistaken low-quality document costs; they are the few
        r = np.random.default_rng(seed)
        f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"T": f(WIDTH, 256, FILTERS, k=0.3), "b": np.zeros(FILTERS, np.float32), "A": f(FILTERS, HIDDEN, k=0.25), "a": np.zeros(HIDDEN, np.float32), "v": f(HIDDEN, k=0.25), "c": np.zeros(1, np.float32)}

    def _responses(self, x: np.ndarray) -> np.ndarray:
        last = x.shape[1] - WIDTH + 1
        out = self.p["T"][0][x[:, 0:last:STRIDE]]
        for j in range(1, WIDTH):
            out += self.p["T"][j][x[:, j : j + last : STRIDE]]
        return out

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each chunk, where each filter responds most, the responses there, the hidden layer before its floor, and the logit."""
        r = self._responses(x)
        at = r.argmax(1)
        z = np.take_along_axis(r, at[:, None, :], 1)[:, 0] + self.p["b"]
        h = np.maximum(z, 0) @ self.p["A"] + self.p["a"]
        return at, z, h, np.maximum(h, 0) @ self.p["v"] + self.p["c"]

    def step(self, texts: list[bytes], y: np.ndarray, group: int = 1024) -> dict[str, np.ndarray]:
        """Gradients of the log loss of whole texts with labels y, over all their chunks.

        A text's logit is the mean of its chunks', as in scoring. Chunks pass in groups, so memory does not grow with a text.
        """
        p, n = self.p, len(y)
        parts = [chunks(t) for t in texts]
        own = np.repeat(np.arange(n), [len(x) for x in parts])
        spans = range(0, len(own), group)
        x = np.concatenate(parts) if len(own) <= group else None
        of = lambda s: x if x is not None else np.concatenate([parts[d][np.arange(len(own))[s : s + group][own[s : s + group] == d] - first[d]] for d in np.unique(own[s : s + group])])
        first = np.searchsorted(own, np.arange(n))
        seen = [self.forward(of(s)) for s in spans]
        per = np.bincount(own, minlength=n)
        logit = np.bincount(own, np.concatenate([q[3] for q in seen]), n) / per
        slope = ((1 / (1 + np.exp(-logit)) - y) * np.where(y > 0, 1.0, self.tilt) / n / per).astype(np.float32)[own]
        g = {k: np.zeros_like(a, np.float64) for k, a in p.items()}
        flat, cols = g["T"].reshape(WIDTH, -1), np.arange(FILTERS)[None, :]
        for s, (at, z, h, _) in zip(spans, seen, strict=True):
            d, part = slope[s : s + group], of(s)
            zr, dh = np.maximum(z, 0), np.outer(d, p["v"]) * (h > 0)
            dz = (dh @ p["A"].T) * (z > 0)
            for k, v in (("v", np.maximum(h, 0).T @ d), ("c", d.sum()), ("A", zr.T @ dh), ("a", dh.sum(0)), ("b", dz.sum(0))):
                g[k] += v
            rows = np.arange(len(part))[:, None]
            for j in range(WIDTH):
                flat[j] += np.bincount((part[rows, at * STRIDE + j].astype(np.int64) * FILTERS + cols).ravel(), dz.ravel(), 256 * FILTERS)
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 5, batch: int = 32, rate: float = 0.004, steps: int = 600) -> Network:
        """Adam over shuffled batches, ``steps`` of them at least; the result depends on the texts and their order only."""
        epochs = max(epochs, -(-steps * batch // max(1, len(texts))))
        m, v, t, r = {k: 0 * a for k, a in self.p.items()}, {k: 0 * a for k, a in self.p.items()}, 0, np.random.default_rng(11)
        for e in range(epochs):
            order = r.permutation(len(texts))
            for s in range(0, len(order), batch):
                on = order[s : s + batch]
                g = self.step([texts[i] for i in on], y[on])
                t += 1
                lr = rate * (1 - 0.9 * e / epochs)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def tables(self) -> list[np.ndarray]:
        """The filters by pairs of bytes: response at an even place = the sum of WIDTH / 2 look-ups."""
        return [(self.p["T"][j][:, None, :] + self.p["T"][j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def score(self, raw: bytes, tables: list[np.ndarray], group: int = 512) -> float:
        """Probability of label 1 for a whole text; chunks pass in groups, so memory does not grow with the text."""
        starts, total = chunk_starts(len(raw)), 0.0
        for s in range(0, len(starts), group):
            x = np.zeros((len(own := starts[s : s + group]), CHUNK), np.uint8)
            for k, at in enumerate(own):
                piece = np.frombuffer(raw[at : at + CHUNK], np.uint8)
                x[k, : len(piece)] = piece
            q = (x[:, 0::2].astype(np.int64) << 8) | x[:, 1::2]
            last = q.shape[1] - WIDTH // 2 + 1
            r = tables[0][q[:, :last]]
            for j in range(1, WIDTH // 2):
                r += tables[j][q[:, j : j + last]]
            h = np.maximum(np.maximum(r.max(1) + self.p["b"], 0) @ self.p["A"] + self.p["a"], 0)
            total += float((h @ self.p["v"] + self.p["c"]).sum())
        return float(1 / (1 + np.exp(-np.clip(total / len(starts), -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4000, sample_bytes: int = 64 << 20, steps: int = 600) -> Network:
    """Train on whole texts of labelled rows: about ``sample`` of them (those of least id hash), fewer where they pass ``sample_bytes``.

    Both bounds are on the sample of rows; every sampled text is learned from to its end. Ids may be of any type. An id with
    several labels takes their mean, from a half up label 1; rows without an id or a label teach nothing, a null text is an
    empty one, and an id that several documents have labels each of them. Rows that tie are taken in the order of their texts. Without
    labels of both kinds, as with an empty table, the network stays as it began.
    """
    top = 1 << 40
    known = labels.filter(column(label_col).isNotNull() & column(id_col).isNotNull()).groupBy(column(id_col).alias("i")).agg(F.avg(column(label_col)).alias("y"))
    n = known.count()
    picked = known.withColumn("h", F.pmod(F.xxhash64("i", F.lit("quality")), F.lit(top))).filter(F.col("h") < int(top * min(1.0, sample / max(1, n))) + 1)
    d = docs.select(column(id_col).alias("i"), F.coalesce(column(text_col), F.lit("")).alias("t")).join(F.broadcast(picked), "i")
    held = d.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    d = d.filter(F.col("h") < int(top * min(1.0, sample / max(1, n)) * min(1.0, sample_bytes / max(1, held))) + 1)
    got = sorted((r["h"], r["t"].encode("utf-8", "replace"), r["y"] >= 0.5) for r in d.select("h", "t", "y").collect())
    y = np.array([k for _, _, k in got], np.float32)
    net = Network()
    if 0 < y.sum() < len(y):
        net.fit([t for _, t, _ in got], y, steps=steps)
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: id, score (label 1's probability) and predicted (1 from ``threshold`` up).

    One narrow pass over whole texts. A null text is empty, and an empty text scores as a chunk of padding; null ids and
    repeated rows pass through; an empty table gives an empty result; only the two columns named are read.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for rb in sliced(batches):
            s = np.array([net.score((t.as_py() or "").encode("utf-8", "replace"), tables) for t in rb.column(1)], float)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype("int32"), pa.int32())], names=["i", "s", "k"])

    rows = docs.select(column(id_col).alias("i"), column(text_col).alias("t"))
    out = rows.mapInArrow(predict, T.StructType([rows.schema["i"], T.StructField("s", T.DoubleType()), T.StructField("k", T.IntegerType())]))
    return out.select(F.col("i").alias(id_col), F.col("s").alias("score"), F.col("k").alias("predicted"))


def train_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Learn from rows whose id's crc32 modulo 5 is not 0 and score all: doc_id, held_out, score, predicted."""
    net = fit(docs, labels.filter(crc_mod(column(id_col), 5) != 0), id_col, text_col, **options)
    out = score(docs, net, id_col, text_col)
    return out.select(id_col, (crc_mod(F.col(id_col), 5) == 0).alias("held_out"), "score", "predicted")
