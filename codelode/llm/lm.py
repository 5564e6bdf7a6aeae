"""Operator 10: language-model scoring by deleted interpolation.

A bigram model: P(w | v) = l2 c(v, w) / c(v) + l1 c(w) / N + l0 / (V + 1), with weights l for each bucket of c(v), learned by
expectation-maximisation on deleted counts (each training occurrence is held out from the counts that predict it).

Documents never travel word by word. They are read once into blocks of a few million words: sorted hashes of the block's
distinct words, and packed codes. Blocks ask shards for counts, first of their words, then of their distinct word pairs,
and the answers return in the order of the questions. Hot words and pairs are one entry per block, and a frequent first
word's pairs are spread over shards by the second.
"""

from __future__ import annotations

import math
import pickle
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts, column, crc_mod, sliced

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The hash of the end of a text, which is also what the first word follows.
END = 0x9E3779B97F4A7C15
#: Words of a block at most, and bytes of text that make one; occurrences of a first word from which its pairs are spread; bits below a word's frequency class in its id.
BLOCK_WORDS, BLOCK_BYTES, SPREAD, CLASS_SHIFT = 1_500_000, 8 << 20, 1 << 16, 44
BUCKETS, CELLS2 = 24, 64
#: Bytes of a block's hashes, or of its pairs, that a shard gets of all blocks together, about: what meets in one task.
SHARD_BYTES = 12 << 20


def pack(a: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, deflated."""
    a = np.ascontiguousarray(a, "<i8")
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([width]) + zlib.compress(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : b[0]] = raw.T
    return out.view("<i8").ravel()


def count_class(c: np.ndarray) -> np.ndarray:
    """Frequency classes: exact below 16, then eight to an octave."""
    c = np.asarray(c, np.int64)
    return np.where(c < 16, c, (16 + np.floor(8 * (np.log2(np.maximum(c, 16)) - 4) + 1e-9)).astype(np.int64))


def class_count(k: np.ndarray) -> np.ndarray:
    """The middle of a frequency class."""
    k = np.asarray(k, float)
    return np.where(k < 16, k, 16 * 2 ** ((k - 16 + 0.5) / 8))


def bucket(c: np.ndarray) -> np.ndarray:
    """Buckets of context frequency: 0, then one to an octave."""
    return np.where(c < 1, 0, np.minimum(BUCKETS - 1, 1 + np.floor(np.log2(np.maximum(c, 1)) + 1e-9))).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about a block's text."""
    held: list[pa.RecordBatch] = []
    for rb in sliced(batches, BLOCK_BYTES):
        held.append(rb)
        if sum(x.nbytes for x in held) >= BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(len(x) for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: (block, docs, codes, words, counts, tokens).

    Blocks are numbered at random, and written before they are used: several partitions may be read by one task.
    """
    for rb in _gathered(batches):
        ids, held = rb.column(0), rb.column(1).to_numpy(zero_copy_only=False).astype(bool)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(rb.column(2), "")))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat, first = lists.flatten(), 0
        while first < len(ids):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_WORDS, "right")) - 1)
            d = flat.slice(offsets[first], offsets[last] - offsets[first]).dictionary_encode()
            codes, words = d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()
            hashes = np.append(pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64), np.uint64(END))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            bounds = offsets[first : last + 1] - offsets[first]
            word = np.array([bool(w) for w in words], bool)[codes] if words else np.zeros(0, bool)
            lens = np.add.reduceat(np.append(word, False), bounds[:-1]) * (np.diff(bounds) > 0) if len(bounds) > 1 else np.zeros(0, int)
            ends = np.cumsum(lens + 1) - 1
            seqs = np.full(int(lens.sum()) + len(lens), place[-1])
            keep = np.ones(len(seqs), bool)
            keep[ends] = False
            seqs[keep] = place[codes[word]]
            own = np.repeat(~held[first:last], lens + 1)
            counts = np.bincount(seqs[own], minlength=len(order))
            docs = pickle.dumps((ids.slice(first, last - first).to_pylist(), held[first:last].tolist()))
            yield pa.RecordBatch.from_pydict({"block": pa.array([uuid.uuid4().int >> 65], pa.int64()), "docs": pa.array([docs], pa.binary()), "codes": pa.array([pickle.dumps((pack(seqs), pack(lens)))], pa.binary()), "words": pa.array([hashes[order].tobytes()], pa.binary()), "counts": pa.array([pack(counts)], pa.binary()), "tokens": pa.array([len(seqs)], pa.int64())})
            first = last


def ask_words(shards: int):
    """A block's words, by ranges of their hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)
        for p in batches:
            for block, words, counts in zip(p["block"], p["words"], p["counts"], strict=True):
                w, c = np.frombuffer(words, np.uint64), unpack(counts)
                at = [0, *np.searchsorted(w, edges), len(w)]
                rows = [(k, block, pickle.dumps((w[a:b].tobytes(), pack(c[a:b])))) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
                yield pd.DataFrame(rows, columns=["shard", "block", "data"])

    return run


def count_words(shards: int):
    """A shard's answers: each word's count over all training documents and an id that tells its frequency class."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        cells = [pickle.loads(x) for x in p["data"]]
        words = [np.frombuffer(w, np.uint64) for w, _ in cells]
        u, inv = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inv, np.concatenate([unpack(c) for _, c in cells]), len(u)).astype(np.int64)
        rank = np.empty(len(u), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(u))
        ids = count_class(total) << CLASS_SHIFT | (rank * shards + int(p["shard"].iloc[0]))
        edges = np.cumsum([0, *map(len, words)])
        data = [pickle.dumps((pack(total[i]), pack(ids[i]))) for i in (inv[a:b] for a, b in zip(edges, edges[1:], strict=False))]
        zero = [0] * (len(p) - 1)
        return pd.DataFrame({"block": p["block"], "kind": 1, "shard": p["shard"], "data": data, "n": [int(total.sum()), *zero], "v": [int((total > 0).sum()), *zero]})

    return run


def _assemble(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's codes and lengths, and its words' counts and ids."""
    codes, lens = pickle.loads(p.loc[p["kind"] == 0, "data"].iloc[0])
    got = [pickle.loads(x) for x in p[p["kind"] == 1].sort_values("shard")["data"]]
    return unpack(codes), unpack(lens), np.concatenate([unpack(c) for c, _ in got]), np.concatenate([unpack(i) for _, i in got])


def _pairs(codes: np.ndarray, ids: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order they are asked (shard, first id, second id): firsts, seconds, shards; and each word's pair.

    The first word of a document follows the end of the one before it, that is, END. A first word's pairs go to one shard,
    or, where it is frequent, to as many as its frequency class needs, by the second word.
    """
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    r = rank[codes]
    if not len(r):
        return (np.zeros(0, np.int64),) * 4
    before = np.empty_like(r)
    before[1:], before[0] = r[:-1], r[-1]  # a block ends with END
    u, inv = np.unique(before * len(ids) + r, return_inverse=True)
    v, w = ids[order][u // len(ids)], ids[order][u % len(ids)]
    ways = np.maximum(1, class_count(v >> CLASS_SHIFT) // SPREAD).astype(np.uint64)
    x = (v.astype(np.uint64) + (w.astype(np.uint64) % ways) * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0x9E3779B97F4A7C15)
    s = ((x >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
    by = np.argsort(s.astype(np.uint16) if shards < 65536 else s, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return v[by], w[by], s[by], place[inv]


def _steps(a: np.ndarray) -> bytes:
    """Ascending integers as packed differences."""
    return pack(np.diff(a, prepend=0))


def _spread(v: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes, bytes]:
    first = np.flatnonzero(np.diff(v, prepend=-1))
    inner = np.diff(w, prepend=0)
    inner[first] = w[first]
    return _steps(v[first]), pack(np.diff(np.append(first, len(v)))), pack(inner)


def _gather(v: bytes, runs: bytes, inner: bytes) -> tuple[np.ndarray, np.ndarray]:
    v, runs, inner = np.cumsum(unpack(v)), unpack(runs), unpack(inner)
    total = np.cumsum(inner)
    first = np.cumsum(runs) - runs
    return np.repeat(v, runs), total - np.repeat(total[first] - inner[first], runs)


def ask_pairs(shards: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        codes, lens, _, ids = _assemble(p)
        held = np.array(pickle.loads(p.loc[p["kind"] == 2, "data"].iloc[0])[1], bool)
        v, w, s, inv = _pairs(codes, ids, shards)
        own = np.bincount(inv[np.repeat(~held, lens + 1)], minlength=len(v))
        at = np.searchsorted(s, np.arange(shards + 1))
        rows = [(k, p["block"].iloc[0], pickle.dumps((*_spread(v[a:b], w[a:b]), pack(own[a:b])))) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        return pd.DataFrame(rows, columns=["shard", "block", "data"])

    return run


def count_pairs(n: int):
    """A shard's answers, each pair's count; and what EM needs of its training pairs, each occurrence left out of its own counts.

    An EM cell is (bucket of c(v) - 1, class of (c(v,w) - 1) / (c(v) - 1), class of c(w)); its weight is the occurrences in it.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        cells = [pickle.loads(x) for x in p["data"]]
        pairs = [_gather(*x[:3]) for x in cells]
        v, w = (np.concatenate([x[k] for x in pairs]) for k in (0, 1))
        (uv, iv), (uw, iw) = np.unique(v, return_inverse=True), np.unique(w, return_inverse=True)
        u, inv = np.unique(iv * len(uw) + iw, return_inverse=True)
        total = np.bincount(inv, np.concatenate([unpack(x[3]) for x in cells]), len(u)).astype(np.int64)
        edges = np.cumsum([0, *(len(x[0]) for x in pairs)])
        out = pd.DataFrame({"block": p["block"], "kind": 3, "shard": p["shard"], "data": [pickle.dumps((pack(total[inv[a:b]]),)) for a, b in zip(edges, edges[1:], strict=False)], "cell": -1, "weight": 0})
        on = total > 0
        t, cv, cw = total[on], np.round(class_count(uv[u[on] // len(uw)] >> CLASS_SHIFT)), uw[u[on] % len(uw)] >> CLASS_SHIFT
        f2 = np.minimum(1.0, (t - 1) / np.maximum(1, cv - 1))
        x2 = np.where(f2 > 0, np.clip(np.round(CELLS2 - 1 + 2 * np.log2(np.maximum(f2, 1e-12))), 1, CELLS2 - 1), 0).astype(np.int64)
        cell, back = np.unique((bucket(cv - 1) * CELLS2 + x2) * 1024 + cw, return_inverse=True)
        em = pd.DataFrame({"block": -1, "kind": 4, "shard": p["shard"].iloc[0], "data": None, "cell": cell, "weight": np.bincount(back, t, len(cell)).astype(np.int64)})
        return pd.concat([out, em], ignore_index=True)

    return run


def learn(cells: list[tuple[int, int]], n: int, v: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bucket; pair, word, uniform) by expectation-maximisation over the deleted counts' cells.

    A bucket without occurrences takes the weights of all buckets together; bucket 0 has no pairs to look at.
    """
    out = np.zeros((BUCKETS, 3))
    if not cells:
        out[:] = (0.0, 0.0, 1.0)
        return out
    c, m = np.array([k for k, _ in cells]), np.array([x for _, x in cells], float)
    b, x2, k1 = c // 1024 // CELLS2, c // 1024 % CELLS2, c % 1024
    f = np.stack([np.where(x2 > 0, 2.0 ** ((x2 - CELLS2 + 1) / 2), 0.0), np.maximum(0, class_count(k1) - 1) / max(1, n - 1), np.full(len(c), 1 / (v + 1))], 1)

    def em(on: np.ndarray, pairs: bool) -> np.ndarray:
        w = np.array([0.5 * pairs, 0.3, 0.2]) / (0.5 + 0.5 * pairs)
        for _ in range(rounds):
            post = f[on] * w
            post *= (m[on] / post.sum(1))[:, None]
            w = post.sum(0) + np.array([0, 0, 1e-3])
            w /= w.sum()
        return w

    every = em(np.ones(len(c), bool), True)
    for k in range(BUCKETS):
        on = b == k
        out[k] = em(on, k > 0) if on.any() else every if k else em(np.ones(len(c), bool), False)
    return out


def score_block(n: int, v: int, weights: np.ndarray, shards: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        codes, lens, c, ids = _assemble(p)
        docs, _ = pickle.loads(p.loc[p["kind"] == 2, "data"].iloc[0])
        _, _, _, inv = _pairs(codes, ids, shards)
        got = np.concatenate([unpack(pickle.loads(x)[0]) for x in p[p["kind"] == 3].sort_values("shard")["data"]])
        cw = c[codes]
        cv = np.append(cw[-1:], cw[:-1])
        w = weights[bucket(cv)]
        prob = w[:, 0] * got[inv] / np.maximum(1, cv) + w[:, 1] * cw / max(1, n) + w[:, 2] / (v + 1)
        base = np.log10((cw + 0.5) / (n + 0.5 * (v + 1)))
        starts = np.cumsum(lens + 1) - lens - 1
        add = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({"i": pd.array(docs, "string"), "n_tokens": lens + 1, "n_known": add((cw > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(prob))})

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 5, held: int = 1) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Ids may be of any type. Texts are lower-cased in A-Z and read whole; a null text is empty and has one token, the end. Training
    rows are those whose id's crc32 modulo ``fold`` is not ``held`` (a null id's is 0). Without a training row every
    probability is the uniform share. Repeated rows are trained on and scored as often as they occur; an empty table gives an
    empty result; other columns are not read. There are as many shards as the blocks' words and pairs, counted in bytes, need.
    """
    cut = Cuts(docs.select(column(id_col), column(text_col)))
    rows = docs.select(column(id_col).cast("string").alias("i"), (crc_mod(column(id_col), fold) == held).alias("h"), column(text_col).alias("t"))
    blocks = cut(rows.mapInArrow(encode, "block long, docs binary, codes binary, words binary, counts binary, tokens long"))
    sizes = blocks.agg(F.sum(F.octet_length("words")).alias("words"), F.sum("tokens").alias("tokens")).first()
    shards = max(1, -(-(sizes["words"] or 0) // SHARD_BYTES))
    pair_shards = max(1, -(-8 * (sizes["tokens"] or 0) // SHARD_BYTES))
    part = lambda k, c: blocks.select("block", F.lit(k).alias("kind"), F.lit(0).alias("shard"), F.col(c).alias("data"))
    asked = blocks.select("block", "words", "counts").mapInPandas(ask_words(shards), "shard int, block long, data binary")
    words = cut(asked.groupBy("shard").applyInPandas(count_words(shards), "block long, kind int, shard int, data binary, n long, v long"))
    total = words.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = total["n"] or 0, total["v"] or 0
    known = part(0, "codes").unionByName(part(2, "docs")).unionByName(words.select("block", "kind", "shard", "data"))
    asked = known.groupBy("block").applyInPandas(ask_pairs(pair_shards), "shard int, block long, data binary")
    pairs = cut(asked.groupBy("shard").applyInPandas(count_pairs(n), "block long, kind int, shard int, data binary, cell long, weight long"))
    cells = pairs.filter("kind = 4").groupBy("cell").agg(F.sum("weight").alias("weight")).collect()
    weights = learn(sorted((r["cell"], r["weight"]) for r in cells), n, v)
    known = known.unionByName(pairs.filter("kind = 3").select("block", "kind", "shard", "data"))
    out = known.groupBy("block").applyInPandas(score_block(n, v, weights, pair_shards), "i string, n_tokens long, n_known long, base_score double, score double")
    kind = docs.schema[id_col].dataType
    return cut.done(out.select(F.col("i").cast(kind).alias(id_col), (crc_mod(F.col("i"), fold) == held).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"))
