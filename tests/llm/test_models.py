import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from codelode.llm import langid, lm, quality
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


def test_language_edges(docs, no_docs):
    got = langid.train_and_identify(docs).collect()
    assert len(got) == docs.count()
    said = {r.doc_id: r for r in got}
    assert said[5].lang_pred == said[6].lang_pred == said[7].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert langid.train_and_identify(no_docs).count() == 0
    model = langid.fit(docs)
    assert langid.recognised(docs, model).columns == docs.columns
    kept = [str(r) for r in langid.recognised(docs, model).collect()]
    assert set(kept) <= {str(r) for r in docs.collect()}
    assert not any(r.doc_id in (5, 6, 7) for r in langid.recognised(docs, model).collect())
    assert langid.recognised(no_docs, model).count() == 0
    for t in ("²½", "Ⅷ ⅷ", "123 ... !!", "©®", "_"):
        assert model.predict(t) == ("und", 0.0)
    long = "der Hund und die Katze " * 100_000
    assert model.predict(long)[0] in model.langs
    assert langid.Model(["de", "en"], np.zeros((2, 1 << langid.DIM_BITS), np.float32), np.array([0, 1])).predict("tie")[0] == "de"


def test_language_families():
    r = np.random.default_rng(2)
    parts = {"en": ["the", "ing", "tion"], "de": ["der", "ung", "sch"], "fr": ["eau", "oux", "que"], "es": ["cion", "los", "ado"], "xx": ["zzz", "qqq", "vvv"]}
    text = lambda k: " ".join("".join(r.choice(parts[k], 2)) for _ in range(30))
    langs = sorted(parts)
    rows = [(langs.index(k), text(k)) for k in langs for _ in range(30)]
    m = langid.Model(langs, np.stack([langid.vector(t) for _, t in rows]), np.array([k for k, _ in rows]))
    assert m.families == ["=xx", "germanic", "romance"]
    assert len(m.pairs) == 2
    tests = [(k, text(k)) for k in langs for _ in range(20)]
    assert sum(m.predict(t)[0] == k for k, t in tests) >= 98
    assert m.predict("123 ... !!") == ("und", 0.0)
    assert langid.Model([], np.zeros((0, 1 << langid.DIM_BITS), np.float32), np.zeros(0, int)).predict("text")[0] == "und"


def test_language_training_holds_one_copy():
    rng = np.random.default_rng(1)
    x = rng.random((400, 1 << langid.DIM_BITS)).astype(np.float16)
    tracemalloc.start()
    m = langid.Model(["de", "en", "fr"], x, np.arange(400) % 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 4 * x.size and m.weights.shape == (1 << langid.DIM_BITS, 3)  # the vectors as floats, and the model's own


def test_language_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.train_and_identify(d).collect()}
    held = [r for r in d.collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)


def test_quality_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 448, 1000, 5000):
        s = quality.chunk_starts(n)
        assert s[0] == 0
        assert s[-1] + quality.CHUNK >= n
        assert all(b - a <= quality.HOP for a, b in zip(s, s[1:], strict=False))


@pytest.mark.parametrize("group", [1024, 2])
def test_quality_gradients(group):
    """The backward pass over whole texts, in groups of chunks, against differences."""
    net = quality.Network(tilt=1.0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(4)
    texts, y = [bytes(r.integers(97, 122, n).astype(np.uint8)) for n in (700, 100, 300)], np.array([1.0, 0.0, 1.0])
    parts = [quality.chunks(t) for t in texts]
    x, doc = np.concatenate(parts), np.repeat(np.arange(3), [len(p) for p in parts])

    def loss():
        z = np.maximum(net._responses(x).max(1) + net.p["b"], 0)
        out = np.maximum(z @ net.p["A"] + net.p["a"], 0) @ net.p["v"] + net.p["c"]
        p = 1 / (1 + np.exp(-np.bincount(doc, out) / np.bincount(doc)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.step(texts, y, group)
    for k, at in (("v", (2,)), ("c", (0,)), ("A", (1, 2)), ("a", (3,)), ("b", (1,)), ("T", (3, 101, 4))):
        old, eps = net.p[k][at], 1e-5
        net.p[k][at] = old + eps
        up = loss()
        net.p[k][at] = old - eps
        down = loss()
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), abs=1e-5)


def test_quality_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.train_and_score(docs, labels, steps=20).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.train_and_score(no_docs, labels.limit(0)).count() == 0
    long = spark.createDataFrame([("a", "word " * 400_000), ("b", "word " * 400_000), (None, ""), ("a", "word " * 400_000)], "doc_id string, text string")
    got = quality.score(long, quality.Network()).collect()
    assert len({r.score for r in got if r.doc_id}) == 1
    few = quality.fit(docs, labels, sample_bytes=10, steps=2)
    assert isinstance(few, quality.Network)


def test_quality_held_out(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.train_and_score(d, labels).collect()}
    held = [r for r in labels.collect() if got[r.doc_id].held_out]
    good = [r for r in held if r.quality == 1]
    assert sum(got[r.doc_id].predicted for r in good) >= 0.97 * len(good)
    bad = [r for r in held if r.quality == 0]
    assert sum(got[r.doc_id].predicted == 0 for r in bad) >= 0.6 * len(bad)


def test_quality_tables_score_as_the_filters():
    net = quality.Network()
    raw = prose(3, 200).encode()
    x = quality.chunks(raw)
    z = np.maximum(net._responses(x).max(1) + net.p["b"], 0)
    out = (np.maximum(z @ net.p["A"] + net.p["a"], 0) @ net.p["v"] + net.p["c"]).mean()
    assert net.score(raw, net.tables()) == pytest.approx(1 / (1 + math.exp(-out)), abs=1e-4)


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_lm_against_brute_force(docs, no_docs):
    got = lm.score_texts(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    train = [r for r in rows if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 != 1]
    uni, pairs = Counter(), Counter()
    for r in train:
        t = tokens(r.text)
        uni.update(t)
        pairs.update(zip([None, *t], t, strict=False))
    n, v = sum(uni.values()), len(uni)

    def key(i, t):
        w = tokens(t)
        return str(i), len(w), sum(uni[x] > 0 for x in w), round(sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)

    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(key(r.doc_id, r.text) for r in rows)
    assert {r.train_tokens for r in got} == {n}
    assert all(r.score < 0 for r in got)
    assert lm.score_texts(no_docs).count() == 0


def test_lm_scores_against_brute_force(spark):
    """Every text's score from the mixture said again over plain counters, with the operator's own weights."""
    rows = [(k, prose(k % 9, 40 + k)) for k in range(40)]
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    uni, pairs = Counter(), Counter()
    for k, t in rows:
        if not held(k):
            w = tokens(t)
            uni.update(w)
            pairs.update(zip([None, *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    cells = Counter()
    for (a, b), m in pairs.items():
        f = min(1.0, (m - 1) / max(1, uni_of(uni, a) - 1))
        x2 = int(np.clip(np.round(lm.CELLS2 - 1 + 2 * np.log2(f)), 1, lm.CELLS2 - 1)) if f > 0 else 0
        cells[(int(lm.bucket(np.array([uni_of(uni, a) - 1]))[0]) * lm.CELLS2 + x2) * 1024 + int(lm.count_class(np.array([uni[b]]))[0])] += m
    weights = lm.learn(sorted(cells.items()), n, v)
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        w, want = tokens(t), 0.0
        for a, b in zip([None, *w], w, strict=False):
            l2, l1, l0 = weights[int(lm.bucket(np.array([uni[a]]))[0])]
            want += math.log10(l2 * pairs[a, b] / max(1, uni[a]) + l1 * uni[b] / n + l0 / (v + 1))
        assert got[k] == pytest.approx(want, rel=1e-9)
    names = spark.createDataFrame([(f"doc {k}", t) for k, t in rows], "doc_id string, text string")
    assert {r.doc_id for r in lm.score_texts(names).collect()} == {f"doc {k}" for k, _ in rows}


def uni_of(uni, a):
    """A context's count as the operator sees it: the middle of its frequency class."""
    return int(np.round(lm.class_count(lm.count_class(np.array([uni[a]]))))[0])


def test_lm_mixture_is_a_distribution(spark):
    """Probabilities of all known words and one unknown after any word sum to 1, and held-out words gain from the pairs."""
    cells = [((5 * lm.CELLS2 + 40) * 1024 + 9, 50), ((5 * lm.CELLS2) * 1024 + 3, 20), ((0 * lm.CELLS2) * 1024 + 12, 10)]
    w = lm.learn(cells, 1000, 100)
    assert w.shape == (lm.BUCKETS, 3)
    assert np.allclose(w.sum(1), 1)
    assert (w >= 0).all()
    uni = np.array([5, 3, 2])
    after = np.array([2, 1, 0])
    for b in range(lm.BUCKETS):
        known = w[b, 0] * after / after.sum() + w[b, 1] * uni / uni.sum() + w[b, 2] / (len(uni) + 1)
        total = known.sum() + w[b, 2] / (len(uni) + 1)
        assert total == pytest.approx(1)


def test_lm_blocks_agree_with_one_block(spark, monkeypatch):
    """Many blocks and shards give the scores of few."""
    rows = [(k, prose(k, 60)) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r for r in lm.score_texts(d.coalesce(1)).collect()}
    many = {r.doc_id: r for r in lm.score_texts(d.repartition(7)).collect()}
    for k in one:
        assert one[k].score == pytest.approx(many[k].score, rel=1e-9)
        assert one[k].base_score == pytest.approx(many[k].base_score, rel=1e-12)


def test_lm_keeps_all_rows_where_partitions_share_a_task(spark):
    """More partitions than files of an intermediate table: blocks of one task stay apart."""
    from pyspark.sql import functions as F

    d = spark.range(0, 90, 1, 16).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a word and"), F.col("id").cast("string")).alias("text"))
    got = lm.score_texts(d).collect()
    assert sorted(r.doc_id for r in got) == list(range(90))
    assert {r.n_tokens for r in got} == {5}


def test_packing():
    r = np.random.default_rng(6)
    for a in (np.zeros(0, int), np.array([0]), r.integers(0, 2**50, 1000), r.integers(0, 3, 1000)):
        assert (lm.unpack(lm.pack(a)) == a).all()
    v = np.sort(r.integers(0, 20, 300))
    w = r.integers(0, 1000, 300)
    order = np.lexsort((w, v))
    a, b = lm._gather(*lm._spread(v[order], w[order]))
    assert (a == v[order]).all()
    assert (b == w[order]).all()
    assert (lm.count_class(lm.class_count(np.arange(200)).astype(int)) <= np.arange(200) + 1).all()
