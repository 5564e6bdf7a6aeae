import hashlib
from collections import defaultdict

import pytest

from codelode.llm import exact, mixing


def lower_az(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize(("block_chars", "key_bits"), [(4096, 64), (16, 3)])
def test_exact_against_brute_force(docs, block_chars, key_bits):
    got = exact.exact_dedup(docs, block_chars=block_chars, key_bits=key_bits).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[lower_az(r.text)].append(r.doc_id)
    want = sorted((str(i), str(max((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_exact_empty(no_docs):
    assert exact.exact_dedup(no_docs).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact.exact_dedup(no_docs).count() == 0


def test_mix(docs, no_docs):
    rows = mixing.mix(docs, block_words=4).collect()
    assert len(rows) == docs.count()
    assert mixing.mix(no_docs).count() == 0
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert set(size) == {"a", "b", "c", None}
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-6
        assert abs(taken[s] - target[s]) <= 4
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, block_words=4).collect()))


def test_targets_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    weights, caps, want, open_ = {"a": 5, "b": 2, "c": 1, None: 5}, {"a": 20, "b": 2000, "c": 2000, None: 0}, {}, {"a", "b", "c", None}
    while True:
        left = 1.5 * 2010 - sum(want.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > caps[s]}
        if not over:
            want |= share
            break
        want |= {s: caps[s] for s in over}
        open_ -= over
    assert got == pytest.approx(want)


def test_points_are_the_mirrored_bits(spark):
    from pyspark.sql import functions as F

    got = [r[0] / 2**mixing.BITS for r in spark.range(5).select(mixing._point(F.col("id"))).collect()]
    assert got == [0, 0.5, 0.25, 0.75, 0.125]


def test_schedule_gives_small_sources_their_slots(spark):
    """One large source beside many small ones: each has the ranks 0, 1, ... that its target needs, and no slot is dealt twice."""
    want = {"big": 200_000.0, None: 50.0} | {f"s{k:04}": (40.0, 60.0, 128.0, 200.0)[k % 4] for k in range(600)}
    quota = spark.createDataFrame([(s, int(t), t) for s, t in want.items()], "source string, source_size long, target double")
    rows = mixing.schedule(quota, 64).collect()
    assert len({r.slot for r in rows}) == len(rows)
    ranks = defaultdict(list)
    for r in rows:
        ranks[r.source].append(r["rank"])
    assert {s: sorted(x) for s, x in ranks.items()} == {s: list(range(-int(-t // 64))) for s, t in want.items()}
