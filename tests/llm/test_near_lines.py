import random

import numpy as np
import pytest

from codelode.llm import dart, linetree
from tests.llm import brute
from tests.llm.conftest import prose


def classes(rows):
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    sets = [brute.shingles(r.text) for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a].text or "").lower() == (rows[b].text or "").lower() or brute.alike(sets[a], sets[b]):
                label[find(a)] = find(b)
    return [find(k) for k in range(len(rows))]


def test_classes_against_brute_force(docs, no_docs):
    rows = docs.collect()
    label = classes(rows)
    least = {}
    for r, k in zip(rows, label, strict=True):
        least[k] = min((x for x in (least.get(k), r.doc_id) if x is not None), default=None)
    want = sorted((str(r.doc_id), str(least[k]), label.count(k)) for r, k in zip(rows, label, strict=True))
    got = dart.near_classes(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == want
    assert dart.near_classes(no_docs).count() == 0
    one = dart.one_of_each(docs)
    assert one.columns == docs.columns
    kept = one.collect()
    assert len(kept) == len(set(label))
    have = {str(r) for r in rows}
    assert all(str(r) in have for r in kept)


def test_many_copies_chain(spark):
    """A chain of near copies, each like the next but not like the last, is one class."""
    words = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(40):
        words[5 * k] = f"new{k}"
        texts.append((k, " ".join(words)))
    texts += [(100 + k, " ".join(f"z{k}x{j}" for j in range(60))) for k in range(20)]
    got = dart.near_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.class_id for r in got if r.doc_id < 100} == {0}
    assert all(r.class_size == 1 for r in got if r.doc_id >= 100)


@pytest.mark.parametrize("j", [0.5, 0.8, 0.9])
def test_darts_estimate_similarity(j):
    r = np.random.default_rng(3)
    n = 300
    both = round(2 * n * j / (1 + j))
    x = r.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
    s = dart.signatures([x[:n], x[n - both :]], k=1500)
    assert abs((s[0] == s[1]).mean() - both / (2 * n - both)) < 0.05


def test_weighted_darts_and_counts():
    x = np.arange(4, dtype=np.uint64) + np.uint64(99)
    s = dart.signatures([x, x], [np.array([1.0, 3, 7, 2.5]), np.array([2.0, 1, 7, 2.5])], k=3000)
    assert abs((s[0] == s[1]).mean() - 11.5 / 14.5) < 0.04
    assert dart.weighted_similarity((x, np.array([1, 2, 3, 4])), (x, np.array([1, 1, 3, 5]))) == 9 / 11
    maps = dart.parities([x, x[:3]])
    assert sum(int(a ^ b).bit_count() for a, b in zip(*maps.astype(np.uint64).tolist(), strict=True)) <= 1


def test_counted_weighting(spark):
    rows = [(1, "a b c d e " * 10), (2, "a b c d e " * 40), (3, "a b c d e " * 41)]
    got = {r.doc_id: r.class_id for r in dart.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), weighting="count").collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def held(spark, rows, **options):
    """dedup_lines of (id, text) rows against the definition."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linetree.dedup_lines(d, **options).collect()), key=str)
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute.lines(rows, **options), strict=True)), key=str)
    assert got == want
    return {i: t for i, t, _, _ in got}


def test_lines_edges(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    text = held(spark, rows)
    assert "recurs" in text[12]
    assert "recurs" not in text[13]
    assert "recurs" not in text[14]
    assert text[5] is None
    for i, t in rows:
        if i in (1, 3, 8, 11):
            assert text[i] == t  # copies keep their lines
    assert linetree.dedup_lines(no_docs).count() == 0
    out = linetree.rewrite_lines(docs)
    assert out.columns == docs.columns
    was = {(r.doc_id, r.lang, r.source): r for r in docs.collect()}
    for r in out.collect():
        old = was[r.doc_id, r.lang, r.source].asDict()
        changed = r.text != old["text"]
        assert r.asDict() == old | {"text": r.text, "n_chars": len(r.text) if changed else old["n_chars"]}
    assert linetree.rewrite_lines(no_docs).count() == 0


def test_a_footer_of_two_lines_leaves_one_copy(spark):
    """Multi-line blocks go though their lines always have the same neighbours, under long and under short bodies."""
    footer = "\nAll rights reserved by the owners of this site\nWrite to the editor about anything you miss"
    for body in (lambda k: prose(90 + k, 60), lambda k: f"w{k}x short unlike{'abcdef'[k]}"):
        text = held(spark, [(k, body(k) + footer) for k in range(6)])
        assert ["rights" in text[k] for k in range(6)] == [True, *[False] * 5]
        assert ["editor" in text[k] for k in range(6)] == [True, *[False] * 5]


def test_no_document_is_emptied_where_that_is_asked(spark):
    """A text of recurring lines only keeps them with never_empty; others lose theirs."""
    rows = [(1, "one line of its own\nthe shared line here is long\nand a second shared line"), (2, "the shared line here is long\n\nand a second shared line"), (3, "something else entirely said\nthe shared line here is long"), (4, None), (5, " \n")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in linetree.rewrite_lines(d, never_empty=True).collect()}
    assert left == {1: rows[0][1], 2: rows[1][1], 3: "something else entirely said", 4: None, 5: " \n"}
    assert {r.doc_id: r.text for r in linetree.rewrite_lines(d).collect()}[2] == ""


def test_long_passages_that_repeat_go_and_copies_stay(spark):
    """A passage of over 50 words in documents and in their copies goes everywhere but in its first document and that one's copies."""
    passage = prose(5, 60)
    bodies = [prose(20 + k, 80) for k in range(5)]
    rows = [(k, f"{bodies[k]}\n{passage}\n{prose(40 + k, 20)}") for k in range(5)]
    rows += [(10 + k, rows[k][1]) for k in range(5)] + [(20, rows[0][1].replace(bodies[0].split()[7], "altered", 1)), (21, rows[3][1].replace(bodies[3].split()[7], "altered", 1))]
    text = held(spark, rows)
    assert {i for i, t in text.items() if passage in t} == {0, 10, 20}
    assert all(prose(40 + k, 20) in text[k] and prose(40 + k, 20) in text[10 + k] for k in range(5))


def test_many_templates_in_a_leaf_and_short_lines(spark):
    """Lines of one leaf with several templates, unrelated lines among them, and lines of one to seven tokens."""
    r = random.Random(4)
    a, b = "please note that order red was sent on friday to your home address", "please note that parcels with glass go by a slower road in winter"
    rows = []
    for k in range(30):
        own = [f"own{k} line{k} {'xyz'[k % 3]}" + "q" * k]
        x = a.split()
        x[4] = ["red", "blue", "green", "mauve"][k % 4]
        y = b.split()
        y[7 + k % 2] = f"v{'abcdefghij'[k % 10]}"
        noise = "please note that " + " ".join(r.choice("abcdefghijklmnop") * 4 for _ in range(10))
        short = [["page 3 of", "thank you", "go on reading here now", "stop", "one two three four five six seven", "one two three four five six eleven"][k % 6]]
        rows.append((k, "\n".join([*own, " ".join(x), *short, " ".join(y), noise])))
    text = held(spark, rows)
    assert sum("parcels" in t for t in text.values()) < 12
    assert sum("order" in t for t in text.values()) == 1
    assert sum("thank you" in t for t in text.values()) == 1
    assert sum("stop" in t.split("\n") for t in text.values()) == 1
    held(spark, rows[:12], least_docs=4)


def test_lines_on_the_smallest_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held(spark, [(r.doc_id, r.text) for r in d.collect()])
