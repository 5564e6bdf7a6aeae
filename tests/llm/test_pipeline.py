import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_small_tables(spark, tmp_path):
    """Each stage against what brute force says of its own input."""
    item = "seven wizards bake large purple cakes in a tiny oven while the quick brown fox jumps over the lazy dog".split()
    text = lambda k, n=60: " ".join(f"word{random.Random(1000 * k + j).randrange(997)} and the" for j in range(n))
    rows = [(k, text(k), "en", f"s{k % 3}", None) for k in range(20)]
    rows += [(100, text(3) + " extra", "en", "s0", None), (101, "12345 6789 !!", "en", "s0", None), (102, text(50) + " " + " ".join(item) + " " + text(51), "en", "s1", None), (103, None, None, None, None), (104, text(60) + "\nthis is the very same footer line everywhere", "en", "s1", None), (105, text(61) + "\nthis is the very same footer line everywhere", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "mixture":
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in at.collect()}
    assert set(seen["language"]) == {r[0] for r in rows} - {101, 103}
    assert set(seen["lines"]) == set(seen["language"])
    assert "footer" in seen["lines"][104].text
    assert "footer" not in seen["lines"][105].text
    assert set(seen["lines"]) - set(seen["near"]) == {100}
    assert set(seen["near"]) - set(seen["benchmark"]) == {102}
    assert set(seen["mixture"]) == set(seen["benchmark"])
    for k, r in seen["mixture"].items():
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", seen["benchmark"][k].text))
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.collect())) == sorted(map(str, seen["mixture"].values()))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_rejects_letters_of_no_known_language(spark):
    """Texts with letters but of none of the learned languages go; those of a learned one stay."""
    words = {"en": "the house and then with other there shing", "de": "der und die schlicht nicht einer gegen", "fr": "les des une avec pour dans était", "es": "los una para con pero ción donde"}
    text = lambda k, lang: " ".join(random.Random(k).choices(words[lang].split(), k=30))
    rows = [(k, text(k, lang), lang) for k, lang in enumerate(list(words) * 20)]
    strange = ["xqzt wvkj qqxz zxcv bnmm qwrt pqzx wkjf", "Это русский текст о погоде и природе", "日本語のテキスト文章です"]
    rows += [(1000 + k, t, None) for k, t in enumerate(strange)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == set(range(80))
