import os

import pytest
from pyspark.sql import functions as F

from codelode.llm import common, mixing


def folder(spark):
    return common.shared_dir(spark).removeprefix("file:")


def test_cuts_go_when_nothing_reads_them(spark):
    d = spark.range(100)
    cut = common.Cuts(d)
    a, b = cut(d.withColumn("x", F.col("id") * 2)), cut(d.withColumn("y", F.lit("text")))
    c = cut(a.join(b, "id"))
    names = lambda: {x for x in os.listdir(folder(spark)) if x in {os.path.basename(f.cut_path) for f in (a, b, c)}}
    assert len(names()) == 3
    cut.drop(a)
    assert len(names()) == 2
    out = cut.done(c.filter("x > 10"))
    assert names() == {os.path.basename(c.cut_path)}
    assert out.count() == 94
    assert len(c.inputFiles()) <= cut.files


def test_files_follow_bytes(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        many = common.Cuts(d.select("doc_id")).files
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        assert (many, common.Cuts(d).files) == (14, spark.sparkContext.defaultParallelism)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_broadcasts_are_bounded_by_bytes(spark):
    d = spark.createDataFrame([(k, "x" * 1000) for k in range(200)], "id long, t string")
    d = common.Cuts(d)(d)
    assert common.fits(d, 1 << 20)
    assert not common.fits(d, 100_000)


def test_sliced_batches():
    import pyarrow as pa

    rb = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 100})
    parts = list(common.sliced([rb, rb.slice(0, 0)], 10_000))
    assert sum(len(p) for p in parts) == 100
    assert max(len(p) for p in parts) <= 10


def test_sums_in_three_steps(spark):
    rows = [(s, r, (r * 7 + (s or "").count("b")) % 5) for s in ("a", "b", None) for r in range(0, 60, 1 + (s == "b"))]
    got = {(x.source, x.run): x.base for x in mixing._upto(spark.createDataFrame(rows, "source string, run long, words long"), "words", "base", width=8).collect()}
    for s, r, _ in rows:
        assert got[s, r] == sum(w for t, q, w in rows if t == s and q < r)
