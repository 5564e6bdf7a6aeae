"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join of at most so many bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a session within one machine (``local``, as in tests) gets a temporary one; any other is refused, since
    its executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="codelode-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's own file systems, wherever it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Cuts:
    """The intermediate tables of one run of an operator over ``docs``, written to the shared folder.

    A table has at most as many files as the input has splits (or the cluster cores, if these are more), and fewer where adaptive execution merges small partitions: file
    counts follow bytes, and nothing is shuffled to write them. ``drop`` deletes tables that nothing reads any more and ``done``
    all that the result doesn't read; what a result does read stays until the interpreter ends.
    """

    _left: dict[str, SparkSession] = {}

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.paths: list[str] = []
        leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(min(int(str(leaves.apply(k).stats().sizeInBytes())), 1 << 60) for k in range(leaves.size()))
        self.files = min(max(self.spark.sparkContext.defaultParallelism, -(-size // self._bytes("spark.sql.files.maxPartitionBytes"))), 1 << 24)

    def _bytes(self, key: str) -> int:
        return self.spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(self.spark.conf.get(key))

    def __call__(self, df: DataFrame, codec: str = "none") -> DataFrame:
        """Write a frame and read it again: lineage ends here, and a lost executor costs nothing before it.

        Frames of digests, names and packed arrays don't compress; frames of texts take ``codec``.
        """
        path = f"{shared_dir(self.spark)}/cut-{uuid.uuid4().hex}"
        df.coalesce(self.files).write.option("compression", codec).parquet(path)
        self.paths.append(path)
        Cuts._left[path] = self.spark
        out = self.spark.read.schema(df.schema).parquet(path)
        out.cut_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables that these frames were written to."""
        for frame in frames:
            self._gone(frame.cut_path)

    def done(self, out: DataFrame) -> DataFrame:
        """The result; the tables that it does not read are deleted."""
        read = " ".join(out.inputFiles())
        for path in [p for p in self.paths if p.rsplit("/", 1)[1] not in read]:
            self._gone(path)
        return out

    def _gone(self, path: str) -> None:
        self.paths.remove(path)
        Cuts._left.pop(path, None)
        remove(self.spark, path)


def _sweep() -> None:
    for path, spark in Cuts._left.items():
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before the interpreter
            return


atexit.register(_sweep)


def fits(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a written table takes at most so many bytes in memory, by its files first and then by its rows and their contents."""
    jvm, conf, total = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration(), 0
    for f in df.inputFiles():
        at = jvm.org.apache.hadoop.fs.Path(f)
        total += at.getFileSystem(conf).getFileStatus(at).getLen()
        if total > most:
            return False
    held = F.lit(8 * (2 + len(df.columns)))
    for c, kind in df.dtypes:
        more = F.octet_length(column(c)) if kind in ("string", "binary") else F.size(column(c)) * 8 if kind in ("array<bigint>", "array<int>", "array<double>") else F.octet_length(F.to_json(F.struct(column(c)))) if kind[:5] in ("array", "map<", "struc") else F.lit(0)
        held = held + F.greatest(F.coalesce(more, F.lit(0)), F.lit(0))
    return (df.agg(F.sum(held.cast("long"))).first()[0] or 0) <= most


def near(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast where its measured bytes allow it."""
    return F.broadcast(df) if fits(df, most) else df


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(docs: DataFrame, name: str = "row") -> Column:
    """The input's row as one struct, so that no column of it can clash with an operator's own; ``select(f"{name}.*")`` undoes it."""
    return F.struct(*[column(c) for c in docs.columns]).alias(name)


def text_of(text_col: str) -> Column:
    return F.coalesce(column(text_col), F.lit(""))


def key_of(*values: Column) -> list[Column]:
    """128 bits, k1 and k2, that stand for strings (null: a value of its own)."""
    some = [F.coalesce(v.cast("string"), F.lit("\u0000")) for v in values]
    return [F.xxhash64(*some).alias("k1"), F.xxhash64(F.lit("second"), *some[::-1]).alias("k2")]


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII text takes the built-in's fast path, which is the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id: remainder of the empty text, 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n)).cast("int")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where a lambda refers to it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sliced(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about so many bytes, so that a Python worker's memory does not follow Spark's batches."""
    for rb in batches:
        step = max(1, int(len(rb) * size / max(size, rb.nbytes)))
        for at in range(0, len(rb), step):
            yield rb.slice(at, step)
