"""The index kept up to date from a stream of file changes, and receipts of repeated answers as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codelode.functions.hashing import content_hash
from codelode.schema import FILES_RAW
from codelode.sources import store


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """File rows as they arrive, as Parquet of FILES_RAW."""
    return spark.readStream.schema(FILES_RAW).parquet(folder)


def maintain(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Merge each batch into the persisted index: a path's last row counts; a batch that changes nothing leaves the generation alone.

    Batches are merged with the files the index knows, so each snapshot is whole; only unknown contents are parsed.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "path"]), F.struct("mtime", "file_ord")).alias("r")).select("path", "r.*").select(*batch.columns)
        known = f"{root}/contents"
        try:
            old = spark.read.schema(FILES_RAW).parquet(f"{known}/{store.load(spark, root)[2]}")
            files = old.join(last.select("path"), "path", "left_anti").select(*batch.columns).unionByName(last)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            files = last
        files = files.filter("content is not null")
        generation, _n = store.save(spark, root, files)
        if store.load(spark, root)[2] == generation:
            files.write.mode("ignore").parquet(f"{known}/{generation}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def receipts(stream: DataFrame) -> DataFrame:
    """(key, digest, repeat) of a stream of answers (key, text): whether an answer equals its key's previous one. No timeout: state stays."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for p in batches:
            out = []
            for d in p["digest"]:
                out.append((key[0], d, d == last))
                last = d
            yield pd.DataFrame(out, columns=["key", "digest", "repeat"])
        state.update((last,))

    hashed = stream.select("key", content_hash(F.coalesce("text", F.lit("")), 12).alias("digest"))
    return hashed.groupBy("key").applyInPandasWithState(step, "key string, digest string, repeat boolean", "last string", "append", GroupStateTimeout.NoTimeout)
