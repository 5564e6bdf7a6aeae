"""The persisted index (S24, S25, K1): artifacts keyed by path, content and parser, written before the manifest that vouches for them."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codelode.functions.hashing import content_hash
from codelode.sources.parse import PARSER_VERSION, parsed

SCHEMA_VERSION = 1


def states(files: DataFrame, generation: int) -> DataFrame:
    return files.select("path", "size", "mtime", content_hash(F.coalesce("content", F.lit(""))).alias("content_hash"), F.lit(PARSER_VERSION).alias("parser_version"), F.lit(generation).cast("long").alias("generation"))


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.json(f"{root}/manifests")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def load(spark: SparkSession, root: str) -> tuple[DataFrame | None, DataFrame | None, int, str]:
    """(records, states, generation, reason): the last vouched-for snapshot, or why there is none."""
    found = _manifests(spark, root)
    last = found.orderBy(F.desc("generation")).first() if found is not None else None
    if last is None:
        return None, None, 0, "no index"
    if last["schema_version"] != SCHEMA_VERSION or last["parser_version"] != PARSER_VERSION:
        return None, None, last["generation"], "other version"
    return spark.read.parquet(f"{root}/{last['payload']}/records"), spark.read.parquet(f"{root}/{last['payload']}/states"), last["generation"], ""


def save(spark: SparkSession, root: str, files: DataFrame) -> tuple[int, int]:
    """Bring the index up to date with files: only unknown (path, content) pairs are parsed; (generation, files parsed).

    A snapshot that changes nothing leaves the generation alone. The payload goes to a new folder and the manifest row last, so
    a run that dies in between leaves the old snapshot in force.
    """
    records, old, generation, _ = load(spark, root)
    now = states(files, generation + 1)
    if old is not None:
        known = old.select("path", "content_hash")
        fresh = files.withColumn("content_hash", content_hash(F.coalesce("content", F.lit("")))).join(known, ["path", "content_hash"], "left_anti")
        gone = known.join(now.select("path", "content_hash"), ["path", "content_hash"], "left_anti")
        n = fresh.count()
        if not n and not gone.limit(1).count():
            return generation, 0
        own = F.coalesce(F.get_json_object("row", "$.path"), F.get_json_object("row", "$.from_file"))
        kept = records.withColumn("path", own).join(now.join(known, ["path", "content_hash"], "left_semi").select("path"), "path", "left_semi").select("table", "row")
        new = kept.unionByName(parsed(fresh))
    else:
        n, new = files.count(), parsed(files)
    payload = f"payload-{uuid.uuid4().hex}"
    new.write.parquet(f"{root}/{payload}/records")
    now.write.parquet(f"{root}/{payload}/states")
    row = {"generation": generation + 1, "payload": payload, "schema_version": SCHEMA_VERSION, "parser_version": PARSER_VERSION}
    spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("append").text(f"{root}/manifests")
    return generation + 1, n


def read_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored report with an explicit schema: a field that an older report lacks is NULL, and the rules that need it are skipped and counted."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


#: Bytes from which a telemetry file is put aside, as its name with .1.
TELEMETRY_BYTES = 5 << 20


def append_telemetry(path: str, tool: str, args: dict, ms: int, chars: int, ok: bool) -> None:
    """One JSON line in a file beside the server (K9); of the arguments only a digest is kept. What can't be written is left out."""
    digest = hashlib.sha256(json.dumps(args, sort_keys=True, default=str).encode()).hexdigest()[:12]
    row = {"ts": datetime.now(UTC).isoformat(), "tool": tool, "args_hash": digest, "ms": ms, "chars": chars, "tokens": (chars + 2) // 4, "ok": ok}
    try:
        if os.path.exists(path) and os.path.getsize(path) >= TELEMETRY_BYTES:
            os.replace(path, f"{path}.1")
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")
    except OSError:
        return
