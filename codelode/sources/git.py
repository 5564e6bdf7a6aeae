"""Commit history and old file versions through a hardened git."""

from __future__ import annotations

import subprocess
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.sources.classify import CODE, MAX_BYTES

#: Nothing that a repository configures may run, and no system settings apply.
SAFE = ["-c", "core.hooksPath=/dev/null", "-c", "core.fsmonitor=false", "-c", "protocol.ext.allow=never", "-c", "protocol.file.allow=never", "-c", "core.quotePath=false"]
ENV = {"GIT_CONFIG_NOSYSTEM": "1", "GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C", "PATH": "/usr/local/bin:/usr/bin:/bin", "HOME": "/nonexistent"}
TIMEOUT, BUFFER, MARK = 120, 64 * 1024 * 1024, "\x01commit\x01"


@lru_cache(maxsize=500)
def run(root: str, *args: str) -> str | None:
    """Output of git, or None where it fails, is missing or says too much; failures are remembered like answers."""
    try:
        p = subprocess.run(["git", *SAFE, "-C", root, *args], capture_output=True, timeout=TIMEOUT, env=ENV, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return p.stdout.decode("utf-8", "replace") if p.returncode == 0 and len(p.stdout) <= BUFFER else None


def log_lines(root: str, months: int = 12) -> list[str]:
    return (run(root, "log", f"--since={months}.months", "--no-merges", "--name-only", f"--format={MARK}%an\x01%aI") or "").split("\n")


def commits(spark: SparkSession, lines: list[str]) -> DataFrame:
    """commits(commit_id, author, ts, files): runs of lines that a marker begins; commits without code files are dropped.

    The log is one text, cut at its markers: what follows each is a commit's head and files, in the log's order.
    """
    log = spark.createDataFrame([("\n".join(lines),)], "log string")
    parts = log.select(F.posexplode(F.split("log", f"(?m)^{MARK}")).alias("commit_id", "part")).filter("commit_id > 0")
    rows = parts.select("commit_id", F.split("part", "\n").alias("rows")).withColumn("head", F.split(F.get("rows", F.lit(0)), "\x01"))
    code = lambda f: f.rlike(CODE) & ~f.endswith(".d.ts")
    files = F.array_sort(F.filter(F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda f: F.regexp_replace(f, r"\\", "/")), code))
    out = rows.select("commit_id", F.get("head", F.lit(0)).alias("author"), F.try_to_timestamp(F.get("head", F.lit(1))).alias("ts"), files.alias("files"))
    return out.filter(F.size("files") > 0)


def old_version(root: str, path: str, ref: str = "HEAD") -> tuple[str | None, str]:
    """(text, reason): a file as it was; too large or binary ones give a reason instead."""
    text = run(root, "show", f"{ref}:{path}")
    if text is None:
        return None, "missing"
    if len(text) > MAX_BYTES:
        return None, "too large"
    return (None, "binary") if "\0" in text else (text, "")
