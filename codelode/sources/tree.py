"""A source tree as a table (S1-S3): a Python data source that lists on the driver and reads file contents on executors.

Spark's binaryFile source drops names that start with an underscore, ``__init__.py`` among them; this one keeps them.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codelode.schema import FILES_RAW
from codelode.sources import classify

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(classify)


def walk(root: str, ignore: list[str] | None = None, most: int = classify.MAX_FILES) -> tuple[list[tuple[str, int, float]], bool]:
    """(path, size, mtime) of code files, siblings in code-point order, and whether the list was cut at ``most``.

    Hidden names, links, vendor and build folders, declarations and files over 4 MiB are left out. A root that is no folder is an
    error: an empty answer about a place that doesn't exist would look like a perfect one.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    out: list[tuple[str, int, float]] = []

    def visit(folder: str, rel: str) -> bool:
        for e in sorted(os.scandir(folder), key=lambda x: x.name):
            if e.name.startswith(".") or e.is_symlink():
                continue
            path = f"{rel}{e.name}"
            if e.is_dir():
                if e.name not in classify.SKIP_DIRS and not visit(e.path, f"{path}/"):
                    return False
            elif classify.is_code(path) and not classify.ignored(path, ignore or []):
                s = e.stat()
                if s.st_size <= classify.MAX_BYTES:
                    if len(out) >= most:
                        return False
                    out.append((path, s.st_size, s.st_mtime))
        return True

    return out, not visit(root, "")


class _Chunk(InputPartition):
    def __init__(self, first: int, files: list[tuple[str, int, float]]):
        self.first, self.files = first, files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.per = int(options.get("filesperpartition", 200))
        self.ignore = [x for x in options.get("ignore", "").split(",") if x]

    def partitions(self) -> list[InputPartition]:
        files, _ = walk(self.root, self.ignore)
        return [_Chunk(k, files[k : k + self.per]) for k in range(0, len(files), self.per)] or [_Chunk(0, [])]

    def read(self, part: _Chunk) -> Iterator[tuple]:
        for k, (path, size, mtime) in enumerate(part.files):
            with open(os.path.join(self.root, path), "rb") as f:
                raw = f.read()
            text = None if b"\0" in raw else raw.decode("utf-8", "replace")
            yield (path, classify.module_of(path), classify.language(path), classify.is_test(path), size, datetime.fromtimestamp(mtime, UTC).replace(tzinfo=None), text, part.first + k)


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``: one row per code file, its content and its place in discovery order."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self):
        return FILES_RAW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """The tree as FILES_RAW. The root must be reachable from every executor, as any file source's."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("ignore", ",".join(ignore or []))
    return reader.load(root)
