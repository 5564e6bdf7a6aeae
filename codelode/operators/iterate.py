"""Cutting lineage of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder in ``spark.checkpoint.dir``, shared by all executors.

    Where it is unset, a session within one machine (``local``, as in tests) gets a temporary one; any other is refused, since
    its executors would write to disks of their own.
    """
    context = df.sparkSession.sparkContext
    if not (context.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)):
        if context.master.startswith("local-cluster") or not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="codelode-"))
    return df.checkpoint()
