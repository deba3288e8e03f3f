"""Cutting lineage: what follows plans from stored rows, and a lost executor loses none of them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df's rows, checkpointed in the folder that spark.checkpoint.dir names. Where none is set: one of our own if all runs on this machine, else an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="fluxloom-"))
    return df.checkpoint()
