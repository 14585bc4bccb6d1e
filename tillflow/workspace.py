"""A folder every executor can reach, for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the session names in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one machine, may
    fall back to a temporary folder; a cluster without the setting is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return f"{root.rstrip('/')}/tillflow-{purpose}-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix=f"tillflow-{purpose}-")
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
