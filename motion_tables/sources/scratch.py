"""A folder for what a job writes on the way, shared by all executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's checkpoint folder.  Where none is set one of this machine if all executors are on it, as in tests; else it raises."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{top or os.path.join(tempfile.gettempdir(), 'checkpoints')}/{name}-{uuid.uuid4().hex}"
