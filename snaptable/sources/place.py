"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below ``spark.checkpoint.dir``; below a temporary one only where that is unset."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        known = context._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="snaptable-"))
            known = context._jsc.sc().getCheckpointDir()
        root = known.get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
