"""Folders for what queries write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and everything runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not named and context.getCheckpointDir().isDefined():
        named = context.getCheckpointDir().get()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex}"
