"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which spark.checkpoint.dir names. Where it is unset a session in one JVM gets one; a cluster has to name it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/slatewise-{uuid.uuid4().hex}")
    return sc._jsc.sc().getCheckpointDir().get()
