"""A folder for files that a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder that the cluster names; a local one only where all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        key = spark.sparkContext.applicationId
        base = _own.setdefault(key, _own.get(key) or "file://" + tempfile.mkdtemp(prefix="tidewheel-"))
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
