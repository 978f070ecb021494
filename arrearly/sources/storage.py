"""Folders that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="arrearly-")


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, local mode (one
    machine, as in tests) has a folder of its own; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
