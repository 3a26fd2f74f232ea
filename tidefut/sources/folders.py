"""Folders for tables that jobs write on the way."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=1)
def _one_process_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where all of Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _one_process_dir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
