"""Cutting lineage in the folder that all executors share, and jobs that run side by side."""

from __future__ import annotations

import re
import tempfile
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Jobs that do not depend on each other and are started together.
TOGETHER = 4


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder below spark.checkpoint.dir.  Where that is unset, a local session takes one of its own; a cluster has none to take."""
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def side_by_side(spark: SparkSession, work, items) -> list:
    """``work`` of each item, some at a time: each starts Spark jobs of its own, which small tables leave executors idle for."""
    shared_folder(spark)
    items = list(items)
    with ThreadPool(max(1, min(TOGETHER, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)
