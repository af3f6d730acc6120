"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where it is unset and everything runs on this machine, a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder there, gone when this process ends."""
    path = f"{shared_folder(spark)}/lodestack/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session has ended before; the folder is the cluster's to sweep
            store.delete(at, True)

    atexit.register(remove)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: every reader sees the same rows, and a lost executor costs tasks alone."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
