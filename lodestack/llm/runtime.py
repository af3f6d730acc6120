"""Shared storage and small plan helpers for the operators of this package.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, which every executor can read, so a lost executor
costs a recomputation of tasks and never a rerun from the first stage.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word, as a regex class, as bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only where it is unset and all runs on this machine, a temporary one; elsewhere executors could not read that."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: The folders made since each ``settled`` that is under way began.
_MADE: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared storage that goes when this process ends."""
    path = f"{shared_dir(spark)}/lodestack/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    for made in _MADE:
        made.append(path)

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session has ended before; the folder is the cluster's to sweep
            _delete(spark, path)

    atexit.register(remove)
    return path


#: Rows of whole texts that Python gets at once: Spark's 10,000 are tens of megabytes on both sides.
TEXT_ROWS = 1000


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within sends Python at most so many rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of ids and numbers that one task writes, about.
FEW_ROWS = 100_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most about so many rows of ids and numbers, written by no more tasks than that needs, but by all cores.

    On a local disk Hadoop starts a process for each file and each checksum,
    which takes longer than a few rows do.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FEW_ROWS)))


def materialise(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared storage and read again: cuts the lineage. batch_rows: as in ``batches_of``."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with batches_of(spark, batch_rows) if batch_rows else contextlib.nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, stored, in batches of ``TEXT_ROWS``; whatever it has stored on its way goes. Nothing else may read that later."""
    made: list[str] = []
    _MADE.append(made)
    try:
        out = materialise(make(), name, batch_rows=TEXT_ROWS)
    finally:
        _MADE.remove(made)
    for path in made:
        if path != out._stored_at:
            _delete(out.sparkSession, path)
    return out


def dropped(*tables: DataFrame) -> None:
    """Frees stored tables that no later step reads."""
    for df in tables:
        _delete(df.sparkSession, df._stored_at)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def first_rows(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with one row for each combination of ``keys`` (null is a value): the one whose columns, written as JSON, come first.

    Rows that are written alike are alike, so a task that runs again keeps the
    same row.
    """
    row = F.struct(*(df[c] for c in df.columns))
    first = F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"}))
    return df.groupBy(*keys).agg(first.alias("_first")).select("_first.*")
