"""Files of a format as DataFrames.

``spark.read.format("binaryFile")`` lists and splits the files, so any file
system that Spark reaches will do and a filter on the path or the time prunes
files before they are read. The codec then runs on Arrow batches; a file's rows
are emitted as they come.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .decoders import CODECS, TABLES

#: Rows in an emitted batch, at most.
_BATCH = 2000


def files(spark: SparkSession, path: str, glob: str | None = None, with_empty: bool = False) -> DataFrame:
    """(file, content) of the files under a path.

    Spark plans no read of a file without bytes. ``with_empty`` adds those: the
    names that the listing has and the scan has not.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    loaded = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    found = loaded.select(F.col("path").alias("file"), "content")
    if with_empty:
        names = [unquote(re.sub("^file:/+", "file:/", n)) for n in loaded.inputFiles()]
        if len(names) > loaded.select("path").count():
            listed = spark.createDataFrame([(n,) for n in names], "file string")
            found = found.unionByName(listed.join(found.select("file"), "file", "left_anti").withColumn("content", F.lit(b"")))
    return found


def decode(df: DataFrame, table: str, file: str = "file", content: str = "content", strict: bool = False) -> DataFrame:
    """Rows of ``table`` for each file of ``df``, with the file's name and, where a file can't be read, one row that has only ``error``.

    With ``strict`` such a file fails the job. A null content has no rows.
    """
    ddl, rows_of = TABLES[table]
    schema = T.StructType([T.StructField("file", T.StringType()), *T._parse_datatype_string(ddl).fields, T.StructField("error", T.StringType())])
    shape = to_arrow_schema(schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], f.type) for n, f in zip(names, shape)], names=names)

        held, size = [], 0
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                data = raw.as_py()
                if data is None:
                    continue
                try:
                    for row in rows_of(data):
                        held.append(row | {"file": name, "error": None})
                        size += len(row.get("data") or b"")
                        if len(held) >= _BATCH or size > 8 << 20:
                            yield batch(held)
                            held, size = [], 0
                except (ValueError, KeyError, IndexError, OverflowError) as error:
                    if strict:
                        raise ValueError(f"{name}: {error}") from error
                    held.append({"file": name, "error": str(error)})
        if held:
            yield batch(held)

    return df.select(F.col(file).cast("string"), F.col(content).cast("binary")).mapInArrow(run, schema)


def read_table(spark: SparkSession, path: str, table: str, glob: str | None = None, strict: bool = False) -> DataFrame:
    return decode(files(spark, path, glob), table, strict=strict)


def codec(name: str, strict: bool = False, **parameters):
    """A function of a binary or string column that applies the codec. What can't be converted is null, or with ``strict`` fails."""
    f = CODECS[name]
    as_text = name.endswith(("to_json", "to_xml", ".tag"))
    from_text = name.endswith(("from_json", "from_xml"))

    def one(x):
        if x is None:
            return None
        try:
            x = x.decode() if from_text and isinstance(x, bytes) else x.encode() if not from_text and isinstance(x, str) else x
            return f(x, **parameters)
        except (ValueError, KeyError, IndexError, TypeError, OverflowError):
            if strict:
                raise
            return None

    @F.pandas_udf(T.StringType() if as_text else T.BinaryType())
    def apply(column: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in column], dtype=object)

    return apply
