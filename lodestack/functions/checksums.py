"""Checksums of binary columns. CRC-32 as zlib has it is Spark's own ``crc32``; these two Spark has not."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The generator of the CRC that reads each byte from its high bit on.
_GENERATOR = 0x04C11DB7


@cache
def _steps() -> np.ndarray:
    out = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        out = np.where(out & np.uint64(1 << 31), out << np.uint64(1) ^ np.uint64(_GENERATOR), out << np.uint64(1)) & np.uint64(0xFFFFFFFF)
    return out


def crc32_high(data: bytes) -> int:
    steps, crc = _steps().tolist(), 0xFFFFFFFF
    for b in data:
        crc = crc << 8 & 0xFFFFFFFF ^ steps[crc >> 24 ^ b]
    return crc ^ 0xFFFFFFFF


def _of_bytes(f, column: str | Column) -> Column:
    @F.pandas_udf("long")
    def apply(data: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in data], dtype="Int64")

    return apply(column)


def adler32(column: str | Column) -> Column:
    return _of_bytes(zlib.adler32, column)


def bzip_crc32(column: str | Column) -> Column:
    return _of_bytes(crc32_high, column)
