"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import codec_queries, command_queries, decoded, extensions, relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**relational.QUERIES, **codec_queries.QUERIES, **decoded.QUERIES, **command_queries.QUERIES, **extensions.QUERIES}
SQL: dict[str, str] = {**relational.SQL, **codec_queries.SQL, **decoded.SQL, **command_queries.SQL, **extensions.SQL}
FLAGSHIP = "lookahead_span"
