"""The corpus pipeline: each stage takes all that the one before it kept.

Rows without an id, with a null or empty text or given twice pass through the
stages as each operator's docstring says; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm.exact_dedup import exact_dedup
from lodestack.llm.minhash import near_dedup
from lodestack.llm.mixing import mixed
from lodestack.llm.packing import packed_documents
from lodestack.llm.quality_rules import quality_filter
from lodestack.llm.runtime import documents, dropped, settled

#: Target weights of the sources, relative to one another; a source without one has 1.
WEIGHTS = {f"src{i}": 1 + i % 5 for i in range(20)}

#: (name, function of (spark, docs, sf_dir)): documents to documents, the last one to packed pieces.
STAGES = [
    ("quality rules", lambda spark, docs, sf_dir: quality_filter(docs)),
    ("exact dedup", lambda spark, docs, sf_dir: exact_dedup(docs)),
    ("near dedup", lambda spark, docs, sf_dir: near_dedup(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixed(docs, WEIGHTS)),
    ("packing", lambda spark, docs, sf_dir: packed_documents(docs, weights=WEIGHTS)),
]

#: Tokens and best-fit packing have no SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written once to the shared storage and read again, and what led to it goes."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))  # noqa: B023
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
