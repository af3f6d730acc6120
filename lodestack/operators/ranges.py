"""Joins by order instead of equality, without scanning pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Points with the ranges [low, high) that hold them.

    A range goes into each bucket of ``width`` that it touches and a point into its
    own, so the join is by bucket with the bounds as its condition. Choose the
    width near the ranges' usual length: a range is repeated once for each bucket.
    """
    bucketed = ranges.withColumn("_bucket", F.explode(F.expr(f"sequence(cast(floor(`{low}` / {width!r}) as bigint), cast(floor(`{high}` / {width!r}) as bigint))"))).where(F.col(low) < F.col(high))
    own = points.withColumn("_own", F.floor(F.col(at) / width).cast("long"))
    return own.join(bucketed, (F.col("_own") == F.col("_bucket")) & (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high)), how).drop("_own", "_bucket")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, fields: Sequence[str], tie: str, prefix: str = "last_", bucket: Column | None = None) -> DataFrame:
    """Each left row with the fields of the latest right row of its keys at or before its time; of right rows at one time the last by ``tie``.

    Both sides become one sorted sequence, in which the last right row is
    carried along. ``bucket`` (of ``time``, rising with it; a timestamp's day by
    default) cuts a key's sequence into stretches that go to different tasks;
    what a stretch has before its first right row comes from the last row of
    the stretches before it, of which there is one for each key and bucket.
    """
    held = F.struct(F.col(time).alias("t"), *fields)
    kind = right.select(held.alias("h")).schema["h"].dataType
    if bucket is None:
        bucket = F.to_date(time) if "timestamp" in dict(left.dtypes)[time] else F.lit(0)
    a = left.select(*left.columns, F.lit(None).cast(kind).alias("_held"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"))
    b = right.select(*keys, time, held.alias("_held"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_bucket", bucket)
    within = Window.partitionBy(*keys, "_bucket").orderBy(time, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_held", ignorenulls=True).over(within))
    # a bucket's last right row; the struct keeps buckets without one
    ends = both.groupBy(*keys, "_bucket").agg(F.max(F.when(F.col("_side") == 0, F.struct(F.col(time).alias("t"), F.col("_tie").alias("tie"), F.col("_held").alias("h")))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bucket").alias("_b"), F.col("_carried.h").alias("_carried"))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    found = both.where("_side = 1").join(carried, same, "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return found.select(*left.columns, F.col("_last.t").alias(prefix + time), *(F.col(f"_last.{f}").alias(prefix + f) for f in fields))


def top_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group. Spark keeps n rows of a group on each side of the exchange, so a hot key costs no more."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
