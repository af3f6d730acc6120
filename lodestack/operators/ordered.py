"""Operators over ordered rows: spans, fills, offsets, intervals, dense numbers.

Each takes the columns that part the rows (``keys``), which become the only
exchange, and the columns that order them. Give an order that is total: ties
are broken by what the caller names, never by chance.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks.shared import stored as stored_table

Cols = Sequence[str]


def _window(keys: Cols, order: Cols):
    return Window.partitionBy(*keys).orderBy(*order)


def lookahead_span(df: DataFrame, keys: Cols, start: str, order: Cols, out: str, end: Column | None = None, stored: Column | None = None, boundary: Column | None = None, placeholder: Column | None = None) -> DataFrame:
    """Length up to the next start in the same group.

    The last row's neighbour is ``end``; where that is unknown too, the length
    is ``stored``. A length is never negative nor, where ``stored`` is given and the row
    is not a ``placeholder``, above it. Rows that are no ``boundary`` get 0 and are
    nobody's neighbour.
    """
    none = F.lit(None).cast("long")
    stored = none if stored is None else stored
    is_boundary = F.lit(True) if boundary is None else F.coalesce(boundary, F.lit(False))
    # rows that are no boundary form a group of their own, so that one exchange serves both kinds
    rows = df.withColumn("_b", is_boundary)
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    gap = F.coalesce(F.lead(start).over(w), none if end is None else end) - F.col(start)
    span = F.coalesce(F.when(gap.isNotNull(), F.greatest(F.lit(0), gap)), stored)
    capped = F.when(F.lit(False) if placeholder is None else placeholder, span).otherwise(F.least(span, stored))
    return rows.withColumn(out, F.when(F.col("_b"), capped).otherwise(F.lit(0)).cast("long")).drop("_b")


def forward_fill(df: DataFrame, keys: Cols, order: Cols, defaults: Mapping[str, object]) -> DataFrame:
    """Each column's last value that is not null so far; before the first, its default."""
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(v)) for c, v in defaults.items()})


def tolerance_delta(df: DataFrame, keys: Cols, order: Cols, value: str, tolerance: float, out: str, initial: float = 0.0) -> DataFrame:
    """The value where it differs by more than the tolerance from the last one emitted, else null. The first row counts against ``initial``.

    A fold over each group's values: every step needs what the step before it
    emitted, which no window function offers. Groups are sorted within their
    partitions and streamed; a task holds a batch and the last value emitted,
    however long a group is. A null value emits nothing.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    at, own = df.columns.index(value), [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, initial
        for batch in batches:
            emitted = []
            for *key, v in zip(*(batch.column(k).to_pylist() for k in own), batch.column(at).to_pylist()):
                if group != key:
                    group, last = key, initial
                if v is not None and abs(v - last) > tolerance:
                    last = float(v)
                    emitted.append(last)
                else:
                    emitted.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(emitted, pa.float64())], names=schema.names)

    dealt = df.repartition(*keys) if keys else df.coalesce(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def run_length_expand(df: DataFrame, times: Column, offset: str) -> DataFrame:
    """Each row as often as ``times`` says, numbered from 0; none where it is 0, negative or null."""
    return df.withColumn("_t", times).where("_t > 0").withColumn(offset, F.explode(F.expr("sequence(0L, cast(_t as bigint) - 1)"))).drop("_t")


def aligned_offset(df: DataFrame, keys: Cols, order: Cols, length: Column, alignment: int, out: str, reserved: Column | None = None, reserved_offset: int = 1) -> DataFrame:
    """The sum of the earlier lengths, each rounded up to the alignment. Reserved rows have a fixed offset and move nobody."""
    is_reserved = F.lit(False) if reserved is None else F.coalesce(reserved, F.lit(False))
    padded = F.when(is_reserved, 0).otherwise(F.ceil(length / alignment) * alignment)
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.when(is_reserved, F.lit(reserved_offset)).otherwise(F.coalesce(F.sum(padded).over(w), F.lit(0))).cast("long"))


def positional_join(left: DataFrame, keys: Cols, order: Cols, before: str, number: str, right: DataFrame, index: str) -> DataFrame:
    """Row n of a group meets row ``before`` + n of ``right``, while n < ``number``; a ``number`` of 0 is no bound. An equi-join: no row pairs are scanned."""
    n = F.row_number().over(_window(keys, order)) - 1
    at = F.when((F.col(number) == 0) | (n < F.col(number)), F.col(before) + n).cast("long")
    return left.withColumn("_at", at).join(right.withColumn("_index", F.col(index).cast("long")), F.col("_at") == F.col("_index"), "left").drop("_at", "_index")


def interval_merge(df: DataFrame, keys: Cols, start: str, end: str, restarts: str | None = None) -> DataFrame:
    """Intervals that overlap as one; those that only touch stay apart. ``restarts`` names a column for the distinct starts within."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0)
    marked = df.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    aggs = [F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_intervals")]
    if restarts:
        aggs.append(F.array_sort(F.collect_set(start)).alias(restarts))
    return marked.groupBy(*keys, "_island").agg(*aggs).drop("_island")


def dense_index(df: DataFrame, order: Cols, out: str, keys: Cols = ()) -> DataFrame:
    """Numbers from 0 in order. With keys the numbers are each group's own; without, rows are numbered in range partitions whose counts are summed first, so no task gets all rows."""
    if keys:
        return df.withColumn(out, F.row_number().over(_window(keys, order)).cast("long") - 1)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    # a partition's rows count from its id shifted left by 33 bits
    ranged = ranged.withColumn("_i", F.expr("_m - shiftleft(cast(_p as bigint), 33)")).drop("_m")
    ranged = stored_table(ranged, "ranged")  # rows and counts must come from the same ranges
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_p").withColumn(out, (F.col("_before") + F.col("_i")).cast("long")).drop("_p", "_i", "_before")


def running_total(df: DataFrame, order: Cols, amount: Column, out: str, index: str) -> DataFrame:
    """The sum of an amount over all rows before, in order, and how many rows these are. Range partitions are summed each by itself, as they stream, and their totals first; no task gets all rows."""
    schema = T.StructType([*df.schema.fields, T.StructField("_p", T.IntegerType()), T.StructField(out, T.LongType()), T.StructField(index, T.LongType()), T.StructField("_a", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total, n = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            amounts = batch.column(batch.num_columns - 1).to_pylist()
            before = []
            for a in amounts:
                before.append(total)
                total += a
            places = range(n, n + len(before))
            n += len(before)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([part] * len(before), pa.int32()), pa.array(before, pa.int64()), pa.array(places, pa.int64()), batch.columns[-1]], names=schema.names)

    ranged = df.withColumn("_a", F.coalesce(amount.cast("long"), F.lit(0))).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored_table(ranged.mapInArrow(run, schema), "running")
    sums = ranged.groupBy("_p").agg(F.sum("_a").alias("_s"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_p", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
    # a row for each range partition
    return ranged.join(F.broadcast(sums), "_p").withColumns({out: F.col(out) + F.col("_s"), index: F.col(index) + F.col("_n")}).drop("_p", "_a", "_s", "_n")


#: Indices that share a bucket when ranges are taken out.
_BUCKET = 4096


def remove_ranges(df: DataFrame, index: str, ranges: DataFrame, low: str, count: str, out: str, order: Cols | None = None) -> DataFrame:
    """Rows whose index lies in no range [low, low + count), numbered anew. A range goes into each bucket of indices that it touches: an equi anti-join with the bounds as its condition."""
    spans = ranges.select(F.col(low).cast("long").alias("_low"), (F.col(low) + F.col(count)).cast("long").alias("_high")).where("_low < _high")
    spans = spans.withColumn("_bucket", F.explode(F.expr(f"sequence(cast(floor(_low / {_BUCKET}) as bigint), cast(floor((_high - 1) / {_BUCKET}) as bigint))")))
    at = F.col(index).cast("long")
    kept = df.withColumn("_own", F.floor(at / _BUCKET)).join(spans, (F.col("_own") == F.col("_bucket")) & (at >= F.col("_low")) & (at < F.col("_high")), "left_anti").drop("_own")
    return dense_index(kept, order or [index], out)


def contiguity(df: DataFrame, keys: Cols, value: str, first: int = 0) -> DataFrame:
    """For each group whether its distinct values are exactly first, first + 1, ... and none comes twice."""
    n, d = F.count(value), F.countDistinct(value)
    ok = (n == d) & (F.min(value) == first) & (F.max(value) == first + n - 1)
    return df.groupBy(*keys).agg(n.alias("n_values"), F.coalesce(ok, F.lit(False)).alias("contiguous"))


def budget(df: DataFrame, keys: Cols, order: Cols, amount: str, limit: float) -> DataFrame:
    """For each group the first row at which the running total exceeds the limit."""
    running = F.sum(amount).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    over = df.withColumn("running", running).where(F.col("running") > limit)
    first = F.min(F.struct(*order, "running")).alias("_f")
    return over.groupBy(*keys).agg(first).select(*keys, *(F.col(f"_f.{c}").alias(c) for c in order), F.col("_f.running").alias("running"))
