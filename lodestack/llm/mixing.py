"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions alone.

A weight is a positive whole number, relative to the other sources' weights;
their sum Q is the period. A source's rows, in the order of a digest of their
id, are cut into blocks. Block j of a source of weight q may start at slot
floor(j Q / q) and must be placed before slot ceil((j + 1) Q / q); of the blocks
that may start, each slot takes the one with the earliest deadline. The
weights fill every slot, so all deadlines are met: as long as a source has
rows, its share of the first t slots differs from t q / Q by less than one
block. When a source has run out its slots stay empty and the others go on in
their proportions. Every row is placed once.

The schedule repeats after Q slots, so one period is computed by a fold. Its
state is a count for each different weight: sources of one weight have the same
windows and take turns, so the fold's cost is Q times the number of different
weights, however many sources there are. The weights that are named may add up
to ``MAX_NAMED``; every other source adds 1. The period is broadcast up to
``BROADCAST`` slots and joined by sorting beyond that.

Rows are numbered in two levels: counts of (source, digest cell) first, then
row numbers within a cell. With 4096 cells a source of a third of all rows is
dealt like any other. A row's slot follows from its number by arithmetic; its
position among all rows is the number of rows in earlier periods, summed in two
levels, and its place in its own period, which has at most Q blocks.

Defined cases: rows without a source are a source of their own, by default of
weight 1, as is any source that ``weights`` does not name; rows without an id
are dealt over the cells by a number of the row, in an order that is not fixed;
rows that repeat an id are placed next to each other in an order that is not
fixed; an empty table gives an empty result; text is not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise

#: Rows in a block.
BLOCK_ROWS = 16
#: What the named weights may add up to, and the slots of a period up to which it is broadcast.
MAX_NAMED, BROADCAST = 4096, 65_536
#: Periods whose rows are summed together, and slots that the fold strings together at a time.
_PERIODS, _STRING = 4096, 256
#: Leading hexadecimal digits of the digest that make a cell.
CELL_DIGITS = 3


def _keyed(docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """Each row as one struct, with its source as a key that is never null and its order within the source."""
    source = F.col(source_col).cast("string")

    def keyed(rows: DataFrame, order) -> DataFrame:
        return rows.select(
            F.struct(*(docs[c] for c in docs.columns)).alias("_row"),
            F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source)).alias("_source"),
            order.alias("_order"),
            F.substring(order, 1, CELL_DIGITS).alias("_cell"),
            F.col(id_col).alias("_id"),
        )

    known = keyed(docs.where(F.col(id_col).isNotNull()), F.md5(F.col(id_col).cast("string")))
    bare = docs.where(F.col(id_col).isNull())
    if bare.isEmpty():
        return known
    # stored, as their numbers must be the same each time they are read
    return known.unionByName(materialise(keyed(bare, F.md5(F.monotonically_increasing_id().cast("string"))), "without-ids"))


def _schedule(counts: DataFrame, weights: Mapping[str, int]) -> DataFrame:
    """(source, q, k, slot, period) for every slot of a period: block k of the source in this period has the slot."""
    if any(w != int(w) or w < 1 for w in weights.values()):
        raise ValueError("weights are positive whole numbers")
    weight = F.lit(None).cast("int")
    if weights:
        weight = F.create_map(*(F.lit(x) for k, w in weights.items() for x in ("=" + k, int(w))))[F.col("_source")]
    sources = counts.select("_source").distinct().withColumn("_w", weight).withColumn("q", F.coalesce("_w", F.lit(1)).cast("long"))
    one = sources.agg(F.sort_array(F.collect_list(F.struct("_source", "q"))).alias("src"), F.sum("q").alias("Q"), F.sum("_w").alias("_named"))
    one = one.where("Q is not null").withColumn("Q", F.expr(f"if(_named > {MAX_NAMED}, raise_error('the weights add up to more than {MAX_NAMED}'), Q)"))
    # the sources of a weight, in their order; the m-th block of them all is block m div (their number) of source m mod (their number)
    same = "transform(array_sort(array_distinct(src.q)), w -> struct(w as q, filter(sequence(0, size(src) - 1), i -> src[i].q = w) as at))"
    one = one.withColumn("same", F.expr(same)).withColumn("same", F.expr("transform(same, x -> struct(x.q as q, x.at as at, cast(size(x.at) as bigint) as g))"))
    block, of = "(a.k[i] div same[i].g)", "same[i].at[cast(a.k[i] % same[i].g as int)]"
    free = f"filter(sequence(0, size(same) - 1), i -> {block} < same[i].q and ({block} * Q) div same[i].q <= t)"
    first = f"array_min(transform({free}, i -> struct((({block} + 1) * Q + same[i].q - 1) div same[i].q as d, {of} as s, i as i)))"
    step = f"transform(array({first}), p -> named_struct('k', transform(a.k, (v, i) -> if(i = p.i, v + 1L, v)), 'out', concat(a.out, array(p.s))))[0]"
    none = "cast(array() as array<int>)"
    part = f"aggregate(sequence(u * {_STRING}L, least(u * {_STRING}L + {_STRING - 1}, Q - 1)), named_struct('k', o.k, 'out', {none}), (a, t) -> {step})"
    outer = f"transform(array({part}), x -> named_struct('k', x.k, 'out', concat(o.out, x.out)))[0]"
    fold = f"aggregate(sequence(0L, (Q - 1) div {_STRING}), named_struct('k', transform(same, x -> 0L), 'out', {none}), (o, u) -> {outer}).out"
    slots = one.select("src", "Q", F.posexplode(F.expr(fold)).alias("_slot", "_p")).select(
        F.expr("src[_p]._source").alias("_source"), F.expr("src[_p].q").alias("_q"), F.col("_slot").cast("long").alias("_slot"), F.col("Q").alias("_period")
    )
    return slots.withColumn("_k", (F.row_number().over(Window.partitionBy("_source").orderBy("_slot")) - 1).cast("long"))


def slots(docs: DataFrame, weights: Mapping[str, int] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, block, slot, place, turn): each row of ``docs`` as a struct, its block within the source, the block's slot, its place in the block, and the period."""
    rows = _keyed(docs, id_col, source_col)
    counts = rows.groupBy("_source", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("_source", "_cell").orderBy("_order", "_id")
    numbered = rows.withColumn("_at", F.row_number().over(within) - 1).join(cells.hint("merge"), ["_source", "_cell"]).withColumn("_n", F.col("_before") + F.col("_at"))
    plan = materialise(_schedule(counts, weights or {}), "schedule")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST else plan.hint("merge")
    placed = (
        numbered.withColumn("_block", F.expr(f"_n div {block_rows}"))
        .join(plan.withColumnRenamed("_source", "_s"), F.expr("_source = _s and _block % _q = _k"))
        .withColumn("_turn", F.expr("_block div _q"))
    )
    return placed.select(
        F.col("_row").alias("row"), F.col("_block").alias("block"), F.expr("_turn * _period + _slot").alias("slot"), F.expr(f"_n % {block_rows}").alias("place"), F.col("_turn").alias("turn")
    )


def place(docs: DataFrame, weights: Mapping[str, int] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, block, slot, position): ``slots`` with each row's place among all, from 0 without gaps. The rows are stored once, so they should be narrow."""
    placed = materialise(slots(docs, weights, id_col, source_col, block_rows), "slots")
    turns = placed.groupBy("turn").agg(F.count(F.lit(1)).alias("_n")).withColumn("_far", F.expr(f"turn div {_PERIODS}"))
    earlier = Window.partitionBy("_far").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each _PERIODS periods, so for that many times Q blocks
    far = turns.groupBy("_far").agg(F.sum("_n").alias("_all")).withColumn("_base", F.sum("_all").over(Window.orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)))
    starts = turns.withColumn("_within", F.sum("_n").over(earlier)).join(far.hint("merge"), "_far")
    starts = materialise(starts.select(F.col("turn").alias("_turn"), (F.coalesce("_base", F.lit(0)) + F.coalesce("_within", F.lit(0))).alias("_start")), "periods")
    inside = F.row_number().over(Window.partitionBy("turn").orderBy("slot", "place")) - 1
    return placed.withColumn("_at", inside).join(starts.hint("merge"), F.col("turn") == F.col("_turn")).select("row", "block", "slot", (F.col("_start") + F.col("_at")).alias("position"))


def mixed_order(docs: DataFrame, weights: Mapping[str, int] | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """For each row: doc_id, source, block, slot, position."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    return place(picked, weights).select("row.doc_id", "row.source", "block", "slot", "position")


def mixed(docs: DataFrame, weights: Mapping[str, int] | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` in mixed order: the partitions are ranges of slots, sorted, so that the files written from them follow one another."""
    out = slots(docs, weights, id_col, source_col).select("row", "slot", "place")
    return out.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")
