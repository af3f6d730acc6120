"""Connected components of a table of links, without bringing links to the driver.

Alternating star contraction: large-star hangs every larger neighbour on the
smallest, small-star does so for the smaller ones; both keep connectivity and
the longest chain halves with each pair of steps. Neighbour minima are
map-side aggregates joined back, so a node with many links is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import dropped, few_files, materialise


def _star(edges: DataFrame, large: bool, rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """About so many edges (u, v), u > v, to edges of the same form that hang neighbours on minima, and what is stored for them."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    held = []
    if large:  # a centre has many neighbours here: with the minima stored, both sides of the join are plain exchanges, which Spark can split
        low = materialise(few_files(low, 2 * rows), "minima")
        held.append(low)
    hung = both.join(low.hint("merge"), "u")
    if large:
        out = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct(), held


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component), stored: for every node of a link, the smallest node reachable. Links may repeat or loop and are read twice; an empty table gives an empty result."""
    rows = edges.count()
    now = materialise(
        few_files(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct(), rows), "links"
    )
    mark = None
    for _ in range(max_rounds):
        hung, held = _star(now, True, rows)
        settled, _ = _star(hung, False, rows)
        before, now = now, materialise(few_files(settled, 2 * rows), "stars")
        dropped(before, *held)
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(v as decimal(38,0)))")).first()
        if mark == seen:
            break
        mark, rows = seen, seen[0]
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = materialise(few_files(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), 2 * rows), "components")
    dropped(now)
    return out
