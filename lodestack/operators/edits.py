"""Edits of archives that have been read into tables: entries by ordinal, packets by name, and what follows for the tables that refer to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import keyed, ordered

# entries of flat archives: (archive, ordinal, path, kind, time, data)


def insert(entries: DataFrame, new: DataFrame, at: int | None = None, archive: str = "archive") -> DataFrame:
    """New entries, in their own order, before the ordinal ``at`` of their archive, or at its end; ordinals have no gap afterwards."""
    place = F.col("ordinal").cast("double")
    if at is None:
        both = entries.withColumn("_o", F.struct(F.lit(0), place)).unionByName(new.withColumn("_o", F.struct(F.lit(1), place)))
    else:
        both = entries.withColumn("_o", F.struct(F.when(F.col("ordinal") < at, 0).otherwise(2), place)).unionByName(new.withColumn("_o", F.struct(F.lit(1), place)))
    return ordered.dense_index(both.drop("ordinal"), ["_o"], "ordinal", [archive]).withColumn("ordinal", F.col("ordinal").cast("int")).select(entries.columns)


def remove(entries: DataFrame, gone: Column, archive: str = "archive") -> DataFrame:
    """Without the entries that a condition names, numbered anew."""
    left = entries.where(~F.coalesce(gone, F.lit(False))).withColumnRenamed("ordinal", "_o")
    return ordered.dense_index(left, ["_o"], "ordinal", [archive]).withColumn("ordinal", F.col("ordinal").cast("int")).select(entries.columns)


def rename(entries: DataFrame, old: str, new: str) -> DataFrame:
    """Every entry of a path, byte for byte."""
    return entries.withColumn("path", F.when(F.col("path") == old, new).otherwise(F.col("path")))


def replace(entries: DataFrame, contents: DataFrame, path: str = "path", data: str = "data", archive: str = "archive") -> DataFrame:
    """The first entry of each path in ``contents`` (archive, path, data) gets that content."""
    first = keyed.lookup_first(contents.withColumn("_want", F.struct(archive, path)), "_want", entries.withColumn("_have", F.struct(archive, path)), "_have", "ordinal")
    new = first.where("first_match is not null").select(archive, F.col("first_match").alias("ordinal"), F.col(data).alias("_new"))
    return entries.join(new, [archive, "ordinal"], "left").withColumn(data, F.coalesce("_new", data)).select(entries.columns)


def for_flat(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries that a flat archive can hold, what is lost): folders and links go, calendar times become none."""
    lost = F.when(F.col("kind") != "file", "entry dropped").when(F.col("time.kind") == "dos", "time dropped")
    log = entries.withColumn("change", lost).where("change is not null").select("archive", "ordinal", "path", "change")
    kept = remove(entries, F.col("kind") != "file")
    none = F.lit(None).cast(dict(entries.dtypes)["time"])
    return kept.withColumn("time", F.when(F.col("time.kind") == "dos", none).otherwise(F.col("time"))), log


# bundles: packets (name, packet_index, pool_index, ptx_number, ptx_before) and the tables that refer to them


def edited_packets(packets: DataFrame, edits: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(old_index, new_index, name, ptx_number, ptx_before) after edits (packet_index, name, ptx_number; null keeps), removals (packet_index) and additions (name, ptx_number).

    Packets keep their order, additions come last; textures are numbered on from
    packet to packet. Names that differ only in case fail.
    """
    e = edits.select("packet_index", F.col("name").alias("_name"), F.col("ptx_number").alias("_n"))
    own = packets.join(e, "packet_index", "left").join(removed.select("packet_index").distinct(), "packet_index", "left_anti")
    own = own.select(F.col("packet_index").cast("long").alias("old_index"), F.coalesce("_name", "name").alias("name"), F.coalesce("_n", "ptx_number").cast("long").alias("ptx_number"), F.struct(F.lit(0), F.col("packet_index").cast("long")).alias("_o"))
    new = added.select(F.lit(None).cast("long").alias("old_index"), "name", F.col("ptx_number").cast("long").alias("ptx_number"), F.struct(F.lit(1), F.monotonically_increasing_id()).alias("_o"))
    every = keyed.assert_unique(own.unionByName(new), F.lower("name"), "packet name")
    numbered = ordered.dense_index(every, ["_o"], "new_index")
    return ordered.aligned_offset(numbered, [], ["new_index"], F.col("ptx_number"), 1, "ptx_before").drop("_o")


def edited_file_list(file_list: DataFrame, packets: DataFrame, edited: DataFrame, replaced: DataFrame) -> DataFrame:
    """Paths of surviving packets under new numbers; those of packets in ``replaced`` (old_index, paths) come from there. A pool that belongs to no packet fails, as do two paths that differ only in case."""
    owner = packets.select(F.col("pool_index").alias("_pool"), F.col("packet_index").cast("long").alias("_old"))
    found = keyed.mandatory_remap(file_list, "pool_index", owner, "_pool", "_old", "old_index")
    kept = found.join(replaced.select("old_index").distinct(), "old_index", "left_anti").select("path", "old_index")
    fresh = replaced.select(F.explode("paths").alias("path"), F.col("old_index").cast("long").alias("old_index"))
    rows = kept.unionByName(fresh).join(edited.where("old_index is not null").select("old_index", "new_index"), "old_index")
    return keyed.assert_unique(rows, F.lower("path"), "path").select("path", F.col("new_index").alias("pool_index")).orderBy(F.lower("path"))


def edited_composites(composites: DataFrame, edited: DataFrame) -> DataFrame:
    """Composites (name, is_composite, packets) with the packets that survive, under their new numbers; composites without any go."""
    survivors = edited.where("old_index is not null").select(F.col("old_index").cast("int").alias("_old"), F.col("new_index").cast("int").alias("_new"))
    return keyed.filter_nested(composites, "packets", "packet_index", survivors, "_old", "_new")


def edited_textures(textures: DataFrame, packets: DataFrame, removed: DataFrame) -> DataFrame:
    """Texture records without those of removed packets, numbered anew."""
    ranges = packets.join(removed.select("packet_index").distinct(), "packet_index", "left_semi").select(F.col("ptx_before").alias("low"), F.col("ptx_number").alias("n"))
    return ordered.remove_ranges(textures, "ptx_index", ranges, "low", "n", "new_index").drop("ptx_index").withColumnRenamed("new_index", "ptx_index")


def texture_ids(files: DataFrame) -> DataFrame:
    """For each packet whether its texture ids are 0, 1, ... each once."""
    return ordered.contiguity(files.where("is_part1").withColumn("_id", F.col("part1.id")), ["packet"], "_id")


# versioned look-ups


def versioned_lookup(rows: DataFrame, version: str, value: str, dimension: DataFrame, out: str = "meaning") -> DataFrame:
    """The name that a value has in a row's version. ``dimension`` has (value, since, until, name), until exclusive or null; the rows of one value may not overlap.

    The dimension holds a few hundred rows by nature, a hundred thousand at most
    (checked); it is broadcast, and the join is by value with the range as its condition.
    """
    if dimension.limit(100_001).count() > 100_000:
        raise ValueError("a dimension of more than 100,000 rows")
    d = dimension.select(F.col("value").alias("_v"), F.col("since").alias("_a"), F.col("until").alias("_b"), F.col("name").alias(out))
    fits = (F.col(value) == F.col("_v")) & (F.col(version) >= F.col("_a")) & (F.col("_b").isNull() | (F.col(version) < F.col("_b")))
    return rows.join(F.broadcast(d), fits, "left").drop("_v", "_a", "_b")
