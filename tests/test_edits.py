"""Edits of archives as tables."""

import pytest
from pyspark.sql import functions as F

from lodestack.operators import edits

ENTRY = "archive string, ordinal int, path string, kind string, time struct<kind:string,value:long>, data binary"


def entries(spark):
    return spark.createDataFrame([("a", 0, "x", "file", ("raw", 1), b"0"), ("a", 1, "y", "directory", ("none", None), b""), ("a", 2, "x", "file", ("dos", None), b"2"), ("b", 0, "z", "file", ("none", None), b"3")], ENTRY)


def paths(df):
    return [(r.archive, r.ordinal, r.path) for r in df.orderBy("archive", "ordinal").collect()]


def test_entry_edits(spark):
    e = entries(spark)
    new = spark.createDataFrame([("a", 0, "n1", "file", None, b"n"), ("a", 1, "n2", "file", None, b"m")], ENTRY)
    assert paths(edits.insert(e, new, 1)) == [("a", 0, "x"), ("a", 1, "n1"), ("a", 2, "n2"), ("a", 3, "y"), ("a", 4, "x"), ("b", 0, "z")]
    assert paths(edits.insert(e, new))[3:5] == [("a", 3, "n1"), ("a", 4, "n2")]
    assert paths(edits.remove(e, F.col("path") == "y")) == [("a", 0, "x"), ("a", 1, "x"), ("b", 0, "z")]
    assert paths(edits.rename(e, "x", "w"))[0] == ("a", 0, "w")
    changed = edits.replace(e, spark.createDataFrame([("a", "x", b"new"), ("a", "none", b"!")], "archive string, path string, data binary"))
    assert [(r.ordinal, bytes(r.data)) for r in changed.where("archive = 'a' and path = 'x'").orderBy("ordinal").collect()] == [(0, b"new"), (2, b"2")]
    kept, log = edits.for_flat(e)
    assert paths(kept) == [("a", 0, "x"), ("a", 1, "x"), ("b", 0, "z")]
    assert sorted((r.ordinal, r.change) for r in log.collect()) == [(1, "entry dropped"), (2, "time dropped")]


def test_bundle_edits(spark):
    packets = spark.createDataFrame([(0, "P", 10, 2, 0), (1, "Q", 11, 1, 2), (2, "R", 12, 3, 3)], "packet_index int, name string, pool_index int, ptx_number int, ptx_before int")
    change = spark.createDataFrame([(0, "P2", 4)], "packet_index int, name string, ptx_number int")
    removed = spark.createDataFrame([(1,)], "packet_index int")
    added = spark.createDataFrame([("S", 1)], "name string, ptx_number int")
    edited = edits.edited_packets(packets, change, removed, added)
    assert [tuple(r) for r in edited.select("old_index", "new_index", "name", "ptx_number", "ptx_before").orderBy("new_index").collect()] == [(0, 0, "P2", 4, 0), (2, 1, "R", 3, 4), (None, 2, "S", 1, 7)]
    with pytest.raises(Exception, match="duplicate packet name"):
        edits.edited_packets(packets, change, removed, spark.createDataFrame([("r", 1)], "name string, ptx_number int")).collect()
    files = spark.createDataFrame([("b", 12), ("A", 10), ("q", 11)], "path string, pool_index int")
    replaced = spark.createDataFrame([(0, ["n1", "n2"])], "old_index long, paths array<string>")
    assert [tuple(r) for r in edits.edited_file_list(files, packets, edited, replaced).collect()] == [("b", 1), ("n1", 0), ("n2", 0)]
    with pytest.raises(Exception, match="no code for 99"):
        edits.edited_file_list(spark.createDataFrame([("b", 99)], "path string, pool_index int"), packets, edited, replaced).collect()
    composites = spark.createDataFrame([("C", True, [(1,), (2,)]), ("D", True, [(1,)])], "name string, is_composite boolean, packets array<struct<packet_index:int>>")
    assert [(r.name, [x.packet_index for x in r.packets]) for r in edits.edited_composites(composites, edited).collect()] == [("C", [1])]
    textures = spark.createDataFrame([(i, i * 10) for i in range(6)], "ptx_index int, width int")
    assert [(r.ptx_index, r.width) for r in edits.edited_textures(textures, packets, removed).orderBy("ptx_index").collect()] == [(0, 0), (1, 10), (2, 30), (3, 40), (4, 50)]


def test_versioned_lookup(spark):
    rows = spark.createDataFrame([(120, 1), (125, 1), (130, 2), (130, 9)], "version int, code int")
    names = spark.createDataFrame([(1, 0, 125, "old"), (1, 125, None, "new"), (2, 128, None, "two")], "value int, since int, until int, name string")
    assert sorted((r.version, r.code, r.meaning) for r in edits.versioned_lookup(rows, "version", "code", names).collect()) == [(120, 1, "old"), (125, 1, "new"), (130, 2, "two"), (130, 9, None)]
