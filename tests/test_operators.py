"""Operators on small fixtures, with the cases that a naive mapping gets wrong."""

import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as fx
from lodestack.operators import keyed, ordered


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_lookahead_span_skips_rows_that_are_no_boundary(spark):
    df = spark.createDataFrame([(0, 0, 10, 50, True), (0, 1, 12, 5, False), (0, 2, 30, 15, True), (1, 3, 5, 7, True)], "file int, i int, off long, len long, edge boolean")
    got = ordered.lookahead_span(df, ["file"], "off", ["off", "i"], "span", end=F.when(F.col("file") == 0, 100), stored=F.col("len"), boundary=F.col("edge"))
    assert rows(got.select("i", "span")) == [(0, 20), (1, 0), (2, 15), (3, 7)]


def test_lookahead_span_placeholder_and_overlap(spark):
    df = spark.createDataFrame([(0, 10, 0), (1, 10, 4), (2, 40, 99)], "i int, off long, len long")
    got = ordered.lookahead_span(df, [], "off", ["off", "i"], "span", end=F.lit(30), stored=F.col("len"), placeholder=F.col("len") == 99)
    assert rows(got.select("i", "span")) == [(0, 0), (1, 4), (2, 0)]


def test_forward_fill_default_before_first(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None)], "k int, x double")
    assert rows(ordered.forward_fill(df, [], ["k"], {"x": 1.0})) == [(1, 1.0), (2, 5.0), (3, 5.0)]


def test_tolerance_counts_from_last_emitted(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.0, 0.0008, 0.0016, 1.0])], "t int, k int, v double")
    assert [r[-1] for r in rows(ordered.tolerance_delta(df, ["t"], ["k"], "v", 0.001, "e"))] == [None, None, 0.0016, 1.0]


def test_run_length_expand_drops_zero_and_negative(spark):
    df = spark.createDataFrame([(1, 2), (2, 0), (3, -1), (4, None)], "k int, n int")
    assert rows(ordered.run_length_expand(df, F.col("n"), "o").select("k", "o")) == [(1, 0), (1, 1)]


def test_aligned_offset_reserved_rows(spark):
    df = spark.createDataFrame([(1, 5), (0, 0), (2, 16), (3, 1)], "id int, size int").withColumn("at", F.monotonically_increasing_id())
    got = ordered.aligned_offset(df, [], ["at"], F.col("size"), 16, "off", reserved=F.col("id") == 0)
    assert rows(got.select("id", "off")) == [(0, 1), (1, 0), (2, 16), (3, 32)]


def test_interval_merge_keeps_touching_apart(spark):
    df = spark.createDataFrame([(0, 5), (3, 8), (8, 9), (3, 4)], "a int, b int")
    assert rows(ordered.interval_merge(df, [], "a", "b", "s").select("a", "b", "s")) == [(0, 8, [0, 3]), (8, 9, [8])]


def test_positional_join_bound_and_none(spark):
    left = spark.createDataFrame([("p", i, 10, 2) for i in range(3)] + [("q", i, 20, 0) for i in range(2)], "p string, i int, before int, number int")
    right = spark.createDataFrame([(i,) for i in range(30)], "idx int")
    assert rows(ordered.positional_join(left, ["p"], ["i"], "before", "number", right, "idx").select("p", "i", "idx")) == [("p", 0, 10), ("p", 1, 11), ("p", 2, None), ("q", 0, 20), ("q", 1, 21)]


def test_dense_index_without_keys_has_no_gap(spark):
    df = spark.range(0, 1000, 7, 5).withColumn("v", F.col("id") * -1)
    got = rows(ordered.dense_index(df, ["v"], "n").select("n", "v"))
    assert [n for n, _ in got] == list(range(143)) and [v for _, v in got] == sorted(v for _, v in got)


def test_dense_index_of_nothing(spark):
    assert ordered.dense_index(spark.range(0), ["id"], "n").count() == 0


def test_contiguity(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2), ("c", 0), ("c", 0), ("d", None)], "k string, v int")
    assert rows(ordered.contiguity(df, ["k"], "v").select("k", "contiguous")) == [("a", True), ("b", False), ("c", False), ("d", False)]


def test_budget_first_offender(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 3, 1), ("b", 1, 10)], "k string, i int, n int")
    assert rows(ordered.budget(df, ["k"], ["i"], "n", 10)) == [("a", 2, 11)]


def test_dictionary_with_root(spark):
    df = spark.createDataFrame([(3, "A"), (1, "b"), (2, "a")], "i int, d string")
    assert rows(keyed.first_seen_dictionary(df, F.lower("d"), "i", root="")) == [("", 0), ("a", 2), ("b", 1)]


def test_mandatory_remap_fails_on_unknown(spark):
    df = spark.createDataFrame([(1,), (9,)], "k int")
    codes = spark.createDataFrame([(1, 0)], "k int, c int")
    with pytest.raises(Exception, match="no code for 9"):
        keyed.mandatory_remap(df, "k", codes, "k", "c", "n").collect()
    assert rows(keyed.mandatory_remap(df, "k", codes, "k", "c", "n", strict=False)) == [(1, 0), (9, None)]


def test_conflict_reports_first_earlier(spark):
    df = spark.createDataFrame([("x", 1, "g1", "p", 1), ("x", 2, "g2", "p", 2), ("x", 3, "g1", None, 1), ("y", 4, "g1", None, 1)], "id string, o int, g string, p string, r int")
    ok = (F.col("g") != F.col("earlier_g")) & (F.col("p") == F.col("earlier_p")) & (F.col("r") != F.col("earlier_r"))
    assert rows(keyed.first_conflict(df, ["id"], "o", ok, ["g", "p", "r"])) == [("x", 3, 1)]


def test_audit_uses_last_of_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "i int, p string")
    dim = spark.createDataFrame([("a", 0, "simple"), ("a", 1, "composite"), ("b", 0, "composite"), ("b", 1, "simple")], "id string, o int, kind string")
    assert rows(keyed.referential_audit(df, "p", dim, "id", "o", "kind", F.lit("composite"), "s").select("i", "s")) == [(1, "ok"), (2, "wrong kind"), (3, "missing"), (4, "ok")]


def test_delta_round_trip(spark):
    before = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("gone", b"3")], "k string, v binary")
    after = spark.createDataFrame([("a", b"1"), ("b", b"9"), ("new", b"4")], "k string, v binary")
    patch = keyed.delta(before, after, "k", "v")
    assert {r.k: r.patch for r in patch.collect()} == {"a": None, "b": b"9", "new": b"4"}
    assert rows(keyed.apply_delta(before, patch, "k", "v")) == rows(after)
    with pytest.raises(Exception, match="differs"):
        keyed.apply_delta(after.withColumn("v", F.lit(b"x")), patch, "k", "v").collect()


def test_filter_nested_drops_empty(spark):
    df = spark.createDataFrame([("g", [(0,), (1,)]), ("h", [(2,)])], "n string, c array<struct<i:int>>")
    left = spark.createDataFrame([(1, 0)], "old int, new int")
    assert rows(keyed.filter_nested(df, "c", "i", left, "old", "new").select("n", "c.i")) == [("g", [0])]


def test_human_size(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1280,), (1 << 30,), (1 << 41,)], "n long")
    assert [r[1] for r in rows(df.select("n", fx.human_size(F.col("n"))), "n")] == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.0 GB", "2048.0 GB"]


def test_path_problems(spark):
    df = spark.createDataFrame([("a/b",), ("",), ("/x",), ("C:\\x",), ("a/../b",), ("a\x00",), ("..a",)], "p string")
    assert {r[0]: r[1] for r in df.select("p", fx.path_problem(F.col("p"))).collect()} == {"a/b": None, "": "empty", "/x": "absolute", "C:\\x": "drive", "a/../b": "parent", "a\x00": "nul", "..a": None}


def test_bits(spark):
    r = spark.range(1).select(fx.bit_field(F.lit(-1).cast("long"), 60, 4), fx.with_bit_field(F.lit(0xFF), 4, 2, F.lit(1)), fx.unzigzag(fx.zigzag(F.lit(-77))), fx.varint_length(F.lit(128)), fx.is_zlib(F.lit(b"\x78\x9c")), fx.is_zlib(F.lit(b"\x78"))).first()
    assert tuple(r) == (15, 0xDF, -77, 2, True, False)


def test_checksums(spark):
    import bz2
    import struct

    from lodestack.functions import checksums

    df = spark.createDataFrame([(b"hello",), (b"",), (None,)], "x binary")
    got = [tuple(r) for r in df.select(checksums.adler32("x"), checksums.bzip_crc32("x")).collect()]
    # a bzip2 block holds its own checksum behind the ten bytes of both heads
    assert got[0] == (0x062C0215, struct.unpack_from(">I", bz2.compress(b"hello"), 10)[0]) and got[1] == (1, 0) and got[2] == (None, None)
