"""What only more rows than the smallest tables have can show."""

import duckdb

from lodestack.codecs import chunked, delta
from lodestack.plans import decoded
from lodestack.sources.decoders import TABLES

from .compare import same


def test_aac_files_rates_are_exact(spark, tmp_path):
    """Key 668 plays 1,800 / 8,668 seconds: 4,334 bytes a second exactly, which a quotient of floats passes."""
    spark.range(600, 2700).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    db = duckdb.connect()
    db.sql(f"create view supplier as from '{tmp_path}/supplier.parquet/*.parquet'")
    same(decoded.aac_files(spark, str(tmp_path)), db, decoded.SQL["aac_files"])


def test_bundle_patches_are_made_by_many_tasks(spark):
    assert decoded.bundle_patches(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_equal_blocks_that_cannot_win_are_not_measured(monkeypatch):
    """A page of zeros has 256 equal blocks; once a match reaches the end, no other can be longer."""
    calls = []
    common = delta._common
    monkeypatch.setattr(delta, "_common", lambda *a: calls.append(1) or common(*a))
    source, target = bytes(4096) + b"text" + bytes(4096), bytes(2048) + b"other" + bytes(4096)
    assert delta.decode(source, delta.encode(source, target)) == target
    assert len(calls) < 40


def test_chunks_are_placed_once_for_all_files(monkeypatch):
    calls = []
    layout = chunked.resolve_layout
    monkeypatch.setattr(chunked, "resolve_layout", lambda *a: calls.append(1) or layout(*a))
    files = [(f"f/{k}", b"%d" % k * k, ("zlib", "copy", "bzip", "lzma")[k % 4]) for k in range(40)]
    rows = list(TABLES["chunked.files"][1](chunked.write(files)))
    assert [(r["path"], r["data"]) for r in rows] == [f[:2] for f in files]
    assert len(calls) == 1


def test_lzma_chunks_have_the_formats_dictionary():
    """The codec's header is a byte of properties and the dictionary's size: 64 KB, as the format's own tools write it."""
    data = chunked.write([("a", b"text", "lzma")])
    at = chunked.read_index(data)["chunks"][0]["offset"]
    assert data[at : at + 5] == b"\x5d\x00\x00\x01\x00"
