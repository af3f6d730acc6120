"""Files to tables, tables to files, commands end to end, and streams."""

import json
import pathlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import commands
from lodestack.codecs import animation, audio, bundle, chunked, flat, keyframes, manifest, scene, soundbank, texture, tree, wrappers
from lodestack.operators.validation import validate_manifests
from lodestack.sinks import files as sink
from lodestack.sources import datasource, tables
from lodestack.streaming import files as streaming


@pytest.fixture()
def folder(tmp_path):
    def write(name, data):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
        return str(at)

    write.root = tmp_path
    return write


def test_bad_files_are_rows_or_failures(spark, folder):
    folder("in/good.pak", flat.write([(flat.Entry(b"a"), b"1")]))
    folder("in/bad.pak", b"nothing")
    got = tables.read_table(spark, str(folder.root / "in"), "flat.files").select(F.substring_index("file", "/", -1).alias("f"), "path", "error").collect()
    assert {(r.f, r.path, r.error is None) for r in got} == {("good.pak", "a", True), ("bad.pak", None, False)}
    with pytest.raises(Exception, match="no archive begins"):
        tables.read_table(spark, str(folder.root / "in"), "flat.files", strict=True).collect()
    assert tables.read_table(spark, str(folder.root / "in"), "flat.files", glob="good*").count() == 1


def test_data_source_prunes_and_filters(spark, folder):
    datasource.register(spark)
    folder("in/a.pak", flat.write([(flat.Entry(f"d/{i}".encode()), b"x" * i) for i in range(20)], "plain", "zlib"))
    folder("in/b.pak", flat.write([(flat.Entry(b"e/1"), b"y")]))
    df = spark.read.format("flat_archive").option("withData", "true").load(str(folder.root / "in"))
    assert df.count() == 21
    some = spark.read.format("flat_archive").option("withData", "true").option("prefix", "d/1").load(str(folder.root / "in")).where(F.col("original_size") > 11)
    assert sorted((r.path, len(r.data)) for r in some.collect()) == [(f"d/{i}", i) for i in range(12, 20)]
    assert df.where("path = 'd/2'").count() == 1 and df.count() == 21
    assert "data" not in spark.read.format("flat_archive").load(str(folder.root / "in")).columns
    df.select("path", "data").repartition(2).write.format("flat_archive").option("profile", "aligned").mode("append").save(str(folder.root / "out"))
    assert spark.read.format("flat_archive").load(str(folder.root / "out")).count() == 21
    assert not list((folder.root / "out").glob("_*"))


def test_sink_refuses_unsafe_paths(spark, folder):
    df = spark.createDataFrame([("a/b", b"1"), ("../c", b"2")], "path string, data binary")
    with pytest.raises(Exception, match="unsafe path"):
        sink.write_files(df, str(folder.root / "out"))
    assert sink.write_files(df.where("path = 'a/b'"), str(folder.root / "out")) == {"files": 1, "bytes": 1}
    assert (folder.root / "out/a/b").read_bytes() == b"1"


def test_archive_commands(spark, folder):
    for name, data in (("x/1.txt", b"one"), ("x/2.bin", b"2" * 5000), ("3", b"")):
        folder(f"src/{name}", data)
    for pack, unpack, extra in (("pak.pack", "pak.unpack", {}), ("dzip.pack", "dzip.unpack", {"codec": "lzma"})):
        out, back = folder.root / pack, folder.root / unpack
        commands.run(spark, pack, input=str(folder.root / "src"), output=str(out), **extra)
        assert commands.run(spark, unpack, input=str(out), output=str(back)) == {"files": 3, "bytes": 5003}
        assert (back / "x/2.bin").read_bytes() == b"2" * 5000
    lines = [r.line for r in commands.run(spark, "pak.list", input=str(folder.root / "pak.pack")).collect()]
    assert lines[0].endswith("archive.pak: 3 entries") and lines[1:] == ["0 B\t3", "3 B\tx/1.txt", "4.9 KB\tx/2.bin"]
    commands.run(spark, "pak.list", input=str(folder.root / "pak.pack"), output=str(folder.root / "lists"))
    assert (folder.root / "lists/archive_list.txt").read_text().splitlines()[1:] == lines[1:]


def test_volumes(spark, folder):
    main, other = chunked.write_volumes([("a/1", b"one" * 99, "zlib", 0), ("a/2", b"two" * 99, "bzip", 1), ("3", b"", "copy", 1), ("4", b"\0" * 9, "zero", 1)], ["v.d01"])
    folder("in/v.dz", main)
    folder("in/v.d01", other)
    folder("in/w.dz", chunked.write([("w", b"w", "copy")]))
    assert commands.run(spark, "dzip.unpack", input=str(folder.root / "in"), output=str(folder.root / "o")) == {"files": 5, "bytes": 297 + 297 + 9 + 1}
    assert (folder.root / "o/a/2").read_bytes() == b"two" * 99 and (folder.root / "o/3").read_bytes() == b""


def test_conversion_commands(spark, folder):
    folder("j/t.json", json.dumps({"a": [1, "é"], "b": 1.5}).encode())
    run = lambda id_, a, b, **k: commands.run(spark, id_, input=str(folder.root / a), output=str(folder.root / b), **k)
    run("rton.encode", "j", "r", seed="s")
    run("rton.decode", "r", "j2", seed="s")
    assert json.loads((folder.root / "j2/t.json").read_text()) == {"a": [1, "é"], "b": 1.5}
    assert (folder.root / "r/t.rton").read_bytes()[:2] == b"\x10\0"
    for there, back, key in (("smf.encode", "smf.decode", {}), ("ctext.encode", "ctext.decode", {"seed": "q"}), ("cdat.encode", "cdat.decode", {"key": "00 ff", "key_format": "hex"})):
        folder(f"{there}/x.dat", b"payload" * 100)
        run(there, there, there + "o", **key)
        run(back, there + "o", back + "o", **key)
        assert next((folder.root / (back + "o")).iterdir()).read_bytes() == b"payload" * 100
    with pytest.raises(ValueError, match="missing"):
        run("ctext.encode", "j", "z")
    folder("w/s.wav", audio.wav((np.arange(1000) % 50).astype("<i2").tobytes(), 1, 8000, 16))
    run("wem.encode", "w", "wem", codec="adpcm")
    run("wem.decode", "wem", "wav")
    assert audio.inspect((folder.root / "wav/s.wav").read_bytes())["data_size"] == 2048
    with pytest.raises(ValueError, match="not one of"):
        run("wem.encode", "w", "wem", codec="mp3")


def test_texture_commands(spark, folder):
    image = np.random.default_rng(0).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    folder("p/i.png", texture.to_png(image))
    commands.run(spark, "ptx.encode", input=str(folder.root / "p"), output=str(folder.root / "t"), format="rgba8888")
    commands.run(spark, "ptx.decode", input=str(folder.root / "t"), output=str(folder.root / "q"), width="7", height="5", format="0")
    assert (texture.from_png((folder.root / "q/i.png").read_bytes()) == image).all()


def make_bundle(text=b"hello"):
    pixels = texture.encode(np.full((8, 8, 4), 7, np.uint8), "rgba8888")
    packet = bundle.pack_packet([{"path": "D\\A.TXT", "is_part1": False, "part1": None, "data": text}])
    images = bundle.pack_packet([{"path": "D\\B.PTX", "is_part1": True, "part1": {"id": 0, "width": 8, "height": 8}, "data": pixels}])
    packets = [{"name": "one", "data": packet, "pool_index": 0, "ptx_number": 0, "ptx_before": 0}, {"name": "two", "data": images, "pool_index": 1, "ptx_number": 1, "ptx_before": 0}]
    return bundle.build_bundle(packets, [{"ptx_index": 0, "width": 8, "height": 8, "pitch": 32, "format": 0, "alpha_size": None, "alpha_format": None}], [], [], [{"path": "D\\A.TXT", "pool_index": 0}])


def test_bundle_loop(spark, folder):
    folder("in/x.rsb", make_bundle())
    run = lambda id_, b, **k: commands.run(spark, id_, input=str(folder.root / "in"), output=str(folder.root / b), **k)
    assert run("rsb.unpack", "files", png="true")["files"] == 2
    assert (texture.from_png((folder.root / "files/D/B.png").read_bytes()) == 7).all() and not (folder.root / "files/D/B.PTX").exists()
    assert run("rsb.ptx-export", "png")["files"] == 1
    run("rsb.unpack", "raw")
    with pytest.raises(ValueError, match="nothing has changed"):
        run("rsb.pack", "out", edited=str(folder.root / "raw"))
    folder("raw/D/A.TXT", b"edited")
    run("rsb.pack", "out", edited=str(folder.root / "raw"))
    rebuilt = (folder.root / "out/x.rsb").read_bytes()
    assert {f["path"]: f["data"] for f in bundle.unpack_bundle(rebuilt)}["D\\A.TXT"] == b"edited"
    folder("target/x.rsb", rebuilt)
    run("rsbp.create", "patch", target=str(folder.root / "target"))
    run("rsbp.apply", "applied", patch=str(folder.root / "patch"))
    assert [f["data"] for f in bundle.unpack_bundle((folder.root / "applied/x.rsb").read_bytes())] == [f["data"] for f in bundle.unpack_bundle(rebuilt)]


def test_packet_commands(spark, folder):
    files = [{"path": "A\\B.TXT", "is_part1": False, "part1": None, "data": b"q"}, {"path": "C.PTX", "is_part1": True, "part1": {"id": 0, "width": 1, "height": 1}, "data": b"1234"}]
    folder("in/p.rsg", bundle.pack_packet(files))
    commands.run(spark, "rsgp.unpack", input=str(folder.root / "in"), output=str(folder.root / "u"))
    commands.run(spark, "rsgp.pack", input=str(folder.root / "u"), output=str(folder.root / "o"), name="p.rsg", flags="0")
    back = bundle.unpack_packet((folder.root / "o/p.rsg").read_bytes())
    assert sorted((f["path"], f["data"], f["part1"]) for f in back) == sorted((f["path"], f["data"], f["part1"]) for f in files)


def test_scene_round_trip(spark, folder):
    none = dict.fromkeys(keyframes.FIELDS + keyframes.TEXTS)
    frames = [none | {"x": 1.0, "i": "IMAGE_REANIM_HEAD"}, none, none | {"x": 5.0, "kx": 30.0, "ky": 30.0}, none | {"f": -1.0}, none | {"f": 0.0, "a": 0.5}]
    a = {"fps": 12.0, "tracks": [{"name": "t", "frames": frames}, {"name": "u", "frames": frames[:1]}]}
    back = scene.decode(scene.encode(a)[scene.DOCUMENT])
    assert [t["name"] for t in back["tracks"]] == ["t", "u"] and back["fps"] == 12.0
    got = back["tracks"][0]["frames"]
    assert got[0]["x"] == 1.0 and got[0]["i"] == "head" and got[1] == none and got[3]["f"] == -1.0 and got[4]["f"] == 0.0 and got[4]["a"] == 0.5
    assert abs(got[2]["kx"] - 30) < 0.01 and abs(got[2]["ky"] - 30) < 0.01 and got[2]["sx"] is None
    folder("in/w.compiled", keyframes.encode(a))
    commands.run(spark, "reanim.xfl-encode", input=str(folder.root / "in"), output=str(folder.root / "x"))
    commands.run(spark, "reanim.xfl-decode", input=str(folder.root / "x"), output=str(folder.root / "r"))
    assert keyframes.decode((folder.root / "r/w.reanim.compiled").read_bytes())[0]["tracks"][1]["name"] == "u"


def test_document_commands(spark, folder):
    run = lambda id_, a, b, **k: commands.run(spark, id_, input=str(folder.root / a), output=str(folder.root / b), **k)
    m = {"slot_count": 1, "groups": [{"kind": "simple", "id": "g", "resources": [{"type": "File", "slot": 0, "id": "i", "path": "p"}]}]}
    folder("m/a.json", json.dumps(m).encode())
    run("newton.encode", "m", "n")
    run("newton.decode", "n", "m2")
    assert json.loads((folder.root / "m2/a.json").read_text())["groups"][0]["resources"][0]["id"] == "i"
    sprite = {"name": "s", "frame_rate": 1.0, "work_area": [0, 0], "frame": []}
    a = {"version": 6, "frame_rate": 1, "position": [0.0, 0.0], "size": [1.0, 1.0], "image": [], "sprite": [sprite], "main_sprite": None}
    folder("a/a.json", json.dumps(a).encode())
    run("pam.encode", "a", "b")
    assert animation.decode((folder.root / "b/a.pam").read_bytes()) == a
    run("pam.decode", "b", "a2")
    folder("e/x.xml", b"<Emitter><Name>n</Name><SpawnRate>[1 2],50 EaseIn 3</SpawnRate></Emitter>")
    run("popfx.encode", "e", "c")
    run("popfx.decode", "c", "e2")
    assert "<SpawnRate>[1 2],50 EaseIn 3</SpawnRate>" in next((folder.root / "e2").iterdir()).read_text()


def test_bank_command(spark, folder):
    bank = {"version": 140, "bank_id": 7, "language": 0, "expand": b"", "chunks": [{"id": "HIRC", "offset": 0, "data": soundbank.write_objects(140, [("Event", 5, b"\x01\2\0\0\0"), ("Sound", 6, b"zz")])}]}
    folder("in/b.bnk", soundbank.write(soundbank.with_media(bank, [(0, b""), (3, b"abc"), (9, b"q" * 20), (3, b"dup")])))
    commands.run(spark, "bnk.extract", input=str(folder.root / "in"), output=str(folder.root / "o"))
    assert (folder.root / "o/3.wem").read_bytes() == b"abc" and len(json.loads((folder.root / "o/b.objects.json").read_text())) == 2
    got = tables.read_table(spark, str(folder.root / "in"), "bank.fields", strict=True).collect()
    assert {(r.object_id, r.path, r.value) for r in got} == {(5, "action_count", "1"), (5, "actions[0]", "2"), (6, "body", "7a7a")}


def test_bank_sections(spark):
    bank = {"version": 140, "bank_id": 7, "language": 0, "expand": b"", "chunks": [{"id": "PLAT", "offset": 0, "data": b"Windows\0"}, {"id": "XXXX", "offset": 0, "data": b""}]}
    df = spark.createDataFrame([("f", soundbank.write(bank))], "file string, content binary")
    assert [(r.ordinal, r.id, r.json) for r in tables.decode(df, "bank.sections", strict=True).collect()] == [(0, "PLAT", '"Windows"')]


def test_bank_kinds_and_media():
    assert soundbank.kind_of(125, 18) == "Effect" and soundbank.kind_of(128, 18) == "AuxiliaryAudioBus" and soundbank.kind_of(128, 22) == "Unknown" and soundbank.kind_of(132, 22) == "TimeModulator"
    for version in soundbank.VERSIONS:
        for code in range(30):
            kind = soundbank.kind_of(version, code)
            assert kind == "Unknown" or soundbank.kind_of(version, soundbank.code_of(version, kind)) == kind
    index, body = soundbank.build_media([(5, b"abc"), (0, b""), (6, b"d")], 16)
    assert soundbank.media_index(index) == [(5, 0, 3), (0, 1, 0), (6, 16, 1)] and len(body) == 17


def test_chunk_layout():
    c = lambda off, stored, size, flags, file=0: {"offset": off, "compressed_length": stored, "decompressed_length": size, "flags": flags, "file": file}
    rows = [c(10, 5, 9, chunked.ZLIB), c(30, 50, 50, chunked.ZLIB), c(20, 0, 7, chunked.ZERO), c(90, 8, 8, chunked.COPY), c(0, 4, 9, chunked.ZLIB, 1)]
    assert chunked.resolve_layout(rows, {0: 95}) == [5, 60, 0, 5, 4]
    data = chunked.write([("a/b", b"x" * 99, "bzip"), ("A/c", b"", "copy")])
    index = chunked.read_index(data)
    assert [f["path"] for f in index["files"]] == ["a/b", "a/c"] and chunked.read_file([data], index, 0) == b"x" * 99


def test_manifest_audit(spark):
    base = dict.fromkeys(("width", "height", "x", "y", "ax", "ay", "aw", "ah", "cols", "rows", "parent")) | {"type": "File", "path": "p", "atlas": False}
    simple = lambda id_, parent, res, rows: {"kind": "simple", "id": id_, "resolution": res, "parent": parent, "subgroups": [], "resources": rows}
    m = {"slot_count": 3, "groups": [
        {"kind": "composite", "id": "c", "resolution": None, "parent": None, "subgroups": [{"id": "s", "resolution": 1}, {"id": "gone", "resolution": None}, {"id": "c", "resolution": None}], "resources": []},
        simple("s", "c", 1, [base | {"id": "a", "slot": 0}, base | {"id": "b", "slot": 9}]),
        simple("t", "c", 2, [base | {"id": "a", "slot": 0}]),
        simple("u", "s", None, [base | {"id": "a", "slot": 1}, base | {"id": "atlas", "slot": 2, "type": "Image", "atlas": True}, base | {"id": "kid", "slot": 1, "type": "Image", "parent": "a", "x": 0, "y": 0, "aw": 70000, "ah": 1}, base | {"id": "w", "slot": 2, "width": 4, "cols": 0}]),
        simple("s", "nobody", None, []),
    ]}
    df = spark.createDataFrame([("f", manifest.encode(m))], "file string, content binary")
    groups, subgroups, resources = (tables.decode(df, f"manifest.{t}", strict=True) for t in ("groups", "subgroups", "resources"))
    got = {(r.code, r.place, r.severity) for r in validate_manifests(groups, subgroups, resources).collect()}
    assert got == {
        ("DuplicateGroupId", "groups[4].id", "error"), ("SlotOutOfRange", "groups[1].resources[1].slot", "error"), ("DuplicateResourceId", "groups[3].resources[0].id", "error"),
        ("DuplicateSlot", "groups[3].resources[2].slot", "error"), ("DuplicateSlot", "groups[3].resources[3].slot", "error"), ("MissingGroupReference", "groups[0].subgroups[1].id", "error"),
        ("WrongGroupReferenceKind", "groups[0].subgroups[2].id", "error"), ("WrongGroupReferenceKind", "groups[3].parent", "error"), ("MissingGroupReference", "groups[4].parent", "error"),
        ("InvalidAtlasImage", "groups[3].resources[1]", "error"), ("InvalidAtlasReference", "groups[3].resources[2].parent", "error"), ("GeometryOutOfRange", "groups[3].resources[2].aw", "error"),
        ("InvalidGridSize", "groups[3].resources[3].cols", "error"), ("UnexpectedResourceMetadata", "groups[3].resources[3]", "warning"),
    }
    strict = {r.code for r in validate_manifests(groups, subgroups, resources, canonical=True).where("severity = 'error'").collect()}
    assert {"UnexpectedResourceMetadata", "IncompleteSlotTable"} <= strict


def test_every_command_is_there(spark):
    ids = set(commands.COMMANDS)
    assert len(ids) == 35
    assert [r.id for r in commands.catalog(spark, " PAK. ").orderBy("ordinal").collect()] == ["pak.unpack", "pak.pack", "pak.list"]


def test_files_as_a_stream(spark, folder):
    folder("in/a.pak", flat.write([(flat.Entry(b"a"), b"1")]))
    query = streaming.arriving(spark, str(folder.root / "in"), "flat.entries").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(folder.root / "cp")).start()
    try:
        query.processAllAvailable()
        folder("in/b.pak", flat.write([(flat.Entry(b"b"), b"2"), (flat.Entry(b"c"), b"3")]))
        query.processAllAvailable()
        assert sorted(r.path for r in spark.sql("select path from arrived").collect()) == ["a", "b", "c"]
    finally:
        query.stop()


def test_event_windows_in_stream_and_batch_agree(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = streaming.windowed_counts(stream, "6 hours", lateness="60 days").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    try:
        query.processAllAvailable()
        assert sorted((str(r.start), r.event_type, r.n) for r in spark.sql("select * from windows").collect()) == sorted((str(r.start), r.event_type, r.n) for r in streaming.windowed_counts(events, "6 hours").collect())
    finally:
        query.stop()
    assert sum(r.n for r in streaming.sessions(events, "1 hour").collect()) == events.count()


def test_library_does_not_import_the_text_package():
    root = pathlib.Path(commands.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", f.read_text()), f


def test_codecs_do_not_import_spark():
    for f in (pathlib.Path(commands.__file__).parent / "codecs").glob("*.py"):
        assert "pyspark" not in f.read_text(), f


def test_round_trip_of_wrapped_trees(spark):
    df = spark.createDataFrame([("f", tree.encode(("object", [("a", ("u8", 1))])))], "file string, content binary")
    wrapped = df.select("file", tables.codec("container.wrap")("content").alias("content"))
    assert wrappers.unwrap_container(wrapped.first().content) == df.first().content
    assert [r.tag for r in tables.decode(df, "tree.nodes").orderBy("ordinal").collect()] == ["object", "u8"]
