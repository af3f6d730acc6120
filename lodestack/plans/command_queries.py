"""The commands over files written from the test tables: there, back, and what the last files hold."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import commands
from ..codecs import audio, bundle, soundbank, texture
from ..sinks.files import write_files
from ..sinks.shared import new_folder
from ..sources.tables import decode, files
from .relational import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


class _Place:
    """Folders beside each other for the steps of one query."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, new_folder(spark, name)

    def at(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, rows: DataFrame, name: str) -> str:
        write_files(rows, self.at(name))
        return name

    def run(self, id_: str, source_: str, target_: str, **parameters: str) -> str:
        commands.run(self.spark, id_, input=self.at(source_), output=self.at(target_), **parameters)
        return target_

    def read(self, name: str, glob: str | None = None) -> DataFrame:
        """(stem, name, data)"""
        last = F.substring_index("file", "/", -1)
        return files(self.spark, self.at(name), glob, with_empty=True).select(F.regexp_replace(last, r"\..*$", "").alias("stem"), last.alias("name"), "file", F.col("content").alias("data"))


def _named(rows: DataFrame, key: str, extension: str, data: Column) -> DataFrame:
    return rows.select(F.concat(F.col(key).cast("string"), F.lit(f".{extension}")).alias("path"), data.cast("binary").alias("data"))


_NATIONS = "select n_nationkey, md5(n_name) as md5 from nation"


def _there_and_back(spark, sf_dir, name: str, there: str, back: str, **parameters: str) -> DataFrame:
    place = _Place(spark, name)
    place.put(_named(table(spark, sf_dir, "nation"), "n_nationkey", "dat", F.col("n_name")), "in")
    place.run(there, "in", "made", **parameters)
    place.run(back, "made", "out", **parameters)
    return place.read("out").select(F.col("stem").cast("int").alias("n_nationkey"), F.md5("data").alias("md5"))


@query(_NATIONS)
def command_container(spark, sf_dir):
    return _there_and_back(spark, sf_dir, "container", "smf.encode", "smf.decode")


@query(_NATIONS)
def command_text(spark, sf_dir):
    return _there_and_back(spark, sf_dir, "text", "ctext.encode", "ctext.decode", seed="a seed")


@query(_NATIONS)
def command_prefix(spark, sf_dir):
    return _there_and_back(spark, sf_dir, "prefix", "cdat.encode", "cdat.decode", key="00 ff 7a", key_format="hex")


@query("select s_suppkey, s_name as name, s_nationkey as nation, true as is_negative from supplier")
def command_tree(spark, sf_dir):
    """JSON to encrypted trees and back."""
    place = _Place(spark, "tree")
    s = table(spark, sf_dir, "supplier")
    place.put(_named(s, "s_suppkey", "json", F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), (-F.col("s_suppkey") - 1).alias("low")))), "in")
    place.run("rton.encode", "in", "made", seed="x")
    place.run("rton.decode", "made", "out", seed="x")
    held = F.from_json(F.col("data").cast("string"), "name string, nation int, low long").alias("j")
    return place.read("out").select(F.col("stem").cast("long").alias("s_suppkey"), held).select("s_suppkey", "j.name", "j.nation", (F.col("j.low") == -F.col("s_suppkey") - 1).alias("is_negative"))


@query("select r_regionkey, r_name as grp, n_name as id, cast(row_number() over (partition by r_regionkey order by n_nationkey) - 1 as bigint) as slot from region join nation on n_regionkey = r_regionkey")
def command_manifest(spark, sf_dir):
    place = _Place(spark, "manifest")
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))

    @F.pandas_udf("string")
    def text(name: pd.Series, members: pd.Series) -> pd.Series:
        return pd.Series([json.dumps({"slot_count": 99, "groups": [{"kind": "simple", "id": g, "resources": [{"type": "File", "slot": k, "id": x["n_name"], "path": "p"} for k, x in enumerate(m)]}]}) for g, m in zip(name, members)])

    place.put(_named(rows, "r_regionkey", "json", text("r_name", "n")), "in")
    place.run("newton.encode", "in", "made")
    place.run("newton.decode", "made", "out")
    held = F.from_json(F.col("data").cast("string"), "groups array<struct<id: string, resources: array<struct<id: string, slot: long>>>>")
    out = place.read("out").select(F.col("stem").cast("int").alias("r_regionkey"), F.explode(held["groups"]).alias("g"))
    return out.select("r_regionkey", F.col("g.id").alias("grp"), F.explode("g.resources").alias("r")).select("r_regionkey", "grp", "r.id", "r.slot")


@query("select n_nationkey, cast(n_nationkey % 6 + 1 as bigint) as version, n_name as label, cast(n_nationkey % 60 as bigint) as rate from nation")
def command_animation(spark, sf_dir):
    place = _Place(spark, "animation")

    @F.pandas_udf("string")
    def text(key: pd.Series, name: pd.Series) -> pd.Series:
        def one(k: int, n: str) -> str:
            version = k % 6 + 1
            frame = {"label": n, "stop": False, "command": [], "remove": [], "append": [], "change": []}
            sprite = {"name": "s" if version >= 4 else None, "frame_rate": 30.0 if version >= 4 else None, "work_area": [0, 1] if version >= 5 else None, "frame": [frame]}
            return json.dumps({"version": version, "frame_rate": k % 60, "position": [0.0, 0.0], "size": [1.0, 1.0], "image": [], "sprite": [], "main_sprite": sprite})

        return pd.Series([one(int(k), n) for k, n in zip(key, name)])

    place.put(_named(table(spark, sf_dir, "nation"), "n_nationkey", "json", text("n_nationkey", "n_name")), "in")
    place.run("pam.encode", "in", "made")
    place.run("pam.decode", "made", "out")
    held = F.from_json(F.col("data").cast("string"), "version long, frame_rate long, main_sprite struct<frame: array<struct<label: string>>>").alias("j")
    return place.read("out").select(F.col("stem").cast("int").alias("n_nationkey"), held).select("n_nationkey", "j.version", F.col("j.main_sprite.frame")[0]["label"].alias("label"), F.col("j.frame_rate").alias("rate"))


_TRACKS = "select n_nationkey, n_name as track, cast(n_nationkey * 2 as double) as x from nation"


def _tracks(spark, sf_dir, place: _Place, layout: str) -> str:
    @F.pandas_udf("string")
    def text(key: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([json.dumps({"fps": 12.0, "tracks": [{"name": n, "frames": [{"x": float(k) * 2, "i": "IMAGE_REANIM_A"}]}]}) for k, n in zip(key, name)])

    place.put(_named(table(spark, sf_dir, "nation"), "n_nationkey", "json", text("n_nationkey", "n_name")), "in")
    return place.run("reanim.encode", "in", "made", layout=layout)


def _read_tracks(place: _Place, name: str) -> DataFrame:
    held = F.from_json(F.col("data").cast("string"), "tracks array<struct<name: string, frames: array<struct<x: double>>>>")
    out = place.read(name).select(F.col("stem").cast("int").alias("n_nationkey"), held["tracks"][0].alias("t"))
    return out.select("n_nationkey", F.col("t.name").alias("track"), F.coalesce(F.col("t.frames")[0]["x"], F.lit(0.0)).alias("x"))


@query(_TRACKS)
def command_keyframes(spark, sf_dir):
    place = _Place(spark, "keyframes")
    _tracks(spark, sf_dir, place, "phone64")
    place.run("reanim.decode", "made", "out")
    return _read_tracks(place, "out")


@query(_TRACKS)
def command_project(spark, sf_dir):
    """Keyframes to XML projects and back to keyframes: a project says 0 where a frame says nothing."""
    place = _Place(spark, "project")
    _tracks(spark, sf_dir, place, "pc")
    place.run("reanim.xfl-encode", "made", "projects")
    place.run("reanim.xfl-decode", "projects", "again", layout="phone32")
    place.run("reanim.decode", "again", "out")
    return _read_tracks(place, "out")


@query("select s_suppkey, '<SpawnRate>[' || (s_suppkey % 50 + 1) || ' ' || (s_suppkey % 50 + 2) || '],50 EaseIn ' || (s_suppkey % 50 + 3) || '</SpawnRate>' as spawn_rate from supplier")
def command_particles(spark, sf_dir):
    place = _Place(spark, "particles")
    v = F.col("s_suppkey") % 50 + 1
    xml = F.format_string("<Emitter><Name>n</Name><SpawnRate>[%d %d],50 EaseIn %d</SpawnRate></Emitter>", v, v + 1, v + 2)
    place.put(_named(table(spark, sf_dir, "supplier"), "s_suppkey", "xml", xml), "in")
    place.run("popfx.encode", "in", "made", layout="phone64")
    place.run("popfx.decode", "made", "out")
    return place.read("out").select(F.col("stem").cast("long").alias("s_suppkey"), F.regexp_extract(F.col("data").cast("string"), "<SpawnRate>.*</SpawnRate>", 0).alias("spawn_rate"))


@query("select n_nationkey, cast((n_nationkey + 64) // 64 * 128 as bigint) as n_bytes, cast(8000 + n_nationkey as bigint) as sample_rate from nation")
def command_sound(spark, sf_dir):
    """Silence to ADPCM and back: as many samples as whole blocks have."""
    place = _Place(spark, "sound")

    @F.pandas_udf("binary")
    def wav(key: pd.Series) -> pd.Series:
        return pd.Series([audio.wav(bytes(2 * (int(k) + 1)), 1, 8000 + int(k), 16) for k in key], dtype=object)

    place.put(_named(table(spark, sf_dir, "nation"), "n_nationkey", "wav", wav("n_nationkey")), "in")
    place.run("wem.encode", "in", "made", codec="adpcm")
    place.run("wem.decode", "made", "out")
    heads = decode(place.read("out"), "audio.info", "stem", "data", strict=True)
    return heads.select(F.col("file").cast("int").alias("n_nationkey"), F.col("data_size").alias("n_bytes"), "sample_rate")


def _folder(spark, sf_dir, place: _Place) -> str:
    n = table(spark, sf_dir, "nation")
    return place.put(n.select(F.concat(F.lit("r"), "n_regionkey", F.lit("/"), "n_nationkey", F.lit(".txt")).alias("path"), F.col("n_name").cast("binary").alias("data")), "in")


@query("select '# ' || (select count(*) from nation) as line union all select octet_length(encode(n_name)) || ' B' || chr(9) || 'r' || n_regionkey || '/' || n_nationkey || '.txt' from nation")
def command_archive_list(spark, sf_dir):
    place = _Place(spark, "list")
    place.run("pak.pack", _folder(spark, sf_dir, place), "made", name="a.pak")
    lines = commands.run(spark, "pak.list", input=place.at("made"))
    return lines.select(F.when(F.col("line").startswith("# "), F.concat(F.lit("# "), F.regexp_extract("line", "([0-9]+) entries$", 1))).otherwise(F.col("line")).alias("line"))


@query(_NATIONS)
def command_archive(spark, sf_dir):
    place = _Place(spark, "archive")
    place.run("pak.pack", _folder(spark, sf_dir, place), "made", name="a.pak")
    place.run("pak.unpack", "made", "out")
    return place.read("out").select(F.col("stem").cast("int").alias("n_nationkey"), F.md5("data").alias("md5"))


@query(_NATIONS)
def command_chunked(spark, sf_dir):
    place = _Place(spark, "chunked")
    place.run("dzip.pack", _folder(spark, sf_dir, place), "made", name="a.dz", codec="bzip")
    place.run("dzip.unpack", "made", "out")
    return place.read("out").select(F.col("stem").cast("int").alias("n_nationkey"), F.md5("data").alias("md5"))


@query(_NATIONS)
def command_packet(spark, sf_dir):
    """A folder to a packet, the packet to files and a manifest, both to a packet again, and its files."""
    place = _Place(spark, "packet")
    place.run("rsgp.pack", _folder(spark, sf_dir, place), "made", name="p.rsg", flags="3")
    place.run("rsgp.unpack", "made", "files")
    place.run("rsgp.pack", "files", "again", name="p.rsg", flags="0")
    out = decode(place.read("again"), "packet.files", "name", "data", strict=True)
    return out.select(F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("int").alias("n_nationkey"), F.md5("data").alias("md5"))


def _bundle_files(spark, sf_dir, place: _Place) -> str:
    n = table(spark, sf_dir, "nation")

    @F.pandas_udf("binary")
    def made(key: pd.Series, name: pd.Series) -> pd.Series:
        def one(k: int, text: str) -> bytes:
            pixels = texture.encode(_square(k), "rgba8888")
            words = bundle.pack_packet([{"path": f"D\\{k}.TXT", "is_part1": False, "part1": None, "data": text.encode()}])
            images = bundle.pack_packet([{"path": f"D\\{k}.PTX", "is_part1": True, "part1": {"id": 0, "width": 2, "height": 2}, "data": pixels}])
            packets = [{"name": "one", "data": words, "pool_index": 0, "ptx_number": 0, "ptx_before": 0}, {"name": "two", "data": images, "pool_index": 1, "ptx_number": 1, "ptx_before": 0}]
            return bundle.build_bundle(packets, [{"ptx_index": 0, "width": 2, "height": 2, "pitch": 8, "format": 0, "alpha_size": None, "alpha_format": None}], [], [], [{"path": f"D\\{k}.TXT", "pool_index": 0}])

        return pd.Series([one(int(k), t) for k, t in zip(key, name)], dtype=object)

    return place.put(_named(n, "n_nationkey", "rsb", made("n_nationkey", "n_name")), "in")


def _square(k: int):
    import numpy as np

    return np.full((2, 2, 4), k % 256, np.uint8)


def _red(column: str) -> Column:
    @F.pandas_udf(T.LongType())
    def red(png: pd.Series) -> pd.Series:
        return pd.Series([int(texture.from_png(x)[..., 0].astype(int).sum()) for x in png])

    return red(column)


@query("select n_nationkey, cast(4 * (n_nationkey % 256) as bigint) as red from nation")
def command_bundle_textures(spark, sf_dir):
    place = _Place(spark, "bundle-textures")
    place.run("rsb.ptx-export", _bundle_files(spark, sf_dir, place), "out")
    return place.read("out").select(F.col("stem").cast("int").alias("n_nationkey"), _red("data").alias("red"))


@query("select n_nationkey, md5(n_name || ' edited') as md5 from nation")
def command_bundle_edit(spark, sf_dir):
    """Bundles unpacked, their texts changed, rebuilt; the delta from the old to the new bundles, applied to the old ones, and unpacked."""
    place = _Place(spark, "bundle-edit")
    place.run("rsb.unpack", _bundle_files(spark, sf_dir, place), "files")
    edited = place.read("files", "*.TXT").select(F.concat(F.lit("D/"), "name").alias("path"), F.concat("data", F.lit(b" edited")).alias("data"))
    place.put(edited, "edited")
    place.run("rsb.pack", "in", "rebuilt", edited=place.at("edited"))
    place.run("rsbp.create", "in", "patches", target=place.at("rebuilt"))
    renamed = place.read("patches").select(F.concat("stem", F.lit(".rsb")).alias("path"), "data")
    place.put(renamed, "by-name")
    place.run("rsbp.apply", "in", "applied", patch=place.at("by-name"))
    place.run("rsb.unpack", "applied", "out")
    return place.read("out", "*.TXT").select(F.col("stem").cast("int").alias("n_nationkey"), F.md5("data").alias("md5"))


@query("select n_nationkey, cast(4 * (n_nationkey % 32 * 8 + n_nationkey % 32 // 4) as bigint) as red from nation")
def command_textures(spark, sf_dir):
    """PNG to 16-bit textures and back: five bits of red stay."""
    place = _Place(spark, "textures")

    @F.pandas_udf("binary")
    def png(key: pd.Series) -> pd.Series:
        return pd.Series([texture.to_png(_square(int(k) % 32 * 8)) for k in key], dtype=object)

    place.put(_named(table(spark, sf_dir, "nation"), "n_nationkey", "png", png("n_nationkey")), "in")
    place.run("ptx.encode", "in", "made", format="rgb565")
    place.run("ptx.decode", "made", "out", width="2", height="2", format="2")
    return place.read("out").select(F.col("stem").cast("int").alias("n_nationkey"), _red("data").alias("red"))


@query("select n_nationkey + 1 as media, md5(n_name) as md5, cast(2 as integer) as n_objects from nation")
def command_bank(spark, sf_dir):
    """A bank for each nation with its name as media, an id twice; what is taken out, and the list of objects."""
    place = _Place(spark, "bank")

    @F.pandas_udf("binary")
    def made(key: pd.Series, name: pd.Series) -> pd.Series:
        def one(k: int, n: str) -> bytes:
            objects = soundbank.write_objects(140, [("Event", 5, b"\x01\2\0\0\0"), ("Sound", 6, b"zz")])
            bank = {"version": 140, "bank_id": k, "language": 0, "expand": b"", "chunks": [{"id": "HIRC", "offset": 0, "data": objects}]}
            return soundbank.write(soundbank.with_media(bank, [(0, b""), (k + 1, n.encode()), (k + 1, b"later")]))

        return pd.Series([one(int(k), n) for k, n in zip(key, name)], dtype=object)

    place.put(_named(table(spark, sf_dir, "nation"), "n_nationkey", "bnk", made("n_nationkey", "n_name")), "in")
    place.run("bnk.extract", "in", "out")
    media = place.read("out", "*.wem").select(F.col("stem").cast("int").alias("media"), F.md5("data").alias("md5"))
    lists = place.read("out", "*.json").select((F.col("stem").cast("int") + 1).alias("media"), F.size(F.from_json(F.col("data").cast("string"), "array<struct<ordinal: int>>")).alias("n_objects"))
    return media.join(lists, "media")
