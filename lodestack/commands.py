"""The commands of the library by id: each takes a session and parameters as text, reads files, and writes files or returns a table.

Parameters are trimmed; a blank one is missing. A command that converts files
takes one file or a folder of them: each input is a row, so a folder of a
million files is one job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codecs import bundle, chunked, delta, texture
from .functions import text as fx
from .sinks import files as sink
from .sources.tables import codec, decode, files


class Parameters:
    """Text parameters, read by type."""

    def __init__(self, held: dict[str, str]) -> None:
        self.held = held

    def text(self, key: str, default: str | None = None) -> str | None:
        value = (self.held.get(key) or "").strip()
        return value or default

    def need(self, key: str) -> str:
        value = self.text(key)
        if value is None:
            raise ValueError(f"{key} is missing")
        return value

    def flag(self, key: str) -> bool:
        return self.text(key) in ("true", "1")

    def number(self, key: str, default: int | None = None, zero_is_missing: bool = False) -> int | None:
        value = self.text(key)
        n = default if value is None else int(value)
        return None if zero_is_missing and n == 0 else n

    def choice(self, key: str, options: tuple[str, ...]) -> str:
        """One of the options; the first if missing."""
        value = self.text(key, options[0])
        if value not in options:
            raise ValueError(f"{key} is {value!r}, not one of {', '.join(options)}")
        return value


@dataclass(frozen=True)
class Command:
    id: str
    category: str
    about: str
    run: Callable[[SparkSession, Parameters], object]


COMMANDS: dict[str, Command] = {}


def command(id_: str, about: str):
    def add(f):
        COMMANDS[id_] = Command(id_, id_.partition(".")[0], about, f)
        return f

    return add


def run(spark: SparkSession, id_: str, **parameters: str):
    return COMMANDS[id_].run(spark, Parameters(parameters))


def catalog(spark: SparkSession, query: str = "") -> DataFrame:
    """The commands that a search finds, in order."""
    rows = spark.createDataFrame([(k, c.id, c.category, c.about) for k, c in enumerate(COMMANDS.values())], "ordinal int, id string, category string, about string")
    return rows.where(fx.matches_query(query, F.col("id"), F.col("category"), F.col("about"))) if query.strip() else rows


def _name(extension: str, tag: str = "") -> F.Column:
    """The file's own name with another extension."""
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(stem, F.lit(f"{tag}.{extension}"))


def _convert(spark: SparkSession, p: Parameters, name: str, extension: str, **parameters) -> dict:
    """Every input file through one codec, to files beside each other."""
    out = files(spark, p.need("input")).select(_name(extension).alias("path"), codec(name, strict=True, **parameters)("content").cast("binary").alias("data"))
    return sink.write_files(out, p.need("output"))


def _key(p: Parameters) -> bytes:
    from .codecs.wrappers import parse_key

    return parse_key(p.need("key"), p.choice("key_format", ("utf8", "hex")))


def _simple(id_: str, name: str, extension: str, about: str, parameters: Callable[[Parameters], dict] = lambda p: {}) -> None:
    command(id_, about)(lambda spark, p: _convert(spark, p, name, extension, **parameters(p)))


_seed = lambda p: {"seed": p.need("seed")}
_layout = lambda p: {"layout": p.choice("layout", ("pc", "phone32", "phone64"))}
_simple("smf.decode", "container.unwrap", "bin", "unwrap zlib containers")
_simple("smf.encode", "container.wrap", "smf", "wrap into zlib containers")
_simple("ctext.decode", "text.decode", "txt", "decode encrypted texts", _seed)
_simple("ctext.encode", "text.encode", "txt", "encode encrypted texts", _seed)
_simple("cdat.decode", "xor.unwrap", "bin", "decrypt XOR prefixes", lambda p: {"key": _key(p)})
_simple("cdat.encode", "xor.wrap", "cdat", "encrypt XOR prefixes", lambda p: {"key": _key(p)})
_simple("newton.decode", "manifest.to_json", "json", "resource manifests to JSON")
_simple("newton.encode", "manifest.from_json", "newton", "JSON to resource manifests")
_simple("pam.decode", "animation.to_json", "json", "sprite animations to JSON")
_simple("pam.encode", "animation.from_json", "pam", "JSON to sprite animations")
_simple("reanim.decode", "keyframes.to_json", "json", "keyframe tracks to JSON")
_simple("reanim.encode", "keyframes.from_json", "compiled", "JSON to keyframe tracks", _layout)
_simple("popfx.decode", "particles.to_xml", "xml", "particle emitters to XML")
_simple("popfx.encode", "particles.from_xml", "compiled", "XML to particle emitters", _layout)
_simple("wem.decode", "audio.to_wav", "wav", "sound containers to WAV")
_simple("wem.encode", "audio.from_wav", "wem", "WAV to sound containers", lambda p: {"codec": p.choice("codec", ("pcm", "adpcm"))})


@command("rton.decode", "tagged trees to JSON, decrypted first if a seed is given")
def rton_decode(spark: SparkSession, p: Parameters) -> dict:
    content = F.col("content")
    if p.text("seed"):
        content = codec("cipher.unwrap", strict=True, seed=p.need("seed"))(content)
    out = files(spark, p.need("input")).select(_name("json").alias("path"), codec("tree.to_json", strict=True)(content).cast("binary").alias("data"))
    return sink.write_files(out, p.need("output"))


@command("rton.encode", "JSON to tagged trees, encrypted if a seed is given")
def rton_encode(spark: SparkSession, p: Parameters) -> dict:
    data = codec("tree.from_json", strict=True)(F.col("content").cast("string"))
    if p.text("seed"):
        data = codec("cipher.wrap", strict=True, seed=p.need("seed"))(data)
    return sink.write_files(files(spark, p.need("input")).select(_name("rton").alias("path"), data.alias("data")), p.need("output"))


def _to_png(df: DataFrame, width, height, form_code, alpha_size=None, pitch=None) -> DataFrame:
    """Texture bytes as PNG; null where the format is not decoded."""

    @F.pandas_udf("binary")
    def png(data: pd.Series, w: pd.Series, h: pd.Series, code: pd.Series, alpha: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for d, w1, h1, c1, a1, p1 in zip(data, w, h, code, alpha, p):
            try:
                pitch_ = int(p1) if p1 == p1 and p1 else None
                form = texture.resolve(int(c1), int(w1), int(h1), alpha_size=int(a1) if a1 == a1 and a1 is not None else None, data=d, pitch=pitch_)
                own = pitch_ if form in texture._WORDS else None
                out.append(texture.to_png(texture.decode(d, form, int(w1), int(h1), own)))
            except (ValueError, TypeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    none = F.lit(None).cast("int")
    return df.withColumn("png", png("data", width, height, form_code, none if alpha_size is None else alpha_size, none if pitch is None else pitch))


@command("rsb.unpack", "files of bundles; textures as PNG if asked for, the raw file where that fails")
def rsb_unpack(spark: SparkSession, p: Parameters, only_textures: bool = False) -> dict:
    rows = decode(files(spark, p.need("input")), "bundle.files", strict=True)
    rows = rows.where(fx.suffix_is(F.col("path"), ".ptx")) if only_textures else rows
    if p.flag("png") or only_textures:
        rows = _to_png(rows, F.col("texture.width"), F.col("texture.height"), F.col("texture.format"), F.col("texture.alpha_size"), F.col("texture.pitch"))
        is_png = F.col("is_part1") & F.col("png").isNotNull()
        rows = rows.select(F.when(is_png, F.concat(F.regexp_replace("path", r"\.[^.]*$", ""), F.lit(".png"))).otherwise(F.col("path")).alias("path"), F.when(is_png, F.col("png")).otherwise(F.col("data")).alias("data"))
    return sink.write_files(rows.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "data"), p.need("output"))


@command("rsb.ptx-export", "textures of bundles as PNG")
def rsb_ptx_export(spark: SparkSession, p: Parameters) -> dict:
    return rsb_unpack(spark, p, only_textures=True)


@command("rsb.pack", "rebuild the packets of a bundle whose files an edited folder changes; fails if none does")
def rsb_pack(spark: SparkSession, p: Parameters) -> dict:
    base = p.need("edited").rstrip("/") + "/"
    own = decode(files(spark, p.need("input")), "bundle.files", strict=True).withColumn("key", F.lower(F.replace("path", F.lit("\\"), F.lit("/"))))
    new = files(spark, base, with_empty=True).select(F.lower(F.regexp_replace("file", "^.*" + base.strip("/").replace(".", r"\.") + "/", "")).alias("key"), F.col("content").alias("edited"))
    both = own.join(new, "key", "left").withColumn("changed", F.col("edited").isNotNull() & (F.col("edited") != F.col("data")))
    touched = both.groupBy("file", "packet").agg(F.max("changed").alias("touched")).where("touched").select("file", "packet")
    if touched.isEmpty():
        raise ValueError("nothing has changed")
    resized = both.where(F.col("changed") & F.col("is_part1") & (F.length("edited") != F.length("data")))
    if not resized.isEmpty():
        raise ValueError(f"a texture's size has changed: {resized.first()['path']}")
    rows = both.join(touched, ["file", "packet"], "left_semi").select(F.struct("file", "packet").alias("at"), "path", "is_part1", "part1", F.coalesce("edited", "data").alias("data"))
    packets = sink.pack_packets(rows.withColumn("at", F.to_json("at")), "at").select(F.from_json("at", "file string, packet string").alias("at"), "data").select("at.*", "data")
    archives = files(spark, p.need("input"))

    @F.pandas_udf("binary")
    def rebuilt(content: pd.Series, names: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([_rebuilt(c, dict(zip(n, d))) for c, n, d in zip(content, names, data)])

    edits = packets.groupBy("file").agg(F.collect_list("packet").alias("names"), F.collect_list("data").alias("packets"))
    out = archives.join(edits, "file").select(F.substring_index("file", "/", -1).alias("path"), rebuilt("content", "names", "packets").alias("data"))
    return sink.write_files(out, p.need("output"))


def _rebuilt(data: bytes, edits: dict[str, bytes]) -> bytes:
    head = bundle.read_head(data)
    packets = [q | {"data": edits.get(q["name"], bundle.packet_bytes(data, q))} for q in bundle.read_packet_table(data, head)]
    size = head["texture_size"] if head["texture_size"] in (0x10, 0x14, 0x18) else 0x10
    return bundle.build_bundle(packets, bundle.read_textures(data, head), bundle.read_composites(data, head), bundle.read_autopools(data, head), bundle.read_file_list(data, head),
                               bundle.read_description(data, head) if head["part1_offset"] else None, head["version"], size)


@command("ptx.decode", "textures without a header to PNG")
def ptx_decode(spark: SparkSession, p: Parameters) -> dict:
    rows = files(spark, p.need("input")).withColumnRenamed("content", "data")
    out = _to_png(rows, F.lit(p.number("width")), F.lit(p.number("height")), F.lit(p.number("format", 0)), F.lit(p.number("alpha_size", zero_is_missing=True)).cast("int"), F.lit(p.number("pitch", zero_is_missing=True)).cast("int"))
    return sink.write_files(out.select(_name("png").alias("path"), F.col("png").alias("data")), p.need("output"))


@command("ptx.encode", "PNG to textures")
def ptx_encode(spark: SparkSession, p: Parameters) -> dict:
    form = p.choice("format", ("rgba8888", "rgba4444", "rgb565", "rgba5551", "rgba4444_tiled", "rgb565_tiled", "rgba5551_tiled", "argb8888", "etc1", "etc1_a8", "etc1_alpha", "etc1_palette", "pvrtc4", "pvrtc4_a8", "a8", "l8"))

    @F.pandas_udf("binary")
    def encoded(content: pd.Series) -> pd.Series:
        return pd.Series([texture.encode(texture.from_png(c), form) for c in content])

    return sink.write_files(files(spark, p.need("input")).select(_name("ptx").alias("path"), encoded("content").alias("data")), p.need("output"))


@command("rsgp.unpack", "files of packets, with a manifest of them")
def rsgp_unpack(spark: SparkSession, p: Parameters) -> dict:
    rows = decode(files(spark, p.need("input")), "packet.files", strict=True)
    listed = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ordinal", "path", "is_part1", "part1"))).alias("files"))
    manifest = listed.select(F.lit("manifest.json").alias("path"), F.to_json(F.struct("files")).cast("binary").alias("data"))
    return sink.write_files(rows.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "data").unionByName(manifest), p.need("output"))


@command("rsgp.pack", "a folder and its manifest to a packet")
def rsgp_pack(spark: SparkSession, p: Parameters) -> dict:
    base = p.need("input").rstrip("/") + "/"
    rows = files(spark, base, with_empty=True).select(F.regexp_replace("file", "^.*" + base.strip("/").replace(".", r"\.") + "/", "").alias("path"), F.col("content").alias("data"))
    told = rows.where("path = 'manifest.json'").select(F.explode(F.from_json(F.col("data").cast("string"), "files array<struct<ordinal:int,path:string,is_part1:boolean,part1:struct<id:long,width:long,height:long>>>").getField("files")).alias("m"))
    first = told.groupBy(fx.normalised_path(F.col("m.path")).alias("key")).agg(F.min_by("m", "m.ordinal").alias("m"))
    both = rows.where("path <> 'manifest.json'").withColumn("key", fx.normalised_path(F.col("path"))).join(first, "key", "left")
    packed = sink.pack_packets(both.select(F.lit(p.text("name", "packet.rsg")).alias("archive"), F.coalesce("m.path", "path").alias("path"), F.coalesce("m.is_part1", F.lit(False)).alias("is_part1"), F.col("m.part1").alias("part1"), "data"), "archive", p.number("version", 4), p.number("flags", 3))
    return sink.write_files(packed.select(F.col("archive").alias("path"), "data"), p.need("output"))


def _pairs(spark: SparkSession, p: Parameters, other: str) -> DataFrame:
    """Files of two folders by name, or two files."""
    a = files(spark, p.need("input")).select(F.substring_index("file", "/", -1).alias("path"), "content")
    b = files(spark, p.need(other)).select(F.substring_index("file", "/", -1).alias("path_b"), F.col("content").alias("other"))
    one = a.count() == 1 and b.count() == 1
    return a.crossJoin(b) if one else a.join(b, a["path"] == b["path_b"])  # one row on each side


@command("rsbp.create", "the delta from one bundle to another")
def rsbp_create(spark: SparkSession, p: Parameters) -> dict:
    raw = p.choice("mode", ("stored", "raw")) == "raw"

    @F.pandas_udf("binary")
    def made(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([delta.write_patch(delta.create_patch(a, b, raw)) for a, b in zip(before, after)])

    return sink.write_files(_pairs(spark, p, "target").select(F.concat("path", F.lit(".rsbpatch")).alias("path"), made("content", "other").alias("data")), p.need("output"))


@command("rsbp.apply", "a bundle and a delta to the other bundle")
def rsbp_apply(spark: SparkSession, p: Parameters) -> dict:
    raw = p.choice("mode", ("stored", "raw")) == "raw"

    @F.pandas_udf("binary")
    def made(before: pd.Series, patch: pd.Series) -> pd.Series:
        return pd.Series([delta.apply_patch(a, delta.read_patch(b), raw) for a, b in zip(before, patch)])

    return sink.write_files(_pairs(spark, p, "patch").select("path", made("content", "other").alias("data")), p.need("output"))


def _unpack(spark: SparkSession, p: Parameters, table: str) -> dict:
    rows = decode(files(spark, p.need("input")), table, strict=True)
    return sink.write_files(rows.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "data"), p.need("output"))


def _folder(spark: SparkSession, p: Parameters, name: str) -> DataFrame:
    base = p.need("input").rstrip("/") + "/"
    return files(spark, base, with_empty=True).select(F.lit(p.text("name", name)).alias("archive"), F.regexp_replace("file", "^.*" + base.strip("/").replace(".", r"\.") + "/", "").alias("path"), F.col("content").alias("data"))


@command("pak.unpack", "files of flat archives")
def pak_unpack(spark: SparkSession, p: Parameters) -> dict:
    return _unpack(spark, p, "flat.files")


@command("pak.pack", "a folder to a flat archive")
def pak_pack(spark: SparkSession, p: Parameters) -> dict:
    return sink.write_files(sink.pack_flat(_folder(spark, p, "archive.pak"), "archive").select(F.col("archive").alias("path"), "data"), p.need("output"))


@command("pak.list", "sizes and paths of flat archives, each list headed by its archive and count; to files if an output is given")
def pak_list(spark: SparkSession, p: Parameters):
    rows = decode(files(spark, p.need("input")), "flat.entries", strict=True)
    lines = rows.select("file", F.col("ordinal").cast("long").alias("at"), F.concat(fx.human_size(F.col("original_size")), F.lit("\t"), "path").alias("line"))
    heads = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", F.lit(-1).cast("long").alias("at"), F.concat(F.lit("# "), "file", F.lit(": "), "n", F.lit(" entries")).alias("line"))
    both = heads.unionByName(lines)
    if not p.text("output"):
        return both.orderBy("file", "at").select("line")
    texts = both.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    out = texts.select(_name("txt", "_list").alias("path"), F.concat(F.array_join("l.line", "\n"), F.lit("\n")).cast("binary").alias("data"))
    return sink.write_files(out, p.need("output"))


@command("dzip.unpack", "files of chunked archives, with the other volumes that lie beside them")
def dzip_unpack(spark: SparkSession, p: Parameters) -> dict:
    base = p.need("input").rstrip("/")
    every = files(spark, base)

    @F.pandas_udf("array<string>")
    def others(content: pd.Series) -> pd.Series:
        return pd.Series([chunked.read_index(c)["volumes"] for c in content], dtype=object)

    @F.pandas_udf("array<struct<path: string, data: binary>>")
    def unpacked(content: pd.Series, volumes: pd.Series) -> pd.Series:
        out = []
        for c, v in zip(content, volumes):
            index, whole = chunked.read_index(c), [c, *(x["content"] for x in v)]
            out.append([{"path": f["path"], "data": raw} for f, raw in zip(index["files"], chunked.read_files(whole, index))])
        return pd.Series(out, dtype=object)

    main = every.where(F.substring("content", 1, 4) == F.lit(chunked.MAGIC.to_bytes(4, "little")))
    folder = F.regexp_extract("file", "^(.*/)", 1)
    named = main.select("file", F.posexplode(others("content")).alias("at", "name"), folder.alias("folder")).withColumn("volume", F.concat("folder", "name"))
    # a main file names its other volumes, which need not be few: they meet it in one exchange by name
    parts = named.join(every.select(F.col("file").alias("volume"), "content"), "volume").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "content"))).alias("volumes"))
    none = F.array().cast("array<struct<at: int, content: binary>>")
    rows = main.join(parts, "file", "left").select(F.explode(unpacked("content", F.coalesce("volumes", none))).alias("f")).select("f.*")
    return sink.write_files(rows, p.need("output"))


@command("dzip.pack", "a folder to a chunked archive")
def dzip_pack(spark: SparkSession, p: Parameters) -> dict:
    packed = sink.pack_chunked(_folder(spark, p, "archive.dz"), "archive", p.choice("codec", ("zlib", "copy", "bzip", "lzma")))
    return sink.write_files(packed.select(F.col("archive").alias("path"), "data"), p.need("output"))


@command("reanim.xfl-encode", "keyframe tracks to XML projects")
def reanim_xfl_encode(spark: SparkSession, p: Parameters) -> dict:
    @F.pandas_udf("array<struct<path: string, data: binary>>")
    def project(content: pd.Series) -> pd.Series:
        from .codecs import keyframes, scene

        return pd.Series([[{"path": k, "data": v} for k, v in scene.encode(keyframes.decode(c)[0]).items()] for c in content])

    rows = files(spark, p.need("input")).select(_name("", "").alias("stem"), F.explode(project("content")).alias("f"))
    return sink.write_files(rows.select(F.concat(F.regexp_replace("stem", r"\.$", ""), F.lit("/"), "f.path").alias("path"), "f.data"), p.need("output"))


@command("reanim.xfl-decode", "XML projects to keyframe tracks")
def reanim_xfl_decode(spark: SparkSession, p: Parameters) -> dict:
    layout = p.choice("layout", ("pc", "phone32", "phone64"))

    @F.pandas_udf("binary")
    def tracks(content: pd.Series) -> pd.Series:
        from .codecs import keyframes, scene

        return pd.Series([keyframes.encode(scene.decode(c), layout) for c in content])

    rows = files(spark, p.need("input"), "DOMDocument.xml")
    return sink.write_files(rows.select(F.concat(F.element_at(F.split("file", "/"), -2), F.lit(".reanim.compiled")).alias("path"), tracks("content").alias("data")), p.need("output"))


@command("bnk.extract", "media of sound banks, each id once, and a list of their objects")
def bnk_extract(spark: SparkSession, p: Parameters) -> dict:
    banks = files(spark, p.need("input"))
    media = decode(banks, "bank.media", strict=True).where("id <> 0")
    first = media.groupBy("file", "id").agg(F.min_by("data", F.struct("chunk", "entry")).alias("data"))
    objects = decode(banks, "bank.objects", strict=True).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "id"))).alias("objects"))
    lists = objects.select(_name("json", ".objects").alias("path"), F.to_json("objects").cast("binary").alias("data"))
    return sink.write_files(first.select(F.concat(F.col("id").cast("string"), F.lit(".wem")).alias("path"), "data").unionByName(lists), p.need("output"))
