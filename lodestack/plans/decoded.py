"""Formats written from the test tables and read back into fields, sizes and places that SQL computes from the rows by the format's own rules."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import animation, audio, bank_properties, bits, bundle, delta, soundbank, texture
from ..functions import checksums
from ..functions import text as fx
from ..operators import edits
from ..sinks.files import pack_chunked
from ..sources.tables import codec, decode
from .relational import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def dealt(df: DataFrame) -> DataFrame:
    """Small rows that cost much time each, over four tasks for each core: a file of them is one split of the scan, and so one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


# textures

#: Formats by the key's remainder, and the pixel that a key draws.
_FORMS = ("rgba8888", "argb8888", "rgb888", "rgba4444", "rgb565", "rgba5551", "rgb332", "a8", "l8", "la88", "al88", "la44", "al44", "argb4444", "argb1555")
_PIXEL = "p_partkey * 7 % 256 as r, p_partkey * 13 % 256 as g, p_partkey * 29 % 256 as b, p_partkey * 53 % 256 as a, (p_partkey * 7 % 256 + p_partkey * 13 % 256 + p_partkey * 29 % 256) // 3 as l"


@query(f"""
with p as (select p_partkey, p_partkey % 15 as f, {_PIXEL} from part),
w as (
  select *, case f
    when 0 then r + g * 256 + b * 65536 + a * 16777216 when 1 then b + g * 256 + r * 65536 + a * 16777216 when 2 then r + g * 256 + b * 65536
    when 3 then r // 16 * 4096 + g // 16 * 256 + b // 16 * 16 + a // 16 when 4 then r // 8 * 2048 + g // 4 * 32 + b // 8
    when 5 then r // 8 * 2048 + g // 8 * 64 + b // 8 * 2 + a // 128 when 6 then r // 32 * 32 + g // 32 * 4 + b // 64
    when 7 then a when 8 then l when 9 then l + a * 256 when 10 then a + l * 256 when 11 then a // 16 * 16 + l // 16 when 12 then l // 16 * 16 + a // 16
    when 13 then a // 16 * 4096 + r // 16 * 256 + g // 16 * 16 + b // 16 else a // 128 * 32768 + r // 8 * 1024 + g // 8 * 32 + b // 8 end as word,
    case when f < 2 then 4 when f = 2 then 3 when f in (6, 7, 8, 11, 12) then 1 else 2 end as n from p
)
select p_partkey, cast(word as bigint) as word, cast(n as bigint) as n_bytes,
  cast(case when f in (0, 1, 2) then r when f in (3, 13) then r // 16 * 17 when f in (4, 5, 14) then r // 8 * 8 + r // 32
    when f = 6 then r // 32 * 36 + r // 64 when f = 7 then 255 when f in (8, 9, 10) then l else l // 16 * 17 end as bigint) as red,
  cast(case when f in (0, 1, 7, 9, 10) then a when f in (3, 11, 12, 13) then a // 16 * 17 when f in (5, 14) then a // 128 * 255 else 255 end as bigint) as alpha
from w
""")
def texture_pixels(spark, sf_dir):
    """One pixel of every part in one of the fifteen packed formats: its word on the wire, and red and alpha read back."""

    @F.pandas_udf("struct<word: long, n_bytes: long, red: long, alpha: long>")
    def drawn(key: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for k in key.tolist():
            image = np.array([[[k * m % 256 for m in (7, 13, 29, 53)]]], np.uint8)
            form = _FORMS[k % 15]
            data = texture.encode(image, form)
            back = texture.decode(data, form, 1, 1)[0, 0]
            out.append((int.from_bytes(data, "little"), len(data), int(back[0]), int(back[3])))
        return pd.DataFrame(out, columns=["word", "n_bytes", "red", "alpha"])

    return table(spark, sf_dir, "part").select("p_partkey", drawn("p_partkey").alias("r")).select("p_partkey", "r.*")


@query("""
with s as (select s_suppkey, s_suppkey % 70 + 1 as w, s_suppkey % 45 + 1 as h, s_suppkey * 11 % (s_suppkey % 70 + 1) as x, s_suppkey * 17 % (s_suppkey % 45 + 1) as y from supplier)
select s_suppkey, cast((w + 31) // 32 * ((h + 31) // 32) * 2048 as bigint) as n_bytes,
  cast((y // 32 * ((w + 31) // 32) + x // 32) * 1024 + y % 32 * 32 + x % 32 as bigint) as word_at, cast(65535 as bigint) as word
from s
""")
def texture_tiles(spark, sf_dir):
    """One white pixel on black in tiles of 32 by 32: where its word lies among the words, tile by tile."""

    @F.pandas_udf("struct<n_bytes: long, word_at: long, word: long>")
    def drawn(key: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for k in key.tolist():
            w, h = k % 70 + 1, k % 45 + 1
            image = np.zeros((h, w, 4), np.uint8)
            image[k * 17 % h, k * 11 % w] = 255
            words = np.frombuffer(texture.encode(image, "rgb565_tiled"), "<u2")
            at = int(np.flatnonzero(words)[0])
            out.append((2 * len(words), at, int(words[at])))
        return pd.DataFrame(out, columns=["n_bytes", "word_at", "word"])

    return table(spark, sf_dir, "supplier").select("s_suppkey", drawn("s_suppkey").alias("r")).select("s_suppkey", "r.*")


@query("""
with o as (
  select o_orderkey, o_orderkey * 5 % 16 as r0, o_orderkey * 3 % 16 as r1, o_orderkey % 8 as t0, o_custkey % 8 as t1, o_custkey % 2 as flip,
    o_orderkey % 4 as x, o_custkey % 4 as y, o_orderkey % 3 % 2 as big, o_custkey % 5 % 2 as neg from orders
),
p as (select *, case when flip = 1 then y >= 2 else x >= 2 end as half from o),
q as (
  select *, (case when half then r1 else r0 end) * 17 as base,
    (case when big = 1 then [8, 17, 29, 42, 60, 80, 106, 183] else [2, 5, 9, 13, 18, 24, 33, 47] end)[(case when half then t1 else t0 end) + 1] as step from p
)
select o_orderkey, cast(greatest(0, least(255, base + case when neg = 1 then -step else step end)) as bigint) as red from q
""")
def etc1_pixels(spark, sf_dir):
    """Blocks of two colours in four bits each, put together bit by bit; one of their sixteen pixels, as decoded."""

    @F.pandas_udf("long")
    def red(order: pd.Series, customer: pd.Series) -> pd.Series:
        import numpy as np

        o, c = order.to_numpy(np.uint64), customer.to_numpy(np.uint64)
        x, y = o % 4, c % 4
        at = 4 * x + y
        block = (o * 5 % 16) << 60 | (o * 3 % 16) << 56 | (o % 8) << 37 | (c % 8) << 34 | (c % 2) << 32 | (c % 5 % 2) << (16 + at) | (o % 3 % 2) << at
        # all blocks side by side as one image
        image = texture.decode(block.astype(">u8").tobytes(), "etc1", 4 * len(block), 4) if len(block) else np.zeros((4, 0, 4), np.uint8)
        return pd.Series(image[y.astype(int), 4 * np.arange(len(block)) + x.astype(int), 0].astype(np.int64))

    return table(spark, sf_dir, "orders").select("o_orderkey", red("o_orderkey", "o_custkey").alias("red"))


@query("""
with s as (select s_suppkey, s_suppkey * 7 % 256 as r, s_suppkey * 53 % 256 as a, case s_suppkey % 3 when 0 then 4 when 1 then 8 else 16 end as w from supplier)
select s_suppkey, cast(w * w // 2 + w * w as bigint) as n_bytes, cast(round(r * 31 / 255.0) as bigint) * 8 + cast(round(r * 31 / 255.0) as bigint) // 4 as red, cast(a as bigint) as alpha from s
""")
def pvrtc_images(spark, sf_dir):
    """Images of one colour in two bits a pixel with a plane of alpha beside: five bits of red, all of alpha."""

    @F.pandas_udf("struct<n_bytes: long, red: long, alpha: long>")
    def drawn(key: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for k in key.tolist():
            w = (4, 8, 16)[k % 3]
            image = np.empty((w, w, 4), np.uint8)
            image[:] = (k * 7 % 256, k * 13 % 256, k * 29 % 256, k * 53 % 256)
            data = texture.encode(image, "pvrtc4_a8")
            back = texture.decode(data, "pvrtc4_a8", w, w)
            out.append((len(data), int(back[..., 0].mean()), int(back[..., 3].min())))
        return pd.DataFrame(out, columns=["n_bytes", "red", "alpha"])

    return table(spark, sf_dir, "supplier").select("s_suppkey", drawn("s_suppkey").alias("r")).select("s_suppkey", "r.*")


# sound


@query("""
select vec_id, 'adpcm' as codec, cast(1 as integer) as channels, cast(8000 + vec_id % 100 as bigint) as sample_rate, cast(36 as integer) as block_align, (len(embedding) + 63) // 64 * 36 as data_size,
  cast((8000 + vec_id % 100) * 36 // 64 as bigint) as byte_rate,
  cast(list_sum(list_transform(range(0, (len(embedding) + 63) // 64), lambda k: greatest(-32768, least(32767, cast(floor(embedding[k * 64 + 1]::double * 1000) as integer))))) as bigint) as first_samples
from embeddings
""")
def adpcm_blocks(spark, sf_dir):
    """Vectors as block ADPCM: the header, and the sample that each block stores whole."""
    sound = _sound("adpcm")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("file"), sound("vec_id", "embedding").alias("content"))

    @F.pandas_udf("long")
    def firsts(wav: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([int(np.frombuffer(w, "<i2", offset=audio.inspect(w)["data_offset"])[::64].astype(np.int64).sum()) for w in wav])

    heads = decode(rows, "audio.info", strict=True).select("file", "codec", "channels", "sample_rate", "block_align", "data_size", "byte_rate")
    heard = rows.select("file", firsts(codec("audio.to_wav", strict=True)("content")).alias("first_samples"))
    return heads.join(heard, "file").select(F.col("file").cast("long").alias("vec_id"), *heads.columns[1:], "first_samples")


def _sound(form: str):
    @F.pandas_udf("binary")
    def made(key: pd.Series, column: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for k, v in zip(key.tolist(), column):
            samples = np.clip(np.floor(np.asarray(v, np.float64) * 1000), -32768, 32767).astype("<i2")
            out.append(audio.encode(audio.wav(samples.tobytes(), 1, 8000 + k % 100, 16), form))
        return pd.Series(out, dtype=object)

    return made


@query("""
with k as (select c_custkey, c_custkey % 4 + 1 as width, c_custkey % 2 + 1 as channels, c_custkey % 3 = 0 as big, c_custkey % 50 as frames from customer)
select c_custkey, cast(channels as integer) as channels, cast(width * 8 as integer) as bits, cast(8000 + c_custkey as bigint) as sample_rate, cast(channels * width as integer) as block_align,
  cast((8000 + c_custkey) * channels * width as bigint) as byte_rate, cast(frames * channels * width as bigint) as data_size, big as big_endian, cast(frames * channels * (c_custkey % 100) as bigint) as sum_samples
from k
""")
def pcm_widths(spark, sf_dir):
    """Sound of 8 to 32 bits in either byte order: its header, and the samples after conversion."""

    @F.pandas_udf("binary")
    def made(key: pd.Series) -> pd.Series:
        out = []
        for k in key.tolist():
            width, channels, frames = k % 4 + 1, k % 2 + 1, k % 50
            order, mark = (">", b"RIFX") if k % 3 == 0 else ("<", b"RIFF")
            body = (k % 100).to_bytes(width, "big" if k % 3 == 0 else "little") * (frames * channels)
            head = struct.pack(order + "2H2I2H", 1, channels, 8000 + k, (8000 + k) * channels * width, channels * width, width * 8)
            out.append(mark + struct.pack(order + "I", 36 + len(body)) + b"WAVEfmt " + struct.pack(order + "I", 16) + head + b"data" + struct.pack(order + "I", len(body)) + body)
        return pd.Series(out, dtype=object)

    @F.pandas_udf("long")
    def total(wav: pd.Series) -> pd.Series:
        out = []
        for w in wav:
            i = audio.inspect(w)
            width = i["bits"] // 8
            raw = w[i["data_offset"] : i["data_offset"] + i["data_size"]]
            out.append(sum(int.from_bytes(raw[k : k + width], "little") for k in range(0, len(raw), width)))
        return pd.Series(out)

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("file"), made("c_custkey").alias("content"))
    heads = decode(rows, "audio.info", strict=True).select("file", "channels", "bits", "sample_rate", "block_align", "byte_rate", "data_size", "big_endian")
    heard = rows.select("file", total(codec("audio.to_wav", strict=True)("content")).alias("sum_samples"))
    return heads.join(heard, "file").select(F.col("file").cast("long").alias("c_custkey"), *heads.columns[1:], "sum_samples")


@query("""
with s as (select s_suppkey, s_suppkey % 4 + 1 as frames, s_suppkey % 7 + 1 as channels, s_suppkey % 300 as body, [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350][s_suppkey % 13 + 1] as rate from supplier)
select s_suppkey, 'aac' as codec, cast(channels as integer) as channels, cast(rate as bigint) as sample_rate, cast((frames * (body + 7) * rate + 1024 * frames - 1) // (1024 * frames) as bigint) as byte_rate,
  cast(frames * (body + 7) as bigint) as data_size, cast(frames * (body + 7) as bigint) as n_extracted
from s
""")
def aac_streams(spark, sf_dir):
    """Streams of ADTS frames, probed, wrapped and taken out again."""

    @F.pandas_udf("binary")
    def stream(key: pd.Series) -> pd.Series:
        out = []
        for k in key.tolist():
            channels, n = k % 7 + 1, k % 300 + 7
            frame = bytes([0xFF, 0xF1, k % 13 << 2 | channels >> 2, (channels & 3) << 6 | n >> 11, n >> 3 & 255, (n & 7) << 5, 0]) + bytes(n - 7)
            out.append(frame * (k % 4 + 1))
        return pd.Series(out, dtype=object)

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("file"), codec("audio.from_aac", strict=True)(stream("s_suppkey")).alias("content"))
    heads = decode(rows, "audio.info", strict=True).select("file", "codec", "channels", "sample_rate", "byte_rate", "data_size")
    back = rows.select("file", F.octet_length(codec("audio.aac", strict=True)("content")).cast("long").alias("n_extracted"))
    return heads.join(back, "file").select(F.col("file").cast("long").alias("s_suppkey"), *heads.columns[1:], "n_extracted")


@query("""
with s as (select s_suppkey, s_suppkey % 7 + 1 as channels, s_suppkey % 2000 as body, 8000 + s_suppkey as scale, s_suppkey % 50 * 100 as duration, [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350][s_suppkey % 13 + 1] as rate from supplier),
n as (select *, 16 + 8 + 48 + 8 + 8 + 32 + 8 + 8 + 16 + 36 + 36 + 8 + body as n from s)
select s_suppkey, cast(case when channels = 7 then 8 else channels end as integer) as channels, cast(rate as bigint) as sample_rate, cast(n as bigint) as data_size,
  cast(case when duration = 0 then 16000 else (n * scale + duration - 1) // duration end as bigint) as byte_rate from n
""")
def aac_files(spark, sf_dir):
    """AAC in MP4 files, put together box by box: what their configurations and durations say after wrapping."""

    def box(kind: bytes, *parts: bytes) -> bytes:
        body = b"".join(parts)
        return struct.pack(">I4s", 8 + len(body), kind) + body

    def made(k: int) -> bytes:
        config = (2 << 11 | k % 13 << 7 | (k % 7 + 1) << 3).to_bytes(2, "big")
        decoder = b"\x04\x11" + bytes(13) + b"\x05\x02" + config
        esds = box(b"esds", bytes(4), b"\x03" + bytes([3 + len(decoder)]) + bytes(3) + decoder)
        entry = box(b"mp4a", bytes(16), struct.pack(">2H", 2, 16), bytes(4), struct.pack(">I", 44100 << 16), esds)
        table = box(b"minf", box(b"stbl", box(b"stsd", bytes(4), struct.pack(">I", 1), entry)))
        head = box(b"mdhd", bytes(12), struct.pack(">2I", 8000 + k, k % 50 * 100), bytes(4))
        other = box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", bytes(4), struct.pack(">I", 0))))))
        return box(b"ftyp", b"M4A ", bytes(4)) + box(b"moov", other, box(b"trak", box(b"mdia", head, table))) + box(b"mdat", bytes(k % 2000))

    @F.pandas_udf("binary")
    def files(key: pd.Series) -> pd.Series:
        return pd.Series([made(k) for k in key.tolist()], dtype=object)

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("file"), codec("audio.from_aac", strict=True)(files("s_suppkey")).alias("content"))
    heads = decode(rows, "audio.info", strict=True)
    return heads.select(F.col("file").cast("long").alias("s_suppkey"), "channels", "sample_rate", "data_size", "byte_rate")


# chunked archives

_CODECS = ("zlib", "copy", "bzip", "lzma")


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each nation: its customers' names as files, by one of four codecs."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("archive"), "c_nationkey", F.concat(F.lit("N"), F.col("c_custkey") % 3, F.lit("/"), "c_custkey").alias("path"), F.col("c_name").cast("binary").alias("data"))
    out = None
    for k, name in enumerate(_CODECS):
        one = pack_chunked(c.where(F.col("c_nationkey") % 4 == k).drop("c_nationkey"), "archive", name)
        out = one if out is None else out.unionByName(one)
    return out


@query("""
select c_nationkey as nation, 'N' || (c_custkey % 3) || '/' || c_custkey as path, cast(row_number() over (partition by c_nationkey order by 'N' || (c_custkey % 3) || '/' || c_custkey) - 1 as integer) as ordinal,
  octet_length(encode(c_name)) as size, md5(c_name) as md5 from customer
""")
def chunked_files(spark, sf_dir):
    out = decode(_chunked(spark, sf_dir), "chunked.files", "archive", "data", strict=True)
    return out.select(F.col("file").cast("int").alias("nation"), "path", "ordinal", "size", F.md5("data").alias("md5"))


@query("""
select c_nationkey as nation, ['zlib', 'copy', 'bzip', 'lzma'][c_nationkey % 4 + 1] as codec, count(*) as n_chunks, cast(sum(octet_length(encode(c_name))) as bigint) as unpacked,
  cast(sum(octet_length(encode(c_name))) as bigint) as stored, count(*) filter (octet_length(encode(c_name)) > 0) as n_boundaries, count(*) filter (c_nationkey % 4 <> 1) as n_placeholders
from customer group by 1, 2
""")
def chunked_chunks(spark, sf_dir):
    """The chunk tables: the stored length is the unpacked one, as the writers of three of the codecs leave it, and in the fourth by nature."""
    out = decode(_chunked(spark, sf_dir), "chunked.chunks", "archive", "data", strict=True)
    counted = lambda c: F.count(F.when(F.col(c), 1))
    return out.groupBy(F.col("file").cast("int").alias("nation"), "codec").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("decompressed_length").alias("unpacked"), F.sum("compressed_length").alias("stored"), counted("is_boundary").alias("n_boundaries"), counted("has_placeholder").alias("n_placeholders")
    )


# bundles


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle for each nation: a packet for each supplier with a text and, for even keys, a texture; and all tables beside."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("rows"))

    @F.pandas_udf("binary")
    def made(nation: pd.Series, rows: pd.Series) -> pd.Series:
        def one(n: int, members) -> bytes:
            packets, textures, composites, pools, paths, described = [], [], [], [], [], []
            for k, m in enumerate(members):
                key, name = int(m["s_suppkey"]), m["s_name"]
                files = [{"path": f"T\\{key}.TXT", "is_part1": False, "part1": None, "data": name.encode()}]
                before = len(textures)
                if key % 2 == 0:
                    files.append({"path": f"T\\{key}.PTX", "is_part1": True, "part1": {"id": 0, "width": 2, "height": key % 5 + 1}, "data": bytes([key % 95 + 32]) * (8 * (key % 5 + 1))})
                    textures.append({"ptx_index": before, "width": 2, "height": key % 5 + 1, "pitch": 8, "format": 0, "alpha_size": key % 9, "alpha_format": key % 3})
                paths += [{"path": f["path"], "pool_index": k} for f in files]
                packets.append({"name": f"P{key}", "data": bundle.pack_packet(files, 4, key % 4), "pool_index": k, "ptx_number": len(textures) - before, "ptx_before": before})
                composites.append({"name": f"C{key}", "is_composite": key % 3 == 0, "packets": [{"packet_index": k, "category": [str(key % 4), "EN"]}]})
                pools.append({"name": f"A{key}", "part0_size": key * 3, "part1_size": key * 5})
                described.append({"group": f"G{key}_CompositeShell", "composite": False, "subgroup": f"S{key}", "resolution": str(key % 4 * 384), "language": "EN", "id": f"I{key}", "type": key % 7, "path": f"p{key}", "image": None, "properties": {"k": name}})
            return bundle.build_bundle(packets, textures, composites, pools, sorted(paths, key=lambda p: p["path"]), described, texture_size=0x18)

        return pd.Series([one(n, m) for n, m in zip(nation, rows)], dtype=object)

    return s.select(F.col("s_nationkey").cast("string").alias("file"), made("s_nationkey", "rows").alias("content"))


_ORDERED = "select s_nationkey as nation, s_suppkey, s_name, cast(row_number() over (partition by s_nationkey order by s_suppkey) - 1 as integer) as k, cast(coalesce(sum(case when s_suppkey % 2 = 0 then 1 else 0 end) over (partition by s_nationkey order by s_suppkey rows between unbounded preceding and 1 preceding), 0) as bigint) as before from supplier"


@query(f"select nation, k as packet_index, 'P' || s_suppkey as name, k as pool_index, cast(case when s_suppkey % 2 = 0 then 1 else 0 end as bigint) as ptx_number, before as ptx_before, true as on_page from ({_ORDERED})")
def bundle_packets(spark, sf_dir):
    out = decode(_bundles(spark, sf_dir), "bundle.packets", strict=True)
    return out.select(F.col("file").cast("int").alias("nation"), "packet_index", "name", "pool_index", "ptx_number", "ptx_before", (F.col("offset") % 4096 == 0).alias("on_page"))


@query("""
select s_nationkey as nation, 'P' || s_suppkey as packet, 'T\\' || s_suppkey || '.TXT' as path, false as is_part1, md5(s_name) as md5, cast(null as integer) as height, cast(null as integer) as alpha_size from supplier
union all select s_nationkey, 'P' || s_suppkey, 'T\\' || s_suppkey || '.PTX', true, md5(repeat(chr(cast(s_suppkey % 95 + 32 as integer)), cast(8 * (s_suppkey % 5 + 1) as integer))), cast(s_suppkey % 5 + 1 as integer), cast(s_suppkey % 9 as integer)
from supplier where s_suppkey % 2 = 0
""".replace("\\\\", "\\"))
def bundle_files(spark, sf_dir):
    """Every file of every packet, and the texture record that its place points to."""
    out = decode(_bundles(spark, sf_dir), "bundle.files", strict=True)
    return out.select(F.col("file").cast("int").alias("nation"), "packet", "path", "is_part1", F.md5("data").alias("md5"), F.col("texture.height").alias("height"), F.col("texture.alpha_size").alias("alpha_size"))


@query(f"""
select nation, cast(before as integer) as ptx_index, cast(2 as integer) as width, cast(s_suppkey % 5 + 1 as integer) as height, cast(8 as integer) as pitch, cast(s_suppkey % 9 as integer) as alpha_size, cast(s_suppkey % 3 as integer) as alpha_format
from ({_ORDERED}) where s_suppkey % 2 = 0
""")
def bundle_textures(spark, sf_dir):
    return decode(_bundles(spark, sf_dir), "bundle.textures", strict=True).select(F.col("file").cast("int").alias("nation"), "ptx_index", "width", "height", "pitch", "alpha_size", "alpha_format")


@query(f"""
select nation, 'T\\' || s_suppkey || '.TXT' as path, k as pool_index from ({_ORDERED}) union all select nation, 'T\\' || s_suppkey || '.PTX', k from ({_ORDERED}) where s_suppkey % 2 = 0
""".replace("\\\\", "\\"))
def bundle_paths(spark, sf_dir):
    """The path trie of each bundle, walked."""
    return decode(_bundles(spark, sf_dir), "bundle.file_list", strict=True).select(F.col("file").cast("int").alias("nation"), "path", "pool_index")


@query(f"select nation, 'C' || s_suppkey as name, s_suppkey % 3 = 0 as is_composite, k as packet_index, cast(s_suppkey % 4 as varchar) as category, 'EN' as locale from ({_ORDERED})")
def bundle_composites(spark, sf_dir):
    out = decode(_bundles(spark, sf_dir), "bundle.composites", strict=True).select(F.col("file").cast("int").alias("nation"), "name", "is_composite", F.explode("packets").alias("p"))
    return out.select("nation", "name", "is_composite", "p.packet_index", F.col("p.category")[0].alias("category"), F.col("p.category")[1].alias("locale"))


@query("select s_nationkey as nation, 'A' || s_suppkey as name, cast(s_suppkey * 3 as bigint) as part0_size, cast(s_suppkey * 5 as bigint) as part1_size from supplier")
def bundle_pools(spark, sf_dir):
    return decode(_bundles(spark, sf_dir), "bundle.autopools", strict=True).select(F.col("file").cast("int").alias("nation"), "name", "part0_size", "part1_size")


@query("""
select s_nationkey as nation, 'G' || s_suppkey || '_CompositeShell' as grp, 'S' || s_suppkey as subgroup, cast(s_suppkey % 4 * 384 as varchar) as resolution, 'I' || s_suppkey as id, cast(s_suppkey % 7 as integer) as type, 'p' || s_suppkey as path, s_name as k from supplier
""")
def bundle_resources(spark, sf_dir):
    out = decode(_bundles(spark, sf_dir), "bundle.resources", strict=True)
    return out.select(F.col("file").cast("int").alias("nation"), F.col("group").alias("grp"), "subgroup", "resolution", "id", "type", "path", F.col("properties")["k"].alias("k"))


@query("""
with p as (select p_partkey, p_partkey % 4 as what, octet_length(encode(p_name)) as n from part)
select p_partkey, what <> 0 as has_patch, md5(p_name || case when what = 1 then ' and more' when what = 2 then '' else '' end) as md5, true as applies from p join part using (p_partkey)
""")
def bundle_patches(spark, sf_dir):
    """A delta between two bundles of one packet each: unchanged, longer, and (for the rest) packed otherwise; what it makes of the first."""

    def one(key: int, name: bytes, after: bool) -> bytes:
        text = name + b" and more" if after and key % 4 == 1 else name
        flags = 3 if not after or key % 4 < 2 else 0
        packet = bundle.pack_packet([{"path": "a", "is_part1": False, "part1": None, "data": text}], 4, flags)
        return bundle.build_bundle([{"name": "p", "data": packet, "pool_index": 0, "ptx_number": 0, "ptx_before": 0}], [], [], [], [])

    @F.pandas_udf("struct<has_patch: boolean, md5: string, applies: boolean>")
    def patched(key: pd.Series, name: pd.Series) -> pd.DataFrame:
        import hashlib

        out = []
        for k, n in zip(key.tolist(), name):
            before, after = (one(k, n.encode(), x) for x in (False, True))
            patch = delta.read_patch(delta.write_patch(delta.create_patch(before, after, False)))
            made = delta.apply_patch(before, patch, False)
            found = [f["data"] for f in bundle.unpack_bundle(made)]
            out.append((patch["packets"][0]["patch"] is not None, hashlib.md5(found[0]).hexdigest(), found == [f["data"] for f in bundle.unpack_bundle(after)]))
        return pd.DataFrame(out, columns=["has_patch", "md5", "applies"])

    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", patched("p_partkey", "p_name").alias("r")).select("p_partkey", "r.*")


# deltas of bytes


@query("""
select doc_id, md5(coalesce(text, '')) as md5, true as copies from documents
""")
def delta_copies(spark, sf_dir):
    """Each whole text from a source that has its two halves the other way round: the delta may hold a few instructions, never the text."""

    @F.pandas_udf("struct<md5: string, copies: boolean>")
    def made(column: pd.Series) -> pd.DataFrame:
        import hashlib

        out = []
        for t in column:
            raw = t.encode()
            source = raw[len(raw) // 2 :] + raw[: len(raw) // 2]
            patch = delta.encode(source, raw)
            # two copies and the headers; texts of fewer bytes than that may come whole
            out.append((hashlib.md5(delta.decode(source, patch)).hexdigest(), len(patch) <= 160 or len(patch) * 4 <= len(raw)))
        return pd.DataFrame(out, columns=["md5", "copies"])

    d = table(spark, sf_dir, "documents").select("doc_id", made(F.coalesce("text", F.lit(""))).alias("r"))
    return d.select("doc_id", "r.*")


@query("""
select n_nationkey, 'd6c3c4' as mark, n_name || ' of ' || n_name as target from nation
""")
def delta_golden(spark, sf_dir):
    """Deltas written by hand, one instruction after the other: ADD the first word, RUN and COPY what follows; as the decoder reads them."""

    @F.pandas_udf("struct<mark: string, target: string>")
    def made(name: pd.Series) -> pd.DataFrame:
        out = []
        for n in name:
            raw, between = n.encode(), b" of "
            # an ADD of all up to the second name, then a COPY of the first name from address 0 of the target itself
            adds, size = raw + between, len(raw)
            instructions = bytes([1, len(adds), 19, size])
            addresses = b"\x00"
            body = bytes([len(adds) + size, 0, len(adds), len(instructions), len(addresses)]) + adds + instructions + addresses
            patch = b"\xd6\xc3\xc4\0\0" + b"\0" + bytes([len(body)]) + body
            out.append((patch[:3].hex(), delta.decode(b"", patch).decode()))
        return pd.DataFrame(out, columns=["mark", "target"])

    return table(spark, sf_dir, "nation").select("n_nationkey", made("n_name").alias("r")).select("n_nationkey", "r.*")


# sound banks


def _banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank for each nation: its suppliers' names as media, its customers as events, in one of the versions."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("media"))
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey"))).alias("events"))

    @F.pandas_udf("binary")
    def made(nation: pd.Series, media: pd.Series, events: pd.Series) -> pd.Series:
        def one(n: int, files, rows) -> bytes:
            version = soundbank.VERSIONS[n % len(soundbank.VERSIONS)]
            count = (lambda k: bytes([k])) if version >= 125 else (lambda k: struct.pack("<I", k))
            objects = [("Event", int(r["c_custkey"]), count(2) + struct.pack("<2I", int(r["c_custkey"]) + 1, int(r["c_custkey"]) + 2)) for r in (rows if rows is not None else ())]
            bank = {"version": version, "bank_id": n, "language": n % 3, "expand": bytes(n % 4), "chunks": [{"id": "HIRC", "offset": 0, "data": soundbank.write_objects(version, objects)}]}
            items = [(int(f["s_suppkey"]), f["s_name"].encode() * (int(f["s_suppkey"]) % 3)) for f in (files if files is not None else ())]
            return soundbank.write(soundbank.with_media(bank, items))

        return pd.Series([one(*x) for x in zip(nation.tolist(), media, events)], dtype=object)

    both = c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full").withColumn("nation", F.coalesce("c_nationkey", "s_nationkey"))
    return both.select(F.col("nation").cast("string").alias("file"), made("nation", "media", "events").alias("content"))


@query("""
with s as (select s_nationkey as nation, s_suppkey as id, octet_length(encode(s_name)) * (s_suppkey % 3) as size, s_name, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as entry from supplier),
t as (select *, lag((size + 15) // 16 * 16, 1, 0) over (partition by nation order by entry) as room from s)
select nation, cast(entry as integer) as entry, cast(id as bigint) as id, cast(case when id = 0 then 1 else sum(room) over (partition by nation order by entry) end as bigint) as "offset", cast(size as bigint) as size, md5(repeat(s_name, cast(id % 3 as integer))) as md5 from t
""")
def bank_media(spark, sf_dir):
    """The index of each bank's media: payloads at multiples of 16."""
    out = decode(_banks(spark, sf_dir), "bank.media", strict=True)
    return out.select(F.col("file").cast("int").alias("nation"), "entry", "id", "offset", "size", F.md5("data").alias("md5"))


@query("""
with v as (select [72, 88, 112, 113, 118, 120, 125, 128, 132, 134, 135, 140, 145, 150] as list)
select c_nationkey as nation, cast(list[c_nationkey % 14 + 1] as integer) as version, cast(row_number() over (partition by c_nationkey order by c_custkey) - 1 as integer) as ordinal, cast(4 as integer) as type_code, 'Event' as kind, cast(c_custkey as bigint) as id,
  cast(case when list[c_nationkey % 14 + 1] >= 125 then 9 else 12 end as integer) as n_body from customer, v
""")
def bank_objects(spark, sf_dir):
    out = decode(_banks(spark, sf_dir), "bank.objects", strict=True)
    return out.select(F.col("file").cast("int").alias("nation"), "version", "ordinal", "type_code", "kind", "id", F.octet_length("body").alias("n_body"))


@query("""
select n as nation, cast(k as integer) as ordinal, ['DIDX', 'DATA', 'HIRC'][k + 1] as id, cast(n as bigint) as bank_id, cast(n % 3 as bigint) as language
from (select distinct s_nationkey as n from supplier union select distinct c_nationkey from customer) cross join range(0, 3) r(k)
""")
def bank_chunks(spark, sf_dir):
    out = decode(_banks(spark, sf_dir), "bank.chunks", strict=True)
    return out.select(F.col("file").cast("int").alias("nation"), "ordinal", "id", "bank_id", "language")


@query("""
select c_custkey as object_id, 'Event' as kind, unnest(['action_count', 'actions[0]', 'actions[1]']) as path, unnest(['2', cast(c_custkey + 1 as varchar), cast(c_custkey + 2 as varchar)]) as value from customer
""")
def bank_event_fields(spark, sf_dir):
    """The fields of events by version: a count of one byte from a certain version on, of four before."""
    return decode(_banks(spark, sf_dir), "bank.fields", strict=True).select("object_id", "kind", "path", "value")


@query("""
select c_custkey as object_id, unnest(['action_count', 'actions[0]', 'actions[1]']) as path, unnest(['2', cast(c_custkey + 1 as varchar), cast(c_custkey * 3 as varchar)]) as value, cast(c_custkey + 2 as varchar) as before from customer
""")
def bank_updates(spark, sf_dir):
    """One field of every event replaced, its type and place kept; all fields afterwards, and the value there was."""
    banks = decode(_banks(spark, sf_dir), "bank.objects", strict=True)

    @F.pandas_udf("array<struct<path: string, value: string, before: string>>")
    def updated(version: pd.Series, kind: pd.Series, key: pd.Series, body: pd.Series) -> pd.Series:
        out = []
        for v, k, i, b in zip(version.tolist(), kind, key.tolist(), body):
            row, before = soundbank.replace_field(v, {"kind": k, "id": i, "body": b}, "actions[1]", i * 3)
            out.append([{"path": f["path"], "value": f["value"], "before": before} for f in soundbank.fields(v, row)])
        return pd.Series(out, dtype=object)

    return banks.select(F.col("id").alias("object_id"), F.explode(updated("version", "kind", "id", "body")).alias("f")).select("object_id", "f.*")


@query("""
with o as (select o_orderkey, cast([72, 88, 112, 113, 118, 120, 125, 128, 132, 134, 135, 140, 145, 150][o_custkey % 14 + 1] as bigint) as version, o_orderkey % 62 as value, o_orderkey % 2 as d from orders),
p as (select *, case when d = 0 then value - case when version < 118 then 14 when version < 150 then 15 else 57 end when version < 112 then -1 when version < 150 or value < 9 then value when value = 9 then -1 else value - 1 end as k from o),
n as (
  select *, case when d = 0 then ['delay', 'fade_time', 'probability'] else ['scope', 'stop_playback', 'depth', 'attack', 'frequency', 'waveform', 'smoothing', 'pulse_width_modulation', 'initial_phase_offset', 'attack_time', 'attack_curve',
    'decay_time', 'sustain_level', 'sustain_time', 'release_time', 'trigger_on', 'duration', 'loop', 'playback_rate', 'initial_delay'] end as names from p
)
select o_orderkey, version, case when d = 0 then 'event_action' else 'modulator' end as domain, case when k between 0 and len(names) - 1 then names[k + 1] end as name from n
""")
def bank_property_names(spark, sf_dir):
    """What an identifier of two domains means in a version, by a join with the descriptors."""
    rows = [(d["domain"], d["value"], d["since"], d["until"], d["name"]) for d in bank_properties.descriptors()]
    dimension = spark.createDataFrame(rows, "domain string, value long, since long, until long, name string").withColumn("value", F.concat("domain", F.lit(":"), "value"))
    versions = F.array(*map(F.lit, soundbank.VERSIONS))
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.element_at(versions, (F.col("o_custkey") % 14 + 1).cast("int")).cast("long").alias("version"), F.when(F.col("o_orderkey") % 2 == 0, "event_action").otherwise("modulator").alias("domain"), (F.col("o_orderkey") % 62).alias("value")
    )
    found = edits.versioned_lookup(o.withColumn("value", F.concat("domain", F.lit(":"), "value")), "version", "value", dimension, "name")
    return found.select("o_orderkey", "version", "domain", "name")


@query("""
select o_orderkey, cast(o_orderkey % 32 + o_custkey % 2048 * 32 + o_orderkey * 7 % 8192 * 65536 as bigint) as word, o_orderkey % 32 as a, o_custkey % 2048 as b, o_orderkey * 7 % 8192 as c from orders
""")
def bit_stream(spark, sf_dir):
    """Three numbers of 5, 11 and 13 bits in a stream, the lowest bit first: the bytes as one number, and the numbers read back."""

    @F.pandas_udf("struct<word: long, a: long, b: long, c: long>")
    def streamed(order: pd.Series, customer: pd.Series) -> pd.DataFrame:
        out = []
        for o, c in zip(order.tolist(), customer.tolist()):
            w = bits.BitWriter()
            for value, width in ((o % 32, 5), (c % 2048, 11), (o * 7 % 8192, 13)):
                w.write(value, width)
            r = bits.BitReader(w.done())
            out.append((int.from_bytes(w.done(), "little"), r.read(5), r.read(11), r.read(13)))
        return pd.DataFrame(out, columns=["word", "a", "b", "c"])

    return table(spark, sf_dir, "orders").select("o_orderkey", streamed("o_orderkey", "o_custkey").alias("r")).select("o_orderkey", "r.*")


# animations, particles and trails


def _animations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An animation for each customer with orders, in versions 1 to 6: a frame for each order, which appends, moves and removes a layer."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))

    @F.pandas_udf("binary")
    def made(customer: pd.Series, keys: pd.Series) -> pd.Series:
        def frame(k: int) -> dict:
            append = {"index": k % 5000, "name": f"n{k}" if k % 2 else None, "resource": k % 200, "sprite": False, "additive": k % 3 == 0, "preload_frame": 0, "time_scale": 1.0}
            change = {"index": k % 3000, "transform": [k % 50 / 1000, k % 900 / 20, k % 70 / 20] if k % 2 else [k % 9000 / 20, -(k % 33) / 20], "source_rectangle": None, "color": [0.0, 1.0, k % 256 / 255, 1.0] if k % 4 == 0 else None, "sprite_frame_number": None}
            return {"label": f"l{k}" if k % 5 == 0 else None, "stop": k % 10 == 0, "command": [], "remove": [{"index": k % 4000}], "append": [append], "change": [change]}

        def one(c: int, own) -> bytes:
            version = c % 6 + 1
            sprite = {"name": "s" if version >= 4 else None, "frame_rate": 30.0 if version >= 4 else None, "work_area": [0, 1] if version >= 5 else None, "frame": [frame(int(k)) for k in own]}
            return animation.encode({"version": version, "frame_rate": 30, "position": [0.0, 0.0], "size": [1.0, 1.0], "image": [], "sprite": [], "main_sprite": sprite})

        return pd.Series([one(*x) for x in zip(customer.tolist(), keys)], dtype=object)

    return o.select(F.col("o_custkey").cast("string").alias("file"), made("o_custkey", "keys").alias("content"))


@query("""
with o as (select o_custkey as customer, o_orderkey as k, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as integer) as frame from orders)
select customer, frame, 'remove' as op, cast(k % 4000 as integer) as index, cast(null as bigint) as resource, cast(null as bigint) as x, cast(null as bigint) as blue, cast(null as varchar) as name from o
union all select customer, frame, 'append', cast(k % 5000 as integer), k % 200, null, null, case when k % 2 = 1 then 'n' || k end from o
union all select customer, frame, 'change', cast(k % 3000 as integer), null, case when k % 2 = 1 then k % 900 else k % 9000 end, case when k % 4 = 0 then k % 256 end, null from o
union all select customer, frame, case when k % 10 = 0 then 'stop' else 'label' end, null, null, null, null, 'l' || k from o where k % 5 = 0
""")
def animation_events(spark, sf_dir):
    """What each frame does: indices beyond the short form, places in twentieths, turns or none, colours in 255ths."""
    out = decode(_animations(spark, sf_dir), "animation.events", strict=True)
    at = F.when(F.size("transform") == 3, F.col("transform")[1]).otherwise(F.col("transform")[0])
    return out.select(
        F.col("file").cast("long").alias("customer"), "frame", "op", "index", "resource", F.round(at * 20).cast("long").alias("x"), F.round(F.col("color")[2] * 255).cast("long").alias("blue"), "name"
    )


@query("""
with p as (select p_partkey as part, p_size as v from part)
select part, 'spawn_rate' as curve, cast(0 as integer) as node, cast(0.5 as double) as time, cast(v as double) as low, cast(v + 2 as double) as high, cast(2 as integer) as curve_type from p
union all select part, 'spawn_rate', 1, 1.0, v + 1, v + 1, cast(null as integer) from p
union all select part, 'particle_scale', 0, 0.0, -v, -v, cast(case when part % 2 = 0 then 6 end as integer) from p
union all select part, 'field[0].x', 0, 0.25, v, v, null from p where part % 3 = 0
""")
def particle_curves(spark, sf_dir):
    """Emitters written as XML, encoded by turns in the three layouts, and their curves as nodes: percents as shares, names of curves as numbers."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("v"))
    field = F.when(F.col("p_partkey") % 3 == 0, F.format_string("<Field><FieldType>Friction</FieldType><X>%d,25</X></Field>", "v")).otherwise("")
    bounce = F.when(F.col("p_partkey") % 2 == 0, " Bounce").otherwise("")
    xml = F.concat(F.format_string("<Emitter><Name>e%d</Name><SpawnRate>[%d %d],50 EaseIn %d,100</SpawnRate><ParticleScale>-%d", "p_partkey", "v", F.col("v") + 2, F.col("v") + 1, "v"), bounce, F.lit("</ParticleScale>"), field, F.lit("</Emitter>"))
    content = None
    for k, layout in enumerate(("pc", "phone32", "phone64")):
        one = F.when(F.col("p_partkey") % 3 == k, codec("particles.from_xml", strict=True, layout=layout)("xml"))
        content = one if content is None else F.coalesce(content, one)
    files = p.withColumn("xml", xml).select(F.col("p_partkey").cast("string").alias("file"), content.alias("content"))
    out = decode(files, "particles.curves", strict=True)
    return out.select(F.col("file").cast("long").alias("part"), "curve", "node", *(F.col(c).cast("double").alias(c) for c in ("time", "low", "high")), "curve_type")


@query("""
select s_suppkey, '<Image>i' || s_suppkey || '</Image>' || chr(10) || '<MaxPoints>' || (s_suppkey % 40) || '</MaxPoints>' || chr(10) || case when s_suppkey % 2 = 1 then '<Loops>1</Loops>' || chr(10) else '' end
  || '<MinPointDistance>' || (s_suppkey % 9) || '.5</MinPointDistance>' || chr(10) || '<WidthOverLength>[' || (s_suppkey % 7 + 1) || ' ' || (s_suppkey % 7 + 3) || '],50 ' || (s_suppkey % 5 + 1) || '</WidthOverLength>' || chr(10) as xml
from supplier
""")
def trail_fields(spark, sf_dir):
    """Trails written as XML, encoded, and written as XML again in the order that the format has."""
    s = F.col("s_suppkey")
    loops = F.when(s % 2 == 1, "<Loops>1</Loops>").otherwise("")
    xml = F.concat(F.format_string("<WidthOverLength> [%d %d],50   %d </WidthOverLength><MinPointDistance>%d.5</MinPointDistance>", s % 7 + 1, s % 7 + 3, s % 5 + 1, s % 9), loops, F.format_string("<MaxPoints>%d</MaxPoints><Image>i%d</Image>", s % 40, s))
    back = codec("trail.to_xml", strict=True)(codec("trail.from_xml", strict=True)(xml))
    return table(spark, sf_dir, "supplier").select("s_suppkey", back.alias("xml"))


# checksums and typed text

_STEP = "xor(c >> 1, (c & 1) * 3988292384)"


@query(f"""
with p as (select p_partkey, p_name, list_transform(range(1, octet_length(encode(p_name)) + 1), lambda i: cast(ord(p_name[i]) as bigint)) as b from part),
a as (select *, len(b) as n from p)
select p_partkey,
  cast((1 + list_sum(b)) % 65521 + (n + list_sum(list_transform(range(1, n + 1), lambda i: (n - i + 1) * b[i]))) % 65521 * 65536 as bigint) as adler,
  cast(xor(list_reduce(list_prepend(4294967295::bigint, b), lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {_STEP})), 4294967295) as bigint) as crc
from a
""")
def checksum_values(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", checksums.adler32(F.col("p_name").cast("binary")).alias("adler"), F.crc32(F.col("p_name").cast("binary")).alias("crc"))


@query("""
select o_orderkey, o_custkey % 3 = 0 as flag, nullif(o_custkey % 5, 0) as number, case when o_custkey % 4 = 0 then null else o_orderpriority end as choice from orders
""")
def typed_parameters(spark, sf_dir):
    """Parameters as text, with blanks around and blank ones missing."""
    o = table(spark, sf_dir, "orders").withColumns({
        "f": F.when(F.col("o_custkey") % 3 == 0, " true ").otherwise("yes"), "n": F.concat(F.lit("  "), F.col("o_custkey") % 5, F.lit(" ")), "c": F.when(F.col("o_custkey") % 4 == 0, "   ").otherwise(F.concat(F.col("o_orderpriority"), F.lit(" "))),
    })
    options = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return o.select("o_orderkey", fx.parse_bool(F.col("f")).alias("flag"), fx.parse_int(F.col("n"), zero_as_null=True).alias("number"), fx.parse_choice(F.col("c"), options).alias("choice"))
