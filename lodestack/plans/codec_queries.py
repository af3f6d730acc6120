"""Codecs applied to the test tables: each query encodes rows, decodes the bytes again and reports what SQL can compute from the rows themselves."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import audio, keyframes, texture, tree
from ..sinks.files import flat_shards, pack_packets
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


_TEXT_MD5 = "select doc_id, md5(coalesce(text, '')) as md5, octet_length(encode(coalesce(text, ''))) as n_bytes from documents"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def _round_trip(df, there, back):
    return df.withColumn("back", back(there(F.col("text").cast("binary")))).select("doc_id", F.md5("back").alias("md5"), F.octet_length("back").cast("long").alias("n_bytes"))


@query(_TEXT_MD5)
def container_round_trip(spark, sf_dir):
    return _round_trip(_documents(spark, sf_dir), codec("container.wrap", strict=True, level=6), codec("container.unwrap", strict=True))


@query("select doc_id, 'compact' as variant, octet_length(encode(coalesce(text, ''))) as raw_size, 8 as header_length from documents")
def container_inspect(spark, sf_dir):
    wrapped = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), codec("container.wrap", strict=True, level=1)(F.col("text").cast("binary")).alias("content"))
    return decode(wrapped, "container.info", strict=True).select(F.col("file").cast("long").alias("doc_id"), "variant", "raw_size", "header_length")


@query(_TEXT_MD5)
def xor_round_trip(spark, sf_dir):
    return _round_trip(_documents(spark, sf_dir), codec("xor.wrap", strict=True, key=b"key"), codec("xor.unwrap", strict=True, key=b"key"))


@query("select page_id, md5(url) as md5 from pages")
def cipher_text_round_trip(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    there = codec("text.encode", strict=True, seed="seed")(F.col("url").cast("binary"))
    return p.select("page_id", F.md5(codec("text.decode", strict=True, seed="seed")(there)).alias("md5"))


@query("""
select source as archive, cast(row_number() over (partition by source order by 'docs/' || cast(doc_id as varchar) || '.txt') - 1 as integer) as ordinal,
  'docs/' || cast(doc_id as varchar) || '.txt' as path, octet_length(encode(coalesce(text, ''))) as original_size, md5(coalesce(text, '')) as md5
from documents
""")
def archive_round_trip(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("source", F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("data"))
    packed = flat_shards(rows, "source", profile="aligned", compression="zlib").withColumn("archive", F.to_json("archive"))
    files = decode(packed, "flat.files", "archive", "data", strict=True).withColumn("shard", F.from_json("file", "key string, shard long, first long"))
    return files.select(F.col("shard.key").alias("archive"), (F.col("shard.first") + F.col("ordinal")).cast("int").alias("ordinal"), "path", "original_size", F.md5("data").alias("md5"))


@query("""
select source as archive, count(*) as n_entries, cast(sum(octet_length(encode(coalesce(text, '')))) as bigint) as total, 'xor' as profile, 'none' as compression from documents group by 1
""")
def archive_index(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("source", F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("data"))
    packed = flat_shards(rows, "source").select(F.col("archive.key").alias("source"), "data")
    entries = decode(packed, "flat.entries", "source", "data", strict=True)
    return entries.groupBy(F.col("file").alias("archive"), "profile", "compression").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("original_size").alias("total"))


@query("""
select p_brand as packet, cast(p_partkey as varchar) as path, p_partkey % 3 = 0 as is_part1, case when p_partkey % 3 = 0 then p_size end as width, md5(p_name) as md5 from part
""")
def packet_round_trip(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    textured = F.col("p_partkey") % 3 == 0
    rows = p.select(
        "p_brand", F.col("p_partkey").cast("string").alias("path"), textured.alias("is_part1"),
        F.when(textured, F.struct(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("width"), F.lit(1).cast("long").alias("height"))).alias("part1"), F.col("p_name").cast("binary").alias("data"),
    )
    out = decode(pack_packets(rows, "p_brand"), "packet.files", "p_brand", "data", strict=True)
    return out.select(F.col("file").alias("packet"), "path", "is_part1", F.col("part1.width").cast("int").alias("width"), F.md5("data").alias("md5"))


@query("""
select event_id, '$.' || key as node, key, json_extract_string(props, '$."' || key || '"') as value
from (select event_id, props, unnest(json_keys(props)) as key from events)
""")
def tree_nodes(spark, sf_dir):
    """Properties as tagged trees, standard and compact by turns, and back as node rows."""
    e = table(spark, sf_dir, "events")
    content = F.when(F.col("event_id") % 2 == 0, codec("tree.from_json", strict=True)(F.col("props"))).otherwise(codec("tree.from_json", strict=True, compact=True)(F.col("props")))
    nodes = decode(e.select(F.col("event_id").cast("string").alias("file"), content.alias("content")), "tree.nodes", strict=True)
    return nodes.where("ordinal > 0").select(F.col("file").cast("long").alias("event_id"), "node", "key", "value")


@query("""
with e as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events)
select user_id, cast(frame as integer) as frame, cast(value as float)::double as x, case when event_id % 3 = 0 then null else cast(event_id % 100 as double) end as y from e
""")
def keyframe_round_trip(spark, sf_dir):
    """A track of each user's events, encoded by turns in the three layouts."""
    e = table(spark, sf_dir, "events")
    tracks = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("rows"))

    @F.pandas_udf("binary")
    def encoded(user: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for u, r in zip(user, rows):
            frames = [{"x": float(x["value"]) if x["value"] is not None else None, "y": None if x["event_id"] % 3 == 0 else float(x["event_id"] % 100)} for x in r]
            out.append(keyframes.encode({"fps": 12.0, "tracks": [{"name": str(u), "frames": frames}]}, list(keyframes.LAYOUTS)[u % 3]))
        return pd.Series(out)

    files = tracks.select(F.col("user_id").cast("string").alias("file"), encoded("user_id", "rows").alias("content"))
    return decode(files, "keyframes.frames", strict=True).select(F.col("name").cast("long").alias("user_id"), "frame", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query("""
select vec_id, cast(len(embedding) as integer) as n, cast(sum_q as bigint) as sum_samples
from (select vec_id, embedding, list_sum(list_transform(embedding, lambda x: greatest(-32768, least(32767, cast(floor(x::double * 1000) as integer))))) as sum_q from embeddings)
""")
def pcm_round_trip(spark, sf_dir):
    """Vectors as 16-bit sound, into a container and back."""

    @F.pandas_udf("struct<n: int, sum_samples: long>")
    def heard(column: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for v in column:
            samples = np.clip(np.floor(np.asarray(v, np.float64) * 1000), -32768, 32767).astype("<i2")
            data = audio.decode(audio.encode(audio.wav(samples.tobytes(), 1, 8000, 16), "pcm"))
            info = audio.inspect(data)
            back = np.frombuffer(data, "<i2", info["data_size"] // 2, info["data_offset"])
            out.append({"n": len(back), "sum_samples": int(back.astype(np.int64).sum())})
        return pd.DataFrame(out, columns=["n", "sum_samples"])

    return table(spark, sf_dir, "embeddings").select("vec_id", heard("embedding").alias("r")).select("vec_id", "r.n", "r.sum_samples")


@query("""
select s_suppkey, w * h as n_pixels, cast(w * h * (s_suppkey % 256) as bigint) as red, cast(case when s_suppkey % 2 = 0 then w * h * 2 else w * h * 4 end as bigint) as n_bytes
from (select s_suppkey, s_suppkey % 37 + 1 as w, s_suppkey % 5 + 1 as h from supplier)
""")
def texture_round_trip(spark, sf_dir):
    """Even keys as 5-bit red widened and narrowed again by format rules, odd keys unchanged; the oracle holds sizes, and red where eight bits are kept."""

    @F.pandas_udf("struct<n_pixels: long, red: long, n_bytes: long>")
    def drawn(key: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for k in key:
            w, h = int(k % 37 + 1), int(k % 5 + 1)
            image = np.full((h, w, 4), 255, np.uint8)
            image[..., 0] = k % 256
            form = "la88" if k % 2 == 0 else "rgba8888"
            if form == "la88":
                image[..., 1:3] = k % 256
            data = texture.encode(image, form)
            out.append({"n_pixels": w * h, "red": int(texture.decode(data, form, w, h)[..., 0].astype(np.int64).sum()), "n_bytes": len(data)})
        return pd.DataFrame(out, columns=["n_pixels", "red", "n_bytes"])

    return table(spark, sf_dir, "supplier").select("s_suppkey", drawn("s_suppkey").alias("r")).select("s_suppkey", "r.n_pixels", "r.red", "r.n_bytes")


@query("""
select o_orderkey, 'RTID(' || printf('%x', o_custkey) || '.' || printf('%x', o_orderkey) || '.' || printf('%08x', o_custkey % 7) || '@' || o_orderpriority || ')' as text, o_custkey as id, o_orderkey as grp
from orders
""")
def typed_ids(spark, sf_dir):
    @F.pandas_udf("struct<text: string, id: long, grp: long>")
    def parsed(column: pd.Series) -> pd.DataFrame:
        out = []
        for t in column:
            r = tree.parse_rtid(t, runtime=True)
            text = tree.format_rtid(r)
            back = tree.parse_rtid(text)
            out.append({"text": text, "id": back["id"], "grp": back["group"]})
        return pd.DataFrame(out, columns=["text", "id", "grp"])

    text = F.format_string("RTID(%d.%d.%08x@%s)", "o_custkey", "o_orderkey", F.col("o_custkey") % 7, "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", parsed(text).alias("r")).select("o_orderkey", "r.*")


@query("""

select cast(n_regionkey as varchar) as file, cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as integer) as resource_index, n_name as id, cast(n_nationkey as bigint) as slot,
  case when n_nationkey % 2 = 0 then null else n_nationkey end as x from nation
""")
def manifest_resources(spark, sf_dir):
    """A manifest of each region, its nations as resources."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))

    @F.pandas_udf("string")
    def as_json(region: pd.Series, rows: pd.Series) -> pd.Series:
        def one(r, members):
            resources = [{"type": "File", "slot": int(m["n_nationkey"]), "id": m["n_name"], "path": m["n_name"]} | ({"x": int(m["n_nationkey"])} if m["n_nationkey"] % 2 else {}) for m in members]
            return json.dumps({"slot_count": 25, "groups": [{"kind": "simple", "id": str(r), "resources": resources}]})

        return pd.Series([one(r, m) for r, m in zip(region, rows)])

    files = n.select(F.col("n_regionkey").cast("string").alias("file"), codec("manifest.from_json", strict=True)(as_json("n_regionkey", "rows")).alias("content"))
    return decode(files, "manifest.resources", strict=True).select("file", "resource_index", "id", "slot", "x")
