"""Rows to files, and rows to archives.

Files go under a folder that all executors share, written under a temporary
name and renamed, so a repeated task replaces its own files. A path that would
leave the folder fails the job before anything is written, and a path through a
symbolic link fails when its file is due.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import bundle, chunked, flat
from ..functions.text import path_problem
from ..operators import ordered
from .shared import stored


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else re.sub("^(file:)?/*", "file:///", folder))


def linked_parent(base: str, name: str) -> str | None:
    """The first folder between the base and a file that is a symbolic link, which could lead anywhere. Only local folders have links."""
    at = base
    for part in name.split("/")[:-1]:
        at = f"{at}/{part}"
        if os.path.islink(at):
            return at
    return None


def safe(df: DataFrame, path: str = "path") -> DataFrame:
    """``df``; running it fails at a path that is empty, absolute, leads upwards, or has a drive or a nul."""
    problem = path_problem(F.col(path))
    return df.where(F.when(problem.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), F.coalesce(F.col(path), F.lit("")))).cast("boolean")))


def write_files(df: DataFrame, folder: str, path: str = "path", data: str = "data", overwrite: bool = True) -> dict:
    """Writes each row's bytes to its path; returns how many files and bytes. An empty entry whose path ends in a slash is a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = _store(folder)
        local = isinstance(store, fs.LocalFileSystem)
        attempt, n, size = TaskContext.get().taskAttemptId(), 0, 0
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, raw = name.replace("\\", "/"), raw or b""
                if name.endswith("/") and not raw:
                    store.create_dir(f"{base}/{name}", recursive=True)
                    continue
                at = f"{base}/{name}"
                if local and (link := linked_parent(base, name)):
                    raise PermissionError(f"{link} is a symbolic link")
                if not overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
                    raise FileExistsError(at)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{at}.{attempt}.tmp", compression=None) as out:
                    out.write(raw)
                store.move(f"{at}.{attempt}.tmp", at)
                n, size = n + 1, size + len(raw)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([size])], names=["n", "size"])

    done = safe(df, path).select(F.col(path).cast("string"), F.col(data).cast("binary")).mapInArrow(run, "n long, size long")
    total = done.agg(F.sum("n").alias("files"), F.sum("size").alias("bytes")).first()
    return {"files": total["files"] or 0, "bytes": total["bytes"] or 0}


def _packed(df: DataFrame, key: str, order: list[str], pack: Callable[[list[dict]], bytes]) -> DataFrame:
    """One archive for each key: its rows, sorted, as dictionaries."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([(c, "ascending") for c in order]).to_pylist()
        return pa.table({key: table[key].slice(0, 1), "data": pa.array([pack(rows)], pa.binary())})

    return df.groupBy(key).applyInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, data binary")


def pack_flat(df: DataFrame, key: str, order: str = "path", profile: str = "xor", compression: str = "none", separator: str = "preserve") -> DataFrame:
    """(key, data): a flat archive of the (path, data) rows of each key, in order. An archive is one cell: its files together must fit a task. ``flat_shards`` has no such bound."""
    return _packed(df, key, [order, "path"], _flat(profile, compression, separator))


def _flat(profile: str, compression: str, separator: str) -> Callable[[list[dict]], bytes]:
    return lambda rows: flat.write([(flat.Entry(r["path"].encode()), r["data"] or b"") for r in rows], profile, compression, separator)


def flat_shards(df: DataFrame, key: str, shard_bytes: int = 64 << 20, profile: str = "xor", compression: str = "none", separator: str = "preserve") -> DataFrame:
    """(archive, data) with archive = struct(key, shard, first): the (path, data) rows of each key, by path, cut where ``shard_bytes`` are reached into archives that follow one another; first is the number of the shard's first file within its key."""
    rows = ordered.running_total(df.select(key, "path", "data"), [key, "path"], F.octet_length("data"), "_before", "_at")
    starts = stored(rows.groupBy(F.col(key).alias("_key")).agg(F.min("_before").alias("_zero"), F.min("_at").alias("_first")), "keys")
    rows = rows.join(starts.hint("merge"), F.col(key).eqNullSafe(F.col("_key"))).withColumn("_shard", F.expr(f"(_before - _zero) div {shard_bytes}"))
    pack = _flat(profile, compression, separator)
    schema = f"archive struct<key: {dict(df.dtypes)[key]}, shard: bigint, first: bigint>, data binary"

    def run(table: pa.Table) -> pa.Table:
        own = table.sort_by("_at").to_pylist()
        head = {"key": own[0][key], "shard": own[0]["_shard"], "first": own[0]["_at"] - own[0]["_first"]}
        kind = pa.struct([("key", table.schema.field(key).type), ("shard", pa.int64()), ("first", pa.int64())])
        return pa.table({"archive": pa.array([head], kind), "data": pa.array([pack(own)], pa.binary())})

    return rows.select(key, "_shard", "_at", "_first", "path", "data").groupBy(key, "_shard").applyInArrow(run, schema)


def pack_packets(df: DataFrame, key: str, version: int = 4, flags: int = 3) -> DataFrame:
    """(key, data): a packet of the (path, is_part1, part1, data) rows of each key."""
    return _packed(df, key, ["path"], lambda rows: bundle.pack_packet([r | {"data": r["data"] or b""} for r in rows], version, flags))


def pack_chunked(df: DataFrame, key: str, codec: str = "zlib") -> DataFrame:
    """(key, data): a chunked archive of the (path, data) rows of each key, by path; each file is one chunk."""
    return _packed(df, key, ["path"], lambda rows: chunked.write([(r["path"], r["data"] or b"", codec) for r in rows]))
