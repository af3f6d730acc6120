"""WARC archives from a table of pages and back, as a chunked record table.

A payload never travels whole: it becomes rows of (page_id, digest, chunk
number, bytes, running SHA-1) of at most ``CHUNK`` bytes. Each archive's task
gets its chunks sorted by record and number, writes a record's headers, then
streams the chunks through a gzip member, and compares the running digest at
the end with the one in the headers. Reading is the same in reverse: files are
read block by block, and each record comes back as chunk rows with the length
and digest so far; the last row of a record carries those of the whole payload.

Payloads of at least ``DEDUP_BYTES`` that are equal are stored once: the record
with the largest page_id is the response, the others revisit it and hold no
payload, only its length and digest.

Archives are written under a temporary name by the attempt that writes them
and renamed when complete, so a repeated attempt replaces the same file.

Defined cases: a null html is empty; a null url is written as ``about:blank``;
a row without a page_id is written with the id ``none`` and read back as null,
and refers to the largest page_id with its payload if there is one; rows that
repeat a page_id and an html are one record that says how many rows it stands
for, and come back as many; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, new_folder

CHUNK = 1 << 20
#: Payload bytes in an archive, about.
ARCHIVE_BYTES = 32 << 20
#: Equal payloads shorter than this are stored each time.
DEDUP_BYTES = 1000
#: The date of records: the table has none.
DATE = "1970-01-01T00:00:00Z"
_BLOCK = 1 << 18
_NONE = -1
_ROWS = "archive int, page_id long, digest string, chunk int, data binary, url string, n_bytes long, refers_to long, copies long"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI; a bare path is a local one."""
    return fs.FileSystem.from_uri(folder if "://" in folder else re.sub("^(file:)?/*", "file:///", folder))


def _uri(page_id: int | None) -> str:
    return f"<urn:lodestack:page:{'none' if page_id is None else page_id}>"


def _head(row: dict) -> bytes:
    """The record's headers and the HTTP headers of its block."""
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(row['page_id'])}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (quote(row["url"], safe="%/:?#[]@!$&'()*+,;=~-._") if row["url"] else "about:blank"),
        f"WARC-Payload-Digest: sha1:{row['digest']}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(row['refers_to'])}"]
    if row["copies"] > 1:
        lines.append(f"Lodestack-Rows: {row['copies']}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else row['n_bytes'])}", "", ""]
    return "\r\n".join(lines).encode() + http


class _Archive:
    """One file under way: a gzip member for each record."""

    def __init__(self, folder: str, number: int, attempt: str) -> None:
        self.fs, base = _place(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.temp = f"{base}/part-{number:06d}.warc.gz", f"{base}/_part-{number:06d}.{attempt}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.records = 0
        self.zip = None
        info = b"software: lodestack\r\nformat: WARC file version 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:lodestack:archive:{number}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        self.begin(head.encode() + info)
        self.end()

    def begin(self, head: bytes) -> None:
        self.zip = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.write(head)

    def write(self, data: bytes) -> None:
        if part := self.zip.compress(data):
            self.out.write(part)

    def end(self) -> None:
        self.write(b"\r\n\r\n")
        self.out.write(self.zip.flush())

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """(archive, page_id, digest, html) to chunk rows."""
    for batch in batches:
        for archive, page_id, digest, html in zip(*(batch.column(k) for k in range(3)), batch.column(3).cast(pa.binary())):
            view = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
            for n, at in enumerate(range(0, len(view), chunk_bytes)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive.as_py()], pa.int32()), pa.array([page_id.as_py()], pa.int64()), pa.array([digest.as_py()]), pa.array([n], pa.int32()), pa.array([bytes(view[at : at + chunk_bytes])], pa.binary())],
                    names=["archive", "page_id", "digest", "chunk", "data"],
                )


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches joined up to some megabytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= 4 * CHUNK or len(held) >= 2000:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows one by one; a chunk's bytes stay where they are until they are asked for."""
    small = [batch.column(k).to_pylist() for k in range(batch.num_columns) if batch.schema.names[k] != "data"]
    names = [n for n in batch.schema.names if n != "data"]
    for data, *values in zip(batch.column("data"), *small):
        yield dict(zip(names, values)) | {"data": data}


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = str(TaskContext.get().taskAttemptId())
        now, number, row, seen, sha, open_ = None, None, None, -1, None, False

        def finish() -> None:
            nonlocal open_
            if open_:
                if sha.hexdigest() != row["digest"]:
                    raise ValueError(f"the chunks of page {row['page_id']} do not make its payload")
                now.end()
                open_ = False

        done = []
        for batch in batches:
            for r in _each(batch):
                if r["archive"] != number:
                    finish()
                    if now:
                        now.close()
                        done.append((number, now.path, now.records))
                    number = r["archive"]
                    now = _Archive(folder, number, attempt)
                if r["chunk"] == _NONE:
                    finish()
                    row, seen, sha = r, -1, hashlib.sha1()
                    now.begin(_head(r))
                    now.records += 1
                    open_ = True
                    if r["refers_to"] is not None:
                        now.end()
                        open_ = False
                elif open_ and r["chunk"] == seen + 1:  # a repeated row's chunks are there again, a revisit's are left out
                    seen += 1
                    sha.update(data := r["data"].as_py())
                    now.write(data)
        finish()
        if now:
            now.close()
            done.append((number, now.path, now.records))
        numbers, paths, records = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(paths, pa.string()), pa.array(records, pa.int64())], names=["archive", "path", "records"])

    return run


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, chunk_bytes: int = CHUNK) -> DataFrame:
    """Writes the archives; returns (archive, path, records) of each, stored."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha1("html"))
    records = materialise(
        rows.select("page_id", "url", "digest", F.octet_length("html").cast("long").alias("n_bytes"))
        .groupBy("page_id", "digest").agg(F.min("url").alias("url"), F.first("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("copies")),
        "records",
    )
    total = records.agg(F.sum("n_bytes")).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    first = records.where(F.col("n_bytes") >= DEDUP_BYTES).groupBy("digest").agg(F.max("page_id").alias("_first"))
    heads = records.join(first.hint("merge"), "digest", "left").withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("_first")), None).otherwise(F.col("_first")))
    archive = F.pmod(F.xxhash64("page_id", "digest"), F.lit(archives)).cast("int").alias("archive")
    heads = heads.select(archive, "page_id", "digest", F.lit(_NONE).alias("chunk"), F.lit(None).cast("binary").alias("data"), "url", "n_bytes", "refers_to", "copies")
    body = rows.select(archive, "page_id", "digest", "html").mapInArrow(lambda b: _batched(_chunks(b, chunk_bytes)), "archive int, page_id long, digest string, chunk int, data binary")
    both = heads.unionByName(body, allowMissingColumns=True)
    dealt = both.repartitionById(archives, "archive").sortWithinPartitions("archive", "page_id", "digest", "chunk")
    return materialise(dealt.mapInArrow(_writer(folder), "archive int, path string, records long"), "archives")


def _blocks(path: str, scheme: str) -> Iterator[tuple[bool, bytes]]:
    """The unpacked bytes of a file; true where a gzip member, so a record, begins."""
    store, _ = _place(scheme)
    with store.open_input_stream(path, compression=None) as source:
        left = b""
        while left or (left := source.read(_BLOCK)):
            unzip, fresh = zlib.decompressobj(31), True
            while not unzip.eof:
                part = unzip.decompress(left, _BLOCK)
                left = unzip.unconsumed_tail or unzip.unused_data
                if part or fresh:
                    yield fresh, part
                    fresh = False
                if not unzip.eof and not left:
                    left = source.read(_BLOCK)
                    if not left:
                        raise ValueError(f"{path} ends within a record")


def _records(path: str, scheme: str, chunk_bytes: int) -> Iterator[tuple[dict, int, bytes, bool]]:
    """(headers, chunk number, bytes, last) of every chunk of every record that is not warcinfo; never holds more than a chunk."""
    head: dict | None = None
    held, chunk, left = b"", 0, 0
    for fresh, part in _blocks(path, scheme):
        if fresh:
            head, held, chunk, left = None, b"", 0, 0
        held += part
        if head is None:
            at = held.find(b"\r\n\r\n")
            if at < 0:
                continue
            fields = dict(x.split(": ", 1) for x in held[:at].decode().split("\r\n")[1:])
            if fields["WARC-Type"] != "warcinfo":
                end = held.find(b"\r\n\r\n", at + 4)
                if end < 0:
                    continue
                http = dict(x.split(": ", 1) for x in held[at + 4 : end].decode().split("\r\n")[1:])
                left = int(fields["Content-Length"]) - (end - at)
                fields["payload"] = int(http["Content-Length"])
                held = held[end + 4 :]
            head = fields
            if head["WARC-Type"] != "warcinfo" and not left:
                yield head, 0, b"", True
                left = -1
        if head["WARC-Type"] == "warcinfo" or left < 0:
            held = b""
            continue
        while left > 0 and len(held) >= (size := min(left, chunk_bytes)):
            data, held = held[:size], held[size:]
            left -= len(data)
            yield head, chunk, data, not left
            chunk += 1
        if not left:
            left = -1


def read_warc(archives: DataFrame, folder: str, with_data: bool = True, chunk_bytes: int = CHUNK) -> DataFrame:
    """Chunk rows of the archives named in the columns archive (their number) and path: page_id, chunk, [data], payload_bytes and payload_digest so far, record_type, refers_to, last."""

    def page(uri: str | None) -> int | None:
        found = (uri or "").rpartition(":")[2].rstrip(">")
        return int(found) if found and found != "none" else None

    fields = "page_id long, chunk int, " + "data binary, " * with_data + "payload_bytes long, payload_digest string, record_type string, refers_to long, last boolean"
    names = [x.split()[0] for x in fields.split(", ")]
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]]) for x in fields.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for head, chunk, data, last in _records(path, folder, chunk_bytes):
                    if not chunk:
                        sha, done = hashlib.sha1(), 0
                    sha.update(data)
                    done += len(data)
                    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = head["WARC-Type"] == "revisit"
                    if last and not revisit and (sha.hexdigest() != told or done != head["payload"]):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    full = (head["payload"], told) if revisit else (done, sha.hexdigest())
                    row = (page(head["WARC-Record-ID"]), chunk, data, *full, head["WARC-Type"], page(head.get("WARC-Refers-To")), last)
                    row = row if with_data else row[:2] + row[3:]
                    for _ in range(int(head.get("Lodestack-Rows", 1))):
                        rows.append(row)
                        size += len(data)
                        if size >= 4 * CHUNK or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names=names)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names=names)

    # a task for each archive: the path rows are so small that adaptive execution would join them into one
    many = (archives.agg(F.max("archive")).first()[0] or 0) + 1
    return archives.select("path", "archive").repartitionById(many, "archive").mapInArrow(run, fields)


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all pages, reads the archives back; for each page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    archives = write_warc(pages, folder)
    return read_warc(archives, folder, with_data=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
