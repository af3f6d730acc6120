"""A Python data source for flat archives: ``spark.read.format("flat_archive").load(path)``.

Each file is a partition. ``withData`` is off unless asked for, so a scan of
directories never touches payloads; the options ``prefix`` and ``suffix`` choose
entries by path before their payloads are read. They are options and not pushed
filters, since Spark 4.1 keeps the filters pushed for one query with the loaded
relation and applies them to the next query on it as well. The file names come
from one local or ``pyarrow`` file system.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_SCHEMA = "file string, ordinal int, path string, kind string, stored_size long, original_size long"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else re.sub("^(file:)?/*", "file:///", path))


class FlatArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flat_archive"

    def schema(self) -> str:
        return _SCHEMA + (", data binary" if self.options.get("withdata", self.options.get("withData", "false")).lower() == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema.names, self.options.get("prefix", ""), self.options.get("suffix", ""))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("profile", "xor"), self.options.get("compression", "none"))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str], prefix: str, suffix: str) -> None:
        self.path, self.names, self.prefix, self.suffix = path, names, prefix, suffix

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _store(self.path)
        found = store.get_file_info(base)
        if found.type == fs.FileType.File:
            return [_File(self.path)]
        every = store.get_file_info(fs.FileSelector(base, recursive=True))
        return [_File(self.path.rstrip("/") + i.path[len(base.rstrip("/")) :]) for i in every if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from ..codecs import flat

        store, base = _store(partition.value)
        with store.open_input_stream(base, compression=None) as f:
            data = f.read()
        index = flat.read_index(data)
        for k, e in enumerate(index.entries):
            row = {"file": partition.value, "ordinal": k, "path": e.path.decode("utf-8", "replace"), "kind": e.kind, "stored_size": e.stored_size, "original_size": e.original_size}
            if row["path"].startswith(self.prefix) and row["path"].endswith(self.suffix):
                if "data" in self.names:
                    row["data"] = flat.read_entry(data, index, k)
                yield tuple(row[n] for n in self.names)


class _Part(WriterCommitMessage):
    def __init__(self, temp: str, path: str) -> None:
        self.temp, self.path = temp, path


class _Writer(DataSourceWriter):
    """An archive for each partition of (path, data) rows, under a temporary name until the job commits."""

    def __init__(self, path: str, profile: str, compression: str) -> None:
        self.path, self.profile, self.compression = path, profile, compression

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from ..codecs import flat

        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        entries = [(flat.Entry(r["path"].encode()), bytes(r["data"] or b"")) for r in rows]
        own = uuid.uuid4().hex  # a repeated attempt has a name of its own; only committed ones are renamed
        with store.open_output_stream(f"{base}/_{own}", compression=None) as out:
            out.write(flat.write(entries, self.profile, self.compression))
        return _Part(f"{base}/_{own}", f"{base}/part-{own}.pak")

    def commit(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m:
                store.move(m.temp, m.path)

    def abort(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m:
                store.delete_file(m.temp)


def register(spark) -> None:
    """Makes ``flat_archive`` known to the session."""
    spark.dataSource.register(FlatArchives)
