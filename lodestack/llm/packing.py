"""Best-fit packing of documents into sequences, certified by lower bounds.

A document's ids end with id 0. Only documents longer than a sequence are
cut. Pieces are dealt over partitions of at most ``ITEMS`` and packed there by
best-fit decreasing. Dual feasible functions (a threshold family and a
rounding family over the lengths) give a lower bound for the partition's bins:
a partition that meets its bound is certified, its packing is optimal and
keeps all bins that are nearly full. Partitions with a gap keep their exactly
full bins. All other bins' documents are exchanged: dealt anew, over as few
partitions as hold them, and packed again by best-fit decreasing. That ends
when the bins together meet the bound of all lengths, one partition is left,
or after ``ROUNDS``; how many bins there are beyond the bound is logged. A task
never packs more than about ``ITEMS``. Only (id,
piece, length) rows move; texts are read once.

With target weights the sequences follow the mix of the sources: each
document has its place in the order of ``mixing.place``, a partition is a
range of places with about ``WINDOW`` pieces instead of a share by a hash, in
every round, the pieces of a sequence lie by their places, and sequence ids
rise with the place of the first piece. So the documents of a sequence come
from one stretch of the mix, and all sequences, read by id, run through it.

Defined cases: a null text is empty; an empty text is the one id 0; rows
without an id or with an id given twice are packed as rows of their own; an
empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import logging
import os
import re
import struct
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mixing import place
from .runtime import TEXT_ROWS, materialise, text_of

_LOG = logging.getLogger(__name__)
#: Ids in a sequence.
CAPACITY = 2048
#: Pieces that a task packs at once, about.
ITEMS = 40_000
#: Pieces of a range of places, about, and the most cells of places whose pieces are counted to cut the ranges.
WINDOW, CELLS = 8192, 16_384
ROUNDS = 5
#: Parts of which a worker remembers the ids, and the length of the longest of them: some 80 MB together.
_CACHE, _LONGEST = 350_000, 64
_ROUND_BITS, _PART_BITS = 58, 30
#: A text has fewer pieces than that many bits can number.
_PIECE_BITS = 28


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public vocabularies has the file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts of these characters alone are split here; in others, parts between white space go to the tokenizer whole.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_ODD = re.compile(f"[^\\t\\n\\r\\x20-\\x26\\x28-\\x7eA-Z\u00c0-\u00d6\u00d8-\u00de{_LETTERS}]|<\\|")
_PART = re.compile(f"[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")


class WordIds(dict):
    """Ids of the parts of a text, each encoded once and looked up afterwards.

    The tokenizer puts texts in lower case, drops white space and applies its
    merges within letter runs, digits and symbol runs alone. Texts of plain
    Latin letters, digits and symbols are split so here; in all others only
    white space splits, and the tokenizer sees each part as it stands.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_as = {c: level.pre_tokenize_str(chr(c))[0][0] for c in [*range(0x21, 0x7F), *range(0xDF, 0x100)]}

    def __missing__(self, part: str | bytes) -> bytes:
        if len(self) > _CACHE:
            self.clear()
        if isinstance(part, str):
            ids = [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.bytes_as))]
        else:
            ids = self.tokenizer.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= _LONGEST:
            self[part] = found
        return found

    def ids(self, raw: bytes) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit values."""
        text = raw.decode("utf-8", "replace")
        parts = raw.split() if _ODD.search(text) else _PART.findall(text.lower())
        return b"".join(map(self.__getitem__, parts))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, source_col: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids][, source, doc]): a row for each piece; ids as little-endian unsigned 32-bit values, doc a number of the row."""
    path = path or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", source string, doc long" * bool(source_col)
    more = [F.col(source_col).cast("string").alias("source"), F.monotonically_increasing_id().alias("doc")] if source_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in batches:
            own, cols = [], [[] for _ in range(4 + keep_ids)]
            for i, v in enumerate(batch.column(1).cast(pa.binary())):
                ids = words.ids(v.as_py() or b"") + bytes(4)
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    own.append(i)
                    for c, x in zip(cols, (piece, start, len(part) // 4, zlib.crc32(part), part)):
                        c.append(x)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            own = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), *(pa.array(c, t) for c, t in zip(cols, types)), *(c.take(own) for c in batch.columns[2:])], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), *more).mapInArrow(run, schema)


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bin count that the dual feasible functions prove; ``count`` has how many documents each length has."""
    size = np.arange(capacity + 1)
    many, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    a = np.arange(capacity // 2 + 1)  # above capacity - a: a bin each; below a: nothing
    over = many[capacity + 1] - many[capacity - a + 1]
    middle = total[capacity - a + 1] - total[a]
    best = int((over + -(-middle // capacity)).max())
    for k in range(1, 33):  # u_k(x) = x where (k + 1) x is a multiple of the capacity, else floor((k + 1) x / capacity) capacity / k
        up = (k + 1) * size
        scaled = np.where(up % capacity == 0, k * size, up // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and the number of bins. The open bins lie by their free space; the set bits of one integer tell which spaces exist."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets, n


def _packer(round_: int, last: bool, capacity: int, mixed: bool = False):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if mixed:
            pdf = pdf.sort_values(["position", "piece"])
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths, n)
        certified = n <= lower_bound(lengths, capacity)
        done = fill >= (0 if last else capacity - capacity // 32 if certified else capacity)
        if mixed:  # the pieces of a bin in their order, which is that of the rows here
            order = np.argsort(bins, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(bins, minlength=n))[:-1]])
            before = np.cumsum(lengths[order]) - lengths[order]
            offsets[order] = before - before[first][bins[order]]
            own = (pdf["position"].to_numpy(np.int64) << _PIECE_BITS) + pdf["piece"].to_numpy(np.int64)
            pdf["sequence_id"] = own[order[first]][bins]
        else:
            pdf["sequence_id"] = (round_ << _ROUND_BITS) + (pdf["_part"].to_numpy(np.int64) << _PART_BITS) + bins
        pdf["offset"] = offsets
        pdf["_done"] = done[bins]
        return pdf

    return run


def _ranges(todo: DataFrame, per_task: int) -> tuple[DataFrame, int]:
    """``todo`` with _part, a number for each range of positions with about ``per_task`` rows, and how many there are."""
    width = (todo.agg(F.max("position")).first()[0] or 0) // CELLS + 1
    cell = F.expr(f"position div {width}")
    counts = dict(todo.groupBy(cell.alias("_cell")).count().collect())  # a row for each cell at most
    parts, before = [], 0
    for k in sorted(counts):
        parts.append((k, before // per_task))
        before += counts[k]
    number = {p: i for i, p in enumerate(sorted({p for _, p in parts}))}
    table = todo.sparkSession.createDataFrame([(k, number[p]) for k, p in parts], "_cell long, _part long")
    return todo.withColumn("_cell", cell).join(F.broadcast(table), "_cell").drop("_cell"), max(1, len(number))  # at most CELLS rows


def pack(items: DataFrame, capacity: int = CAPACITY, per_task: int = ITEMS, mixed: bool = False) -> DataFrame:
    """``items`` (with a column length, 1 to ``capacity``; all columns stay) with sequence_id and offset.

    mixed: by the columns position, which no two documents share, and piece.
    """
    fields = [f for f in items.schema if f.name not in ("sequence_id", "offset")]
    todo = materialise(items.select([f.name for f in fields]).withColumn("_item", F.monotonically_increasing_id()), "pieces", batch_rows=TEXT_ROWS)
    keep = [f.name for f in fields] + ["sequence_id", "offset"]
    held = np.zeros(capacity + 1, np.int64)
    for length, n in todo.groupBy("length").count().collect():  # a row for each length at most
        held[length] = n
    bound = bound_of_counts(held, capacity)
    done: list[DataFrame] = []
    bins = 0
    for round_ in range(ROUNDS):
        n = todo.count()
        if not n and done:
            break
        if mixed:
            dealt, parts = _ranges(todo, per_task)
        else:
            parts = -(-n // per_task) or 1
            dealt = todo.withColumn("_part", F.expr(f"pmod(xxhash64(_item, {round_}), {parts})"))
        last = parts == 1 or round_ == ROUNDS - 1
        schema = T.StructType(dealt.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_done", T.BooleanType())])
        packed = materialise(dealt.groupBy("_part").applyInPandas(_packer(round_, last, capacity, mixed), schema), f"packed-{round_}")
        # a bin has one document at its start
        now = dict(packed.where("offset = 0").groupBy("_done").count().collect())
        if last or bins + sum(now.values()) <= bound:
            done.append(packed.select(keep))
            beyond = bins + sum(now.values()) - bound
            _LOG.info("%d bins, %s", bins + sum(now.values()), "certified: no packing has fewer" if beyond <= 0 else f"{beyond} more than the proven bound")
            break
        done.append(packed.where("_done").select(keep))
        bins += now.get(True, 0)
        todo = packed.where("not _done").select(todo.columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, per_task: int | None = None, weights: Mapping[str, int] | None = None, source_col: str = "source") -> DataFrame:
    """For each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. weights: the sequences follow the mix of the sources by them."""
    if weights is None:
        return pack(pieces(docs, id_col, text_col, path, capacity), capacity, per_task or ITEMS)
    found = materialise(pieces(docs, id_col, text_col, path, capacity, source_col=source_col), "pieces", batch_rows=TEXT_ROWS)
    placed = place(found.where("piece = 0").select("doc", "doc_id", "source"), weights).select("row.doc", "position")
    items = found.join(placed.hint("merge"), "doc").drop("doc", "source")
    return pack(items, capacity, per_task or WINDOW, True).drop("position")
