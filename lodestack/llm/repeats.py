"""Repeated passages by longest previous factors, over all documents at once.

A suffix array of the whole corpus fits no machine, so only places that can
repeat are sorted, next to each other:

1. Every ``LENGTH``-byte window has an anchor, the smallest hash of the
   ``GRAM``-byte strings in it: equal windows have equal anchors. Consecutive
   windows with one anchor form a run; a run is a row (document, first window,
   windows, anchor, digest of its bytes), about one for 70 bytes of text.
2. An anchor that occurs once can't repeat, and its run is dropped. Where all
   runs of an anchor have the same bytes, every window of theirs repeats.
3. For all other anchors, one copy of each different run goes to the task of its
   anchor. Tasks sort the windows' suffixes by prefix doubling over ranks (8,
   16, ... bytes up to ``LENGTH``), which gives the suffix order and, from the
   same ranks, the common prefixes of neighbours. In that order the previous
   and the next smaller position of each suffix are found, with the common
   prefixes on the way; the longer of the two is the longest previous factor
   (``previous_factors``). Where it reaches ``LENGTH`` the window has an
   earlier copy, and the place it was found at has a later one. Windows of
   anchors with very many different runs (more than ``HOT_RUNS``, or
   ``HOT_BYTES`` together) are dealt by their own 128-bit digest instead and
   counted, first position included: as many tasks as wanted share one anchor,
   and nothing is left out.
4. The windows that repeat, as bits of a run, go back to every document that
   has the run, and cover the bytes that go.

With ``keep_first`` the windows of the first copy (by id, then position) stay;
without it every copy goes. Matches never cross documents; overlaps count.

Defined cases: a null text is empty; a text shorter than ``LENGTH`` loses
nothing; a row without an id comes before all others; rows that repeat an id
and text count as copies of each other (with ``keep_first`` both stay or go
alike); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import dropped, materialise, text_of
from .shingles import mix

#: Bytes that a repeated string has at least; bytes of an anchor's string.
LENGTH, GRAM = 200, 64
HOT_RUNS, HOT_BYTES = 4096, 2 << 20
#: Bytes hashed at once, for the CPU's cache; bytes whose suffixes are sorted at once, about.
_SLICE, _SORT = 1 << 18, 1 << 20
#: Bytes of runs that a sorting task gets, about.
_TASK = 2 << 20
#: Windows of a run whose bits are put together at once.
_STRETCH = 1 << 16
_RUN = "id long, th long, start int, n int, anchor long, content long, many boolean"


def _gram_hashes(buf: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings, k a power of two: h of 2s bytes is h of s bytes times a constant plus h of the next s bytes."""
    h, size, base = values[buf], 1, 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        while size < k:
            h = h[:-size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
            size *= 2
    return mix(h)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    m = x
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (w - size)], m[w - size :]) if size < w else m


def runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, th, start, n, anchor, content, many) for each run of windows of docs (id, th, text); many: its anchor's string is there more than once."""
    wide = length - gram + 1

    def of_group(ids: list, ths: list, raws: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(raws)
        buf = np.frombuffer(whole, np.uint8)
        sizes = np.array([len(r) for r in raws], np.int64)
        begins = np.cumsum(sizes) - sizes
        values = mix(np.arange(1, 257, dtype=np.uint64))
        h = _gram_hashes(buf, values, gram)
        low = _sliding_min(h, wide)
        # the first window of a document, and one past its last
        fresh = np.zeros(len(low) + 1, np.int8)
        fresh[begins], fresh[begins + sizes - length + 1] = 1, fresh[begins + sizes - length + 1] - 1
        inside = np.cumsum(fresh[:-1]).astype(bool)
        edge = np.ones(len(low), bool)
        edge[1:] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
        edge[begins] = True
        at = np.flatnonzero(edge)
        end = np.append(at[1:], len(low))
        at, end = at[inside[at]], end[inside[at]]
        anchor = low[at]
        owner = np.searchsorted(begins, at, "right") - 1
        many = _many(h, low, wide, at, end - at + wide - 1)
        view = memoryview(whole)
        content = np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + length - 1]) for a, b in zip(at.tolist(), end.tolist())), np.uint64, len(at))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(ids, np.int64)[owner]), pa.array(np.array(ths, np.int64)[owner]), pa.array((at - begins[owner]).astype(np.int32)),
                pa.array((end - at).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(many),
            ],
            names=[x.split()[0] for x in _RUN.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ths, raws, size = [], [], [], 0
        for batch in batches:
            for i, t, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                raw = v.as_py() or b""
                if len(raw) < length:
                    continue
                ids.append(i), ths.append(t), raws.append(raw)
                size += len(raw)
                if size >= _SLICE:
                    yield of_group(ids, ths, raws)
                    ids, ths, raws, size = [], [], [], 0
        if raws:
            yield of_group(ids, ths, raws)

    return docs.mapInArrow(run, _RUN)


def _many(h: np.ndarray, low: np.ndarray, wide: int, at: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Whether h[at : at + span] may have its minimum twice: true wherever it does.

    A place is some window's minimum where the largest minimum of the windows
    that cover it is its own hash. Two equal ones in a run have no other such
    place between them, as every window of the run covers one of the two.
    """
    edge = np.zeros(wide - 1, np.uint64)
    most = ~_sliding_min(~np.concatenate([edge, low, edge]), wide)
    place = np.flatnonzero(most == h)
    equal = np.concatenate([[0], np.cumsum(h[place][1:] == h[place][:-1])])
    first, last = np.searchsorted(place, at), np.searchsorted(place, at + span) - 1
    return (last > first) & (equal[np.minimum(last, len(place) - 1)] > equal[np.minimum(first, len(place) - 1)])


def _doubled(buf: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(size, ranks of the size-byte strings at every place) for 8, 16, ... bytes, as far as ``length``; zeros follow the end."""
    n = len(buf)
    wide = np.concatenate([buf, np.zeros(length + 8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n + length, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | wide[j : j + n + length]
    out, size = [(8, np.unique(key, return_inverse=True)[1].astype(np.uint32))], 8
    while 2 * size <= length:
        rank = out[-1][1]
        pair = (rank[:-size].astype(np.uint64) << np.uint64(32)) | rank[size:].astype(np.uint64)
        size *= 2
        out.append((size, np.unique(pair, return_inverse=True)[1].astype(np.uint32)))
    return out


def _final(levels: list[tuple[int, np.ndarray]], starts: np.ndarray, length: int) -> np.ndarray:
    size, rank = levels[-1]
    key = rank[starts].astype(np.uint64)
    if size < length:
        key = (key << np.uint64(32)) | rank[starts + (length - size)].astype(np.uint64)
    return np.unique(key, return_inverse=True)[1]


def suffix_ranks(buf: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Dense ranks of the ``length``-byte prefixes of the suffixes at ``starts``, in their order, by prefix doubling."""
    return _final(_doubled(buf, length), starts, length)


def common_prefixes(levels: list[tuple[int, np.ndarray]], buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """How many bytes the suffixes at a and b have in common, ``length`` at most: the ranks' sizes from long to short, then single bytes."""
    out = np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        open_ = np.flatnonzero(out + size <= length)
        at = out[open_]
        out[open_[rank[a[open_] + at] == rank[b[open_] + at]]] += size
    open_ = np.flatnonzero(out < length)
    for _ in range(levels[0][0] - 1):
        open_ = open_[out[open_] < length]
        open_ = open_[buf[a[open_] + out[open_]] == buf[b[open_] + out[open_]]]
        out[open_] += 1
    return out


def _smaller(position: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, common prefix) for each suffix: the nearest before it, in suffix order, with a smaller position (-1: none), and the least common prefix up to there.

    lcp[i] is the common prefix of the suffixes i - 1 and i. All suffixes step
    back at once, each from the one it has reached to the one that this has
    reached: what lies between is larger.
    """
    n = len(position)
    to, least = np.arange(n) - 1, lcp.copy()
    open_ = np.flatnonzero((to >= 0) & (position[to] > position))
    rounds = 0
    while len(open_) and rounds < 64:
        next_ = to[open_]
        least[open_], to[open_] = np.minimum(least[open_], least[next_]), to[next_]
        open_ = open_[(to[open_] >= 0) & (position[to[open_]] > position[open_])]
        rounds += 1
    for i in open_.tolist():  # long chains, in suffix order: what lies before is settled
        j, low = int(to[i]), int(least[i])
        while j >= 0 and position[j] > position[i]:
            j, low = int(to[j]), min(low, int(least[j]))
        to[i], least[i] = j, low
    least[to < 0] = 0
    return to, least


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factor, where) for each position, of the positions in suffix order and the common prefixes with the one before.

    Both smaller neighbours, the previous and the next in suffix order, are
    asked; where is the position of the one with the longer common prefix, -1
    for a factor of no length.
    """
    n = len(order)
    back, a = _smaller(order, lcp)
    flipped = np.concatenate([[0], lcp[1:][::-1]]) if n else lcp
    on, b = _smaller(order[::-1], flipped)
    on, b = np.where(on >= 0, n - 1 - on, -1)[::-1], b[::-1]
    best, at = np.where(b > a, b, a), np.where(b > a, on, back)
    length, where = np.zeros(n, np.int64), np.full(n, -1)
    length[order] = best
    where[order] = np.where(best > 0, order[at], -1)
    return length, where


def repeated(buf: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(repeats, later) for the suffixes at ``starts``; position: their places among all, smaller is earlier, each once."""
    if not len(starts):
        return np.zeros(0, bool), np.zeros(0, bool)
    levels = _doubled(buf, length)
    rank = _final(levels, starts, length)
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = common_prefixes(levels, buf, starts[order[:-1]], starts[order[1:]], length)
    place = np.argsort(position)  # the suffixes by position; previous_factors speaks of positions
    factor, where = previous_factors(position[order], lcp)
    later = (factor >= length)[position]
    repeats = later.copy()
    repeats[place[where[position[later]]]] = True  # the copy it was found at
    return repeats, later


_BITS = "anchor long, content long, repeats binary, later binary"


def _bits(anchor: list, content: list, n: list[int], repeats: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
    """The flags of consecutive windows as bits of their runs; runs without any go."""
    rows = [[], [], [], []]
    at = 0
    for a, c, k in zip(anchor, content, n):
        r, l = repeats[at : at + k], later[at : at + k]
        at += k
        if r.any():
            for col, x in zip(rows, (a, c, np.packbits(r).tobytes(), np.packbits(l).tobytes())):
                col.append(x)
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["anchor", "content", "repeats", "later"])


def _sorted_suffixes(length: int):
    """Rows (anchor, content, n, id, start, data) in order of anchor to _BITS."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        anchor, content, n, ids, starts, data = zip(*rows)
        sizes = np.array([len(d) for d in data], np.int64)
        begins, n_ = np.cumsum(sizes) - sizes, np.array(n, np.int64)
        within = np.arange(n_.sum()) - np.repeat(np.cumsum(n_) - n_, n_)
        # the windows' places: by id, then where they begin
        position = np.empty(len(within), np.int64)
        position[np.lexsort((np.repeat(np.array(starts, np.int64), n_) + within, np.repeat(np.array(ids, np.int64), n_)))] = np.arange(len(within))
        repeats, later = repeated(np.frombuffer(b"".join(data), np.uint8), np.repeat(begins, n_) + within, position, length)
        return _bits(anchor, content, n, repeats, later)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= _SORT and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                if not rows or row[:2] != rows[-1][:2]:  # a document that is given twice has given it twice
                    rows.append(row)
                    size += len(row[5])
        if rows:
            yield solve(rows)

    return run


def _window_rows(length: int):
    """Rows (anchor, content, n, id, start, data) to one row for each window: (h1, h2, anchor, content, n, k, id, place)."""
    names = ["h1", "h2", "anchor", "content", "n", "k", "id", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, c, n, i, s, d in zip(*(c.to_pylist() for c in batch.columns)):
                view = memoryview(d)
                for low in range(0, n, 1 << 16):
                    ks = np.arange(low, min(n, low + (1 << 16)))
                    raw = b"".join(xxhash.xxh3_128_digest(view[k : k + length]) for k in ks.tolist())
                    h = np.frombuffer(raw, np.int64).reshape(-1, 2)
                    m = len(ks)
                    cols = [h[:, 0].copy(), h[:, 1].copy(), np.full(m, a), np.full(m, c), np.full(m, n, np.int32), ks.astype(np.int32), np.full(m, i), s + ks]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    return run


def _bits_of_windows(width: int):
    """The windows (k, repeats, later) of one stretch of a run, ``width`` windows of it, to its bits."""

    def run(pdf):
        first = int(pdf["stretch"].iloc[0]) * width
        flags = [np.zeros(min(width, int(pdf["n"].iloc[0]) - first), bool) for _ in range(2)]
        for f, c in zip(flags, ("repeats", "later")):
            f[pdf["k"].to_numpy() - first] = pdf[c].to_numpy(bool)
        return pdf[["anchor", "content", "n", "stretch"]].iloc[:1].assign(**{c: [np.packbits(f).tobytes()] for f, c in zip(flags, ("repeats", "later"))})

    return run


def _bits_of_stretches(width: int):
    """The bits of a run's stretches, as far as there are any, to those of the run."""

    def run(pdf):
        out = pdf[["anchor", "content"]].iloc[:1]
        for c in ("repeats", "later"):
            bits = bytearray(-(-int(pdf["n"].iloc[0]) // 8))
            for at, part in zip(pdf["stretch"].to_numpy() * (width // 8), pdf[c]):
                bits[at : at + len(part)] = part
            out = out.assign(**{c: [bytes(bits)]})
        return out

    return run


def _apply(length: int, keep_first: bool, with_text: bool):
    """Documents with their runs' flags to what is left of them."""
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(4 + with_text)]
            for v, marks in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                raw = v.as_py() or b""
                cover = np.zeros(len(raw) + 1, np.int32)
                for mark in marks.as_py() or ():
                    start, n = mark["start"], mark["n"]
                    bits = mark["later"] if keep_first and not mark["all_later"] else mark["repeats"]
                    if bits is None:
                        cover[start] += 1
                        cover[start + n - 1 + length] -= 1
                    elif bits:
                        hit = start + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n))
                        cover[hit] += 1
                        cover[hit + length] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                edges = np.diff(np.concatenate([[0], gone.view(np.int8)]))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
                row = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept)
                for c, x in zip(cols, row):
                    c.append(x)
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=[x.split()[0] for x in fields.split(", ")])

    return run, fields


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_first: bool = True, with_text: bool = False) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans (removed runs), kept_sha256[, kept_text: the bytes left, which may split a character]."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumns({
        "id": F.coalesce("doc_id", F.lit(-(1 << 63))), "th": F.xxhash64("text", F.length("text")),
    })
    # where no copy stays it does not matter which is the first
    place = "struct<id: bigint, start: int>"
    first_of = F.min(F.struct("id", "start")) if keep_first else F.first(F.lit(None).cast(place))
    found = materialise(runs(texts.select("id", "th", "text"), length, gram), "all-runs")
    anchors = found.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("_n"), F.min("content").alias("_a"), F.max("content").alias("_b"), F.max("many").alias("_many"), first_of.alias("_first")
    ).where("_n > 1 or _many").select("anchor", F.expr("_a <> _b or _many").alias("mixed"), "_first")
    # aggregates are stored before they are joined back: both sides of the join then are plain exchanges, whose large partitions Spark splits
    anchors = materialise(anchors, "anchors")
    held = materialise(found.join(anchors.hint("merge"), "anchor"), "runs")
    dropped(found, anchors)
    none = F.lit(None).cast("binary")
    alike = held.where("not mixed").withColumn("_is_first", F.expr("coalesce(id = _first.id and start = _first.start, false)")).select("id", "th", F.struct("start", "n", none.alias("repeats"), F.when(F.col("_is_first"), F.lit(b"")).alias("later"), (~F.col("_is_first")).alias("all_later")).alias("mark"))

    mixed = held.where("mixed")
    each = mixed.groupBy("anchor", "content").agg(F.min(F.struct("id", "start", "th", "n")).alias("_r"), F.count(F.lit(1)).alias("copies"))
    each = materialise(each.select("anchor", "content", F.col("_r.id").alias("id"), F.col("_r.th").alias("th"), F.col("_r.start").alias("start"), F.col("_r.n").alias("n"), "copies"), "different")
    heavy = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("_runs"), F.sum(F.col("n") + length).alias("_bytes")).where((F.col("_runs") > HOT_RUNS) | (F.col("_bytes") > HOT_BYTES)).select("anchor", F.lit(True).alias("hot"))
    heavy = materialise(heavy, "heavy")
    wanted = each.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "content", "start", "n")).alias("want"))
    data = _cut(texts.select("id", "th", "text"), wanted, length)
    data = materialise(data.join(heavy.hint("merge"), "anchor", "left"), "contents")
    cols = ("anchor", "content", "n", "id", "start", "data")
    # sorting costs far more than its bytes suggest: a task for every so many bytes, whatever the session's partitions are
    size = each.agg(F.sum(F.col("n") + length)).first()[0] or 0
    cold = data.where("hot is null").select(*cols).repartition(max(1, -(-size // _TASK)), "anchor").sortWithinPartitions("anchor", "content").mapInArrow(_sorted_suffixes(length), _BITS)
    bits = materialise(cold, "bits")
    hot = data.where("hot")
    if not hot.isEmpty():
        windows = materialise(hot.select(*cols).dropDuplicates(["anchor", "content"]).mapInArrow(_window_rows(length), "h1 long, h2 long, anchor long, content long, n int, k int, id long, place long"), "windows")
        twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("id", "place")).alias("_f")).where("_c > 1")
        twice = materialise(twice, "repeated-windows")
        flags = windows.join(twice.hint("merge"), ["h1", "h2"]).select("anchor", "content", "n", "k", F.lit(True).alias("repeats"), F.expr("not (id = _f.id and place = _f.place)").alias("later"))
        # a run may have as many windows as its text: first the bits of its stretches, then its own
        flags = flags.withColumn("stretch", F.expr(f"k div {_STRETCH}").cast("int"))
        flags = flags.groupBy("anchor", "content", "stretch").applyInPandas(_bits_of_windows(_STRETCH), "anchor long, content long, n int, stretch int, repeats binary, later binary")
        bits = bits.unionByName(materialise(flags.groupBy("anchor", "content").applyInPandas(_bits_of_stretches(_STRETCH), _BITS), "hot-bits"))

    # a run that several documents have repeats as a whole, whatever its single windows do
    first = each.select("anchor", "content", F.col("id").alias("_id"), F.col("start").alias("_start"), "copies")
    told = materialise(first.join(bits.hint("merge"), ["anchor", "content"], "left").where("copies > 1 or repeats is not null"), "told")
    back = mixed.select("anchor", "content", "id", "th", "start", "n").join(told.hint("merge"), ["anchor", "content"]).withColumn("_is_first", F.expr("id = _id and start = _start"))
    marks = back.select("id", "th", F.struct(
        "start", "n",
        F.when(F.col("copies") > 1, none).otherwise(F.col("repeats")).alias("repeats"),
        F.when(F.col("_is_first"), F.coalesce("later", F.lit(b""))).alias("later"),
        (~F.col("_is_first")).alias("all_later"),
    ).alias("mark"))
    marks = alike.unionByName(marks).groupBy("id", "th").agg(F.collect_set("mark").alias("marks"))
    run, fields = _apply(length, keep_first, with_text)
    return texts.join(marks.hint("merge"), ["id", "th"], "left").select("doc_id", "text", "marks").mapInArrow(run, fields)


def _cut(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, content, n, id, start, data) for the runs wanted of each document."""
    names = ["anchor", "content", "n", "id", "start", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for i, v, want in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2)):
                raw = v.as_py()
                for w in want.as_py():
                    for c, x in zip(cols, (w["anchor"], w["content"], w["n"], i, w["start"], raw[w["start"] : w["start"] + w["n"] + length - 1])):
                        c.append(x)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return texts.join(wanted.hint("merge"), ["id", "th"]).select("id", "text", "want").mapInArrow(run, "anchor long, content long, n int, id long, start int, data binary")
