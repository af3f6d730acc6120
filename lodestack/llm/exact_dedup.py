"""Exact dedup by a tree merge of sorted digest runs.

A run is one row: packed records (digest, smallest id, rows, fingerprint) in
order of their digests, each digest once, at most ``RUN_ROWS`` of them. Every
input partition writes its rows as runs, and each run is a block of its own.
The rounds are those of a binomial tree: in a round, blocks whose numbers
differ in one bit alone are partners, and each partner's run has been cut in
two where the next bit of the digests turns. Both lower halves meet in one task
and both upper halves in another, where sorted runs are merged and of equal
digests the smallest identifier is retained. So a round halves the number of
blocks and of each block's range of digests alike: runs stay as long as they
were at first, and after as many rounds as the blocks' number has bits each
digest is in one run. A merge never has more than two records of a digest, as
each block has merged it before, so a text that a third of all rows share costs
no more than any other. ``fan_in`` is the number of partners, a power of two.

Each record also carries a second fingerprint of the text (its length and a
64-bit hash, independent of the digest); a merge that meets two different
fingerprints under one digest, at any level, fails the job instead of dropping
a document.

Defined cases: a null text is empty; empty texts equal one another; a row
without an id stays only where no row of its group has one; rows that repeat
an id and a text get the same answer; every 64-bit id is an id like any other;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import first_rows, materialise, text_of

#: Partners in a round; records in a run, about; rounds after which the runs are stored.
FAN_IN, RUN_ROWS, _STORE = 2, 1 << 15, 6
#: A digest as four numbers that sort as its bytes do, the smallest id and whether there is one, rows, fingerprint.
_RECORD = np.dtype([("k0", "<u8"), ("k1", "<u8"), ("k2", "<u8"), ("k3", "<u8"), ("id", "<i8"), ("known", "u1"), ("rows", "<i8"), ("chars", "<i8"), ("check", "<i8")])
_KEYS = ("k0", "k1", "k2", "k3")
_RUN = "block long, slot long, run binary"


def normalised(column: str = "text"):
    """The text with every run of white space as one space. Single spaces are left out of the pattern: they are right already."""
    return F.regexp_replace(text_of(column), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_chars, check): what the merge needs of each row; the text is read once."""
    text = normalised(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.length(text).cast("long").alias("n_chars"),
        F.xxhash64(text).alias("check"),
    )


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """Sorted runs as one: a record for each digest, with the smallest id and all rows."""
    r = np.concatenate(runs)
    if len(r) < 2:
        return r
    r = r[np.argsort(r["k0"], kind="stable")]  # finds the sorted runs and merges them
    same = np.logical_and.reduce([r[k][1:] == r[k][:-1] for k in _KEYS])
    if ((r["k0"][1:] == r["k0"][:-1]) & ~same).any():  # different digests with one beginning
        r = r[np.lexsort([r[k] for k in reversed(_KEYS)])]
        same = np.logical_and.reduce([r[k][1:] == r[k][:-1] for k in _KEYS])
    for k in ("chars", "check"):
        if (r[k][1:] != r[k][:-1])[same].any():
            raise ValueError("two different texts have one digest")
    at = np.flatnonzero(np.concatenate([[True], ~same]))
    out = r[at]
    out["id"] = np.minimum.reduceat(np.where(r["known"], r["id"], np.iinfo(np.int64).max), at)
    out["known"] = np.maximum.reduceat(r["known"], at)
    out["rows"] = np.add.reduceat(r["rows"], at)
    return out


def _cut(run: np.ndarray, block: int, slot: int, level: int, bits: int) -> list[tuple[int, int, bytes]]:
    """The parts of a run by the next ``bits`` of its digests, of which the first ``level`` bits are ``slot``; they are for the block that the partners make."""
    edges = [((slot << bits) + k) << (64 - level - bits) for k in range(1, 1 << bits)]
    at = [0, *np.searchsorted(run["k0"], np.array(edges, np.uint64)).tolist(), len(run)]
    return [(block >> bits, (slot << bits) + k, run[a:b].tobytes()) for k, (a, b) in enumerate(zip(at, at[1:])) if a < b]


def _rows(parts: list[tuple]) -> pa.Table:
    block, slot, run = zip(*parts) if parts else ((), (), ())
    return pa.table({"block": pa.array(block, pa.int64()), "slot": pa.array(slot, pa.int64()), "run": pa.array(run, pa.binary())})


def first_runs(rows: DataFrame) -> DataFrame:
    """(part, k, run): the runs of each partition of (doc_id, digest, n_chars, check), numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([k], pa.int64()), pa.array([merged(held).tobytes()], pa.binary())], names=["part", "k", "run"])

        for batch in batches:
            for at in range(0, batch.num_rows, RUN_ROWS):
                some = batch.slice(at, RUN_ROWS)
                r = np.zeros(some.num_rows, _RECORD)
                keys = np.frombuffer(b"".join(some.column(1).to_pylist()), ">u8").reshape(-1, 4)
                for j, name in enumerate(_KEYS):
                    r[name] = keys[:, j]
                r["id"] = some.column(0).fill_null(0).to_numpy()
                r["known"] = some.column(0).is_valid().to_numpy(zero_copy_only=False)
                r["rows"], r["chars"], r["check"] = 1, some.column(2).to_numpy(), some.column(3).to_numpy()
                held.append(r)
                n += len(r)
                if n >= RUN_ROWS:
                    yield packed()
                    held, n, k = [], 0, k + 1
        if held:
            yield packed()

    return rows.select("doc_id", "digest", "n_chars", "check").mapInArrow(run, "part long, k long, run binary")


def tree_merge(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(digest, keep_id, group_size): one row for each digest of the runs (part, k, run), which are stored."""
    bits = fan_in.bit_length() - 1
    if fan_in != 1 << bits or bits < 1:
        raise ValueError("the number of partners is a power of two")
    top = runs.agg(F.max("part"), F.max("k")).first()
    parts, many = (top[0] or 0) + 1, (top[1] or 0) + 1
    rounds = -(-(parts * many - 1).bit_length() // bits)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                run = np.frombuffer(raw.as_py(), _RECORD)
                yield from _rows(_cut(run, block, 0, 0, bits) if rounds else [(block, 0, run.tobytes())]).to_batches()

    def meet(level: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            out = merged([np.frombuffer(x.as_py(), _RECORD) for x in table["run"]])
            block, slot = table["block"][0].as_py(), table["slot"][0].as_py()
            return _rows([(block, slot, out.tobytes())] if last else _cut(out, block, slot, level, bits))

        return run

    now = runs.select((F.col("k") * parts + F.col("part")).alias("block"), "run").mapInArrow(begin, _RUN)
    for r in range(rounds):
        now = now.groupBy("block", "slot").applyInArrow(meet((r + 1) * bits, r == rounds - 1), _RUN)
        if r % _STORE == _STORE - 1:
            now = materialise(now, "runs")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                r = np.frombuffer(raw.as_py(), _RECORD)
                keys = np.stack([r[k] for k in _KEYS], axis=1).astype(">u8").tobytes()
                digest = pa.Array.from_buffers(pa.binary(32), len(r), [None, pa.py_buffer(keys)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([digest, pa.array(np.ascontiguousarray(r["id"]), mask=r["known"] == 0), pa.array(np.ascontiguousarray(r["rows"]))], names=["digest", "keep_id", "group_size"])

    return now.select("run").mapInArrow(rows, "digest binary, keep_id long, group_size long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialise(digests(docs, id_col, text_col), "digests")
    # stored before they are joined back: both sides of the join then are plain exchanges, whose large partitions Spark splits
    groups = materialise(tree_merge(materialise(first_runs(rows), "first-runs"), fan_in), "merged")
    return rows.select("doc_id", "digest").join(groups.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without later copies: of equal texts the smallest id stays.

    Only ids move: the rows that go are anti-joined by id. Where an id is given
    twice its rows are judged by id and text: each of its texts stays or goes
    by itself, and of rows that repeat both one stays (``first_rows``). A row
    without an id goes if a row with an id has its text, or another row without
    one (of those one stays, likewise).
    """
    groups = materialise(exact_groups(docs, id_col, text_col), "exact-groups")
    known = groups.where("doc_id is not null")
    twice = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_gone"))
    twice = materialise(twice, "repeated-ids")
    again = not twice.isEmpty()
    gone = known.where("not kept").select(F.col("doc_id").alias("_gone"))
    named = docs.where(F.col(id_col).isNotNull())
    out = named.join((gone.unionByName(twice) if again else gone).distinct().hint("merge"), F.col(id_col) == F.col("_gone"), "left_anti")
    digest = F.sha2(normalised(text_col), 256)
    if again:
        stay = known.where("kept").join(twice.hint("merge"), F.col("doc_id") == F.col("_gone"), "left_semi").select(F.col("doc_id").alias("_kept"), F.col("text_sha256").alias("_kept_sha"))
        rows = named.join(twice.hint("merge"), F.col(id_col) == F.col("_gone"), "left_semi").withColumn("_sha", digest)
        rows = rows.join(stay.distinct().hint("merge"), (F.col(id_col) == F.col("_kept")) & (F.col("_sha") == F.col("_kept_sha")), "left_semi")
        out = out.unionByName(first_rows(rows, id_col, "_sha").select(docs.columns))
    bare = docs.where(F.col(id_col).isNull())
    if bare.isEmpty():
        return out
    nameless = groups.where("kept and doc_id is null").select(F.col("text_sha256").alias("_sha")).distinct()
    bare = first_rows(bare.withColumn("_sha", digest).join(nameless, "_sha", "left_semi"), "_sha")
    return out.unionByName(bare.select(docs.columns))
