"""Near-duplicate documents by b-bit MinHash.

1. Each text's set of 5-word shingles gives ``BANDS`` x ``ROWS`` minima. A
   band's minima make its bucket key; of every minimum only the ``BITS`` low
   bits stay, packed into four 64-bit words: the signature.
2. Texts with the same set (by a 128-bit digest) are one node. In each bucket
   with two or more nodes the smallest is the leader, and every other node forms
   a candidate pair with it: as many candidates as members, never all pairs.
3. The signatures' equal b-bit values are counted with XOR and bit counts, and
   the share is corrected for values that collide by chance:
   J = (share - 2^-b) / (1 - 2^-b). Candidates estimated below
   ``threshold - MARGIN`` (five standard errors) go; the rest is confirmed on
   the full shingle sets.
4. Confirmed links make components. A bucket whose nodes are in one component
   needs nothing more. In any other bucket of at most ``SMALL`` nodes each node
   outside the largest component meets all nodes of other components there:
   the same estimate is the join's condition, and what passes is confirmed on
   full sets. Larger buckets are cut into blocks of at most ``TILE`` nodes and
   ``TILE_SHINGLES`` shingles, about; a tile is two blocks. First a tile has
   signatures alone and names the nodes that the estimate lets pass with some
   node of another component. Then only these nodes' texts meet in the tile,
   which counts their intersections exactly as a product of incidence matrices
   and returns a spanning forest of the links: fewer rows than it has nodes.
   So every pair that shares a bucket is linked, known to be connected, or
   refused by the same estimate and the same full sets, and no step returns a
   row for each pair of a group.

With 32 bands of 4 rows, a pair at similarity 0.75 shares no bucket with a
probability of 5 in a million.

Texts move once: those of all nodes that share a bucket are taken from the
corpus by one join and stored; every later step reads them from there. Batches
of texts in Python are bounded in rows and bytes.

Defined cases: a null text is empty; a text without words has no set, is
linked with nothing and stays; a row without an id is linked with nothing,
has no component and stays; rows that repeat an id are one document with the
union of their links to ``near_groups``, while ``near_dedup`` judges each of their
texts by itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import TEXT_ROWS, dropped, few_files, first_rows, materialise, text_of
from .shingles import Shingler, mix

BANDS, ROWS, BITS = 32, 4, 2
#: Below the threshold by so much, an estimate rules a pair out: five standard errors of 128 two-bit values.
MARGIN = 0.23
#: Nodes of a bucket up to which pairs are joined; nodes and shingles in a block of a tile; shingles that a tile multiplies at once.
SMALL, TILE, TILE_SHINGLES, _COLUMNS = 64, 512, 1 << 19, 4096
#: Percent of the union that the intersection must have.
THRESHOLD = 75
#: Rows and bytes of texts that are shingled together.
_SLICE_ROWS, _SLICE_BYTES = 512, 1 << 20
#: Rows of an Arrow batch that carries pairs of texts.
_PAIRS = 128
_PERMUTATIONS = BANDS * ROWS
_CHUNK = 1 << 16
_EVEN = 0x5555555555555555
_SIGNED = "doc_id long, th long, n_shingles long, digest binary, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, _PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``_SLICE_ROWS`` rows and, but for single rows, ``_SLICE_BYTES``."""
    sizes = np.diff(np.frombuffer(batch.column(column).cast(pa.large_binary()).buffers()[1], np.int64)[batch.column(column).offset :][: batch.num_rows + 1])
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and (held + n > _SLICE_BYTES or i - at >= _SLICE_ROWS):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, digest, s0..s3, bands): th is a hash of the text, digest one of the shingle set, null for an empty one."""

    def signed(batch: pa.RecordBatch, shingle: Shingler, times: np.ndarray, salt: np.ndarray) -> pa.RecordBatch:
        sets = [shingle(v.as_py() or b"") for v in batch.column(2).cast(pa.binary())]
        sizes = np.array([len(s) for s in sets], np.int64)
        low = np.zeros((len(sets), _PERMUTATIONS), np.uint64)
        full = np.flatnonzero(sizes)
        at = 0
        while at < len(full):  # as many texts at once as fit the CPU's cache
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[full[at:]]), _CHUNK, "right")))
            part = full[at:end]
            h = np.concatenate([sets[i] for i in part])
            starts = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
            for k in range(_PERMUTATIONS):
                low[part, k] = np.minimum.reduceat(h * times[k], starts)
            at = end
        with np.errstate(over="ignore"):
            rows = low.reshape(-1, BANDS, ROWS)
            key = salt[None, :].repeat(len(sets), 0)
            for r in range(ROWS):
                key = mix(key + rows[:, :, r])
        bits = (low & np.uint64((1 << BITS) - 1)).reshape(len(sets), 4, 32)
        packed = np.bitwise_or.reduce(bits << (np.arange(32, dtype=np.uint64) * np.uint64(BITS)), axis=2).view(np.int64)
        digest = pa.array([xxhash.xxh3_128_digest(s.tobytes(), seed=len(s)) if len(s) else None for s in sets], pa.binary())
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (len(sets) + 1), BANDS), pa.int32()), pa.array(key.reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes), digest, *(pa.array(np.ascontiguousarray(packed[:, j])) for j in range(4)), bands],
            names=[x.split()[0] for x in _SIGNED.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, times = Shingler(), _multipliers()
        salt = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            for part in _slices(batch, 2):
                yield signed(part, shingle, times, salt)

    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, _SIGNED)


def _similarity(a: str, b: str):
    """The collision-corrected estimate from the two packed signatures."""
    differ = None
    for j in range(4):
        x = F.col(f"{a}{j}").bitwiseXOR(F.col(f"{b}{j}"))
        one = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_EVEN)))
        differ = one if differ is None else differ + one
    chance = 2.0**-BITS
    return (1 - differ / float(_PERMUTATIONS) - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Of the pairs (a, b) of nodes, those linked by their full shingle sets, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            left, right = (batch.column(k).cast(pa.binary()) for k in (2, 3))
            keep = []
            for x, y in zip(left, right):
                p, q = shingle(x.as_py()), shingle(y.as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= threshold * (len(p) + len(q) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    return materialise(two.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "links", batch_rows=_PAIRS)


_TILE = ("bucket", "first", "last")


def _passing(enough: float):
    """Of the nodes of one tile (with signatures), those that the estimate lets pass with a node of another component."""

    def run(table: pa.Table) -> pa.Table:
        comp, block = (table[k].to_numpy() for k in ("comp", "block"))
        words = np.stack([table[f"x{j}"].to_numpy().view(np.uint64) for j in range(4)], axis=1)
        first, last = table["first"][0].as_py(), table["last"][0].as_py()
        # as many differing values as the estimate allows
        most = int(np.floor((1 - enough * (1 - 2.0**-BITS) - 2.0**-BITS) * _PERMUTATIONS + 1e-9))
        passed = np.zeros(len(comp), bool)
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == last)
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            x = words[some][:, None, :] ^ words[right][None, :, :]
            differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_EVEN)).sum(axis=2)
            hit = (differ <= most) & (comp[some][:, None] != comp[right][None, :])
            passed[some] |= hit.any(axis=1)
            passed[right] |= hit.any(axis=0)
        return table.select([*_TILE, "node", "comp", "block"]).filter(pa.array(passed))

    return run


def _forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many links of a symmetric matrix as connect the same nodes: fewer than it has nodes."""
    ends: list[list[np.ndarray]] = [[], []]
    todo = link.any(axis=1)
    while todo.any():
        front = np.array([np.argmax(todo)])
        todo[front] = False
        while len(front):
            reach = link[front] & todo
            new = np.flatnonzero(reach.any(axis=0))
            ends[0].append(front[reach[:, new].argmax(axis=0)] if len(new) else new)
            ends[1].append(new)
            todo[new] = False
            front = new
    return tuple(np.concatenate(e) if e else np.zeros(0, np.int64) for e in ends)


def _tile_links(threshold: int):
    """For the nodes of one tile (with texts), a spanning forest of the links between different components."""

    def run(table: pa.Table) -> pa.Table:
        shingle = Shingler()
        node, comp, block = (table[k].to_numpy() for k in ("node", "comp", "block"))
        sets = [shingle(v.as_py()) for chunk in table["text"].chunks for v in chunk.cast(pa.binary())]
        sizes = np.array([len(s) for s in sets], np.int64)
        first, last = table["first"][0].as_py(), table["last"][0].as_py()
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == last)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        del sets
        shared = count > 1  # what one node alone has is in no intersection
        owner, column = owner[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(left), len(right)), np.float32)
        for low in range(0, int(shared.sum()), _COLUMNS):
            a, b = np.searchsorted(column, (low, low + _COLUMNS))
            has = np.zeros((len(sizes), _COLUMNS), np.float32)
            has[owner[a:b], column[a:b] - low] = 1
            both += has[left] @ has[right].T  # counts below 2^24 are exact
        union = sizes[left][:, None] + sizes[right][None, :] - both
        found = (100 * both >= threshold * union) & (comp[left][:, None] != comp[right][None, :])
        link = np.zeros((len(sizes), len(sizes)), bool)
        link[np.ix_(left, right)] = found
        i, j = _forest(link | link.T)
        return pa.table({"a": pa.array(node[i], pa.int64()), "b": pa.array(node[j], pa.int64())})

    return run


def _tiles(large: DataFrame, texts: DataFrame, enough: float, threshold: int) -> DataFrame:
    """Links between the components of large buckets: (bucket, node, comp, n_shingles, x0..x3) to (a, b), stored."""
    size = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s"))
    size = materialise(size.select("bucket", F.greatest(F.ceil(F.col("_n") / TILE), F.ceil(F.col("_s") / TILE_SHINGLES)).cast("int").alias("_blocks")), "blocks")
    tiles = (
        large.join(size.hint("merge"), "bucket")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
        .select("bucket", F.least("block", "_other").alias("first"), F.greatest("block", "_other").alias("last"), "node", "comp", "block", *(f"x{j}" for j in range(4)))
        .repartition(*_TILE)  # else the join's partitions, by bucket, would do for the groups, and a bucket's tiles lie in one task
    )
    passed = tiles.groupBy(*_TILE).applyInArrow(_passing(enough), "bucket long, first int, last int, node long, comp long, block int")
    passed = materialise(passed, "passed")
    whole = passed.join(texts.hint("merge"), "node")
    return materialise(whole.groupBy(*_TILE).applyInArrow(_tile_links(threshold), "a long, b long").distinct(), "links", batch_rows=_PAIRS)


def _answers(docs: DataFrame, id_col: str, text_col: str, threshold: int, by_id: bool) -> DataFrame:
    """For each row: doc_id, th, n_shingles, digest, comp and _low (the component's smallest id). by_id: an id joins the components of all its texts."""
    sig = materialise(signatures(docs, id_col, text_col), "signatures", batch_rows=TEXT_ROWS)
    members = sig.where("digest is not null and doc_id is not null")
    # one row for each different set: the first of equal values is any of them
    nodes = members.groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("_m"), *(F.first(c).alias(c) for c in ("n_shingles", "s0", "s1", "s2", "s3", "bands")))
    nodes = materialise(
        nodes.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("_m.doc_id").alias("low_id"), F.col("_m.th").alias("low_th"), "n_shingles", "s0", "s1", "s2", "s3", "bands"), "nodes"
    )
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("_top")).where("leader <> _top").drop("_top")
    # aggregates are stored before they are joined back: both sides of the join then are plain exchanges, whose large partitions Spark splits
    shared = materialise(shared, "shared")
    held = materialise(rows.join(shared.hint("merge"), "bucket"), "buckets")
    dropped(shared)

    # the texts of all nodes that any step may ask for
    wanted = held.select("node").distinct().join(nodes.select("node", "low_id", "low_th").hint("merge"), "node")
    text = text_of(text_col)
    corpus = docs.select(F.col(id_col).cast("long").alias("low_id"), F.xxhash64(text).alias("low_th"), text.alias("text")).where("low_id is not null")
    texts = materialise(wanted.join(corpus.hint("merge"), ["low_id", "low_th"]).select("node", "text"), "texts")
    n_rows, n_nodes = texts.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
    if n_rows > n_nodes:  # rows that repeat an id and a text: one of them
        repeated, texts = texts, materialise(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
        dropped(repeated)

    in_buckets = BANDS * n_nodes  # rows of a node and a bucket, at most

    def signed(df: DataFrame, key: str, as_: str) -> DataFrame:
        return df.join(nodes.select(F.col("node").alias(key), *(F.col(f"s{j}").alias(f"{as_}{j}") for j in range(4))).hint("merge"), key)

    enough = threshold / 100 - MARGIN
    stars = held.where("node <> leader").groupBy(F.col("node").alias("b"), F.col("leader").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    stars = signed(signed(stars, "b", "y"), "a", "x").withColumn("estimate", _similarity("x", "y")).where(F.col("estimate") >= enough)
    stars = materialise(few_files(stars.select("a", "b", "estimate"), in_buckets), "stars")

    # the best candidate of each node first: what they join needs no other confirmation
    best = stars.groupBy("b").agg(F.max(F.struct("estimate", "a")).alias("_best")).select(F.col("_best.a").alias("a"), "b")
    best = materialise(few_files(best, n_nodes), "best")
    links = _confirmed(best, texts, threshold)
    comp = components(links, "a", "b")
    dropped(links)

    def placed(df: DataFrame, key: str, as_: str) -> DataFrame:
        at = comp.select(F.col("node").alias(key), F.col("component").alias("_c"))
        return df.join(at.hint("merge"), key, "left").withColumn(as_, F.coalesce("_c", key)).drop("_c")

    def joined(*more: DataFrame) -> None:
        """The components with these links besides; they go on from what is known."""
        nonlocal comp
        edges = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
        for found in more:
            edges = edges.unionByName(found)
        before, comp = comp, components(edges, "a", "b")
        dropped(before, *more)

    rest = placed(placed(stars.select("a", "b").join(best.hint("merge"), ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    rest = materialise(few_files(rest, in_buckets), "rest")
    if not rest.isEmpty():
        joined(_confirmed(rest, texts, threshold))
    dropped(rest, best)

    # buckets that still hold more than one component
    spread = placed(held.select("bucket", "node"), "node", "comp")
    mixed = spread.groupBy("bucket").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low <> _high").select("bucket")
    mixed = materialise(few_files(mixed, in_buckets), "mixed")
    spread = materialise(few_files(spread.join(mixed.hint("merge"), "bucket"), in_buckets), "spread")
    sizes = spread.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("_m"), F.sum("n").alias("_nodes"))
    sizes = materialise(few_files(sizes.select("bucket", F.col("_m.comp").alias("_major"), "_nodes"), in_buckets), "sizes")
    signs = nodes.select("node", "n_shingles", *(F.col(f"s{j}").alias(f"x{j}") for j in range(4)))
    sized = materialise(few_files(spread.join(sizes.hint("merge"), "bucket").join(signs.hint("merge"), "node"), in_buckets), "sized")
    dropped(held, mixed, spread, sizes)

    small = sized.where(F.col("_nodes") <= SMALL).drop("n_shingles")
    ask = small.where("comp <> _major").select("bucket", F.col("node").alias("b"), F.col("comp").alias("cb"), *(F.col(f"x{j}").alias(f"y{j}") for j in range(4)))
    meet = (F.col("comp") != F.col("cb")) & (_similarity("x", "y") >= enough)
    cross = ask.join(small.withColumnRenamed("bucket", "_bucket").hint("merge"), (F.col("bucket") == F.col("_bucket")) & meet)
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = cross.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti")
    cross = materialise(cross, "cross")
    more = [] if cross.isEmpty() else [_confirmed(cross, texts, threshold)]
    large = sized.where(F.col("_nodes") > SMALL).drop("_nodes", "_major")
    if not large.isEmpty():
        more.append(_tiles(large, texts, enough, threshold))
    if any(not found.isEmpty() for found in more):
        joined(*more)
    dropped(sized, cross, stars, texts)

    # an id that is given twice joins the components of its texts
    twice = members.groupBy("doc_id").agg(F.min("digest").alias("_a"), F.max("digest").alias("_b")).where("_a <> _b").select("doc_id")
    if by_id and not (twice := materialise(twice, "repeated-ids")).isEmpty():
        same = members.join(twice.hint("merge"), "doc_id").select("doc_id", "digest").distinct().join(nodes.select("digest", "node").hint("merge"), "digest")
        first = materialise(same.groupBy("doc_id").agg(F.min("node").alias("a")), "first-nodes")
        joined(materialise(same.join(first.hint("merge"), "doc_id").select("a", F.col("node").alias("b")).where("a <> b"), "bonds"))
    low = placed(nodes.select("node", "digest", "low_id"), "node", "comp")
    least = materialise(low.groupBy("comp").agg(F.min("low_id").alias("_low")), "least")
    answer = materialise(low.join(least.hint("merge"), "comp").select("digest", "comp", "_low"), "answers")
    dropped(nodes, comp, least)
    return sig.select("doc_id", "th", "n_shingles", "digest").join(answer.hint("merge"), "digest", "left")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id = component_id)."""
    return (
        _answers(docs, id_col, text_col, threshold, True)
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("_low", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group: the smallest id. Texts without words stay.

    Where an id is given twice each of its rows is judged by its own text: a
    group that has the id twice keeps one of the rows, and of rows without
    words that repeat an id and a text one stays (``first_rows``).
    """
    rows = materialise(_answers(docs, id_col, text_col, threshold, False).where("doc_id is not null").select("doc_id", "th", "digest", "comp", "_low"), "near")
    twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_gone"))
    twice = materialise(twice, "repeated-ids")
    again = not twice.isEmpty()
    gone = rows.where("_low <> doc_id").select(F.col("doc_id").alias("_gone"))
    gone = (gone.unionByName(twice) if again else gone).distinct()
    out = docs.join(gone.hint("merge"), F.col(id_col) == F.col("_gone"), "left_anti")
    if not again:
        return out
    # the few rows that share an id find their own answers by id and text
    held = docs.join(twice.hint("merge"), F.col(id_col) == F.col("_gone"), "left_semi").withColumn("_th", F.xxhash64(text_of(text_col)))
    answers = rows.join(twice.hint("merge"), F.col("doc_id") == F.col("_gone"), "left_semi").distinct()
    answers = answers.select(F.col("doc_id").alias("_id"), F.col("th").alias("_t"), F.col("digest").alias("_set"), F.col("comp").alias("_comp"), "_low")
    found = held.join(answers.hint("merge"), (F.col(id_col) == F.col("_id")) & (F.col("_th") == F.col("_t")))
    found = found.where(F.col("_low").isNull() | (F.col("_low") == F.col("_id")))
    found = found.withColumn("_bare", F.when(F.col("_set").isNull(), text_of(text_col))).drop("_id", "_t", "_th", "_low", "_set")
    return out.unionByName(first_rows(found, id_col, "_comp", "_bare").select(docs.columns))
