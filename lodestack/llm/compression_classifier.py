"""A quality classifier by compression.

Two zstandard dictionaries are built, from texts labelled good and bad. A whole
text is compressed with each, piece by piece (``PIECE`` bytes, so that a long
text profits from a dictionary as a short one does). The one feature is the
normalised difference of the two sizes: what the dictionary of good texts saves
beyond that of bad ones, of each byte of the text. A logistic curve, fitted on
labelled texts that neither dictionary has seen, turns it into a score between
0 and 1.

What is fitted is bounded: of each label at most ``SAMPLE`` rows, the smallest
by a digest of their id, of which a share of ``DICTIONARY_SHARE`` feeds the
dictionaries: whole texts in the order of the digest, until there are
``DICTIONARY_BYTES`` of a label (the text that reaches them is the last one, and
whole too). A dictionary of at most ``TRAINED_BYTES`` is trained on them; where
they are too few for that, they are the dictionary. Everything that is fitted
on or scored is taken whole. Rows with crc32(id as text) mod 5 = 0 are held out
and never fitted on.

Defined cases: a null text is empty and is scored as such; rows without an id
are scored and never fitted on, held_out is false; labels that are null or
whose document is missing are ignored; without both labels every score is the
share of label 1 among those given, 0.5 if none; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, text_of

#: Labelled rows of each class that are fitted on, at most.
SAMPLE = 6000
DICTIONARY_SHARE = 0.6
#: Bytes of whole texts behind a dictionary, about, and of the dictionary, at most.
DICTIONARY_BYTES, TRAINED_BYTES = 8 << 20, 1 << 19
#: Bytes that are compressed at once, and zstandard's level.
PIECE, LEVEL = 2048, 3
#: From this score on a text is predicted good.
GOOD = 0.3


class Difference:
    """The feature of a text: the normalised difference of its compressed sizes."""

    def __init__(self, bad: bytes, good: bytes) -> None:
        self.bad, self.good = (self._compressor(x) for x in (bad, good))

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        # a trained dictionary says so in its first bytes; anything else is content
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)

    def __call__(self, raw: bytes) -> float:
        bad = good = 0
        for at in range(0, max(1, len(raw)), PIECE):
            piece = raw[at : at + PIECE]
            bad += len(self.bad.compress(piece))
            good += len(self.good.compress(piece))
        return (bad - good) / (len(raw) + 20)


def dictionary(texts: list[bytes]) -> bytes:
    """Trained on whole texts; the texts themselves if they are too few to train on."""
    try:
        return zstandard.train_dictionary(TRAINED_BYTES, [t for t in texts if t]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)


def _differences(docs: DataFrame, model: dict, score: bool) -> DataFrame:
    """docs (first column kept, text second) with the feature, or with its score."""
    first = docs.schema.fields[0]
    held = docs.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k not in ("bad", "good")})
    name = "score" if score else "difference"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        difference = Difference(*m["dictionaries"])
        for batch in batches:
            x = np.array([difference(v.as_py() or b"") for v in batch.column(1).cast(pa.binary())], np.float64)
            if score:
                z = m["weights"][0] + (x - m["mean"]) / m["spread"] * m["weights"][1]
                x = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x)], names=[first.name, name])

    return docs.mapInArrow(run, f"`{first.name}` {first.dataType.simpleString()}, {name} double")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method, with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-2 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _filled(texts: Iterable[bytes]) -> list[bytes]:
    """Whole texts up to the one with which ``DICTIONARY_BYTES`` are reached."""
    out, size = [], 0
    for text in texts:
        if size >= DICTIONARY_BYTES:
            break
        out.append(bytes(text))
        size += len(out[-1])
    return out


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """The model: two dictionaries, the texts behind them, and the curve's parameters; workers get all but the texts, about a megabyte."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"))
    known = known.where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id")).withColumn("_at", F.md5(F.col("_id").cast("string")))
    total = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if len(total) < 2:
        return {"constant": float(next(iter(total), 0.5))}
    picked = known.where("_y = 0").orderBy("_at", "_id").limit(SAMPLE).unionByName(known.where("_y = 1").orderBy("_at", "_id").limit(SAMPLE))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    found = texts.join(F.broadcast(picked), "_id")  # at most 2 * SAMPLE rows of an id, a label and a digest
    # the digest's last two bytes deal rows to the dictionaries and the curve
    found = found.withColumn("_first", F.conv(F.substring("_at", -4, 4), 16, 10).cast("int") < int(DICTIONARY_SHARE * 65536))
    found = materialise(found, "labelled")
    # the sizes tell how far the dictionaries reach; only those texts come to the driver
    sizes = found.where("_first").select("_at", "_y", F.octet_length("_text").alias("_n")).toPandas().sort_values(["_at", "_n"])
    reach = F.lit(False)
    for y in (0, 1):
        own = sizes[sizes["_y"] == y]
        used = own[own["_n"].cumsum() - own["_n"] < DICTIONARY_BYTES]
        if len(used):
            reach = reach | ((F.col("_y") == y) & (F.col("_at") <= used["_at"].iloc[-1]))
    feed = found.where(F.col("_first") & reach).select("_at", "_id", "_y", F.col("_text").cast("binary").alias("_text")).toPandas().sort_values(["_at", "_id", "_text"])
    content = [_filled(feed.loc[feed["_y"] == y, "_text"]) for y in (0, 1)]
    if min(sum(map(len, c)) for c in content) < 8:
        return {"constant": total[1] / (total[0] + total[1])}
    model = {"bad": b"".join(content[0]), "good": b"".join(content[1]), "dictionaries": [dictionary(c) for c in content]}
    rest = found.where("not _first").select(F.struct("_at", "_id", "_y").alias("_key"), "_text")
    seen = _differences(rest, model, False).select("_key.*", "difference").toPandas().sort_values(["_at", "_id", "difference"])
    y = seen["_y"].to_numpy(float)
    if len(set(y)) < 2:
        return {"constant": total[1] / (total[0] + total[1])}
    x = seen["difference"].to_numpy()
    model["mean"], model["spread"] = x.mean(), x.std() + 1e-9
    share = {k: total[k] / (y == k).sum() for k in (0, 1)}  # the sample is taken by label: weights restore the labels' shares
    weight = np.where(y == 1, share[1], share[0])
    model["weights"] = _logistic(((x - model["mean"]) / model["spread"])[:, None], y, weight / weight.mean())
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    out = rows.select("doc_id", F.lit(model["constant"]).cast("double").alias("score")) if "constant" in model else _differences(rows, model, True)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled rows that are not held out, scores every row."""
    return score(docs, fit(docs, labels))
