"""Whole results of queries that SQL can't express, and what a score may come from."""

import collections
import logging
import struct
import zlib

from tokenizers import Tokenizer

from lodestack.llm import compression_classifier, packing, queries
from lodestack.llm.shingles import Shingler

from .test_llm_operators import frame, words

FOLDER = "/root/testdata/sf0.001"


def test_packing_query_is_whole(spark, caplog):
    caplog.set_level(logging.INFO)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op6_packing"](spark, FOLDER).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for i, text in texts.items():
        ids, at = tokenizer.encode(text, add_special_tokens=False).ids + [0], 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.length == min(2048, len(ids) - at)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert any("bins" in m for m in caplog.messages)


def test_the_score_is_the_difference_of_two_dictionaries(spark):
    good, bad = ([" ".join(words(k * 1000 + i, 150)).encode() for i in range(60)] for k in (1, 2))
    bad = [t.replace(b"w", b"zz") for t in bad]
    g, b = compression_classifier.dictionary(good), compression_classifier.dictionary(bad)
    forward, backward, same = (compression_classifier.Difference(x, y) for x, y in ((b, g), (g, b), (g, g)))
    for t in [*good[:5], *bad[:5], b"", b"x" * 50_000]:
        assert forward(t) == -backward(t) and same(t) == 0
    fresh = [" ".join(words(9000 + i, 200)).encode() for i in range(20)]
    assert all(forward(t) > 0 > forward(t.replace(b"w", b"zz")) for t in fresh)
    # a long text's difference is the sum of its pieces' differences, down to the last
    long = b" ".join(fresh)
    pieces = [long[at : at + compression_classifier.PIECE] for at in range(0, len(long), compression_classifier.PIECE)]
    assert len(pieces) > 5 and abs(forward(long) * (len(long) + 20) - sum(forward(p) * (len(p) + 20) for p in pieces)) < 1e-6


def test_too_few_texts_to_train_on_are_the_dictionary():
    assert compression_classifier.dictionary([b"abc", b"", b"def"]) == b"abcdef"
    assert isinstance(compression_classifier.Difference(b"abcdefgh" * 4, b"ijklmnop" * 4)(b"abc"), float)


def test_long_words_are_not_remembered():
    shingle = Shingler()
    long = [b"x" * 65 + str(i).encode() for i in range(50)]
    a = shingle(b" ".join([b"short", *long, b"short"]))
    assert set(shingle.known) == {b"short"}
    assert (shingle(b" ".join([b"short", *long, b"short"])) == a).all()
    known = packing.WordIds(packing.tokenizer_path())
    assert known.ids(b"ab " + b"q" * 100) == known.ids(b"ab " + b"q" * 100) and set(known) == {"ab"}


def test_what_lies_late_in_a_text_counts(spark):
    texts = [" ".join(words(i, 150)) for i in range(400)] + [" ".join(words(i, 150)).replace("w", "zz") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(800)], "doc_id long, quality int")
    model = compression_classifier.fit(frame(spark, texts), labels)
    start = " ".join(words(5000, 40))
    late = frame(spark, [start + " " + " ".join(words(5001, 4000)), start + " " + " ".join(words(5001, 4000)).replace("w", "zz")])
    a, b = (r.score for r in compression_classifier.score(late, model).orderBy("doc_id").collect())
    assert a > 0.9 and b < 0.1
