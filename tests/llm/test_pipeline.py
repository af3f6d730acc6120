"""The pipeline against the operators' brute-force versions, stage by stage and as a whole."""

import collections
import re
import zlib

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestack.llm import packing, queries

from .test_llm_operators import brute_near, brute_quality


def brute(rows):
    """The ids that each filtering stage leaves."""
    def kept(text):
        n, chars, symbols, _, repeated = brute_quality(text)
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        shouted = sum(w.endswith("!!") for w in (text or "").split())
        return not (n < 50 or 100 * repeated > 50 * n or 10 * symbols > 3 * n or 10 * shouted > 3 * n or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or chars < 2 * n or chars > 15 * n)

    rows = [(i, t) for i, t in rows if kept(t)]
    quality = [i for i, _ in rows]
    seen = {}
    for i, t in sorted(rows):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    exact = [i for i, _ in seen.values()]
    near = [i for i, _, c, k in brute_near(list(seen.values())) if k]
    return quality, exact, near


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = tmp_path / "sf"
    copies = docs.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 1000).withColumn("text", F.concat(F.col("text"), F.lit(" and a few words more")))
    docs.unionByName(copies).unionByName(docs.where("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 5000)).write.parquet(str(folder / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(str(folder / "documents.parquet")).select("doc_id", "text").collect()]
    quality, exact, near = brute(rows)
    now = spark.read.parquet(str(folder / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, (quality, exact, near, near))):
        out = stage(spark, now, str(folder))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        assert sorted(r.doc_id for r in now.select("doc_id").collect()) == sorted(want), name
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(folder)).collect()
    whole = corpus_pipeline.run(spark, str(folder)).collect()
    tokenizer, texts = Tokenizer.from_file(packing.tokenizer_path()), dict(rows)
    for result in (packed, whole):
        assert {r.doc_id for r in result} == set(near)
        fill = collections.Counter()
        for r in result:
            fill[r.sequence_id] += r.length
            ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
            part = ids[r.start : r.start + r.length]
            assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == r.ids_crc32 and len(part) == r.length
        assert max(fill.values()) <= 2048


def test_queries_are_named_by_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)
