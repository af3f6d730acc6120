"""The mix of the sources reaches the packed sequences."""

import collections

import corpus_pipeline
import pytest

from lodestack.llm import mixing, packing

from .test_llm_operators import frame, words


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, [" ".join(words(i, 20 + i * 7 % 60)) for i in range(600)], sources={i: f"s{i % 2}" for i in range(600)}).repartition(3).cache()


def shares(rows, source, n):
    """The sources' ids in the first n sequences."""
    first = sorted({r.sequence_id for r in rows})[:n]
    out = collections.Counter()
    for r in rows:
        if r.sequence_id <= first[-1]:
            out[source[r.doc_id]] += r.length
    return out


@pytest.mark.parametrize("per_task", [None, 60])
def test_weights_decide_what_the_first_sequences_hold(docs, per_task, monkeypatch):
    source = {r.doc_id: r.source for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)["packing"]
    seen = []
    if per_task:
        monkeypatch.setattr(packing, "WINDOW", per_task)
    for weights in ({"s0": 9, "s1": 1}, {"s0": 1, "s1": 9}):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights)
        rows = stage(docs.sparkSession, docs, "").collect()
        assert sorted(r.doc_id for r in rows) == sorted(source)
        held = shares(rows, source, 4)
        seen.append(held["s0"] / sum(held.values()))
    assert seen[0] > seen[1] + (0.6 if per_task else 0)


def test_sequences_follow_the_mix(docs):
    weights = {"s0": 3, "s1": 1}
    at = {r.doc_id: r.position for r in mixing.mixed_order(docs, weights).collect()}
    rows = packing.packed_documents(docs, weights=weights, capacity=64, per_task=60).collect()
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, at[r.doc_id], r.piece, r.length))
    first = []
    for k in sorted(held):
        parts, end = sorted(held[k]), 0
        for offset, _, _, n in parts:
            assert offset == end
            end += n
        assert end <= 64
        assert [p[1:3] for p in parts] == sorted(p[1:3] for p in parts)
        first.append(parts[0][1:3])
    assert first == sorted(first)
    assert len(held) <= packing.lower_bound([r.length for r in rows], 64) * 1.03 + 1
