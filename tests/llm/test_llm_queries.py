"""The queries of the text operators against their SQL, and what has no SQL against labels and brute force."""

import numpy as np
import pytest

from lodestack.llm import pii, queries

from ..compare import database, same
from .test_llm_operators import brute_pii, brute_repeats

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, db, name):
    same(queries.QUERIES[name](spark, FOLDER), db, queries.SQL[name])


def test_pii_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.QUERIES["op2_pii"](spark, FOLDER).collect():
        want = brute_pii(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in spans if k in pii.BASE] == want


def test_classifier_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in queries.QUERIES["op3_compression_classifier"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    truth, said = np.array([labels[r.doc_id] for r in held]), np.array([r.predicted for r in held])
    assert (truth == said).mean() > 0.97 and said[truth == 1].mean() > 0.98 and (1 - said[truth == 0]).mean() > 0.85


def test_repeats_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op8_repeats"](spark, FOLDER).collect()), key=str) == brute_repeats(rows, 200, False)


def test_packing_query_is_within_one_of_its_bound(spark):
    from lodestack.llm.packing import lower_bound

    rows = queries.QUERIES["op6_packing"](spark, FOLDER).collect()
    assert len({r.sequence_id for r in rows}) <= lower_bound(np.array([r.length for r in rows])) + 1
