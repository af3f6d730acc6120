"""Every query of the library against its SQL."""

import pytest

from lodestack import catalog

from .compare import database, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL) and catalog.FLAGSHIP in catalog.QUERIES


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    same(catalog.QUERIES[name](spark, FOLDER), db, catalog.SQL[name])
