"""Spark's rows against DuckDB's."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def database(folder: str):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as from '{folder}/{t}.parquet'")
    return db


def _rows(rows, places):
    def plain(v):
        return None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted((tuple(plain(r[i]) for i in places) for r in rows), key=str)


def same(df, db, sql: str) -> None:
    """Names, types and rows agree, whatever their order."""
    found = db.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    kinds = dict(zip(found.columns, map(str, found.types)))
    for name, kind in df.dtypes:
        assert TYPES.get(kind, kinds[name]) == kinds[name], (name, kind, kinds[name])
    assert _rows([tuple(r) for r in df.collect()], [df.columns.index(n) for n in names]) == _rows(found.fetchall(), [found.columns.index(n) for n in names])
