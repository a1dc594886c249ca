"""Every registered query of the library runs, and equals DuckDB where it has SQL."""

import numbers
import os

import duckdb
import pytest

from harrow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.load()


def plain(v):
    import pandas as pd

    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return bool(v)
    if isinstance(v, numbers.Number):
        v = float(v)
        return None if v != v else int(v) if v == int(v) else f"{v:.9g}"
    if hasattr(v, "__iter__") and not isinstance(v, (str, bytes)):
        return tuple(map(plain, v))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    found = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
    else:
        assert len(found) > 0
