"""Every registered query of the library itself against its SQL."""

import duckdb
import pytest

from skein.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def shown(value):
    return repr(float(value)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(shown, r)) for r in df.select(columns).collect())
    if name not in ORACLES:
        assert rows
        return
    told = duck.sql(ORACLES[name])
    assert sorted(told.columns) == columns
    place = [told.columns.index(c) for c in columns]
    assert rows == sorted(tuple(shown(r[k]) for k in place) for r in told.fetchall())
