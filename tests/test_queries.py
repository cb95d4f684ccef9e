"""Every query with SQL gives the rows that DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from agreeline.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    cols = sorted(df.columns)
    cell = lambda v: "NULL" if v is None or v != v else repr(round(float(v), 5)) if isinstance(v, float) else str(v)
    return cols, sorted(tuple(map(cell, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, db, name):
    assert plain(registry.QUERIES[name](spark, DATA).toPandas()) == plain(db.sql(registry.ORACLES[name]).df())
