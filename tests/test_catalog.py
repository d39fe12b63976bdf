import os

import duckdb
import pytest

from factweave.plans import records  # noqa: F401  adds its queries to the catalog
from factweave.plans.catalog import ORACLE_SQL, QUERIES
from factweave.sources.tables import TABLES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, oracle, name):
    df = QUERIES[name](spark, FOLDER)
    wanted = oracle.sql(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(wanted.columns)
    at = [wanted.columns.index(n) for n in names]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in wanted.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr) == expected


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
