"""Every registered query of the archive engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from warcspark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    rows = sorted(map(repr, map(tuple, got.collect())))
    assert rows
    if name in ORACLE_SQL:
        assert rows == sorted(map(repr, db.sql(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall()))
    else:
        assert name == "q47_digest_sha512"
