"""Registered text queries against their SQL, run by DuckDB on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tickloom.llm import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    theirs = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    ours = registry.QUERIES[name](spark, DATA)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in ours.select(columns).collect()))) == sorted(map(str, theirs.fetchall()))
