"""Registered queries against their SQL, run by DuckDB on the same tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from pyspark.sql import functions as F  # noqa: E402

from tickloom.plans import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def canonical(rows):
    def text(x):
        if x is None or x != x:
            return "-"
        return f"{x + 0.0:.9g}" if isinstance(x, float) else str(x)  # the last digits depend on the order of sums

    return sorted(tuple(map(text, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_name_is_registered_once_and_oracles_have_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.QUERIES) > 190


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, DATA)
    theirs = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert canonical(tuple(r) for r in ours.select(columns).collect()) == canonical(theirs.fetchall())


def test_six_digits_are_rounded_as_in_the_sql(spark):
    # the double next to 4.1390625 lies below it: its text ends in a tie, the number does not
    xs = [4.1390625, -4.1390625, 0.5000005, 2.0000005, 0.0078125, -0.0078125, 1e-9, -1e-9, 1e300, 1e305, float("inf"), float("-inf"), None]
    ours = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").withColumn("x", registry.rounded(F.col("x"))).orderBy("k").collect()
    assert [r.x for r in ours] == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6) + 0.0", [x]).fetchone()[0] for x in xs]
