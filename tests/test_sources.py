"""The schema gate over good, odd and broken files, and databases read and loaded in parallel."""

import datetime
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tickloom.sources import database, gate

NOW = datetime.datetime(2024, 1, 1)


@pytest.fixture
def files(tmp_path):
    (tmp_path / "cat_a").mkdir()
    good = {"datetime": pa.array([NOW, NOW], pa.timestamp("us")), "price": [1.0, 2.0]}
    pq.write_table(pa.table(good), tmp_path / "cat_a" / "one.parquet")
    pq.write_table(pa.table(dict(reversed(good.items()))), tmp_path / "turned.parquet")
    pq.write_table(pa.table({k: v[:0] if isinstance(v, list) else v.slice(0, 0) for k, v in good.items()} | {"price": pa.array([], pa.float64())}), tmp_path / "empty.parquet")
    pq.write_table(pa.table(good | {"volume": [1, 2]}), tmp_path / "extra.parquet")
    pq.write_table(pa.table({"datetime": good["datetime"], "cost": [1.0, 2.0]}), tmp_path / "missing.parquet")
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 this is no footer PAR1")
    (tmp_path / "cut.parquet").write_bytes((tmp_path / "turned.parquet").read_bytes()[:-9])
    (tmp_path / "other.csv").write_text("datetime,price\n")
    return tmp_path


@pytest.mark.parametrize("whole_files", [False, True])
def test_the_gate_tells_files_by_their_footers(spark, files, whole_files):
    got = {r.path.rsplit("/", 1)[1]: r for r in gate.judged(gate.footers(spark, str(files), whole_files=whole_files)).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"one.parquet": "accepted", "turned.parquet": "accepted", "empty.parquet": "accepted", "extra.parquet": "extra", "missing.parquet": "missing", "broken.parquet": "broken", "cut.parquet": "broken"}
    assert got["one.parquet"].rows == 2 and got["turned.parquet"]["columns"] == ["price", "datetime"] and got["extra.parquet"].types[2] == "int64" and got["broken.parquet"].error
    rows = gate.gated_scan(spark, str(files), whole_files=whole_files).collect()
    assert sorted((r.token_id, r.price) for r in rows) == [("one", 1.0), ("one", 2.0), ("turned", 1.0), ("turned", 2.0)] and {r.category for r in rows if r.token_id == "one"} == {"cat_a"}


def test_nothing_is_accepted(spark, tmp_path):
    (tmp_path / "none.parquet").write_bytes(b"x")
    assert gate.gated_scan(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("low,high,parts", [(0, 99, 7), (-5, 5, 20), (3, 3, 4), (None, None, 4), (0, 1, 2), (10, 12, 1)])
def test_each_value_meets_one_condition(low, high, parts):
    import duckdb

    conditions = database.range_predicates(low, high, "x", parts)
    assert len(conditions) == len(set(conditions)) <= max(1, parts)
    values = [*range((low or 0) - 30, (high or 0) + 30), None]
    for v in values:
        met = [duckdb.sql(f"SELECT coalesce(({c}), false) FROM (SELECT CAST({'NULL' if v is None else v} AS BIGINT) AS x)").fetchall()[0][0] for c in conditions]
        assert sum(met) == 1, (v, conditions)


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_round_trip_through_a_database(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", DERBY
    rng = random.Random(1)
    rows = [(f"t{k % 7}", None if k % 50 == 0 else (5 if k % 3 else rng.randint(-40, 900)), float(k)) for k in range(600)]
    df = spark.createDataFrame(rows, "token_id string, at long, price double").repartition(5)
    how = {"driver": driver, "types": "token_id VARCHAR(64)"}
    database.load_table(df, url, "prices", "day-1", **how)
    database.load_table(df.limit(20), url, "prices", "day-2", **how)
    database.load_table(df, url, "prices", "day-1", **how)  # again: replaces itself
    got = database.read_table(spark, url, "prices", '"at"', parts=6, driver=driver)
    assert got.rdd.getNumPartitions() == 6 and got.count() == 620
    first = got.where("load_batch = 'day-1'").select("token_id", "at", "price").collect()
    assert sorted(map(str, first)) == sorted(map(str, df.collect()))
    parts = got.where("load_batch = 'day-1'").groupBy(F.spark_partition_id().alias("p"), "at").count().groupBy("at").count().collect()
    assert all(r["count"] == 1 for r in parts)  # no value in two partitions
    assert database.read_table(spark, url, "(SELECT * FROM prices WHERE \"price\" < 10) few", '"at"', parts=3, driver=driver).where("load_batch = 'day-1'").count() == 10
    assert database.read_table(spark, url, "prices", driver=driver).count() == 620
    left = database.read_table(spark, url, "(SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T') t", driver=driver).collect()
    assert len(left) == 1  # no staging table stays
