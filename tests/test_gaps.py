"""Gap filling equals the minute spine with pandas' interpolation, and lays out no minute that it doesn't return."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import cleaning

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def minutes(spark):
    rng = random.Random(2)
    rows = []
    for token in ("a", "b", "c", "wide"):
        at = 0
        for _ in range(60):
            at += rng.choice([1, 1, 2, 5, 11, 12, 300]) if token != "wide" else 3_000
            rows.append((token, START + datetime.timedelta(minutes=at), at, None if rng.random() < 0.1 else rng.uniform(1, 9)))
    return spark.createDataFrame(rows, "token_id string, datetime timestamp, seq long, price double")


def by_spine(part, limit, whole_column):
    known = part.dropna(subset=["price"]).sort_values("datetime").set_index("datetime")["price"]
    if known.empty:
        return {}
    line = known.reindex(pd.date_range(known.index[0], known.index[-1], freq="min"))
    value = line.interpolate()
    run = line.isna().astype(int).groupby(line.notna().cumsum()).transform("sum")
    fill = line.isna() & ((run <= limit) if not whole_column else (run[line.isna()].min() <= limit if line.isna().any() else False))
    return {t: (round(v, 9), bool(f)) for t, v, f in zip(line.index, value, fill, strict=True) if f or not pd.isna(line[t])}


@pytest.mark.parametrize("limit,whole_column", [(1, False), (10, False), (10, True), (0, False)])
def test_fill_gaps(minutes, limit, whole_column):
    s = minutes if not whole_column else minutes.where("token_id <> 'wide'")
    got = cleaning.fill_gaps(s, limit, whole_column)
    found = got.toPandas()
    for token, part in s.toPandas().groupby("token_id"):
        own = found[found.token_id == token]
        assert {t: (round(p, 9), f) for t, p, f in zip(own.datetime, own.price, own.is_filled, strict=True)} == by_spine(part, limit, whole_column)
    if not whole_column:
        assert len(found) <= s.count() * (limit + 1)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_spine_gaps(minutes):
    s = minutes.where("token_id <> 'wide'")
    laid_out = cleaning.minute_spine(s).groupBy("token_id").agg(F.count("*").alias("minutes"), F.count_if(F.col("price").isNull()).alias("missing"))
    assert sorted(map(tuple, cleaning.spine_gaps(s).collect())) == sorted(map(tuple, laid_out.collect()))


def test_stored_tables_are_released(spark):
    from tickloom import session

    session.release()
    kept = session.stored(spark.range(10).selectExpr("id", "id % 3 AS part"), "release-test", by="part")
    (_, path), = session._made
    assert kept.columns == ["id", "part"] and kept.where("part = 1").count() == 3
    session.release()
    assert not session._made and not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
