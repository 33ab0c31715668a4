"""Windows range by range equal the plain windows over whole series."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import ranges as G
from tickloom.functions import rolling as R
from tickloom.operators import indicators

SHAPE = "token_id string, datetime timestamp, seq long, price double, gaps double"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(5)
    rows = []
    for token, n in (("long", 400), ("short", 5), ("one", 1), ("holes", 200)):
        at = 0
        for k in range(n):
            at += rng.choice([0, 0, 60, 60, 600, 40_000 if k % 97 == 0 else 60])  # bursts, ties and pauses
            price = rng.choice([-1.0, 1.0, 1.0]) * rng.uniform(0.5, 2.0) if k % 41 else 0.0 if k % 82 else 1.0
            rows.append((token, START + datetime.timedelta(seconds=at), k, price, None if token == "holes" and k < 120 or rng.random() < 0.4 else price))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SHAPE).cache()


def by_row(df, *names):
    return {(r.token_id, r.seq): tuple(r[n] for n in names) for r in df.select("token_id", "seq", *names).collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k], strict=True):
            assert (x is None or x != x) == (y is None or y != y) and (x is None or x != x or x == pytest.approx(y, rel=1e-9, abs=1e-9)), (k, a[k], b[k])


@pytest.mark.parametrize("rows", [9, 10_000])
def test_rolling_frames(series, rows):
    look = lambda s: s.withColumns({"m": R.mean("price", 20), "s": R.std("gaps", 9, 3), "hi": R.high("price", 33), "lo": R.low("price", 2), "q": R.quantile("price", 0.25, 30), "ahead": R.lead("price", 15), "back": R.lag("gaps", 31), "r": R.pct_change("price", 5)})
    names = ("m", "s", "hi", "lo", "q", "ahead", "back", "r")
    same(by_row(G.over_ranges(series, look, 32, 15, rows=rows, cell=600), *names), by_row(look(series), *names))


def test_ranges_are_small_and_own_each_row_once(series):
    parts = G.in_ranges(series, 10, 4, rows=40, cell=600)
    sizes = {(r.token, r.part): (r.n, r.own) for r in parts.withColumn("own", G.cell_of("datetime", 600).between(F.col("token_id")["first"], F.col("token_id")["last"])).groupBy(F.col("token_id")["token"].alias("token"), F.col("token_id")["part"].alias("part")).agg(F.count("*").alias("n"), F.count_if("own").alias("own")).collect()}
    assert sum(own for _, own in sizes.values()) == series.count() and max(n for n, _ in sizes.values()) < 150 and sum(k[0] == "long" for k in sizes) > 5
    assert parts.select("token_id").rdd.getNumPartitions() >= 1 and G.in_ranges(series, rows=40, tasks=13).rdd.getNumPartitions() == 13


@pytest.mark.parametrize("rows", [13, 10_000])
def test_running_aggregates(series, rows):
    got = G.with_running(series, {"total": ("sum", "gaps"), "n": ("count", "gaps"), "top": ("max", "gaps"), "least": ("min", "gaps"), "fill": ("last", "gaps"), "begin": ("first", "gaps"), "times": ("product", "gaps")}, rows=rows, cell=600)
    over = R.so_far()
    plain = series.withColumns({"total": F.sum("gaps").over(over), "n": F.count("gaps").over(over), "top": F.max("gaps").over(over), "least": F.min("gaps").over(over), "fill": R.forward_fill("gaps"), "begin": F.first("gaps", ignorenulls=True).over(over)})
    names = ("total", "n", "top", "least", "fill", "begin")
    same(by_row(got, *names), by_row(plain, *names))
    want = {}
    for token, part in series.toPandas().groupby("token_id"):
        part = part.sort_values(["datetime", "seq"])
        product = part.gaps.fillna(1.0).cumprod().where(part.gaps.notna().cumsum() > 0)
        want |= {(token, s): (None if np.isnan(v) else v,) for s, v in zip(part.seq, product, strict=True)}
    same(by_row(got, "times"), want)


@pytest.mark.parametrize("rows", [13])
def test_exponential_means(series, rows):
    wanted = {"a": ("gaps", {"span": 12}), "b": ("gaps", {"alpha": 0.1, "adjust": False}), "c": ("price", {"span": 5, "adjust": False}), "d": ("a", {"span": 4}), "e": ("b", {"alpha": 0.3, "adjust": False})}
    got = by_row(G.with_ewm_ranges(series, wanted, rows=rows, cell=600), *wanted)
    want = {}
    for token, part in series.toPandas().groupby("token_id"):
        part = part.sort_values(["datetime", "seq"])
        for name, (source, how) in wanted.items():
            part[name] = part[source].ewm(**how).mean()
        want |= {(token, r.seq): tuple(getattr(r, n) for n in wanted) for r in part.itertuples()}
    same(got, want)


def test_a_million_rows_in_two_hundred_ranges(spark):
    """A token of a million rows; each range goes to a task of its own or shares it with few."""
    n = 1_000_000
    s = spark.range(0, n, 1, 8).select(F.lit("t").alias("token_id"), F.timestamp_seconds(F.col("id") * 60).alias("datetime"), F.col("id").alias("seq"), F.sin(F.col("id") * 0.37).alias("price"))
    x = np.sin(np.arange(n) * 0.37)
    parts = G.in_ranges(s, 239, rows=5000, tasks=200)
    assert parts.select(F.col("token_id")["part"]).distinct().count() == 200 and parts.rdd.getNumPartitions() == 200
    got = G.over_ranges(s, lambda r: indicators.vwap_bands(r.withColumn("v", F.lit(1.0)), volume="v").select("token_id", "datetime", "seq", "vwap_240"), 239, rows=5000)
    got = G.with_ewm_ranges(G.with_running(got, {"top": ("max", "vwap_240")}, rows=5000), {"ema": ("vwap_240", {"span": 26})}, rows=5000)
    found = got.select("seq", "vwap_240", "top", "ema").toPandas().sort_values("seq")
    mean = pd.Series(x).rolling(240).mean()
    assert np.allclose(found.vwap_240, mean, equal_nan=True) and np.allclose(found.top, mean.cummax(), equal_nan=True) and np.allclose(found.ema, mean.ewm(span=26).mean(), equal_nan=True)


def test_no_rows(spark):
    none = spark.createDataFrame([], SHAPE)
    assert G.over_ranges(none, lambda s: s.withColumn("m", R.mean("price", 3)), 2).collect() == []
    assert G.with_running(none, {"t": ("sum", "price")}).collect() == [] and G.with_ewm_ranges(none, {"e": ("price", {"span": 3})}).collect() == []
