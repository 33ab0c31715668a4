"""Correlation by blocks against numpy and against the join of pairs, with missing times, and the choice of alignment."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import blocks, cross

START = datetime.datetime(2024, 1, 1)
SHAPE = "token_id string, datetime timestamp, seq long, price double"


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(4, 90))
    rows = [(f"t{k:02}", int(t) * 7, float(base[k % 4, t] + 0.3 * rng.normal()) if k != 11 else 5.0) for k in range(40) for t in range(90) if rng.random() < (0.8 if k != 7 else 0.2)]
    rows += [("t01", 9999, None), ("t02", 9998, float("nan"))]
    return spark.createDataFrame(rows, "token_id string, at long, r double")


def by_numpy(values, least):
    series = {}
    for r in values.collect():
        if r.r is not None and r.r == r.r:
            series.setdefault(r.token_id, {})[r.at] = r.r
    out = {}
    for a in series:
        for b in series:
            both = sorted(series[a].keys() & series[b].keys())
            if a < b and len(both) >= least:
                x, y = np.array([series[a][t] for t in both]), np.array([series[b][t] for t in both])
                if x.std() > 1e-12 and y.std() > 1e-12:
                    out[a, b] = (len(both), float(np.corrcoef(x, y)[0, 1]))
    return out


@pytest.mark.parametrize("block,chunk,significant", [(256, 100_000, 0.0), (7, 100, 0.0), (1, 50, 0.6)])
def test_pairs_of_many_tokens(values, block, chunk, significant):
    got = {(r.token_a, r.token_b): (r.n, r.correlation) for r in blocks.pair_correlations(values, "at", "r", 20, significant, block=block, chunk=chunk).collect()}
    want = {k: v for k, v in by_numpy(values, 20).items() if abs(v[1]) >= significant}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_pairs_by_districts(values, monkeypatch):
    """More blocks than districts, and more districts than by default: the same pairs, and a value is sent once for each district."""
    want = by_numpy(values, 20)
    for districts, held in ((3, 1 << 30), (1, 2_000)):
        monkeypatch.setattr(blocks, "DISTRICTS", districts)
        got = {(r.token_a, r.token_b): (r.n, r.correlation) for r in blocks.pair_correlations(values, "at", "r", 20, block=4, chunk=200, held=held).collect()}
        assert got.keys() == want.keys() and all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)


def prices(spark, tokens, step, n, jitter=0):
    rng = random.Random(4)
    rows, price = [], dict.fromkeys(range(tokens), 5.0)
    for k in range(n):
        move = rng.gauss(0, 0.02)
        for t in range(tokens):
            price[t] *= np.exp(move + rng.gauss(0, 0.005))
            rows.append((f"t{t}", START + datetime.timedelta(seconds=k * step + t * jitter), k, float(price[t])))
    return spark.createDataFrame(rows, SHAPE)


def test_corr_blocks_equals_the_join_of_pairs(spark):
    s = prices(spark, 6, 1800, 200)
    rows = lambda df: sorted((r.token_a, r.token_b, r.n, round(r.correlation, 9), r.strength) for r in df.collect())
    assert rows(blocks.corr_blocks(s, block=2)) == rows(cross.corr_pairs(s)) and len(rows(blocks.corr_blocks(s))) == 15


def test_choice_of_alignment(spark):
    shared, apart, few = prices(spark, 3, 60, 80), prices(spark, 3, 60, 40, jitter=7), prices(spark, 2, 60, 8)
    assert [blocks.synchronised(s)[1] for s in (shared, apart, few)] == ["inner", "outer", "minute"]
    got = blocks.correlate(shared).collect()
    assert len(got) == 3 and all(r.correlation > 0.9 and r.alignment == "inner" and r.n == 79 for r in got)
    assert {r.alignment for r in blocks.correlate(apart, significant=0.0).collect()} == {"outer"}
    assert blocks.correlate(few).collect() == []  # too few shared minutes


def test_no_rows(spark):
    assert blocks.corr_blocks(spark.createDataFrame([], SHAPE)).collect() == [] and blocks.correlate(spark.createDataFrame([], SHAPE)).collect() == []


def test_two_prices_of_zero_in_a_row_count_as_a_return(spark):
    s = prices(spark, 3, 3600, 60).withColumn("price", F.when((F.col("token_id") == "t1") & F.col("seq").isin(20, 21, 22), 0.0).otherwise(F.col("price")))
    got = {(r.token_a, r.token_b): r for r in blocks.corr_blocks(s, least=10).collect()}
    assert {k: r.n for k, r in got.items()} == {("t0", "t1"): 59, ("t0", "t2"): 59, ("t1", "t2"): 59}
    assert got["t0", "t1"].correlation != got["t0", "t1"].correlation and got["t0", "t1"].strength == "very_strong" and got["t0", "t2"].correlation > 0.9
