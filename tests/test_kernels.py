"""Kernels without SQL against plain loops, pandas and known series."""

import datetime

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import cross, grouped, indicators

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(8)
    out = {f"w{k}": 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 150 + 30 * k))) for k in range(4)}
    mean_back = np.zeros(300)
    for k in range(1, 300):
        mean_back[k] = -0.6 * mean_back[k - 1] + rng.normal(0, 0.01)
    return out | {"ar": 100 * np.cumprod(1 + mean_back), "line": np.linspace(1, 50, 200)}


@pytest.fixture(scope="module")
def series(spark, walks):
    rows = [(t, START + datetime.timedelta(minutes=k), k, float(p)) for t, x in walks.items() for k, p in enumerate(x)]
    return spark.createDataFrame(rows, "token_id string, datetime timestamp, seq long, price double").repartition(3)


def returns(p):
    return p[1:] / p[:-1] - 1


def test_trix(series, walks):
    got = indicators.trix(series).toPandas()
    span = 15
    for t, p in walks.items():
        e = pd.Series(p)
        for _ in range(3):
            e = e.ewm(span=span, adjust=False).mean()
        assert np.allclose(got[got.token_id == t].sort_values("seq").trix, 100 * e.pct_change(), equal_nan=True)


def test_pacf_is_the_last_coefficient_of_each_regression(series, walks):
    got = grouped.pacf(series, lags=6).toPandas()
    for t, p in walks.items():
        d = returns(p) - returns(p).mean()
        if (d * d).sum() < 1e-12:
            continue
        rho = np.array([(d[k:] * d[: len(d) - k]).sum() for k in range(7)]) / (d * d).sum()
        for k in range(1, 7):
            toeplitz = rho[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
            want = np.linalg.solve(toeplitz, rho[1 : k + 1])[-1]
            assert got[(got.token_id == t) & (got.lag == k)].pacf.iloc[0] == pytest.approx(want)
    own = got[(got.token_id == "ar") & (got.lag == 1)].pacf.iloc[0]
    assert -0.75 < own < -0.45


def test_hurst_tells_walks_from_series_that_turn_back(series):
    got = {r.token_id: r.hurst for r in grouped.hurst(series).collect()}
    assert got["ar"] < min(got[f"w{k}"] for k in range(4)) and all(0.3 < got[f"w{k}"] < 0.8 for k in range(4))


def test_higuchi_of_a_line_is_one_and_of_a_walk_more(series):
    got = {r.token_id: r.fractal_dimension for r in grouped.higuchi(series).collect()}
    assert got["line"] == pytest.approx(1.0, abs=0.02) and all(1.3 < got[f"w{k}"] < 1.7 for k in range(4)) and got["ar"] > max(got[f"w{k}"] for k in range(4))


def test_fft_finds_a_planted_period(spark):
    k = np.arange(400)
    p = 100 * np.cumprod(1 + 0.01 * np.sin(2 * np.pi * k / 20) + 0.003 * np.sin(2 * np.pi * k / 8))
    s = spark.createDataFrame([("t", START + datetime.timedelta(minutes=int(i)), int(i), float(x)) for i, x in zip(k, p, strict=True)], "token_id string, datetime timestamp, seq long, price double")
    rows = sorted(grouped.fft_cycles(s).collect(), key=lambda r: r.rank)
    assert rows[0].period == pytest.approx(20, rel=0.06) and rows[0].power >= rows[1].power and rows[0].is_peak and 0 < rows[0].entropy < 0.6
    power = np.abs(np.fft.rfft(returns(p) - returns(p).mean())) ** 2
    assert rows[0].power == pytest.approx(power[1:].max())


def test_divergence_of_planted_peaks(spark):
    """Peaks that rise by ever smaller steps: the price makes new highs, its RSI doesn't."""
    steps = [3 - 0.01 * k if k % 2 == 0 else -1.5 for k in range(59)]
    rising = [100 + sum(steps[:k]) for k in range(60)]
    steady = [100.0 + k for k in range(60)]
    rows = [(t, START + datetime.timedelta(minutes=k), k, float(p)) for t, x in (("apart", rising), ("none", steady)) for k, p in enumerate(x)]
    got = {r.token_id: r.divergence for r in grouped.rsi_divergence(spark.createDataFrame(rows, "token_id string, datetime timestamp, seq long, price double")).collect()}
    assert got == {"apart": "bearish", "none": "none"}


def test_principal_components(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 4)) + 0.1 * rng.normal(size=(200, 4))
    df = spark.createDataFrame([(f"t{k}", *map(float, row)) for k, row in enumerate(x)] + [("hole", None, 1.0, 1.0, 1.0)], "token_id string, a double, b double, c double, d double")
    got = cross.pca_summary(df, ["a", "b", "c", "d"], 3).toPandas()
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    for c in (1, 2, 3):
        own = got[got.component == c]
        v = vectors[:, -c] * np.sign(vectors[np.abs(vectors[:, -c]).argmax(), -c])
        assert np.allclose(own.loading, v, atol=1e-6) and own.explained.iloc[0] == pytest.approx(values[-c] / 4)


def test_kernels_get_prices_alone_and_ranges_of_bounded_size(spark, monkeypatch):
    p = np.random.default_rng(8).integers(1, 30, 700).astype(float)
    rows = [("a", START + datetime.timedelta(minutes=7 * (k // 2)), k, float(p[k])) for k in np.random.default_rng(9).permutation(700).tolist()]
    s = spark.createDataFrame(rows, "token_id string, datetime timestamp, seq long, price double")
    assert [tuple(r) for r in grouped._per_token(s, "n int, same boolean", lambda x: [(len(x), bool((x == p).all()))]).collect()] == [("a", 700, True)]
    whole = {r.row: r.entropy for r in grouped.rolling_entropy(s, 60).collect()}
    monkeypatch.setattr(grouped, "RANGE", 128)
    cut = grouped.rolling_entropy(s, 60)
    assert whole.keys() == set(range(60, 700)) and {r.row: r.entropy for r in cut.collect()} == whole
    plan = cut._jdf.queryExecution().toString()
    assert "_part" in plan and "FlatMapGroupsInArrow" in plan
