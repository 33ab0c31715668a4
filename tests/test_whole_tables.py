"""Registered queries read whole tables: small fixtures on which a subset gives other rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import cross
from tickloom.plans import registry
from tickloom.sources import series

START = dt.datetime(2024, 1, 1)
MEMBERS = {1: "view click", 2: "view", 3: "click", 4: "view error", 5: "error purchase", 6: "signup"}


@pytest.fixture(scope="module")
def cheap(spark, tmp_path_factory):
    """Events of six users, none above 300: every set differs from every other."""
    pairs = [(u, c) for u, names in MEMBERS.items() for c in names.split()]
    rows = [(i, u, START + dt.timedelta(minutes=i), c, 10.0 + i) for i, (u, c) in enumerate(pairs * 2)]
    folder = str(tmp_path_factory.mktemp("cheap"))
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("unique_to_category", {("2", "view"), ("3", "click"), ("6", "signup")}),
        ("category_against_rest", {("view", 3, 2, 1), ("click", 2, 1, 1), ("error", 2, 2, 0), ("purchase", 1, 1, 0), ("signup", 1, 0, 1)}),
        ("overlap_with_category", {("click", 1), ("error", 1)}),
        ("set_difference", {("2",), ("4",)}),
        ("set_intersection", {("1",)}),
        ("category_distribution", {("view", 3, 33.333333), ("click", 2, 22.222222), ("error", 2, 22.222222), ("purchase", 1, 11.111111), ("signup", 1, 11.111111)}),
        ("shared_values", {("view", 3), ("click", 2), ("error", 2)}),
    ],
)
def test_set_queries_read_every_event(spark, cheap, name, expected):
    assert {tuple(r) for r in registry.QUERIES[name](spark, cheap).collect()} == expected


def long_walks(spark, n=300, tokens=("click", "view")):
    rng = np.random.default_rng(6)
    drawn = {t: rng.integers(1, 40, n).astype(float) for t in tokens}
    rows = [(i * len(tokens) + k, 7, START + dt.timedelta(minutes=i), t, float(drawn[t][i])) for k, t in enumerate(tokens) for i in range(n)]
    return drawn, spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double")


def brute_tau(x, y):
    up = np.triu_indices(len(x), 1)
    a, b = (np.sign(v[:, None] - v[None, :])[up] for v in (x, y))
    return (a * b).sum() / np.sqrt(float((a != 0).sum()) * float((b != 0).sum()))


def brute_rho(x, y):
    mean_rank = lambda v: np.array([(v < e).sum() + ((v == e).sum() - 1) / 2 for e in v])
    return np.corrcoef(mean_rank(x), mean_rank(y))[0, 1]


def test_rank_correlations_read_every_aligned_row(spark, tmp_path):
    drawn, events = long_walks(spark)
    events.write.parquet(str(tmp_path / "events.parquet"))
    for name, expected in (("spearman_pairs", brute_rho(*drawn.values())), ("kendall_pairs", brute_tau(*drawn.values()))):
        (row,) = registry.QUERIES[name](spark, str(tmp_path)).collect()
        assert (row.n, row[3]) == (300, pytest.approx(expected, abs=2e-6)), name


def test_rank_correlations_of_the_first_rows_and_of_empty_prices(spark):
    drawn, events = long_walks(spark)
    s = series.as_series(events, "event_type", "ts", "value", "event_id")
    x, y = drawn.values()
    assert cross.kendall_pairs(s, 50).first().kendall == pytest.approx(brute_tau(x[:50], y[:50]))
    assert cross.spearman_pairs(s, 50).first().n == 50
    gone = s.withColumn("price", F.when(F.col("seq") % 10 != 0, F.col("price")))
    kept = np.arange(300) * 2 % 10 != 0
    got = cross.kendall_pairs(gone).first()
    a, b = (np.sign(v[:, None] - v[None, :]) for v in (x, y))
    up = np.triu(np.ones((300, 300), bool), 1)
    both = up & kept[:, None] & kept[None, :]
    assert got.kendall == pytest.approx((a * b)[both].sum() / np.sqrt(float((a[both] != 0).sum()) * float((b[up] != 0).sum())))
    assert cross.kendall_pairs(s.withColumn("price", F.lit(None).cast("double"))).first().kendall is None


@pytest.mark.parametrize("rows", [7, 60])
def test_rank_correlations_range_by_range(spark, rows):
    """Python gets ranges of some rows each; ties, a price that fills several ranges, and missing prices count as in a comparison of all rows."""
    rng = np.random.default_rng(8)
    n = 300
    x, y, z = np.round(rng.normal(size=n), 1), np.where(rng.random(n) < 0.4, 1.0, rng.integers(0, 60, n)), rng.normal(size=n).cumsum()
    drawn = {"a": x, "b": y, "c": np.where(rng.random(n) < 0.1, np.nan, z)}
    s = spark.createDataFrame([(t, START + dt.timedelta(minutes=k), k, float(v)) for t, values in drawn.items() for k, v in enumerate(values)], "token_id string, datetime timestamp, seq long, price double")
    got = {(r.token_a, r.token_b): (r.n, r.kendall) for r in cross.kendall_pairs(s, rows=rows).collect()}
    up = np.triu(np.ones((n, n), bool), 1)
    signs = {t: np.nan_to_num(np.sign(v[:, None] - v[None, :])) for t, v in drawn.items()}
    for a, b in ("ab", "ac", "bc"):
        p, q = signs[a][up], signs[b][up]
        assert got[a, b] == (n, pytest.approx((p * q).sum() / np.sqrt(float((p != 0).sum()) * float((q != 0).sum()))))


def test_timing_queries_read_240_rows(spark, tmp_path):
    long_walks(spark)[1].where("event_type = 'click'").write.parquet(str(tmp_path / "events.parquet"))
    moments = registry.QUERIES["entry_exit_moment"](spark, str(tmp_path))
    assert moments.count() == 240 * 239 // 2 and moments.agg(F.max("exit_row")).first()[0] == 239
    assert registry.QUERIES["trade_timing"](spark, str(tmp_path)).agg(F.max("entry_row")).first()[0] == 239
