"""Operators on small series with known answers, prefix invariance, edge cases, and streams against batches."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.operators import acf, cleaning, cross, features, grouped, indicators, learning, outliers, price, quality, quant
from tickloom.sources import series
from tickloom.streaming import bars as streaming

START = dt.datetime(2024, 1, 1)
SCHEMA = "token_id string, datetime timestamp, seq long, price double"


def make(spark, **tokens):
    rows = [(k, START + dt.timedelta(minutes=i), i, None if p is None else float(p)) for k, ps in tokens.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, SCHEMA)


def walk(n, seed=42, scale=0.02):
    return list(100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, scale, n))))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_rolling_waits_for_full_windows_and_stays_within_tokens(spark):
    s = make(spark, a=[1, 2, 3, 4], b=[10, 20, 30, 40]).withColumn("m", R.mean("price", 3))
    assert [r.m for r in s.orderBy("token_id", "seq").collect()] == [None, None, 2.0, 3.0, None, None, 20.0, 30.0]


def test_interpolation_and_fills(spark):
    s = R.with_row(make(spark, a=[None, 1, None, None, 4, None]))
    r = s.select("seq", R.interpolated("price", "rn").alias("v"), R.forward_fill("price").alias("f"), R.backward_fill("price").alias("b")).orderBy("seq").collect()
    assert [x.v for x in r] == [None, 1.0, 2.0, 3.0, 4.0, None]
    assert [x.f for x in r] == [None, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert [x.b for x in r] == [1.0, 1.0, 4.0, 4.0, 4.0, None]


def test_division_by_zero_and_single_rows(spark):
    s = make(spark, zero=[0, 0, 0], single=[100], pair=[100, 150])
    assert {r.token_id: r.death_hours for r in quality.death_duration(s).collect()} == {"zero": 0, "single": 0, "pair": 0}
    stats = {r.token_id: r for r in price.price_stats(s).collect()}
    assert stats["zero"].total_return is None and stats["pair"].total_return == pytest.approx(0.5)
    assert quant.sharpe_sortino(s).count() == 3


def test_empty_table(spark):
    s = spark.createDataFrame([], SCHEMA)
    for op in (quality.quality_report, features.safe_features, price.pattern_class, cleaning.variability, acf.features_15, outliers.consensus):
        assert op(s).count() == 0


def test_dead_token_and_category(spark):
    s = make(spark, dead=walk(60) + [5.0] * 130, live=walk(190, 7))
    report = {r.token_id: r for r in quality.assign_category(quality.quality_report(s)).collect()}
    assert report["dead"].is_dead and report["dead"].category == "dead_tokens"
    assert report["live"].category == "normal_behavior_tokens"
    assert {r.token_id: r.death_minute for r in acf.death(s).collect()}["live"] is None


def test_death_tail_keeps_two_rows(spark):
    s = make(spark, a=walk(100) + [5.0] * 100)
    assert cleaning.trim_death_tail(s).count() == 102


def test_staircase_is_cut_at_the_jump(spark):
    s = make(spark, a=walk(100, scale=0.001) + [1000.0] * 60)
    assert one(cleaning.staircase_cuts(s)).cut == 100
    assert cleaning.cut_staircases(s).count() == 100


def test_graduated_series_are_checked_in_one_pass(spark):
    live = walk(100)
    far = lambda times: live[:50] + [min(live) / times, *live[50:]]
    s = make(spark, live=live, short=live[:59], flat=[100.0] * 130, dead=live + [5.0] * 100, gone=[float("inf")] * 60 + live[:50], wide=far(2e6), wider=far(2e7), widest=far(1e9), stairs=walk(100, scale=0.001) + [1000.0] * 55)
    out = cleaning.graduated(s).cache()
    everywhere = {"live": 100, "dead": 102, "stairs": 100}
    assert {(r.horizon, r.token_id): r["count"] for r in out.groupBy("horizon", "token_id").count().collect()} == {
        **{(h, t): n for h in cleaning.RATIO_LIMITS for t, n in everywhere.items()}, **{(h, "wide"): 101 for h in ("short_term", "medium_term")}, ("short_term", "wider"): 101,
    }
    for h in cleaning.RATIO_LIMITS:
        assert out.where(F.col("horizon") == h).drop("horizon").exceptAll(cleaning.universal_checks(s, h)).isEmpty()
        assert cleaning.universal_checks(s, h).exceptAll(out.where(F.col("horizon") == h).drop("horizon")).isEmpty()
    out.unpersist()
    plan = cleaning.graduated(s)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1


def test_quality_report_reads_the_series_once(spark):
    s = make(spark, dead=walk(60) + [5.0] * 130, live=walk(190, 7), odd=[0.0, 1.0, 200.0, -1.0, None, 3.0])
    plan = quality.quality_report(s)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1 and "Join" not in plan
    report = quality.quality_report(s).cache()
    for part in (quality.quality_score(s), quality.price_anomalies(s), quality.death_duration(s), quality.extreme_movements(s).drop("details")):
        assert part.exceptAll(report.select(*part.columns)).isEmpty()
    odd = one(report.where("token_id = 'odd'"))
    assert (odd.n_rows, odd.n_times, odd.n_invalid, odd.zero_prices, odd.negative_prices, odd.tail_rows, odd.jumps) == (6, 6, 2, 1, 1, 2, 2)


def test_exponential_means_of_many_tokens_in_one_batch(spark):
    import pandas as pd

    from tickloom.functions.ewm import with_ewm

    tokens = {f"t{k}": [None if i % 5 == k else p for i, p in enumerate(walk(n, k))] for k, n in enumerate((1, 3, 40, 7, 2, 25))}
    s = make(spark, **tokens)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for n in ("9", "10000"):
        before = spark.conf.get(size)
        spark.conf.set(size, n)
        out = with_ewm(s.repartition(1), {"a": ("price", {"span": 12}), "b": ("a", {"alpha": 0.1, "adjust": False})})
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
        got = out.toPandas()
        spark.conf.set(size, before)
        assert len(got) == sum(map(len, tokens.values()))
        for k, prices in tokens.items():
            a = pd.Series(prices, dtype=float).ewm(span=12).mean()
            mine = got[got.token_id == k].sort_values("seq")
            np.testing.assert_array_equal(mine.a, a)
            np.testing.assert_array_equal(mine.b, a.ewm(alpha=0.1, adjust=False).mean())


def test_folds_of_one_series_are_laid_out_in_many_tasks(spark):
    n, plan = 300, (40, 15, 20)
    s = make(spark, a=range(n))
    for how in ({}, {"buffer": 7}, {"buffer": 30, "horizon": 9}, {"sliding": True}, {"sliding": True, "buffer": 7, "most_folds": 5}, {"horizon": 290}):
        out = learning.walk_forward(s, plan, **how).select("seq", "fold", "role", F.spark_partition_id().alias("task")).collect()
        table = learning.fold_table(n - how.get("horizon", 0), *plan, buffer=how.get("buffer", 0), sliding=how.get("sliding", False))[: how.get("most_folds")]
        assert sorted((r.fold, r.role, r.seq) for r in out) == sorted((k, role, i) for k, a, b, c, d in table for role, x, y in (("train", a, b), ("test", c, d)) for i in range(x, y))
        assert not out or len({r.task for r in out}) == 4


def test_gap_limit(spark):
    rows = [("a", START + dt.timedelta(minutes=m), m, float(m)) for m in [*range(10), *range(13, 20), *range(50, 60)]]
    s = spark.createDataFrame(rows, SCHEMA)
    filled = cleaning.fill_gaps(s, 5)
    assert filled.where("is_filled").count() == 3 and filled.count() == 30
    assert cleaning.fill_gaps(s, 5, whole_column=True).count() == 60


def test_flat_token_fails_variability(spark):
    got = {r.token_id: r.is_flat for r in cleaning.variability(make(spark, flat=[100.0] * 200, live=walk(200))).collect()}
    assert got == {"flat": True, "live": False}


def test_features_do_not_look_ahead(spark):
    prices = walk(150)
    whole = features.safe_features(make(spark, a=prices))
    prefix = features.safe_features(make(spark, a=prices[:100]))
    both = prefix.alias("p").join(whole.alias("w"), "seq").select(*(F.max(F.abs(F.col(f"p.{c}") - F.col(f"w.{c}"))).alias(c) for c in features.SAFE))
    assert all(v < 1e-9 for v in one(both))


def test_two_partitionings_agree(spark):
    s = make(spark, a=walk(80), b=walk(80, 1))
    a = sorted(map(tuple, indicators.rsi(s.repartition(1)).select("token_id", "seq", "rsi").collect()), key=str)
    b = sorted(map(tuple, indicators.rsi(s.repartition(7, "seq")).select("token_id", "seq", "rsi").collect()), key=str)
    assert a == b


def test_targets_end_in_nulls(spark):
    r = features.targets(make(spark, a=[1, 2, 1, 3]), (2,)).orderBy("seq").collect()
    assert [x.label_2m for x in r] == [0, 1, None, None]


def test_acf_of_an_autoregression(spark):
    rng, x = np.random.default_rng(3), [0.0]
    for _ in range(3000):
        x.append(0.7 * x[-1] + rng.normal())
    s = make(spark, a=[1.0] * len(x)).join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "seq long, ret double"), "seq")
    got = {r.lag: r.acf for r in acf.acf_lags(s, 3).collect()}
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(0.7, abs=0.05) and got[2] == pytest.approx(0.49, abs=0.07)


def test_local_winsor_hazard(spark):
    s = R.with_returns(make(spark, a=walk(200)))
    assert outliers.local_winsor(s).where("is_outlier").count() == 0
    assert outliers.local_winsor(s, nearest=False).where("is_outlier").count() > 0


def test_ewm_matches_its_weights(spark):
    r = features.macd(make(spark, a=[1, 2, 4])).orderBy("seq").collect()
    a = 2 / 13
    assert r[2].ema_12 == pytest.approx((4 + 2 * (1 - a) + (1 - a) ** 2) / (1 + (1 - a) + (1 - a) ** 2))


def test_non_overlapping_trades(spark):
    r = one(grouped.entry_exit_nonoverlap(make(spark, a=list(range(1, 31))), (5,), (5,)))
    assert r.trades == 4  # in at rows 5, 10, 15, 20


def test_first_hit_of_stop_or_target(spark):
    r = one(quant.sl_tp_grid(make(spark, a=[100, 101, 98, 120]), (0.05,), (0.1,)))
    assert (r.trades, r.wins, r.mean_result) == (1, 1, pytest.approx(0.1))


def test_correlation_and_pca(spark):
    base = np.random.default_rng(0).normal(0, 0.02, 120)
    up = lambda k: list(100 * np.exp(np.cumsum(base + np.random.default_rng(k).normal(0, 0.002, 120))))
    s = make(spark, a=up(1), b=up(2), c=walk(120, 9))
    got = {(r.token_a, r.token_b): r.correlation for r in cross.corr_pairs(s, 1).collect()}
    assert got["a", "b"] > 0.9 and abs(got["a", "c"]) < 0.4
    assert cross.pca(cross.token_matrix(s, 5), [f"r{k}" for k in range(1, 6)], 2).count() == 3


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.9), (0, 1, -0.2, 0.8), (1, 0, 0.1, 0.4), (0, 0, -0.3, 0.1)], "y_true int, y_pred int, ret double, y_proba double")
    assert one(learning.confusion(df)).f1 == pytest.approx(0.5)
    assert one(learning.return_weighted(df)).weighted_recall == pytest.approx(0.5 / 0.6)
    assert one(learning.roc_auc(df)).auc == pytest.approx(0.75)


def test_folds():
    assert learning.fold_table(100, 60, 20, 10, 5) == [(0, 0, 60, 65, 75), (1, 0, 80, 85, 95)]


def test_clusters(spark):
    rows = [(f"t{i}", float(i % 3) * 10 + 0.01 * i, float(i % 3)) for i in range(30)]
    f = spark.createDataFrame(rows, "token_id string, x double, y double")
    assert learning.kmeans(f, ["x", "y"], 3).select("cluster").distinct().count() == 3
    assert one(learning.best_k(learning.k_scan(f, ["x", "y"], range(2, 5)))).k == 3
    assert one(learning.seed_stability(f, ["x", "y"], 3, (1, 2))).ari == pytest.approx(1)


def test_files_and_sinks(spark, tmp_path):
    s = make(spark, abc_1=[1, 2, 3]).select("datetime", "price")
    s.coalesce(1).write.parquet(str(tmp_path / "in/normal"))
    got = series.read_directory(spark, str(tmp_path / "in"))
    assert got.count() == 3 and got.select("category").distinct().first()[0] == "normal"
    assert series.has_exactly(s) and not series.has_exactly(got)
    series.write_parquet(got, str(tmp_path / "out"))
    series.write_json(got, str(tmp_path / "j"))
    series.write_csv(got, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_streamed_bars_are_the_batch_bars(spark, tmp_path):
    s = make(spark, a=walk(50), b=walk(50, 2))
    s.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.read_stream(spark, str(tmp_path / "in"), s.schema, 10)
    q = streaming.bars(stream, 5, "1 day").writeStream.outputMode("complete").format("memory").queryName("bars_test").trigger(availableNow=True).start()
    q.awaitTermination()
    pick = ["token_id", "window_start", "open", "close", "n"]
    assert sorted(map(tuple, spark.table("bars_test").select(pick).collect())) == sorted(map(tuple, streaming.bars(s, 5).select(pick).collect()))


def test_state_per_token(spark, tmp_path):
    s = make(spark, a=[1, 2, 2, 2])
    s.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streaming.running_state(streaming.read_stream(spark, str(tmp_path / "in"), s.schema), 3, 3)
    q = out.writeStream.outputMode("update").format("memory").queryName("state_test").trigger(availableNow=True).start()
    q.awaitTermination()
    r = one(spark.table("state_test"))
    assert (r.n, r.flat_run, r.is_dead) == (4, 3, True) and math.isclose(r.ewm, 1.875)


def test_presets_follow_the_length():
    assert learning.PRESETS["lightgbm_medium_term"] == (240, 120, 120) and len(learning.PRESETS) == 9


def test_adaptive_folds(spark):
    rows = [(n,) for n in (150, 100, 399, 599, 620, 1199, 1799, 5000)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "n int").select(*learning.fold_plan(F.col("n"))).collect()]
    assert got == [(60, 30, 30), (60, 30, 30), (120, 30, 30), (180, 60, 60), (480, 70, 70), (480, 120, 120), (720, 180, 180), (960, 240, 240)]


def test_archetype_names(spark):
    rows = [(95.0, 30.0, 0.6, 0.0), (95.0, 30.0, 0.1, 0.0), (95.0, 200.0, 0.0, 0.0), (95.0, 900.0, 0.0, 0.0), (60.0, 0.0, 0.0, 0.2), (60.0, 0.0, 0.0, 0.0), (10.0, 0.0, 0.4, 0.2), (10.0, 0.0, 0.0, 0.01), (10.0, 0.0, 0.0, 0.07)]
    got = [r.archetype for r in acf.archetype_name(spark.createDataFrame(rows, "pct_dead double, avg_lifespan double, avg_return double, avg_volatility double")).collect()]
    assert got == ["Quick Pump & Death", "Dead on Arrival", "Slow Bleed", "Extended Decline", "Phoenix Attempt", "Zombie Walker", "Survivor Pump", "Stable Survivor", "Survivor Organic"]


def test_peaks_keep_the_higher_of_two_close_ones():
    p = np.array([0, 3, 0, 5, 5, 5, 0, 4, 0, 0, 9, 0, 1], float)
    assert grouped._peaks(p, 1).tolist() == [1, 4, 7, 10] and grouped._peaks(p, 4).tolist() == [4, 10]


def test_rolling_entropy_equals_a_loop(spark):
    rng = np.random.default_rng(5)
    p = np.exp(np.cumsum(rng.normal(size=200) / 50))
    s = make(spark, a=p.tolist(), flat=[1.0] * 80)
    got = {(r.token_id, r.row): r.entropy for r in grouped.rolling_entropy(s, 60, 10).collect()}
    r = p[1:] / p[:-1] - 1
    for k in range(60, 200):
        q = np.histogram(r[k - 60 : k], 10)[0] / 60
        assert got["a", k] == pytest.approx(-(q[q > 0] * np.log(q[q > 0])).sum())
    assert got["flat", 70] == 0


def test_each_strategy_does_its_own_steps(spark):
    dying = [1.0 + 0.01 * (k % 7) for k in range(100)] + [2.0] * 80
    s = make(spark, a=dying)
    assert cleaning.clean(s, "gentle").count() == 180 and cleaning.clean(s, "aggressive").count() == 180
    assert cleaning.clean(s, "minimal").count() == 102 and cleaning.clean(s, "preserve").count() == 102
    gap = s.where("seq not between 20 and 25")
    assert [cleaning.clean(gap, x).count() for x in ("gentle", "aggressive")] == [174, 180]


def test_batch_pipeline_runs_all_stages(spark):
    from tickloom.plans import pipeline

    rng = np.random.default_rng(6)
    s = make(spark, **{f"t{k}": np.exp(np.cumsum(rng.normal(size=300) / 100)).tolist() for k in range(3)})
    rows = pipeline.run_pipeline(s, (15,)).collect()
    assert len(rows) == 3 * 240 and {r.category for r in rows} <= set(cleaning.STRATEGIES) and sum(r.label_15m is None for r in rows) == 45


def test_clusters_of_all_against_those_of_a_category(spark):
    rows = [(f"{c}{k}", c, float(k % 2) * 10 + k / 100) for c in "ab" for k in range(20)] + [("z0", "z", 1.0)]
    got = {r.category: (r.tokens, r.ari) for r in learning.unified_against_category(spark.createDataFrame(rows, "token_id string, category string, x double"), ["x"], 2).collect()}
    assert got == {"a": (20, 1.0), "b": (20, 1.0)}


def test_a_category_is_exported_to_its_folder(spark, tmp_path):
    s = make(spark, a=walk(5), b=walk(6))
    tokens = spark.createDataFrame([("a", "dead"), ("b", "alive")], "token_id string, category string")
    for category in ("dead", "alive"):
        series.export_category(s, tokens, str(tmp_path), category)
    got = spark.read.parquet(str(tmp_path))
    assert {(r.category, r.token_id, r["count"]) for r in got.groupBy("category", "token_id").count().collect()} == {("dead", "a", 5), ("alive", "b", 6)}
    series.export_category(s, tokens, str(tmp_path), "dead")
    assert spark.read.parquet(str(tmp_path)).count() == 11


def test_labels_and_logs_are_read_from_json(spark, tmp_path):
    (tmp_path / "labels.json").write_text('{"archetype_data": {"dead": {"quick": {"cluster_id": 3, "tokens": ["x", "y"]}}, "normal": {"calm": {"cluster_id": 1, "tokens": ["z"]}}}}')
    got = {tuple(r) for r in series.read_label_map(spark, str(tmp_path / "labels.json")).collect()}
    assert got == {("x", "dead", "quick", 3), ("y", "dead", "quick", 3), ("z", "normal", "calm", 1)}
    series.write_json(make(spark, a=[1, 2]), str(tmp_path / "log"))
    assert series.read_json(spark, str(tmp_path / "log"), make(spark, a=[1]).schema).count() == 2


def test_returns_after_a_price_of_zero_are_infinite(spark):
    s = make(spark, a=[2, 0, 4, 6], b=[1, 0, 0, 2])
    got = {t: [r.ret for r in R.with_returns(s).where(F.col("token_id") == t).orderBy("seq").collect()] for t in "ab"}
    assert got["a"] == [None, -1.0, math.inf, 0.5] and math.isnan(got["b"][2]) and got["b"][3] == math.inf
    assert [r.ret for r in acf.safe_returns(s.where("token_id = 'a'")).orderBy("seq").collect()] == [None, -1.0, math.inf, 0.5]
    assert all(math.isnan(r.acf) for r in acf.acf_lags(acf.safe_returns(s.where("token_id = 'a'")), 1).collect())
    assert [r.label_15m for r in features.targets(s, (15,)).collect()] == [None] * 8
    assert {r.return_1m for r in features.targets(s.where("token_id = 'a'"), (1,)).collect()} == {-1.0, math.inf, 0.5, None}
    assert one(price.drawdown_global(s.where("token_id = 'a'"))).total_up_moves == 2


def test_calmar_from_and_to_zero(spark):
    got = {r.token_id: r for r in quant.calmar(make(spark, up=[0, 2, 1], down=[4, 2, 0])).collect()}
    assert got["up"].max_drawdown == -0.5 and got["up"].calmar == pytest.approx(2 * (math.exp(50) - 1)) and got["down"].max_drawdown == -1 and got["down"].calmar == -1


def test_correlation_with_an_infinite_return(spark):
    from tickloom.operators import blocks

    rng = np.random.default_rng(5)
    rows = [(t, k, float("inf") if (t, k) == ("a", 30) else float(rng.normal())) for t in "abc" for k in range(40) if (t, k) != ("c", 30)]
    got = {(r.token_a, r.token_b): (r.n, r.correlation) for r in blocks.pair_correlations(spark.createDataFrame(rows, "token_id string, at long, r double"), "at", "r").collect()}
    assert got["a", "b"][0] == 40 and math.isnan(got["a", "b"][1]) and got["a", "c"][0] == 39 and abs(got["a", "c"][1]) < 0.5


def test_stop_loss_grid_enters_at_zero(spark):
    r = {x.token_id: x for x in quant.sl_tp_grid(make(spark, up=[0, 0, 3], flat=[0, 0, 0], down=[5, 0]), (0.05,), (0.1,)).collect()}
    assert (r["up"].trades, r["up"].wins, r["up"].mean_result) == (1, 1, pytest.approx(0.1))
    assert (r["flat"].trades, r["flat"].wins, r["flat"].mean_result) == (1, 0, None)
    assert r["down"].mean_result == pytest.approx(-0.05)
