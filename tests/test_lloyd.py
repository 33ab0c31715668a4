"""k-means runs against numpy, the choice of k on planted clusters, consensus against the dense matrix, and rules and spectra."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import grouped, learning, lloyd, spectral

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(2)
    rows = [(f"t{k:03}", "ab"[k % 2], *(float(v) for v in rng.normal(size=2) * 0.4 + 5 * np.array([(k % 4) // 2, k % 2])), None if k % 50 == 0 else 1.0) for k in range(160)]
    return spark.createDataFrame(rows, "token_id string, category string, u double, v double, w double")


def plain_lloyd(x, centres, weight):
    while True:
        k = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([np.average(x[k == c], axis=0, weights=weight[k == c]) if weight[k == c].sum() else centres[c] for c in range(len(centres))])
        if np.sqrt(((new - centres) ** 2).sum(1)).max() <= 1e-4:
            return new, k
        centres = new


def test_all_runs_equal_separate_fits(spark, planted):
    points = lloyd.standardised(planted, ["u", "v"], ("category",)).withColumn("g", F.col("category"))
    each = {g: part.sort_values("token_id") for g, part in points.toPandas().groupby("g")}
    arrays = {g: np.array(part["x"].to_list()) for g, part in each.items()}
    runs = {(g, d): lloyd.plus_plus(x, 3, np.random.default_rng(d)) for g, x in arrays.items() for d in range(4)}
    found = lloyd.fit(points, runs, lloyd.poisson_weights)
    for (g, d), (centres, n, cost, far) in found.items():
        weight = lloyd.poisson_weights(each[g]["token_id"], d)
        want, k = plain_lloyd(arrays[g], runs[g, d], weight)
        distance = np.sqrt(((arrays[g] - centres[k]) ** 2).sum(1))
        assert np.allclose(centres, want, atol=1e-3) and n.sum() == weight.sum()
        assert np.allclose(cost.sum(), (weight * distance**2).sum(), rtol=1e-3) and np.allclose(far.sum(), (weight * distance).sum(), rtol=1e-3)


def test_runs_of_very_many_steps_end(spark):
    # points on a line: two centres that start at one end move by little at each step
    x = np.cumsum(1.0 + np.arange(400) * 0.01)
    points = spark.createDataFrame([(f"p{k:03}", "all", [float(v)]) for k, v in enumerate(x)], "token_id string, g string, x array<double>").coalesce(1).cache()
    start = x[:12, None]
    steps, centres = 0, start
    while True:
        k = np.abs(x[:, None] - centres[None, :, 0]).argmin(1)
        new = np.array([[x[k == c].mean()] for c in range(len(centres))])
        steps, moved, centres = steps + 1, np.abs(new - centres).max(), new
        if moved <= 1e-4:
            break
    assert steps > 100
    assert np.allclose(lloyd.fit(points, {("all", 0): start})["all", 0][0], centres)


def test_poisson_weights_are_poisson_and_repeat():
    names = [f"n{k}" for k in range(20_000)]
    w = lloyd.poisson_weights(names, 3)
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06 and (w == lloyd.poisson_weights(names, 3)).all() and (w != lloyd.poisson_weights(names, 4)).any()


def test_k_is_found(planted):
    got = {r.k: r for r in lloyd.k_selection(planted, ["u", "v"], range(1, 8), references=5).collect()}
    assert [k for k, r in got.items() if r.by_gap] == [4] and [k for k, r in got.items() if r.by_elbow] in ([3], [4]) and min((r.davies_bouldin, k) for k, r in got.items() if k > 1)[1] == 4
    x = np.array(lloyd.standardised(planted, ["u", "v"]).toPandas()["x"].to_list())
    assert got[1].within == pytest.approx(((x - x.mean(0)) ** 2).sum()) and all(got[k].within >= got[k + 1].within * 0.99 for k in range(1, 7)) and got[1].davies_bouldin is None
    home = np.array([int(t[1:]) % 4 for t in planted.toPandas()["token_id"]])
    true = sum(((x[home == c] - x[home == c].mean(0)) ** 2).sum() for c in range(4))
    assert got[4].within == pytest.approx(true, rel=1e-3)


def test_few_and_no_tokens(spark, planted):
    assert [r.k for r in lloyd.k_selection(planted.limit(3), ["u", "v"], range(1, 8), references=2).collect()] == [1, 2, 3]
    none = planted.limit(0)
    assert lloyd.k_selection(none, ["u"]).collect() == [] and lloyd.consensus(none, ["u"], 2).collect() == [] and lloyd.unified_or_separate(none, ["u"], 2).collect() == []


def test_consensus(planted):
    draws = {r.token_id: r.labels for r in lloyd.bootstrap_labels(planted, ["u", "v"], 4, draws=6).collect()}
    assert len(draws) == 160
    names = sorted(draws)
    dense = np.mean([[[draws[a][d] == draws[b][d] for b in names] for a in names] for d in range(6)], 0)
    groups = {}
    for t in names:
        groups.setdefault(".".join(map(str, draws[t])), t)
    table = planted.sparkSession.createDataFrame([(g, draws[t]) for g, t in groups.items()], "name string, labels array<int>")
    place = {t: k for k, t in enumerate(names)}
    for r in lloyd.co_association(table, block=2).collect():
        assert r.share == pytest.approx(dense[place[groups[r.token_a]], place[groups[r.token_b]]])
    assert lloyd.co_association(table, block=2).count() == len(groups) * (len(groups) - 1) // 2
    got = lloyd.consensus(planted, ["u", "v"], 4, draws=6).toPandas()
    assert len(got) == 160 and got.cluster.nunique() == 4 and got.stability.between(0, 1).all() and got.stability.mean() > 0.8
    assert all(got[got.token_id.str[1:].astype(int) % 4 == c].cluster.mode().shape[0] == 1 for c in range(4))


def test_silhouettes_and_decision(spark, planted):
    points = lloyd.standardised(planted, ["u", "v"], ("category",)).withColumn("g", F.col("category")).withColumn("label", F.pmod(F.hash("token_id"), F.lit(3)))
    got = {r.g: r.silhouette for r in lloyd.silhouettes(points).collect()}
    for g, part in points.toPandas().groupby("g"):
        x, label = np.array(part["x"].to_list()), part["label"].to_numpy()
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        scores = []
        for i in range(len(x)):
            own = (label == label[i]) & (np.arange(len(x)) != i)
            a, b = d[i, own].mean(), min(d[i, label == c].mean() for c in set(label) if c != label[i])
            scores.append((b - a) / max(a, b))
        assert got[g] == pytest.approx(np.mean(scores))
    got = {r.category: r for r in lloyd.unified_or_separate(planted, ["u", "v"], 2).collect()}
    assert set(got) == {"a", "b"} and all(r.tokens == 80 and r.decision in ("separate", "unified", "either") and r.silhouette_separate > 0.8 for r in got.values())
    assert all(r.decision == "separate" for r in got.values() if r.silhouette_unified is None or r.silhouette_separate - r.silhouette_unified > 0.05)


def test_rules_give_the_models_own_classes(spark):
    rng = random.Random(1)
    rows = [(f"t{k}", a := rng.random(), b := rng.random() if k % 20 else None, "up" if a > 0.6 else "down" if (b or 0) > 0.5 else "flat") for k in range(600)]
    table = spark.createDataFrame(rows, "token_id string, a double, b double, label string")
    model = learning.early_rules(table, ["a", "b"], "label", depth=4)
    rules = learning.rules_table(model, ["a", "b"])
    labels = model.stages[0].labels
    guess = {r.token_id: labels[int(r.prediction)] for r in model.transform(table.na.fill(0.0, ["a", "b"])).collect()}
    got = {r.token_id: (r.rule, r["class"]) for r in learning.apply_rules(table, rules).collect()}
    assert {t: c for t, (_, c) in got.items()} == guess and len({k for k, _ in got.values()}) >= 3
    quality = learning.rule_quality(table, rules, "label").collect()
    truth = {r[0]: r[3] for r in rows}
    for r in quality:
        own = [t for t, (k, _) in got.items() if k == r.rule]
        assert r.support == len(own) >= 20 and r.purity == pytest.approx(sum(truth[t] == r["class"] for t in own) / len(own))
    one = learning.early_rules(table.withColumn("label", F.lit("same")).union(table.limit(1)), ["a", "b"], "label")
    assert [(r.feature, r.rule) for r in learning.rules_table(one, ["a", "b"]).collect()] == [(None, 0)]


@pytest.fixture(scope="module")
def waves(spark):
    rows = []
    for token, n in (("long", 1500), ("mid", 200), ("short", 12), ("none", 6)):
        rows += [(token, START + datetime.timedelta(minutes=k), k, 5 + float(np.sin(k / 3) + 0.4 * np.sin(k / 40 + k * k / 9e4)) if k != 77 else 0.0) for k in range(n)]
    return spark.createDataFrame(rows, "token_id string, datetime timestamp, seq long, price double")


def test_spectrogram(waves):
    got = spectral.spectrogram(waves, 256, rows=300).toPandas()
    assert set(got.token_id) == {"long", "mid", "short"}
    for token, part in waves.toPandas().groupby("token_id"):
        r = grouped._returns(part.sort_values("seq").price.to_numpy())
        n = min(256, len(r))
        if n < 8:
            continue
        own = got[got.token_id == token]
        cuts = range(0, len(r) - n + 1, max(1, n // 2))
        assert sorted(own.start.unique()) == list(cuts)
        for k, at in enumerate(cuts):
            want = np.abs(np.fft.rfft((r[at : at + n] - r[at : at + n].mean()) * np.hanning(n)))[1:] ** 2
            assert np.allclose(own[own.segment == k].sort_values("frequency").power, want)


def test_mean_of_the_spectrogram_is_welchs(waves):
    rows = lambda df: {(r.token_id, r.rank): (round(r.period, 6), round(r.power, 9), r.period_class) for r in df.collect()}
    assert rows(spectral.mean_spectrum(waves, rows=300)) == rows(grouped.welch(waves))


def test_rules_of_infinite_features(spark):
    """Infinite values lie beyond all others, NaN and null at 0, in the fit as where the rules are applied."""
    rows = [(f"t{k}", [float("inf"), 5.0, -3.0, float("-inf"), float("nan"), None][k % 6], ["up", "up", "down", "down", "none", "none"][k % 6]) for k in range(120)]
    table = spark.createDataFrame(rows, "token_id string, a double, label string")
    rules = learning.rules_table(learning.early_rules(table, ["a"], "label"), ["a"])
    met = learning.apply_rules(table, rules).collect()
    assert len(met) == 120 and all(r["class"] == r.label for r in met)
    assert {(r.support, r.purity) for r in learning.rule_quality(table, rules, "label").collect()} == {(40, 1.0)}
