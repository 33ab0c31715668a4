"""Warping distances against a plain table of cells, bounds that never exceed them, and the tree against one merge at a time."""

import datetime
import random
import time

import numpy as np
import pytest

from tickloom.operators import dtw

START = datetime.datetime(2024, 1, 1)


def plain_dtw(x, y, window):
    n, m = len(x), len(y)
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if i - max(0, n - m) - window < j < i + max(0, m - n) + window:
                d[i, j] = (x[i - 1] - y[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return float(np.sqrt(d[n, m]))


@pytest.mark.parametrize("seed", range(12))
def test_distance_and_bound(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=rng.integers(1, 70)).cumsum(), rng.normal(size=rng.integers(1, 70)).cumsum()
    for window in (1, 2, 10, 100):
        want = plain_dtw(x, y, window)
        assert dtw.warped(x, y, window) == pytest.approx(want)
        assert dtw.envelope_bound(x, y, window) <= want + 1e-9 and dtw.envelope_bound(y, x, window) <= dtw.warped(y, x, window) + 1e-9


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    rows = []
    for t in range(24):
        n = rng.randint(52, 90)
        rows += [(f"t{t:02}", START + datetime.timedelta(minutes=k), k, 2.5 + np.sin(k * (0.1 + 0.15 * (t % 3))) + 0.2 * rng.random() if t != 5 else 1.0) for k in range(n)]
    rows += [("few", START + datetime.timedelta(minutes=k), k, 1.0 + k) for k in range(20)]
    rng.shuffle(rows)
    return spark.createDataFrame([(a, b, c, float(d)) for a, b, c, d in rows], "token_id string, datetime timestamp, seq long, price double")


def test_distances_of_whole_series(series):
    got = {(r.token_a, r.token_b): r.distance for r in dtw.dtw_distances(series, block=5).collect()}
    parts = {t: np.log(p.sort_values("seq").price.to_numpy()) for t, p in series.toPandas().groupby("token_id") if len(p) >= 50}
    parts = {t: (x - x.mean()) / x.std() if x.std() > 0 else x for t, x in parts.items()}
    want = {(a, b): plain_dtw(parts[a], parts[b], dtw.band_of(len(parts[a]), len(parts[b]))) for a in parts for b in parts if a < b}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    near = {(r.token_a, r.token_b): r.distance for r in dtw.dtw_distances(series, block=5, most=3.0).collect()}
    assert near == pytest.approx({k: v for k, v in want.items() if v <= 3.0}) and 0 < len(near) < len(want)


def test_pairs_of_long_series_go_to_tasks_of_their_own(series, monkeypatch):
    monkeypatch.setattr(dtw, "WORK", 1.0)
    found = dtw.dtw_distances(series.where("token_id in ('t01', 't02', 't03', 't04')"), block=32)
    parts = found.rdd.glom().map(len).collect()
    assert sum(parts) == 6 and max(parts) == 1


def test_time_of_a_long_pair():
    x = np.random.default_rng(1).normal(size=20_000)
    began = time.process_time()
    assert dtw.warped(x, x[::-1], dtw.band_of(len(x), len(x))) > 0
    assert time.process_time() - began < 2  # 3 s with new arrays for each diagonal


def average_linkage(distance):
    """One merge at a time over all members: (keep, gone, height)."""
    names = sorted({t for p in distance for t in p})
    clusters = {t: [t] for t in names}
    mean = lambda a, b: float(np.mean([distance[tuple(sorted((x, y)))] for x in clusters[a] for y in clusters[b]]))
    out = []
    while len(clusters) > 1:
        height, a, b = min((mean(a, b), a, b) for a in clusters for b in clusters if a < b)
        clusters[a] += clusters.pop(b)
        out.append((a, b, height, len(clusters[a])))
    return out


def test_tree_of_sixty_tokens(spark):
    rng = np.random.default_rng(0)
    at = {f"p{k:02}": rng.normal(size=2) + 6 * np.array([k % 3, k % 2]) for k in range(60)}
    distance = {(a, b): float(np.linalg.norm(at[a] - at[b])) for a in at for b in at if a < b}
    merges = dtw.merge_tree(spark.createDataFrame([(a, b, d) for (a, b), d in distance.items()], "token_a string, token_b string, distance double"))
    got = sorted((r.height, r.keep, r.gone, r.size) for r in merges.collect())
    want = sorted((h, a, b, n) for a, b, h, n in average_linkage(distance))
    assert [(k, g, n) for _, k, g, n in got] == [(k, g, n) for _, k, g, n in want] and np.allclose([g[0] for g in got], [w[0] for w in want])
    labels = {r.token_id: r.cluster for r in dtw.cut_tree(spark.createDataFrame([(t,) for t in at], "token_id string"), merges, 6).collect()}
    assert len(set(labels.values())) == 6 and all(len({labels[f"p{k:02}"] for k in range(g, 60, 6)}) == 1 for g in range(6))


def test_ties_and_no_pairs(spark):
    shape = "token_a string, token_b string, distance double"
    names = "abcdef"
    same = [(x, y, 1.0) for x in names for y in names if x < y]
    merges = dtw.merge_tree(spark.createDataFrame(same, shape)).collect()
    assert len(merges) == 5 and all(r.height == 1.0 for r in merges) and max(r.size for r in merges) == 6
    assert dtw.merge_tree(spark.createDataFrame([], shape)).collect() == []
