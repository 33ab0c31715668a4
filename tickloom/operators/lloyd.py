"""Many k-means runs in one: every pass over the points serves all runs of all groups at once.

A run is a set of centres for one group of points (a category, a reference set, the whole table), with a weight for each point if wanted.
A pass adds up weighted counts and sums of all runs in each task; what comes to the driver are these sums, as many as there are centres.
Runs that no longer move drop out. Starts are chosen by k-means++ on at most `start_rows` points of each group, the first by hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.rolling import KEY
from tickloom.operators.dtw import cut_tree, merge_tree
from tickloom.session import stored

START_ROWS = 2000
#: How many draws of a bootstrap take a point: Poisson with mean 1, by the uniform number that falls under these sums.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def standardised(features: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """token_id, the columns of `keep`, and x: the columns with mean 0 and deviation 1 (0 where there is none), nulls taken as 0 before."""
    filled = features.select(KEY, *keep, *(F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns))
    s = filled.agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)), *(F.stddev_samp(c).alias(f"s{k}") for k, c in enumerate(columns))).first()
    x = F.array(*(((F.col(c) - (s[f"m{k}"] or 0.0)) / s[f"s{k}"]) if s[f"s{k}"] else F.lit(0.0) for k, c in enumerate(columns)))
    return filled.select(KEY, *keep, x.alias("x"))


def uniform(names: Iterable, *what) -> np.ndarray:
    """A number from 0 to 1 for each name, the same wherever it is asked for."""
    seed = repr(what).encode()
    return np.array([int.from_bytes(hashlib.blake2b(f"{n}".encode(), digest_size=8, key=seed[:64]).digest(), "little") / 2.0**64 for n in names])


def poisson_weights(names: Iterable, draw: int) -> np.ndarray:
    """How often a draw takes each token."""
    return np.searchsorted(_POISSON, uniform(names, "draw", draw), "right").astype(float)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centre (the first of equals) and its squared distance."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
    k = d.argmin(1)
    return k, np.maximum(d[np.arange(len(x)), k], 0.0)


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator, weight: np.ndarray | None = None) -> np.ndarray:
    """k of the points, each drawn by its squared distance from those before."""
    weight = np.ones(len(x)) if weight is None or not weight.sum() else weight
    out = [x[rng.choice(len(x), p=weight / weight.sum())]]
    while len(out) < k:
        d = nearest(x, np.array(out))[1] * weight
        out.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(out)


def _weighted(points: DataFrame, order: dict, weights: Callable) -> DataFrame:
    """points with w: the weight of each point in each run of its group, in the order given."""

    def work(batches):
        for b in batches:
            names, labels = np.array(b.column(0).to_pylist(), object), np.array(b.column(1).to_pylist(), object)
            out: list = [[]] * len(labels)
            for g in set(labels.tolist()) & order.keys():
                own = np.flatnonzero(labels == g)
                found = np.stack([weights(names[own].tolist(), run) for run in order[g]], 1)
                for i, w in zip(own.tolist(), found, strict=True):
                    out[i] = w
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=[KEY, "g", "x", "w"])

    return points.select(KEY, "g", "x").mapInArrow(work, f"{KEY} {points.schema[KEY].dataType.simpleString()}, g string, x array<double>, w array<double>")


def _pass(points: DataFrame, runs: dict[tuple, np.ndarray], order: dict | None, last: bool) -> dict[tuple, tuple]:
    """Of each run (group, run): counts, sums, squared distances and distances by centre. order: the runs that the column w has weights of, by group."""
    groups: dict = {}
    for (g, run), centres in runs.items():
        groups.setdefault(g, []).append((run, centres))

    def work(batches):
        total: dict = {}
        for b in batches:
            x, labels = _matrix(b.column(2)), np.array(b.column(1).to_pylist(), object)
            for g in set(labels.tolist()) & groups.keys():
                own = np.flatnonzero(labels == g)
                mine = x[own]
                each = _matrix(b.column(3).take(pa.array(own))) if order else None
                for run, centres in groups[g]:
                    k, d = nearest(mine, centres)
                    w = each[:, order[g].index(run)] if order else np.ones(len(own))
                    n = np.bincount(k, w, len(centres))
                    sums = np.stack([np.bincount(k, w * mine[:, j], len(centres)) for j in range(x.shape[1])], 1)
                    far = np.bincount(k, w * np.sqrt(d), len(centres)) if last else np.zeros(len(centres))
                    new = (n, sums, np.bincount(k, w * d, len(centres)), far)
                    old = total.get((g, run))
                    total[g, run] = new if old is None else tuple(a + c for a, c in zip(old, new, strict=True))
        rows = [(g, repr(run), c, *(float(v[c]) for v in (n, cost, far)), sums[c].tolist()) for (g, run), (n, sums, cost, far) in total.items() for c in range(len(n))]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["g", "run", "c", "n", "cost", "far", "sums"])

    size = next(iter(runs.values())).shape[1]
    found = points.where(F.col("g").isin(list(groups))).select(KEY, "g", "x", *(["w"] if order else [])).mapInArrow(work, "g string, run string, c int, n double, cost double, far double, sums array<double>")
    found = found.groupBy("g", "run", "c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("far").alias("far"), F.array(*(F.sum(F.col("sums")[j]) for j in range(size))).alias("sums"))
    named = {(g, repr(run)): (g, run) for g, run in runs}
    out = {key: (np.zeros(len(c)), np.zeros_like(c), np.zeros(len(c)), np.zeros(len(c))) for key, c in runs.items()}
    for r in found.collect():  # a row per centre
        n, sums, cost, far = out[named[r.g, r.run]]
        n[r.c], sums[r.c], cost[r.c], far[r.c] = r.n, r.sums, r.cost, r.far
    return out


def fit(points: DataFrame, runs: dict[tuple, np.ndarray], weights: Callable | None = None, tolerance: float = 1e-4) -> dict[tuple, tuple]:
    """Lloyd's steps for every run until its centres move by no more than `tolerance`: centres, and the counts, squared distances and distances of their points.

    A step never adds to the distances, so each run ends, after however many steps; one whose distances fall no more has ended too.
    points: token_id, g (string), x. runs: (g, run) -> starting centres. weights(names, run): weight of each point in a run. A centre without points stays."""
    runs = {key: np.asarray(c, float) for key, c in runs.items()}
    order = None
    if weights:
        order = {}
        for g, run in runs:
            order.setdefault(g, []).append(run)
        points = stored(_weighted(points, order, weights), "run-weights")
    moving, least = dict(runs), {}
    while moving:
        found = _pass(points, moving, order, False)
        for key, (n, sums, cost, _) in found.items():
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], runs[key])
            if np.sqrt(((new - runs[key]) ** 2).sum(1)).max() <= tolerance or cost.sum() >= least.get(key, math.inf):
                del moving[key]
            runs[key], least[key] = new, cost.sum()
        moving = {key: runs[key] for key in moving}
    last = _pass(points, runs, order, True)
    return {key: (c, last[key][0], last[key][2], last[key][3]) for key, c in runs.items()}


def _starts(points: DataFrame, start_rows: int) -> dict[str, pd.DataFrame]:
    """Up to start_rows points of each group, the first by hash."""
    from pyspark.sql import Window

    rows = points.withColumn("_r", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64(KEY), KEY))).where(F.col("_r") <= start_rows)
    return {g: part.sort_values("_r") for g, part in rows.toPandas().groupby("g")}


def k_selection(features: DataFrame, columns: list[str], ks: Iterable[int] = range(1, 11), references: int = 10, starts: int = 4, seed: int = 42, start_rows: int = START_ROWS) -> DataFrame:
    """Per k: within (sum of squared distances), gap and its deviation against uniform reference sets, Davies-Bouldin index, distance from the elbow's chord; chosen by gap and by elbow.

    The reference sets have as many points as there are tokens, uniform within the range of each column; all sets, k and starts are fitted at once, and the
    best start of each counts. By gap: the first k whose gap is at least the next one's less its deviation; by elbow: the k farthest from the chord."""
    spark = features.sparkSession
    own = stored(standardised(features, columns), "k-points")
    ends = own.agg(F.count("*").alias("n"), *(f(F.col("x")[j]).alias(f"{f.__name__}{j}") for j in range(len(columns)) for f in (F.min, F.max))).first()
    ks = [k for k in ks if k <= ends.n]
    shape = "k int, within double, gap double, gap_sd double, davies_bouldin double, elbow_distance double, by_gap boolean, by_elbow boolean"
    if not ks:
        return spark.createDataFrame([], shape)
    number = lambda j: F.pmod(F.xxhash64(F.lit(seed), "g", KEY, F.lit(j)), F.lit(1 << 52)) / float(1 << 52)
    sets = own.withColumn("g", F.explode(F.array(*(F.lit(str(b)) for b in range(references + 1)))))
    drawn = F.array(*(F.lit(ends[f"min{j}"]) + number(j) * (ends[f"max{j}"] - ends[f"min{j}"]) for j in range(len(columns))))
    points = stored(sets.withColumn("x", F.when(F.col("g") == "0", F.col("x")).otherwise(drawn)), "k-sets")
    samples = {g: np.array(part["x"].to_list()) for g, part in _starts(points, start_rows).items()}
    runs = {(g, (k, s)): plus_plus(x, k, np.random.default_rng([seed, int(g), k, s])) for g, x in samples.items() for k in ks for s in range(starts if k > 1 else 1)}
    found = fit(points, runs)
    best = {(g, k): min((found[g, (k, s)] for s in range(starts if k > 1 else 1)), key=lambda f: f[2].sum()) for g in samples for k in ks}
    log_within = {key: math.log(max(f[2].sum(), 1e-300)) for key, f in best.items()}
    rows = []
    for k in ks:
        reference = [log_within[str(b), k] for b in range(1, references + 1)]
        centres, n, cost, far = best["0", k]
        spread = far / np.maximum(n, 1)
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
        np.fill_diagonal(apart, np.inf)
        index = float((np.add.outer(spread, spread) / np.maximum(apart, 1e-300)).max(1).mean()) if k > 1 else None
        rows.append([k, float(cost.sum()), float(np.mean(reference) - log_within["0", k]) if references else None, float(np.std(reference) * math.sqrt(1 + 1 / references)) if references else None, index])
    gap = next((k for (k, _, g, _, _), (_, _, g2, s2, _) in zip(rows, rows[1:], strict=False) if references and g >= g2 - s2), max(rows, key=lambda r: r[2] or 0.0)[0])
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    chord = np.array([x[-1] - x[0], y[-1] - y[0]])
    length = float(np.hypot(*chord)) or 1.0
    off = np.abs(chord[0] * (y - y[0]) - chord[1] * (x - x[0])) / length
    elbow = int(x[int(off.argmax())])
    return spark.createDataFrame([(*r, float(o), r[0] == gap, r[0] == elbow) for r, o in zip(rows, off, strict=True)], shape)


def labelled(points: DataFrame, runs: dict[tuple, np.ndarray], order: list) -> DataFrame:
    """points with labels: the nearest centre in each run of `order` (of the point's group)."""

    def work(batches):
        for b in batches:
            x, groups = _matrix(b.column(2)), np.array(b.column(1).to_pylist(), object)
            out = np.zeros((len(x), len(order)), np.int32)
            for g in set(groups.tolist()):
                own = np.flatnonzero(groups == g)
                for j, run in enumerate(order):
                    out[own, j] = nearest(x[own], runs[g, run])[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(order)), pa.int32()), pa.array(out.ravel()))], names=[KEY, "g", "x", "labels"])

    kind = points.schema[KEY].dataType.simpleString()
    return points.select(KEY, "g", "x").mapInArrow(work, f"{KEY} {kind}, g string, x array<double>, labels array<int>")


def bootstrap_labels(features: DataFrame, columns: list[str], k: int, draws: int = 10, seed: int = 42, start_rows: int = START_ROWS) -> DataFrame:
    """Per token: labels, its cluster in each of `draws` bootstrap draws. A draw weights each token by a Poisson number of its name, and all draws are fitted at once.

    Every token gets a label in every draw, those with weight 0 too."""
    points = stored(standardised(features, columns).withColumn("g", F.lit("all")), "draw-points")
    sample = _starts(points, start_rows).get("all")
    if sample is None:
        return features.select(KEY).limit(0).withColumn("labels", F.array().cast("array<int>"))
    x = np.array(sample["x"].to_list())
    runs = {("all", d): plus_plus(x, min(k, len(x)), np.random.default_rng([seed, d]), poisson_weights(sample[KEY], d)) for d in range(draws)}
    found = fit(points, runs, poisson_weights)
    return labelled(points, {key: f[0] for key, f in found.items()}, list(range(draws))).select(KEY, "labels")


def co_association(groups: DataFrame, block: int = 512) -> DataFrame:
    """Share of draws in which each two groups (name, labels) have the same label: token_a < token_b, share. Groups meet block by block."""
    rows = groups.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(max(1, -(-groups.count() // block)))).cast("int"))
    blocks = max(1, -(-groups.count() // block))
    meet = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "name", "labels")

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("name")
        labels, names, home = np.array(part["labels"].to_list()), part["name"].to_numpy(object), part["block"].to_numpy()
        same = sum((labels[:, None, d] == labels[None, :, d]).astype(float) for d in range(labels.shape[1])) / labels.shape[1]
        a, b = np.triu_indices(len(names), 1)
        keep = np.ones(len(a), bool) if part["i"].iloc[0] == part["j"].iloc[0] else home[a] != home[b]
        return pd.DataFrame({"token_a": names[a[keep]], "token_b": names[b[keep]], "share": same[a[keep], b[keep]]})

    return meet.groupBy("i", "j").applyInPandas(work, "token_a string, token_b string, share double")


def consensus(features: DataFrame, columns: list[str], k: int, draws: int = 10, seed: int = 42, start_rows: int = START_ROWS) -> DataFrame:
    """token_id, cluster (agreed on by all draws) and stability: the share of draws in which the token has the label that most of its cluster has.

    Tokens with the same labels in all draws are one group; groups that often share a label are joined by average linkage, weighted by their tokens, down to k."""
    labels = stored(bootstrap_labels(features, columns, k, draws, seed, start_rows).withColumn("name", F.array_join(F.transform("labels", lambda v: v.cast("string")), ".")), "draw-labels")
    groups = stored(labels.groupBy("name").agg(F.first("labels").alias("labels"), F.count("*").alias("n")), "draw-groups")
    distances = co_association(groups).select("token_a", "token_b", (1 - F.col("share")).alias("distance"))
    merges = merge_tree(distances, groups.select(F.col("name").alias(KEY), "n"))
    clusters = cut_tree(groups.select(F.col("name").alias(KEY)), merges, k).withColumnsRenamed({KEY: "name"})
    found = labels.join(clusters, "name")
    each = found.select("cluster", F.posexplode("labels").alias("draw", "label"))
    counts = each.groupBy("cluster", "draw", "label").agg(F.count("*").alias("n"))
    usual = counts.groupBy("cluster", "draw").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "label"))), lambda s: s["label"]).alias("usual"))
    found = found.join(usual, "cluster")
    agree = F.aggregate(F.zip_with("labels", "usual", lambda a, b: (a == b).cast("double")), F.lit(0.0), lambda acc, v: acc + v) / F.size("labels")
    return found.select(KEY, "cluster", agree.alias("stability"))


def silhouettes(points: DataFrame, label: str = "label") -> DataFrame:
    """Mean silhouette of each group by squared distances (points: g, x, label), from the clusters' counts and sums: one pass to sum, one to score. g, n, silhouette; null for one cluster."""
    size = len(points.select("x").first()[0]) if points.limit(1).count() else 0
    norm = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v)
    sums = points.groupBy("g", label).agg(F.count("*").alias("n"), F.sum(norm).alias("q"), F.array(*(F.sum(F.col("x")[j]) for j in range(size))).alias("s"))
    all_of = sums.groupBy("g").agg(F.collect_list(F.struct(F.col(label).alias("c"), "n", "q", "s")).alias("clusters"))
    rows = points.withColumn("_q", norm).join(all_of, "g")
    dot = lambda s: F.aggregate(F.zip_with("x", s, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    # sum of squared distances to a cluster's points: n |x|^2 - 2 x.s + q
    mean = F.transform("clusters", lambda c: F.struct(c["c"].alias("c"), c["n"].alias("n"), (c["n"] * F.col("_q") - 2 * dot(c["s"]) + c["q"]).alias("d")))
    rows = rows.withColumn("_m", mean)
    own = F.filter("_m", lambda c: c["c"] == F.col(label))[0]
    rows = rows.withColumns({"_a": F.when(own["n"] > 1, own["d"] / (own["n"] - 1)), "_b": F.array_min(F.transform(F.filter("_m", lambda c: c["c"] != F.col(label)), lambda c: c["d"] / c["n"]))})
    score = F.when(F.col("_a").isNull(), 0.0).when(F.greatest("_a", "_b") == 0, 0.0).otherwise((F.col("_b") - F.col("_a")) / F.greatest("_a", "_b"))
    return rows.groupBy("g").agg(F.count("*").alias("n"), F.avg(F.when(F.col("_b").isNotNull(), score)).alias("silhouette"))


#: Fixed value: differences of silhouette or agreement over this decide.
DECISIVE = 0.05


def unified_or_separate(features: DataFrame, columns: list[str], k: int, category: str = "category", starts: int = 3, seed: int = 42, start_rows: int = START_ROWS) -> DataFrame:
    """Clusters of all tokens together against clusters of each category alone: category, tokens, silhouettes of both labellings on the category's tokens, their adjusted Rand index, decision.

    All categories and the whole are fitted at once, from the same starts as by themselves. `separate` where its silhouette is better by over .05, `unified`
    where it is worse by over .05, else `either`. Categories of fewer than k + 1 tokens are left out."""
    from tickloom.operators.learning import adjusted_rand_by

    base = standardised(features, columns, (category,)).where(F.col(category).isNotNull())
    points = stored(base.withColumn("g", F.explode(F.array(F.lit("all"), F.concat(F.lit("="), F.col(category).cast("string"))))), "category-points")
    samples = {g: np.array(part["x"].to_list()) for g, part in _starts(points, start_rows).items()}
    samples = {g: x for g, x in samples.items() if len(x) > k}
    shape = f"{category} string, tokens long, silhouette_unified double, silhouette_separate double, ari double, decision string"
    if len(samples) < 2:
        return features.sparkSession.createDataFrame([], shape)
    runs = {(g, s): plus_plus(x, k, np.random.default_rng([seed, s])) for g, x in samples.items() for s in range(starts)}
    points = points.where(F.col("g").isin(list(samples)))
    found = fit(points, runs)
    best = {(g, 0): min((found[g, s] for s in range(starts)), key=lambda f: f[2].sum())[0] for g in samples}
    labels = stored(labelled(points, best, [0]).withColumn("label", F.col("labels")[0]).drop("labels"), "category-labels")
    alone = labels.where("g <> 'all'")
    both = alone.join(labels.where("g = 'all'").select(KEY, F.col("label").alias("unified")), KEY)
    ari = adjusted_rand_by(both, "g", "label", "unified")
    scores = silhouettes(both, "unified").select("g", F.col("silhouette").alias("silhouette_unified")).join(silhouettes(both, "label").select("g", F.col("n").alias("tokens"), F.col("silhouette").alias("silhouette_separate")), "g").join(ari, "g")
    better = F.coalesce("silhouette_separate", F.lit(0.0)) - F.coalesce("silhouette_unified", F.lit(0.0))
    decision = F.when(better > DECISIVE, "separate").when(better < -DECISIVE, "unified").otherwise("either")
    return scores.select(F.expr("substr(g, 2)").alias(category), "tokens", "silhouette_unified", "silhouette_separate", "ari", decision.alias("decision"))
