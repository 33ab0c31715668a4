"""Support for models: clusters and how to choose them, folds in time, and metrics."""

from __future__ import annotations

import math
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.rolling import col, whole, KEY, ratio, with_row
from tickloom.session import stored


def for_trees(c: Column | str) -> Column:
    """A column as trees take it: null and NaN as 0, infinite values as the largest finite ones of their sign, so that they keep their place in the order."""
    c = F.coalesce(F.nanvl(col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.least(c, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))


def _vectors(features: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip").transform(features.na.fill(0.0, columns))
    return StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="features").fit(rows).transform(rows).drop("_raw")


def kmeans(features: DataFrame, columns: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Adds `cluster` from standardised columns."""
    from pyspark.ml.clustering import KMeans

    rows = _vectors(features, columns)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(rows).drop("features")


def k_scan(features: DataFrame, columns: list[str], ks=range(2, 11), seed: int = 42) -> DataFrame:
    """Per k: cost, silhouette, and the Calinski-Harabasz index."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = _vectors(features, columns).cache()
    n = rows.count()
    total = float((n - 1) * len(columns))  # of standardised columns
    out = []
    for k in ks:
        if k >= n:
            break
        model = KMeans(k=k, seed=seed, predictionCol="prediction").fit(rows)
        cost = model.summary.trainingCost
        silhouette = ClusteringEvaluator().evaluate(model.transform(rows))
        out.append((k, float(cost), float(silhouette), float((total - cost) / (k - 1) / (cost / (n - k))) if cost and n > k else None))
    rows.unpersist()
    return features.sparkSession.createDataFrame(out, "k int, cost double, silhouette double, calinski_harabasz double")


def best_k(scan: DataFrame) -> DataFrame:
    return scan.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"), F.max("silhouette").alias("silhouette"))


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labellings, corrected for chance, from their contingency counts."""
    pair = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = labels.groupBy(a, b).agg(F.count("*").alias("c"))
    both = cells.agg(pair("c").alias("ij"), F.sum("c").alias("n"))
    left = cells.groupBy(a).agg(F.sum("c").alias("c")).agg(pair("c").alias("i"))
    right = cells.groupBy(b).agg(F.sum("c").alias("c")).agg(pair("c").alias("j"))
    out = both.crossJoin(F.broadcast(left)).crossJoin(F.broadcast(right))  # one row each
    chance = F.col("i") * F.col("j") / (F.col("n") * (F.col("n") - 1) / 2)
    return out.select(F.coalesce(ratio(F.col("ij") - chance, (F.col("i") + F.col("j")) / 2 - chance), F.lit(1.0)).alias("ari"))


def seed_stability(features: DataFrame, columns: list[str], k: int, seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adjusted Rand index between clusterings of different seeds."""
    rows = None
    for seed in seeds:
        one = kmeans(features, columns, k, seed).select(KEY, F.col("cluster").alias(f"c{seed}"))
        rows = one if rows is None else rows.join(one, KEY)
    out = None
    for i, x in enumerate(seeds):
        for y in seeds[i + 1 :]:
            part = adjusted_rand(rows, f"c{x}", f"c{y}").select(F.lit(x).alias("seed_a"), F.lit(y).alias("seed_b"), "ari")
            out = part if out is None else out.unionByName(part)
    return out


def adjusted_rand_by(labels: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """As adjusted_rand, within each group: group, ari."""
    pair = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = labels.groupBy(group, a, b).agg(F.count("*").alias("c"))
    both = cells.groupBy(group).agg(pair("c").alias("ij"), F.sum("c").alias("n"))
    left = cells.groupBy(group, a).agg(F.sum("c").alias("c")).groupBy(group).agg(pair("c").alias("i"))
    right = cells.groupBy(group, b).agg(F.sum("c").alias("c")).groupBy(group).agg(pair("c").alias("j"))
    out = both.join(left, group).join(right, group)
    chance = F.col("i") * F.col("j") / (F.col("n") * (F.col("n") - 1) / 2)
    return out.select(group, F.coalesce(ratio(F.col("ij") - chance, (F.col("i") + F.col("j")) / 2 - chance), F.lit(1.0)).alias("ari"))


def unified_against_category(features: DataFrame, columns: list[str], k: int, category: str = "category", seed: int = 42) -> DataFrame:
    """Per category: tokens, and the adjusted Rand index between clusters of all tokens together and clusters of the category's tokens alone.

    One clustering per category, so categories are meant to be few; one with fewer than k tokens is left out."""
    together = stored(kmeans(features, columns, k, seed).select(KEY, category, *columns, F.col("cluster").alias("unified")), "unified")
    out = None
    for name, n in sorted((r[0], r[1]) for r in together.groupBy(category).count().where(F.col(category).isNotNull()).collect()):
        if n < k:
            continue
        own = together.where(F.col(category) == name)
        both = own.select(KEY, "unified").join(kmeans(own.drop("unified"), columns, k, seed).select(KEY, "cluster"), KEY)
        part = adjusted_rand(both, "unified", "cluster").select(F.lit(name).alias(category), F.lit(n).alias("tokens"), "ari")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else features.sparkSession.createDataFrame([], f"{category} string, tokens int, ari double")


def early_rules(features: DataFrame, columns: list[str], label: str, depth: int = 5, leaf: int = 20):
    """A decision tree on early features; returns the model, whose debug string is the rules."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_y"), VectorAssembler(inputCols=columns, outputCol="_x"), DecisionTreeClassifier(labelCol="_y", featuresCol="_x", maxDepth=depth, minInstancesPerNode=leaf)]).fit(features.withColumns({c: for_trees(c) for c in columns}))


def rules_table(model, columns: list[str]) -> DataFrame:
    """A fitted tree's paths as rows: rule (leaves from left to right), feature, low and high (low < value <= high, null where open), class.

    A rule of a tree without splits has one row with a null feature. model: what early_rules gives; it has at most 2^depth leaves."""
    from pyspark.sql import SparkSession

    labels, tree = model.stages[0].labels, model.stages[-1]
    rows: list[tuple] = []

    def walk(node, bounds: dict):
        if node.getClass().getSimpleName() == "LeafNode":
            rule = len({r[0] for r in rows})
            rows.extend((rule, columns[f], low, high, labels[int(node.prediction())]) for f, (low, high) in sorted(bounds.items()))
            if not bounds:
                rows.append((rule, None, None, None, labels[int(node.prediction())]))
            return
        f, at = node.split().featureIndex(), float(node.split().threshold())
        low, high = bounds.get(f, (None, None))
        walk(node.leftChild(), bounds | {f: (low, at if high is None else min(at, high))})
        walk(node.rightChild(), bounds | {f: (at if low is None else max(at, low), high)})

    walk(tree._java_obj.rootNode(), {})
    return SparkSession.getActiveSession().createDataFrame(rows, "rule int, feature string, low double, high double, class string")


def apply_rules(features: DataFrame, rules: DataFrame) -> DataFrame:
    """features with `rule` and `class`, by one CASE over the rules' conditions (as many as the tree has leaves). Values that are not finite are taken as in the fit."""
    when: dict[int, list] = {}
    classes = {}
    for r in rules.collect():
        value = for_trees(r["feature"]) if r["feature"] is not None else None
        conditions = when.setdefault(r["rule"], [])
        conditions += [] if r["low"] is None else [value > r["low"]]
        conditions += [] if r["high"] is None else [value <= r["high"]]
        classes[r["rule"]] = r["class"]
    holds = lambda k: reduce(lambda a, b: a & b, when[k], F.lit(True))
    rule = F.coalesce(*(F.when(holds(k), F.lit(k)) for k in sorted(when)))
    return features.withColumn("rule", rule).withColumn("class", F.coalesce(*(F.when(F.col("rule") == k, F.lit(c)) for k, c in sorted(classes.items()))))


def rule_quality(features: DataFrame, rules: DataFrame, label: str) -> DataFrame:
    """The rules' rows with support (tokens that meet the rule) and purity (share of them with the rule's class)."""
    met = apply_rules(features, rules).groupBy("rule").agg(F.count("*").alias("support"), F.avg((F.col(label).cast("string") == F.col("class")).cast("double")).alias("purity"))
    return rules.join(met, "rule", "left").withColumn("support", F.coalesce("support", F.lit(0)))


def boosted_trees(train: DataFrame, columns: list[str], label: str, rounds: int = 30, depth: int = 4, seed: int = 42):
    """A gradient-boosted classifier of a 0/1 label, as one stage of a two-stage classifier or alone."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), GBTClassifier(labelCol=label, featuresCol="_x", maxIter=rounds, maxDepth=depth, seed=seed)]).fit(train.withColumns({c: for_trees(c) for c in columns}))


#: Presets of walk-forward splits as (least training rows, step, test rows), and which one a series takes below a length.
PRESETS = {
    "short": (240, 60, 60), "medium": (480, 120, 120), "long": (720, 180, 180), "very_long": (960, 240, 240), "memecoin_micro": (60, 30, 30),
    "memecoin_short": (120, 30, 30), "memecoin_medium": (180, 60, 60), "lightgbm_short_term": (120, 60, 60), "lightgbm_medium_term": (240, 120, 120),
}
ADAPTIVE = ((200, "memecoin_micro"), (400, "memecoin_short"), (600, "memecoin_medium"), (1200, "medium"), (1800, "long"), (None, "very_long"))


def adaptive_preset(n: Column | str) -> Column:
    """The name of the preset for a series of n rows."""
    n = F.col(n) if isinstance(n, str) else n
    return F.coalesce(*(F.when(n < below, name) if below else F.lit(name) for below, name in ADAPTIVE))


def fold_plan(n: Column, preset: str | tuple[int, int, int] | None = None, least_folds: int = 2) -> tuple[Column, Column, Column]:
    """Training rows, step and test rows of a series of n rows. Without a preset its length decides, and the step shrinks (to 30 rows at least) where it would give fewer than least_folds."""
    if preset:
        return tuple(F.lit(x) for x in (PRESETS[preset] if isinstance(preset, str) else preset))
    name = adaptive_preset(n)
    train, step, test = (F.coalesce(*(F.when(name == k, v[j]) for k, v in PRESETS.items())) for j in range(3))
    few = F.floor((n - train) / step) < least_folds
    fitted = F.greatest(F.floor((n - train) / least_folds), F.lit(30)).cast("int")
    return train, F.when(few, fitted).otherwise(step), F.when(few, fitted).otherwise(test)


def fold_table(n: int, train: int, step: int, test: int, buffer: int = 0, sliding: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(fold, train start, train end, test start, test end) as row ranges, ends exclusive; `buffer` rows lie between, so that targets don't reach over."""
    out, end = [], train
    while end + buffer + test <= n:
        out.append((len(out), end - train if sliding else 0, end, end + buffer, end + buffer + test))
        end += step
    return out


def walk_forward(s: DataFrame, preset: str | tuple[int, int, int] | None = None, buffer: int = 0, horizon: int = 0, sliding: bool = False, most_folds: int | None = None) -> DataFrame:
    """Rows with fold and role (train or test) for every fold: ranges of each token's own rows, so tokens never mix in time.

    preset: a name of PRESETS, (training rows, step, test rows), or None to go by each token's length. buffer: rows left out between
    training and test; horizon: rows left out at the end, whose labels would reach over it; sliding: training rows move on instead of
    adding up. most_folds: folds after which to stop, if given.

    Training rows that add up make a result that grows with the square of a series. Rows are numbered token by token, and then dealt out one by one, so
    that the folds of one series are laid out in all tasks; a row is laid out only in the folds that it may have a part in."""
    rows = with_row(s).withColumn("_n", F.count("*").over(whole()) - horizon)
    train, step, test = fold_plan(F.col("_n") + horizon, preset)
    rows = rows.withColumns({"_train": train, "_step": step, "_test": test})
    last = F.floor((F.col("_n") - buffer - F.col("_test") - F.col("_train")) / F.col("_step")).cast("int")
    if most_folds is not None:
        last = F.least(last, F.lit(most_folds - 1))
    if sliding:
        last = F.least(last, F.floor(F.col("rn") / F.col("_step")).cast("int"))
    first = F.greatest(F.lit(0), F.floor((F.col("rn") - buffer - F.col("_test") - F.col("_train")) / F.col("_step")).cast("int") + 1)
    rows = rows.withColumns({"_first": first, "_last": last}).repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), KEY, "rn")
    folds = F.when(F.col("_last") >= F.col("_first"), F.sequence("_first", "_last"))
    rows = rows.withColumn("fold", F.explode(folds)).withColumn("_end", F.col("fold") * F.col("_step") + F.col("_train"))
    start = F.col("_end") - F.col("_train") if sliding else F.lit(0)
    ahead = F.col("_end") + buffer
    role = F.when((F.col("rn") >= start) & (F.col("rn") < F.col("_end")), "train").when((F.col("rn") >= ahead) & (F.col("rn") < ahead + F.col("_test")), "test")
    return rows.withColumn("role", role).where(F.col("role").isNotNull()).drop("_n", "_end", "_train", "_step", "_test", "_first", "_last")


def confusion(df: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Counts, accuracy, precision, recall, F1 of 0/1 columns."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    out = df.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    out = out.withColumns({"accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), "precision": F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), "recall": F.coalesce(ratio("tp", F.col("tp") + F.col("fn")), F.lit(0.0))})
    return out.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def return_weighted(df: DataFrame, truth: str = "y_true", guess: str = "y_pred", ret: str = "ret") -> DataFrame:
    """Recall and precision with each row weighted by the size of its return, and the mean of their F1 with the plain F1."""
    t, g, w = F.col(truth) == 1, F.col(guess) == 1, F.abs(ret)
    s = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    out = df.agg(s(t & g).alias("hit"), s(t).alias("all"), s(g).alias("said"), F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    out = out.select(F.coalesce(ratio("hit", "all"), F.lit(0.0)).alias("weighted_recall"), F.coalesce(ratio("hit", "said"), F.lit(0.0)).alias("weighted_precision"), F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))
    weighted = F.coalesce(ratio(2 * F.col("weighted_recall") * F.col("weighted_precision"), F.col("weighted_recall") + F.col("weighted_precision")), F.lit(0.0))
    return out.withColumn("hybrid_f1", (weighted + F.col("f1")) / 2)


def roc_auc(df: DataFrame, truth: str = "y_true", score: str = "y_proba", ranges: int = 4096) -> DataFrame:
    """Area under the ROC curve from counts per score: first within ranges of scores, then over the ranges, so no task sees all scores."""
    from pyspark.sql import Window

    counts = df.groupBy(F.col(score).cast("double").alias("_s")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("n"))
    ends = counts.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    spread = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    counts = counts.crossJoin(F.broadcast(ends)).withColumn("_g", F.floor((F.col("_s") - F.col("_lo")) / spread * ranges))  # one row on the right
    whole_ranges = counts.groupBy("_g").agg(F.sum("n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over `ranges` rows at most
    whole_ranges = whole_ranges.select(F.col("_g").alias("_g2"), before.alias("_b"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_w", within).join(whole_ranges, F.col("_g") == F.col("_g2"))
    return counts.agg(ratio(F.sum(F.col("p") * (F.col("_b") + F.col("_w") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def trading_metrics(df: DataFrame, ret: str = "ret") -> DataFrame:
    """Sharpe, Sortino and win rate of a column of returns, with a yearly risk-free rate of 2 % over 252 days."""
    r = F.col(ret) - 0.02 / 252
    down = F.when(r < 0, r * r).otherwise(0.0)
    return df.agg((ratio(F.avg(r), F.stddev_samp(r)) * math.sqrt(252)).alias("sharpe"), (ratio(F.avg(r), F.sqrt(F.avg(down))) * math.sqrt(252)).alias("sortino"), F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"))
