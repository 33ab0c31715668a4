"""Two classifiers in a row over folds in time: the first finds what is over soon, the second sorts what it lets pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.rolling import KEY, ratio
from tickloom.operators.learning import for_trees
from tickloom.session import stored


def time_folds(tokens: DataFrame, at: str, folds: int) -> DataFrame:
    """fold: 0 to `folds` - 1 by time, about as many tokens each, and no time in two folds. Only counts by time are ordered in one place."""
    times = tokens.groupBy(at).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    times = times.withColumn("_b", before).withColumn("fold", F.least(F.floor(F.col("_b") * folds / F.sum("_n").over(Window.partitionBy())), F.lit(folds - 1)).cast("int"))
    return tokens.join(times.select(F.col(at).alias("_t"), "fold"), F.col(at).eqNullSafe(F.col("_t"))).drop("_t")


def _scored(train: DataFrame, test: DataFrame, columns: list[str], label: str, rounds: int, depth: int, seed: int) -> DataFrame:
    """token_id and score (probability of 1) of test, by a boosted model of train with classes of equal weight. Values that are not finite are taken by for_trees. One class in train: its share."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    train = train.where(F.col(label).isNotNull())
    seen = train.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("ones")).first()
    if not seen.n or not 0 < seen.ones < seen.n:
        return test.select(KEY, F.lit(float(seen.ones / seen.n) if seen.n else 0.5).alias("score"))
    filled = lambda d: d.select(KEY, *(for_trees(c).alias(c) for c in columns), *([F.col(label).cast("double").alias("_y")] if label in d.columns else []))
    weighted = filled(train).withColumn("_w", F.when(F.col("_y") == 1, seen.n / (2 * seen.ones)).otherwise(seen.n / (2 * (seen.n - seen.ones))))
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), GBTClassifier(labelCol="_y", weightCol="_w", featuresCol="_x", maxIter=rounds, maxDepth=depth, seed=seed)]).fit(weighted)
    return model.transform(filled(test)).select(KEY, vector_to_array("probability")[1].alias("score"))


def threshold_for(scores: DataFrame, label: str, recall: float) -> float:
    """The greatest score at which at least `recall` of the rows of label 1 still lie at or above; 0.5 where there are none."""
    found = scores.where(F.col(label) == 1).agg(F.expr(f"percentile_disc({1 - recall}) WITHIN GROUP (ORDER BY score)").alias("t")).first().t
    return 0.5 if found is None else float(found)


def two_stage(tokens: DataFrame, columns: list[str], first: str, second: str, at: str, folds: int = 4, recall: float = 0.9, rounds: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    """Per token that is tested: fold, score and found (the first stage's), score_2 and found_2 (the second's, null where the first stage has found it), and the labels.

    Tokens go by time into folds. The model of a fold is trained on the folds before it; its scores of the fold itself are out of fold and give the threshold
    that reaches `recall`, and with this threshold the same model judges the next fold (another model's scores would lie elsewhere). The second stage is trained
    on the earlier tokens that the first let pass, by their out-of-fold scores. No token's labels reach a model, threshold or training set that judges it.
    first, second: 0/1 columns; rows whose second label is null don't train the second stage."""
    rows = stored(time_folds(tokens, at, folds), "two-stage")
    out, passed = [], []
    for f in range(2, folds):
        both = rows.where(F.col("fold").isin(f - 1, f))
        scores = _scored(rows.where(F.col("fold") < f - 1), both.drop(first, second), columns, first, rounds, depth, seed)
        scores = stored(scores.join(both, KEY), "two-stage-scores")
        limit = threshold_for(scores.where(F.col("fold") == f - 1), first, recall)
        passed.append(scores.where((F.col("fold") == f - 1) & (F.col("score") < limit)).drop("score"))
        now = scores.where(F.col("fold") == f)
        passing = now.where(F.col("score") < limit).drop("score", first, second)
        further = _scored(reduce(DataFrame.unionByName, passed), passing, columns, second, rounds, depth, seed).withColumnRenamed("score", "score_2")
        found = now.withColumn("found", (F.col("score") >= limit).cast("int")).withColumn("threshold", F.lit(limit)).join(further, KEY, "left")
        out.append(found.select(KEY, "fold", first, second, "threshold", "score", "found", "score_2", (F.col("score_2") >= 0.5).cast("int").alias("found_2")))
    return reduce(DataFrame.unionByName, out)


def fold_metrics(tested: DataFrame, first: str, second: str) -> DataFrame:
    """Per fold: tokens, recall, precision and F1 of the first stage; tokens that pass it, and recall, precision and false negative rate of the second on those with a label."""
    hit = lambda t, g: F.count_if((F.col(t) == 1) & (F.col(g) == 1))
    ones = lambda c: F.count_if(F.col(c) == 1)
    judged = F.when(F.col("found_2").isNotNull(), F.col(second))
    rows = tested.withColumn("_truth", judged).withColumn("_guess", F.when(judged.isNotNull(), F.col("found_2")))
    out = rows.groupBy("fold").agg(
        F.count("*").alias("tokens"), ratio(hit(first, "found"), ones(first)).alias("recall"), ratio(hit(first, "found"), ones("found")).alias("precision"), F.count("found_2").alias("passed"),
        ratio(hit("_truth", "_guess"), ones("_truth")).alias("recall_2"), ratio(hit("_truth", "_guess"), ones("_guess")).alias("precision_2"),
    )
    f1 = lambda p, r: ratio(2 * F.col(p) * F.col(r), F.col(p) + F.col(r))
    return out.withColumns({"f1": f1("precision", "recall"), "f1_2": f1("precision_2", "recall_2"), "false_negative_rate_2": 1 - F.col("recall_2")})
