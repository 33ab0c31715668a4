"""Two classifiers in a row: labels of later tokens never matter to earlier judgements, and planted classes are found."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import staged


@pytest.fixture(scope="module")
def tokens(spark):
    rng = random.Random(3)
    rows = []
    for k in range(240):
        short, long = rng.random() < 0.4, rng.random() < 0.5
        rows.append((f"t{k:03}", k // 2, rng.gauss(2.0 if short else 0.0, 0.5), rng.gauss(2.0 if long else 0.0, 0.5) if k % 30 else None, int(short), None if short else int(long)))
    return spark.createDataFrame(rows, "token_id string, at long, a double, b double, sprint int, marathon int")


HOW = {"folds": 4, "rounds": 3, "depth": 2}


@pytest.fixture(scope="module")
def tested(tokens):
    return staged.two_stage(tokens, ["a", "b"], "sprint", "marathon", "at", **HOW).collect()


def test_folds_go_by_time(tokens):
    rows = staged.time_folds(tokens, "at", 4).collect()
    ends = {f: ([r["at"] for r in rows if r.fold == f]) for f in range(4)}
    assert all(max(ends[f]) < min(ends[f + 1]) for f in range(3)) and all(50 <= len(v) <= 70 for v in ends.values())


def test_planted_classes_are_found(spark, tested):
    assert {r.fold for r in tested} == {2, 3} and all((r.found == 1) == (r.found_2 is None) for r in tested)
    got = {r.fold: r for r in staged.fold_metrics(spark.createDataFrame(tested), "sprint", "marathon").collect()}
    assert all(r.recall > 0.75 and r.precision > 0.75 and r.recall_2 > 0.7 and r.precision_2 > 0.7 and r.passed > 20 for r in got.values())


def test_labels_of_tested_tokens_never_reach_their_judges(tokens, tested):
    """Turning all labels of the last fold round changes no score, no threshold and no verdict there or before."""
    last = staged.time_folds(tokens, "at", 4).where("fold = 3").select("token_id")
    names = {r.token_id for r in last.collect()}
    turned = tokens.withColumns({c: F.when(F.col("token_id").isin(list(names)), 1 - F.coalesce(F.col(c), F.lit(1))).otherwise(F.col(c)).cast("int") for c in ("sprint", "marathon")})
    again = {r.token_id: r for r in staged.two_stage(turned, ["a", "b"], "sprint", "marathon", "at", **HOW).collect()}
    assert {r.token_id: (r.score, r.threshold, r.found, r.score_2) for r in tested} == {t: (r.score, r.threshold, r.found, r.score_2) for t, r in again.items()}


@pytest.mark.parametrize("recall", [0.5, 0.9, 1.0])
def test_threshold_reaches_the_recall(spark, recall):
    rng = random.Random(int(recall * 10))
    scores = [(round(rng.random(), 2), int(rng.random() < 0.5)) for _ in range(101)]
    t = staged.threshold_for(spark.createDataFrame(scores, "score double, y int"), "y", recall)
    ones = sorted(s for s, y in scores if y)
    reach = lambda v: sum(s >= v for s in ones) / len(ones)
    assert reach(t) >= recall and all(reach(v) < recall for v in ones if v > t)


def test_features_that_are_not_finite_are_judged(tokens):
    """Infinite features (returns after a price of zero) keep their side of a split, and no token is left out."""
    odd = tokens.withColumn("a", F.when((F.col("at") % 7 == 0) & (F.col("sprint") == 1), float("inf")).when(F.col("at") % 11 == 0, float("nan")).when((F.col("at") % 5 == 0) & (F.col("sprint") == 0), float("-inf")).otherwise(F.col("a")))
    rows = staged.two_stage(odd, ["a", "b"], "sprint", "marathon", "at", **HOW).collect()
    assert len(rows) == staged.time_folds(tokens, "at", 4).where("fold > 1").count() and all(r.score == r.score for r in rows)
    score = {r.token_id: r.score for r in rows}
    sides = {s: [score[r.token_id] for r in odd.where(F.col("a") == s).collect() if r.token_id in score] for s in (float("inf"), float("-inf"))}
    assert min(sides[float("inf")]) > max(sides[float("-inf")])
