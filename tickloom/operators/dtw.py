"""Dynamic time warping over whole series of different lengths, and the merge tree of average linkage.

Series meet block by block, as whole arrays. Where only neighbours within a distance are wanted, an envelope of the one series bounds the
distance of the other from below, and the warping itself is left out where that bound is too large. The merge tree is made in rounds: all
clusters that are each other's nearest merge at once, which for average linkage gives the same tree as one merge after the other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.rolling import KEY, PRICE, TIE, TIME
from tickloom.session import stored

#: Rows that a series needs, and the band as a share of the longer series, with its least width.
LEAST_ROWS, BAND, LEAST_BAND = 50, 0.1, 10
#: Cells that two blocks make at most if they are more than one series each, tokens up to which blocks are numbered by name, and tasks for meetings of blocks.
WORK, NUMBERED, TASKS = 1e9, 10_000, 4096


def band_of(n: int, m: int, band: float = BAND) -> int:
    return max(LEAST_BAND, int(band * max(n, m)))


def warped(x: np.ndarray, y: np.ndarray, window: int) -> float:
    """Square root of the least sum of squared differences along a path that stays less than `window` steps off the band between the two corner diagonals.

    Cells of one anti-diagonal don't depend on each other, so each is one step."""
    n, m = len(x), len(y)
    if not n or not m:
        return float("inf")
    low, high = max(0, n - m) + window - 1, max(0, m - n) + window - 1  # j from i - low to i + high
    before, last, now = (np.full(n + 2, np.inf) for _ in range(3))  # by i, of the two diagonals before and this one
    before[0] = 0.0  # the corner that a path starts from
    back = np.ascontiguousarray(y[::-1])
    steps, least = np.empty(n), np.empty(n)
    for d in range(2, n + m + 1):  # i + j, both counted from 1
        # j = d - i lies in [i - low, i + high] and in [1, m]
        a, b = max(1, d - m, -((high - d) // 2)), min(n, d - 1, (d + low) // 2)
        # the ends of a diagonal move by one at most, so the next two look no farther than the cells beside it
        now[a - 1] = now[b + 1] = np.inf
        if a <= b:
            step, low_three = steps[: b - a + 1], least[: b - a + 1]
            np.subtract(x[a - 1 : b], back[m - d + a : m - d + b + 1], out=step)
            np.multiply(step, step, out=step)
            np.minimum(last[a - 1 : b], last[a : b + 1], out=low_three)
            np.minimum(low_three, before[a - 1 : b], out=low_three)
            np.add(step, low_three, out=now[a : b + 1])
        before, last, now = last, now, before
    return float(np.sqrt(last[n]))


def envelope_bound(x: np.ndarray, y: np.ndarray, window: int) -> float:
    """A lower bound of warped(x, y, window): what x leaves the envelope of y by, at the places that each of its values may meet."""
    n, m = len(x), len(y)
    low, high = max(0, n - m) + window - 1, max(0, m - n) + window - 1
    reach = lambda beyond: np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(low, beyond), y, np.full(high + max(0, n - m), beyond)]), low + high + 1)[:n]
    top, least = reach(-np.inf).max(1), reach(np.inf).min(1)
    out = np.where(x > top, x - top, np.where(x < least, least - x, 0.0))
    return float(np.sqrt((out * out).sum()))


def dtw_distances(s: DataFrame, log: bool = True, least: int = LEAST_ROWS, band: float = BAND, most: float | None = None, block: int = 32) -> DataFrame:
    """Warping distance of each two tokens' whole series, of (log) prices brought to mean 0 and deviation 1: token_a < token_b, distance.

    block: tokens of a block at most; of long series a block has fewer, so that no two blocks make more than about WORK cells, down to one pair.
    Tokens with fewer than `least` rows are left out. most: only pairs within this distance; the others' bounds spare most of the work."""
    value = F.log(PRICE) if log else F.col(PRICE).cast("double")
    rows = s.withColumn("_v", value).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    whole = rows.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(TIME, TIE, "_v"))).alias("x")).where(F.size("x") >= least)
    whole = whole.select(KEY, F.transform("x", lambda r: r["_v"]).alias("x"))
    whole = stored(whole, "dtw-series")
    found = whole.agg(F.count("*").alias("n"), F.avg(F.size("x").cast("double") * F.size("x")).alias("square")).first()
    block = max(1, min(block, int(math.sqrt(WORK / max(1.0, 2 * band * (found.square or 0.0))))))
    blocks = max(1, -(-found.n // block))
    if found.n <= NUMBERED:  # few tokens: even blocks
        number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(KEY)) - 1
        whole = whole.join(F.broadcast(whole.select(KEY).withColumn("block", F.floor(number / block).cast("int"))), KEY)
    else:
        whole = whole.withColumn("block", F.pmod(F.xxhash64(KEY), F.lit(blocks)).cast("int"))
    whole = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    meet = whole.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", KEY, "x")

    def plain(x) -> np.ndarray:
        x = np.asarray(x, float)
        sd = x.std()
        return (x - x.mean()) / sd if sd > 0 else x

    def meeting(part: pd.DataFrame) -> pd.DataFrame:
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        series = sorted((t, b, plain(x)) for t, b, x in zip(part[KEY], part["block"], part["x"], strict=True))
        out = []
        for k, (a, block_a, x) in enumerate(series):
            for b, block_b, y in series[k + 1 :]:
                if i != j and block_a == block_b:
                    continue
                window = band_of(len(x), len(y), band)
                if most is not None and max(envelope_bound(x, y, window), envelope_bound(y, x, window)) > most:
                    continue
                distance = warped(x, y, window)
                if most is None or distance <= most:
                    out.append((a, b, distance))
        return pd.DataFrame(out, columns=["token_a", "token_b", "distance"])

    def work(parts):
        held: list[pd.DataFrame] = []
        for part in parts:
            for at, rows in part.groupby(["i", "j"], sort=True):
                if held and at != (held[0]["i"].iloc[0], held[0]["j"].iloc[0]):
                    yield meeting(pd.concat(held))
                    held = []
                held.append(rows)
        if held:
            yield meeting(pd.concat(held))

    # two blocks go to a task of their own, as far as there are TASKS; small or not, tasks are not merged
    meetings = blocks * (blocks + 1) // 2
    place = F.col("j").cast("long") * (F.col("j") + 1) / 2 + F.col("i")
    meet = meet.repartitionById(min(meetings, TASKS), F.pmod(place.cast("long"), F.lit(TASKS)).cast("int")).sortWithinPartitions("i", "j")
    return meet.mapInPandas(work, "token_a string, token_b string, distance double")


def merge_tree(distances: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Average linkage of all tokens of a table of all pairs (token_a < token_b, distance): keep, gone (clusters go by their first token), height, size, round.

    sizes: token_id and n, where a name stands for n tokens.
    Each round joins the clusters that are each other's nearest, ties by name, and averages distances over the members; it is one aggregate
    over the pairs that are left, which become a quarter in each round where half of the clusters merge."""
    order = lambda d, a, b: F.struct(d, F.least(a, b), F.greatest(a, b))
    pairs = distances.select(F.col("token_a").alias("a"), F.col("token_b").alias("b"), F.col("distance").alias("d"))
    if sizes is None:
        pairs = pairs.withColumns({"na": F.lit(1).cast("long"), "nb": F.lit(1).cast("long")})
    else:
        pairs = pairs.join(sizes.select(F.col(KEY).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(KEY).alias("b"), F.col("n").alias("nb")), "b").select("a", "b", "d", "na", "nb")
    pairs = stored(pairs, "merge-pairs")
    merges, number = None, 0
    while pairs.limit(1).count():
        ends = pairs.select(F.col("a").alias("c"), order("d", "a", "b").alias("best"), "na", "nb").unionByName(pairs.select(F.col("b").alias("c"), order("d", "a", "b").alias("best"), "na", "nb"))
        nearest = ends.groupBy("c").agg(F.min_by(F.struct("best", "na", "nb"), "best").alias("n"))
        # a pair that both ends name is mutual
        mutual = nearest.groupBy(F.col("n.best.d").alias("height"), F.col("n.best.col2").alias("keep"), F.col("n.best.col3").alias("gone")).agg(F.count("*").alias("k"), F.first(F.col("n.na") + F.col("n.nb")).alias("size")).where("k = 2")
        mutual = stored(mutual.select("keep", "gone", "height", "size", F.lit(number).alias("round")), "merges")
        merges = mutual if merges is None else merges.unionByName(mutual)
        into = mutual.select("gone", "keep")
        named = pairs.join(into.withColumnsRenamed({"gone": "a", "keep": "ka"}), "a", "left").join(into.withColumnsRenamed({"gone": "b", "keep": "kb"}), "b", "left")
        named = named.select(F.coalesce("ka", "a").alias("x"), F.coalesce("kb", "b").alias("y"), "d", "na", "nb").where(F.col("x") != F.col("y"))
        flip = F.col("x") > F.col("y")
        named = named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d", F.when(flip, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(flip, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        joined = named.groupBy("a", "b").agg((F.sum(F.col("d") * F.col("na") * F.col("nb")) / F.sum(F.col("na") * F.col("nb"))).alias("d"))
        sizes = mutual.select(F.col("keep").alias("c"), "size")
        single = named.select(F.col("a").alias("c"), F.col("na").alias("n")).unionByName(named.select(F.col("b").alias("c"), F.col("nb").alias("n"))).groupBy("c").agg(F.max("n").alias("n"))
        sizes = single.join(sizes, "c", "left").select("c", F.coalesce("size", "n").alias("n"))
        pairs = stored(joined.join(sizes.withColumnsRenamed({"c": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"c": "b", "n": "nb"}), "b").select("a", "b", "d", "na", "nb"), "merge-pairs")
        number += 1
    return merges if merges is not None else distances.sparkSession.createDataFrame([], "keep string, gone string, height double, size long, round int")


def cut_tree(tokens: DataFrame, merges: DataFrame, k: int) -> DataFrame:
    """The k clusters that the tree has before its last k - 1 merges: token_id, cluster (the first token of each).

    The way up from each token is followed by pointer jumping: as many joins as the logarithm of the longest way."""
    every = tokens.select(KEY).distinct()
    allowed = max(0, every.count() - k)
    up = merges.orderBy("height", "round", "keep", "gone").limit(allowed).select("gone", "keep")
    labels = stored(every.join(up, F.col(KEY) == F.col("gone"), "left").select(KEY, F.coalesce("keep", KEY).alias("cluster")), "tree-labels")
    while True:
        onward = labels.select(F.col(KEY).alias("cluster"), F.col("cluster").alias("further"))
        labels = stored(labels.join(onward, "cluster").select(KEY, F.col("further").alias("cluster"), (F.col("further") != F.col("cluster")).alias("_moved")), "tree-labels")
        if not labels.where("_moved").limit(1).count():
            return labels.select(KEY, "cluster")


def dtw_clusters(s: DataFrame, k: int = 5, **how) -> DataFrame:
    """Clusters of average linkage over warping distances, and each cluster's lengths: token_id, cluster, rows, n_tokens, avg_rows, std_rows."""
    distances = stored(dtw_distances(s, **how), "dtw-distances")
    least = how.get("least", LEAST_ROWS)
    lengths = s.groupBy(KEY).agg(F.count("*").alias("rows")).where(F.col("rows") >= least)
    found = cut_tree(lengths, merge_tree(distances), k).join(lengths, KEY)
    own = Window.partitionBy("cluster")
    return found.withColumns({"n_tokens": F.count("*").over(own), "avg_rows": F.avg("rows").over(own), "std_rows": F.stddev_pop("rows").over(own)})
