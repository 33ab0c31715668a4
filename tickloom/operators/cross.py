"""Across series: alignment, correlation, its dynamics, and principal components. Series stay long; pairs come from joins on the time key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.rolling import correlation, from_here, KEY, PRICE, so_far, TIE, TIME, pct_change, ratio, with_row, ln, quotient


def minute_first(s: DataFrame, minutes: int = 1) -> DataFrame:
    """One row per token and bucket of minutes: the first price in it."""
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(TIME)) / (60 * minutes)) * (60 * minutes))
    return s.groupBy(KEY, bucket.alias("bucket")).agg(F.min_by(PRICE, F.struct(TIME, TIE)).alias(PRICE))


def common_range(s: DataFrame) -> DataFrame:
    """Rows within the time range that all tokens cover. The limits are one row."""
    ends = s.groupBy(KEY).agg(F.min(TIME).alias("a"), F.max(TIME).alias("b")).agg(F.max("a").alias("_a"), F.min("b").alias("_b"))
    return s.crossJoin(F.broadcast(ends)).where((F.col(TIME) >= F.col("_a")) & (F.col(TIME) <= F.col("_b"))).drop("_a", "_b")


def aligned_outer(s: DataFrame, minutes: int = 60) -> DataFrame:
    """Every bucket that any token has, for every token, filled forward, then backward."""
    rows = minute_first(s, minutes)
    grid = rows.select("bucket").distinct().crossJoin(rows.select(KEY).distinct())  # tokens x buckets is the result's own size
    along = Window.partitionBy(KEY).orderBy("bucket")
    full = grid.join(rows, [KEY, "bucket"], "left")
    ahead = F.last(PRICE, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    back = F.last(PRICE, ignorenulls=True).over(Window.partitionBy(KEY).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0))
    return full.select(KEY, "bucket", F.coalesce(ahead, back).alias(PRICE))


def lifecycle(s: DataFrame) -> DataFrame:
    """Series aligned by row since launch."""
    return with_row(s).select(KEY, "rn", PRICE)


def _pairs(rows: DataFrame, at: str, value: str) -> DataFrame:
    a = rows.select(F.col(KEY).alias("token_a"), F.col(at), F.col(value).alias("x"))
    b = rows.select(F.col(KEY).alias("token_b"), F.col(at), F.col(value).alias("y"))
    return a.join(b, at).where(F.col("token_a") < F.col("token_b"))


def strength(c):
    """Label of a correlation's size."""
    size = F.abs(c)
    return F.when(size >= 0.8, "very_strong").when(size >= 0.6, "strong").when(size >= 0.4, "moderate").when(size >= 0.2, "weak").otherwise("very_weak")


def corr_pairs(s: DataFrame, minutes: int = 60, least: int = 30) -> DataFrame:
    """Pearson correlation of log returns of all pairs that share at least `least` buckets."""
    along = Window.partitionBy(KEY).orderBy("bucket")
    rows = minute_first(s, minutes).withColumn("r", ln(quotient(PRICE, F.lag(PRICE).over(along)))).where(F.col("r").isNotNull())
    out = _pairs(rows, "bucket", "r").groupBy("token_a", "token_b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("correlation")).where(F.col("n") >= least)
    return out.withColumn("strength", strength(F.col("correlation")))


def significant(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    return pairs.where(F.abs("correlation") >= least)


def corr_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("pairs"), F.avg("correlation").alias("mean"), F.max("correlation").alias("max"), F.min("correlation").alias("min"), F.stddev_samp("correlation").alias("std"), F.count_if(F.abs("correlation") >= 0.5).alias("strong"))


def _aligned_pairs(s: DataFrame, most: int | None) -> DataFrame:
    """Prices x and y of each two tokens by row since launch: all rows, or the first `most`."""
    rows = lifecycle(s)
    return _pairs(rows if most is None else rows.where(F.col("rn") < most), "rn", PRICE)


def spearman_pairs(s: DataFrame, most: int | None = None) -> DataFrame:
    """Correlation of average ranks of prices by row since launch, over all rows that both tokens have, or the first `most`."""
    pairs = _aligned_pairs(s, most)

    def rank(c: str):
        w = Window.partitionBy("token_a", "token_b")
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy("token_a", "token_b", c)) - 1) / 2.0

    ranked = pairs.withColumns({"_rx": rank("x"), "_ry": rank("y")})
    return ranked.groupBy("token_a", "token_b").agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("spearman"))


def kendall_pairs(s: DataFrame, most: int | None = None, rows: int = 250_000) -> DataFrame:
    """Kendall's tau-b by row since launch, over all pairs of rows of a pair of tokens, or those of the first `most` rows.

    Discordant pairs are inversions, counted bit by bit of the ranks: n log n, not n squared. Prices are cut into ranges of about `rows` rows of a token,
    with a range of its own for a price that is an edge; Python gets one range of a pair of tokens at a time. Two rows whose prices lie in different ranges
    on both sides are compared by the numbers of rows in the cells of ranges; others meet in the range that they share on the left, or else on the right."""
    import numpy as np
    import pandas as pd

    def inversions(ranks: np.ndarray) -> int:
        """Pairs of places whose later value is less. In each group of equal higher bits: the ones before each zero."""
        found, at = 0, ranks
        for bit in reversed(range(int(ranks.max(initial=0)).bit_length())):
            high, one = at >> (bit + 1), (at >> bit) & 1
            ones = np.cumsum(one) - one
            start = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
            since = ones - np.repeat(ones[start], np.diff(np.append(start, len(at))))
            found += int(since[one == 0].sum())
            at = at[np.argsort(at >> bit, kind="stable")]
        return found

    def every(n):
        return n * (n - 1) // 2

    def equal(v: np.ndarray) -> int:
        """Pairs of rows with the same value."""
        return int(every(np.unique(v, return_counts=True)[1]).sum())

    def codes(v: np.ndarray) -> np.ndarray:
        return np.unique(v, return_inverse=True)[1].astype(np.int64)

    sums = ("has_x", "has_y", "both", "all_x", "all_y", "same_x", "same_y", "same", "inv")
    shape = "token_a string, token_b string, n long, " + ", ".join(f"{c} long" for c in sums)

    def row(part: pd.DataFrame, n: int = 0, **found) -> pd.DataFrame:
        return pd.DataFrame([[part["token_a"].iloc[0], part["token_b"].iloc[0], n, *(found.get(c, 0) for c in sums)]], columns=["token_a", "token_b", "n", *sums])

    def within(part: pd.DataFrame) -> pd.DataFrame:
        """Rows of one range of prices of the left or the right token, the other's price being any."""
        left = part["side"].iloc[0] == 0
        own, other = ("x", "y") if left else ("y", "x")
        there = part[f"_b{other}"].to_numpy() >= 0
        v = codes(part[own].to_numpy(float))
        both, a = part[there], v[there]
        if left:
            b = codes(both["y"].to_numpy(float))
            return row(part, inv=inversions(b[np.lexsort((b, a))]), all_x=equal(v), same_x=equal(a), same=equal(a * (b.max(initial=0) + 1) + b))
        far = both["_bx"].to_numpy(np.int64)
        edge = far % 2 == 1  # one price on the left, which has no range of its own in Python
        return row(part, inv=inversions(a[np.lexsort((a, far))]), all_y=equal(v), same_y=equal(a), same=equal(far[edge] * (a.max(initial=0) + 1) + a[edge]))

    def across(part: pd.DataFrame) -> pd.DataFrame:
        """Numbers of rows by range on both sides: what they tell without the rows."""
        bx, by, c = (part[name].to_numpy(np.int64) for name in ("_bx", "_by", "c"))
        count = np.zeros((max(bx.max(), 0) + 1, max(by.max(), 0) + 1), np.int64)
        full = (bx >= 0) & (by >= 0)
        count[bx[full], by[full]] = c[full]
        later = np.cumsum(count[::-1], 0)[::-1]  # rows in this range on the left or a later one
        below = np.cumsum(later, 1) - later  # and on the right in a lesser one
        inv = int((count[:-1] * below[1:]).sum())
        edges = lambda n, own, keep: int(sum(every(int(c[(own == k) & keep].sum())) for k in range(1, n, 2)))
        n, m = count.shape
        has = {"has_x": int(c[bx >= 0].sum()), "has_y": int(c[by >= 0].sum()), "both": int(c[full].sum())}
        return row(part, int(c.sum()), inv=inv, **has, all_x=edges(n, bx, bx >= 0), same_x=edges(n, bx, full), all_y=edges(m, by, by >= 0), same_y=edges(m, by, full), same=int(every(count[1::2, 1::2]).sum()))

    prices = lifecycle(s).withColumn(PRICE, F.nanvl(F.col(PRICE).cast("double"), F.lit(None).cast("double")))
    prices = prices if most is None else prices.where(F.col("rn") < most)
    longest = prices.groupBy(KEY).agg(F.count(PRICE).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-longest // rows))
    cuts = [k / parts for k in range(1, parts)]
    edges = prices.groupBy(KEY).agg((F.sort_array(F.array_distinct(F.percentile_approx(PRICE, cuts, max(10_000, 100 * parts)))) if cuts else F.array().cast("array<double>")).alias("_e"))
    place = F.when(F.col(PRICE).isNull(), -1).otherwise(2 * F.size(F.filter("_e", lambda e: e < F.col(PRICE))) + F.array_contains("_e", F.col(PRICE)).cast("int"))
    placed = prices.join(edges, KEY).withColumn("_b", F.coalesce(place, F.lit(-1)).cast("int"))
    a, b = (placed.select(F.col(KEY).alias(token), "rn", F.col(PRICE).alias(v), F.col("_b").alias(f"_b{v}")) for token, v in (("token_a", "x"), ("token_b", "y")))
    pairs = a.join(b, "rn").where(F.col("token_a") < F.col("token_b")).drop("rn")
    sides = F.inline(F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"_b{v}").alias("range")) for k, v in enumerate("xy"))))
    ranged = pairs.select("*", sides).where("range % 2 = 0")  # neither missing nor an edge
    found = ranged.groupBy("token_a", "token_b", "side", "range").applyInPandas(within, shape)
    cells = pairs.groupBy("token_a", "token_b", "_bx", "_by").agg(F.count("*").alias("c")).groupBy("token_a", "token_b").applyInPandas(across, shape)
    total = found.unionByName(cells).groupBy("token_a", "token_b").agg(*(F.sum(c).alias(c) for c in ("n", *sums)))
    every_pair = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    score = every_pair("both") - F.col("same_x") - F.col("same_y") + F.col("same") - 2 * F.col("inv")
    untied = [(every_pair(f"has_{v}") - F.col(f"all_{v}")).cast("double") for v in "xy"]
    return total.select("token_a", "token_b", "n", ratio(score, F.sqrt(untied[0] * untied[1])).alias("kendall"))


def corr_rolling_pairs(s: DataFrame, minutes: int = 60, n: int = 60) -> DataFrame:
    """Correlation of prices of each pair over its last n shared buckets."""
    w = Window.partitionBy("token_a", "token_b").orderBy("bucket").rowsBetween(-(n - 1), 0)
    pairs = _pairs(minute_first(s, minutes), "bucket", PRICE)
    out = pairs.withColumn("correlation", F.when(F.count("*").over(w) >= n, correlation("x", "y", w)))
    return out.select("token_a", "token_b", "bucket", "correlation")


def normalised(s: DataFrame) -> DataFrame:
    """Prices by the first price, and by median and quartile range."""
    q = s.groupBy(KEY).agg(F.percentile(PRICE, 0.25).alias("_a"), F.percentile(PRICE, 0.5).alias("_m"), F.percentile(PRICE, 0.75).alias("_b"))
    return s.join(q, KEY).withColumns({"by_first": quotient(PRICE, F.first(PRICE).over(so_far())), "robust": ratio(F.col(PRICE) - F.col("_m"), F.col("_b") - F.col("_a"))}).drop("_a", "_m", "_b")


def edges(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """The correlation network as rows: both ends and the weight."""
    return significant(pairs, least).select(F.col("token_a").alias("source"), F.col("token_b").alias("target"), F.abs("correlation").alias("weight"))


def pca(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Standardised columns on their k first principal components: adds `components` (array). Columns with nulls drop the row."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip").transform(df)
    rows = StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_std").fit(rows).transform(rows)
    rows = PCA(k=k, inputCol="_std", outputCol="_pc").fit(rows).transform(rows)
    return rows.withColumn("components", vector_to_array("_pc")).drop("_raw", "_std", "_pc")


def pca_summary(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k first principal components of standardised columns: component (from 1), explained (share of the variance), column, loading.

    From the columns' correlations, which are sums over all rows, and as many as columns by columns; rows with a null are left out. A
    component's largest loading is positive."""
    import numpy as np

    there = df.dropna(subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    found = there.agg(*(F.corr(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    matrix = np.eye(len(columns))
    for i, j in pairs:
        v = found[f"c{i}_{j}"]
        matrix[i, j] = matrix[j, i] = 0.0 if v is None or v != v else v
    values, vectors = np.linalg.eigh(matrix)
    rows = []
    for c, e in enumerate(np.argsort(-values, kind="stable")[:k]):
        v = vectors[:, e] * (np.sign(vectors[np.abs(vectors[:, e]).argmax(), e]) or 1.0)
        rows += [(c + 1, float(values[e] / len(columns)), name, float(x)) for name, x in zip(columns, v, strict=True)]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, column string, loading double")


def token_matrix(s: DataFrame, buckets: int = 24) -> DataFrame:
    """A row per token, a column per early row: simple returns, for clustering and PCA."""
    rows = with_row(s).withColumn("r", pct_change()).where((F.col("rn") >= 1) & (F.col("rn") <= buckets))
    return rows.groupBy(KEY).pivot("rn", list(range(1, buckets + 1))).agg(F.first("r")).withColumnsRenamed({str(k): f"r{k}" for k in range(1, buckets + 1)})
