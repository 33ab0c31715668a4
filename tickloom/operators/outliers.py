"""Outlier detectors over a whole series or over a rolling window, their consensus, and winsorizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.rolling import whole, KEY, PRICE, mean, quantile, quantile_nearest, quotient, ratio, std, with_returns


def _whole(s: DataFrame, c: str, **quantiles: float) -> DataFrame:
    """Joins percentiles of each token's column c."""
    return s.join(s.groupBy(KEY).agg(*(F.percentile(c, q).alias(n) for n, q in quantiles.items())), KEY)


def winsor(s: DataFrame, c: str = PRICE, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Outside two percentiles: flag, capped value, and how far out relative to the cap."""
    out = _whole(s, c, _lo=low, _hi=high)
    capped = F.greatest(F.least(F.col(c), F.col("_hi")), F.col("_lo"))
    return out.withColumns({"is_outlier": (F.col(c) < F.col("_lo")) | (F.col(c) > F.col("_hi")), "capped": capped, "magnitude": F.abs(quotient(F.col(c) - capped, capped))}).drop("_lo", "_hi")


def zscore(s: DataFrame, c: str = PRICE, threshold: float = 3.0) -> DataFrame:
    z = ratio(F.col(c) - F.avg(c).over(whole()), F.stddev_samp(c).over(whole()))
    return s.withColumn("z", z).withColumn("is_outlier", F.coalesce(F.abs("z") > threshold, F.lit(False)))


def iqr(s: DataFrame, c: str = PRICE, multiplier: float = 1.5) -> DataFrame:
    out = _whole(s, c, _q1=0.25, _q3=0.75)
    wide = multiplier * (F.col("_q3") - F.col("_q1"))
    return out.withColumn("is_outlier", (F.col(c) < F.col("_q1") - wide) | (F.col(c) > F.col("_q3") + wide)).drop("_q1", "_q3")


def modified_z(s: DataFrame, c: str = PRICE, threshold: float = 3.5) -> DataFrame:
    """0.6745 * (x - median) / median absolute deviation."""
    out = _whole(s, c, _med=0.5).withColumn("_dev", F.abs(F.col(c) - F.col("_med")))
    out = _whole(out, "_dev", _mad=0.5)
    z = ratio(0.6745 * (F.col(c) - F.col("_med")), F.col("_mad"))
    return out.withColumn("mz", z).withColumn("is_outlier", F.coalesce(F.abs("mz") > threshold, F.lit(False))).drop("_med", "_dev", "_mad")


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def local_winsor(s: DataFrame, c: str = "ret", n: int = 60, low: float = 0.005, high: float = 0.995, nearest: bool = True) -> DataFrame:
    """Outside two quantiles of the last n rows. With nearest quantiles of few rows these are the extremes, so nothing is flagged; with linear ones each new extreme is."""
    q = quantile_nearest if nearest else quantile
    return s.withColumn("is_outlier", _flag((F.col(c) < q(c, low, n)) | (F.col(c) > q(c, high, n))))


def local_z(s: DataFrame, c: str = "ret", n: int = 60, threshold: float = 5.0) -> DataFrame:
    return s.withColumn("is_outlier", _flag(F.abs(ratio(F.col(c) - mean(c, n), std(c, n))) > threshold))


def local_iqr(s: DataFrame, c: str = "ret", n: int = 60, multiplier: float = 3.0) -> DataFrame:
    q1, q3 = quantile(c, 0.25, n), quantile(c, 0.75, n)
    return s.withColumn("is_outlier", _flag((F.col(c) < q1 - multiplier * (q3 - q1)) | (F.col(c) > q3 + multiplier * (q3 - q1))))


def local_modified_z(s: DataFrame, c: str = "ret", n: int = 60, threshold: float = 5.0) -> DataFrame:
    """Rolling median, then rolling median of the deviations from it."""
    out = s.withColumn("_dev", F.abs(F.col(c) - quantile(c, 0.5, n))).withColumn("_med", quantile(c, 0.5, n))
    out = out.withColumn("_mad", quantile("_dev", 0.5, n))
    return out.withColumn("is_outlier", _flag(F.abs(ratio(0.6745 * (F.col(c) - F.col("_med")), F.col("_mad"))) > threshold)).drop("_dev", "_med", "_mad")


def consensus(s: DataFrame, least: int = 2) -> DataFrame:
    """Flags of the four whole-series detectors on prices, their count, and whether at least `least` agree."""
    rows = s
    for name, detect in (("by_winsor", winsor), ("by_z", zscore), ("by_iqr", iqr), ("by_mad", modified_z)):
        rows = detect(rows).withColumnRenamed("is_outlier", name).drop("capped", "magnitude", "z", "mz")
    votes = sum((F.col(c).cast("int") for c in ("by_winsor", "by_z", "by_iqr", "by_mad")), F.lit(0))
    return rows.withColumn("votes", votes).withColumn("is_outlier", F.col("votes") >= least)


def consensus_summary(flags: DataFrame) -> DataFrame:
    """Counts per token and the share of rows on which winsor and quartile detectors agree."""
    agree = F.avg((F.col("by_winsor") == F.col("by_iqr")).cast("double"))
    return flags.groupBy(KEY).agg(F.count_if("is_outlier").alias("outliers"), (100 * F.avg(F.col("is_outlier").cast("double"))).alias("outlier_pct"), *(F.count_if(c).alias(c) for c in ("by_winsor", "by_z", "by_iqr", "by_mad")), agree.alias("agreement_winsor_iqr"))


def winsorized(s: DataFrame, columns: list[str], low: float = 0.005, high: float = 0.995, per_token: bool = False) -> DataFrame:
    """The columns clipped to two percentiles, fitted over all rows or per token."""
    keys = [KEY] if per_token else []
    limits = s.groupBy(*keys).agg(*(F.percentile(c, [low, high]).alias(f"_{c}") for c in columns))
    out = s.join(limits, KEY) if per_token else s.crossJoin(F.broadcast(limits))  # one row
    return out.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_{c}")[1]), F.col(f"_{c}")[0])) for c in columns}).drop(*(f"_{c}" for c in columns))
