"""Data quality of each series: statistics, gaps, anomalies, score, death, and the category that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.rolling import in_order, whole, KEY, PRICE, so_far, TIE, TIME, islands, lag, pct_change, quotient, ratio, with_returns

GAP_SECONDS = 90
#: Market eras by year of launch; any other year is 2025_unknown.
ERAS = {2022: "2022_bear", 2023: "2023_recovery", 2024: "2024_bull"}


def _seconds(c):
    return F.unix_micros(c) / 1e6


def _minutes_since(before):
    """Whole microseconds are subtracted, so no digits are lost."""
    return (F.unix_micros(F.col(TIME)) - F.unix_micros(before)) / 60e6


def first_price():
    return F.min_by(PRICE, F.struct(TIME, TIE))


def last_price():
    return F.max_by(PRICE, F.struct(TIME, TIE))


def basic_stats(s: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, range, coefficient of variation and time span in hours."""
    out = s.groupBy(KEY).agg(F.count(PRICE).alias("n"), F.avg(PRICE).alias("mean_price"), F.stddev_samp(PRICE).alias("std_price"), F.min(PRICE).alias("min_price"), F.max(PRICE).alias("max_price"), ((_seconds(F.max(TIME)) - _seconds(F.min(TIME))) / 3600).alias("span_hours"))
    return out.withColumns({"price_range": F.col("max_price") - F.col("min_price"), "cv": ratio("std_price", "mean_price")})


def launch_context(s: DataFrame) -> DataFrame:
    """Calendar of the first time (Monday is 0) and the market era."""
    out = s.groupBy(KEY).agg(F.min(TIME).alias("t"))
    era = F.lit("2025_unknown")
    for year, name in ERAS.items():
        era = F.when(F.year("t") == year, name).otherwise(era)
    return out.select(KEY, F.year("t").alias("launch_year"), F.month("t").alias("launch_month"), F.weekday("t").alias("launch_weekday"), F.hour("t").alias("launch_hour"), (F.weekday("t") >= 5).alias("is_weekend"), era.alias("market_era"))


def gaps(s: DataFrame) -> DataFrame:
    """One row per gap (a step of over 90 s): its size and its start, in minutes after launch."""
    launch = F.min(TIME).over(whole())
    out = s.select(KEY, TIE, _minutes_since(lag(TIME)).alias("gap_minutes"), ((F.unix_micros(lag(TIME)) - F.unix_micros(launch)) / 60e6).alias("start_minute"))
    return out.where(F.col("gap_minutes") > GAP_SECONDS / 60)


def gap_fill_kind(minutes):
    """What a gap of this size would be filled with; a label only."""
    return F.when(minutes <= 1, "linear").when(minutes <= 5, "polynomial").when(minutes <= 10, "forward_fill_linear").otherwise("exclude")


def gap_summary(s: DataFrame) -> DataFrame:
    """Gap count, largest and mean gap of every token, zeros where it has none."""
    return _with_steps(s).groupBy(KEY).agg(*_gap_sums())


def _with_steps(s: DataFrame) -> DataFrame:
    """`gap_minutes`: minutes since the row before; `_new_time`: whether its time is another."""
    return s.withColumns({"gap_minutes": _minutes_since(lag(TIME)), "_new_time": F.col(TIME).isNotNull() & ~F.col(TIME).eqNullSafe(lag(TIME))})


def _gap_sums() -> list[Column]:
    size = F.when(F.col("gap_minutes") > GAP_SECONDS / 60, F.col("gap_minutes"))
    return [F.count(size).alias("total_gaps"), F.coalesce(F.max(size), F.lit(0.0)).alias("max_gap"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_gap")]


def extreme_movements(s: DataFrame) -> DataFrame:
    """Largest minute return, total return, count of minute jumps over 100 (10,000 %), and the first ten of them."""
    details = F.slice(F.sort_array(F.collect_list(F.when(F.abs("ret") > 100, F.struct(TIME, TIE, "ret")))), 1, 10)
    return _extreme_flags(with_returns(s).groupBy(KEY).agg(*_extremes(), details.alias("details")))


def _extremes() -> list[Column]:
    return [F.max(F.abs("ret")).alias("max_minute_return"), (quotient(last_price(), first_price()) - 1).alias("total_return"), F.count_if(F.abs("ret") > 100).alias("extreme_minutes")]


def _extreme_flags(out: DataFrame) -> DataFrame:
    return out.withColumns({"extreme_minute_jump": F.coalesce(F.col("max_minute_return") > 100, F.lit(False)), "extreme_total_return": F.coalesce(F.abs("total_return") > 10000, F.lit(False))})


def price_anomalies(s: DataFrame) -> DataFrame:
    """Zero and negative prices, returns over 10 and under -0.9, jumps over 100, and prices ten quartile ranges out."""
    return _with_quartiles(with_returns(s)).groupBy(KEY).agg(*_anomalies())


def _with_quartiles(s: DataFrame) -> DataFrame:
    return s.withColumns({"q1": F.percentile(PRICE, 0.25).over(whole()), "q3": F.percentile(PRICE, 0.75).over(whole())})


def _anomalies() -> list[Column]:
    wide = 10 * (F.col("q3") - F.col("q1"))
    out_of_range = (F.col(PRICE) < F.col("q1") - wide) | (F.col(PRICE) > F.col("q3") + wide)
    return [F.count_if(F.col(PRICE) == 0).alias("zero_prices"), F.count_if(F.col(PRICE) < 0).alias("negative_prices"), F.count_if(F.col("ret") > 10).alias("extreme_up"), F.count_if(F.col("ret") < -0.9).alias("extreme_down"), F.count_if(F.abs("ret") > 100).alias("jumps"), F.count_if(out_of_range).alias("iqr_outliers")]


def death_duration(s: DataFrame) -> DataFrame:
    """Rows at the end that all have the last price, in whole hours of 60 rows; dead from one hour on."""
    return _dead(_with_tail(s).groupBy(KEY).agg(_tail_rows()))


def _with_tail(s: DataFrame) -> DataFrame:
    """`_tail`: whether all rows from here on have the last price."""
    last = F.last(PRICE).over(in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = s.withColumn("_last", last).withColumn("_d", F.max(F.when(F.col(PRICE) != F.col("_last"), F.struct(TIME, TIE))).over(whole()))
    return rows.withColumn("_tail", F.col("_d").isNull() | (F.struct(TIME, TIE) > F.col("_d")))


def _tail_rows() -> Column:
    return F.count_if(F.col("_tail")).alias("tail_rows")


def _dead(out: DataFrame) -> DataFrame:
    return out.withColumn("death_hours", F.floor(F.col("tail_rows") / 60)).withColumn("is_dead", F.col("death_hours") >= 1)


def quality_score(s: DataFrame) -> DataFrame:
    """100 less the share of duplicate times, the share of invalid prices, and up to ten points for gaps; within 0 to 100."""
    return _scored(_with_steps(s).groupBy(KEY).agg(*_counts(), *_gap_sums()))


def _counts() -> list[Column]:
    return [F.count("*").alias("n_rows"), F.count_if(F.col("_new_time")).alias("n_times"), F.count_if(F.col(PRICE) <= 0).alias("n_invalid")]


def _scored(out: DataFrame) -> DataFrame:
    duplicate = 100.0 * (F.col("n_rows") - F.col("n_times")) / F.col("n_rows")
    score = 100 - duplicate - 100.0 * F.col("n_invalid") / F.col("n_rows") - F.least(F.col("total_gaps"), F.lit(10))
    return out.withColumns({"duplicate_pct": duplicate, "quality_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score.cast("double")))})


def quality_report(s: DataFrame) -> DataFrame:
    """One row per token: score, gaps, anomalies, death, extremes, the rule for extreme tokens, rating and completeness."""
    rows = s.where(F.col(KEY).isNotNull()).repartition(KEY).sortWithinPartitions(KEY, TIME, TIE)  # one sort serves all windows
    rows = _with_tail(_with_quartiles(with_returns(_with_steps(rows))))
    spread = [F.stddev_samp("ret").alias("return_std"), (quotient(F.max(PRICE), F.min(PRICE)) - 1).alias("range_ratio"), _seconds(F.max(TIME)).alias("_b"), _seconds(F.min(TIME)).alias("_a")]
    out = _extreme_flags(_dead(_scored(rows.groupBy(KEY).agg(*_counts(), *_gap_sums(), *_anomalies(), _tail_rows(), *_extremes(), *spread))))
    extreme = F.col("extreme_minute_jump") | F.col("extreme_total_return") | F.coalesce(F.col("return_std") > 100, F.lit(False)) | F.coalesce(F.abs("total_return") > 1000, F.lit(False)) | F.coalesce(F.col("range_ratio") > 100, F.lit(False))
    hours = (F.col("_b") - F.col("_a")) / 3600
    rating = F.when(F.col("quality_score") >= 90, "excellent").when(F.col("quality_score") >= 80, "good").when(F.col("quality_score") >= 60, "fair").otherwise("poor")
    return out.withColumns({"is_extreme": extreme, "hours_covered": hours, "quality_rating": rating, "completeness_pct": F.least(F.lit(100.0), 100 * F.col("n_rows") / (hours * 60 + 1))}).drop("_a", "_b")


def quality_summary(report: DataFrame) -> DataFrame:
    """One row over all tokens."""
    count = lambda c: F.count_if(c)
    return report.agg(F.count("*").alias("tokens"), F.avg("quality_score").alias("avg_score"), count(F.col("is_dead")).alias("dead"), count(F.col("is_extreme")).alias("extreme"), count(F.col("total_gaps") > 0).alias("with_gaps"), F.avg("hours_covered").alias("avg_hours"), count(F.col("quality_rating").isin("excellent", "good")).alias("well_rated"))


def recommended(report: DataFrame, hours: float = 1.0, score: float = 80.0) -> DataFrame:
    """Tokens long and good enough, best first."""
    return report.where((F.col("hours_covered") >= hours) & (F.col("quality_score") >= score)).orderBy(F.desc("quality_score"), KEY)


def assign_category(report: DataFrame) -> DataFrame:
    """Exactly one category each: gaps, then normal, then extremes, then dead."""
    gappy = (F.col("total_gaps") > 5) | (F.col("max_gap") > 30)
    name = F.when(gappy, "tokens_with_gaps").when(~F.col("is_extreme") & ~F.col("is_dead"), "normal_behavior_tokens").when(F.col("is_extreme"), "tokens_with_extremes").otherwise("dead_tokens")
    return report.withColumn("category", name)


def investigate_gaps(report: DataFrame) -> DataFrame:
    """Tokens with many or large gaps: how severe, how dense their data are, and what to do with them."""
    severity = F.when(F.col("total_gaps") > 10, "excessive_gaps").when(F.col("max_gap") > 30, "large_gaps").when(F.col("max_gap") > 5, "medium_gaps").otherwise("small_gaps_only")
    density = ratio("n_rows", "hours_covered")
    action = F.when((F.col("total_gaps") > 50) | (F.col("max_gap") > 720) | (F.col("quality_score") < 50), "remove").when((F.col("quality_score") >= 80) & (F.col("max_gap") <= 120), "keep_and_clean").otherwise("needs_manual_review")
    return report.where((F.col("total_gaps") > 5) | (F.col("max_gap") > 30)).select(KEY, "total_gaps", "max_gap", severity.alias("severity"), density.alias("rows_per_hour"), action.alias("recommendation"))


def return_anomalies(s: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Returns more than `threshold` deviations from their mean: count, extremes, first and last time."""
    r = with_returns(s)
    z = F.abs(ratio(F.col("ret") - F.avg("ret").over(whole()), F.stddev_samp("ret").over(whole())))
    odd = F.col("z") > threshold
    return r.withColumn("z", z).groupBy(KEY).agg(F.count_if(odd).alias("anomalies"), F.max("ret").alias("max_return"), F.min("ret").alias("min_return"), F.min(F.when(odd, F.col(TIME))).alias("first_anomaly"), F.max(F.when(odd, F.col(TIME))).alias("last_anomaly"))


def flat_runs(s: DataFrame) -> DataFrame:
    """Longest run of equal prices per token."""
    runs = islands(s, F.coalesce(F.col(PRICE) != lag(PRICE), F.lit(True)))
    return runs.groupBy(KEY, "island").agg(F.count("*").alias("n")).groupBy(KEY).agg(F.max("n").alias("max_flat"))


def length_percentiles(s: DataFrame, at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Percentiles of the tokens' row counts."""
    n = s.groupBy(KEY).agg(F.count("*").alias("n"))
    return n.agg(*(F.percentile("n", q).alias(f"p{round(100 * q)}") for q in at), F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"))


def running_zero_count(s: DataFrame, dead_after: int = 30) -> DataFrame:
    """Zero prices so far, the token's coefficient of variation, and whether the token is dead by now; rows after death with price zero go."""
    zeros = F.sum(F.when(F.col(PRICE) == 0, 1).otherwise(0)).over(so_far())
    out = s.withColumns({"zero_streak": zeros.cast("long"), "cv": ratio(F.stddev_samp(PRICE).over(whole()), F.avg(PRICE).over(whole()))})
    out = out.withColumn("is_dead", F.col("zero_streak") > dead_after)
    return out.where(~(F.col("is_dead") & (F.col(PRICE) == 0)))


def total_return_series(s: DataFrame) -> DataFrame:
    """Return since launch on every row."""
    return s.withColumn("since_launch", ratio(PRICE, F.first(PRICE).over(so_far())) - 1).withColumn("ret", pct_change())
