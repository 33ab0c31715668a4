"""Cleaning: universal checks, artifact removal, gap filling, and the strategies by category and by time horizon.

Every step keeps or drops rows and leaves a column `audit` (array of what was done), so the log of a token is data too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.rolling import in_order, whole, KEY, PRICE, TIE, TIME, finite, interpolated, lag, lead, pct_change, ratio, so_far, with_row

#: Strategy by category, and the thresholds of each strategy.
STRATEGIES = {"normal_behavior_tokens": "gentle", "dead_tokens": "minimal", "tokens_with_extremes": "preserve", "tokens_with_gaps": "aggressive"}
LISTING = {"gentle": (10, 100.0, 0.99, 3), "minimal": (5, 200.0, 0.995, 2), "aggressive": (20, 10.0, 0.90, 5)}
GAP_LIMITS = {"gentle": 2, "preserve": 3, "aggressive": 10}
ERROR_LIMITS = {"aggressive": 100.0}
INVALID_LIMITS = {"gentle": 0.05, "preserve": 0.10}
RATIO_LIMITS = {"short_term": 50e6, "medium_term": 10e6, "long_term": 1e6}
MIN_ROWS = 60
TRIM_TOLERANCE = 0.0001


def finite_prices(s: DataFrame, most_removed: float = 0.5) -> DataFrame:
    """Rows with a finite price; tokens that would lose more than `most_removed` of their rows go."""
    share = F.avg(F.when(finite(PRICE), 0.0).otherwise(1.0)).over(whole())
    return s.withColumn("_bad", share).where(finite(PRICE) & (F.col("_bad") <= most_removed)).drop("_bad")


def long_enough(s: DataFrame, n: int = MIN_ROWS) -> DataFrame:
    return s.withColumn("_n", F.count("*").over(whole())).where(F.col("_n") >= n).drop("_n")


def _with_ratio(s: DataFrame) -> DataFrame:
    """`_r`: the token's largest price over its least positive one."""
    return s.withColumn("_r", ratio(F.max(PRICE).over(whole()), F.min(F.when(F.col(PRICE) > 0, F.col(PRICE))).over(whole())))


def _within(limit: float) -> Column:
    return F.coalesce(F.col("_r") <= limit, F.lit(True))


def ratio_gate(s: DataFrame, limit: float) -> DataFrame:
    """Tokens whose largest price is at most `limit` times their least positive one."""
    return _with_ratio(s).where(_within(limit)).drop("_r")


def trim_death_tail(s: DataFrame, least: int = 60, keep: int = 2, tolerance: float = TRIM_TOLERANCE) -> DataFrame:
    """Where at least `least` rows at the end stay within `tolerance` of the last price, only the first `keep` of them stay."""
    last = F.last(PRICE).over(in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    moved = F.max(F.when(F.abs(F.col(PRICE) - last) > tolerance * F.abs(last), F.col("rn"))).over(whole())
    rows = with_row(s).withColumn("_last_move", F.coalesce(moved, F.lit(-1))).withColumn("_n", F.count("*").over(whole()))
    tail = F.col("_n") - 1 - F.col("_last_move")
    return rows.where((tail < least) | (F.col("rn") <= F.col("_last_move") + keep)).drop("rn", "_last_move", "_n")


def variability(s: DataFrame) -> DataFrame:
    """The five tests of activity per token, and how many it passes; under three, a token is flat."""
    out = _with_moves(s).groupBy(KEY).agg(F.count("*").alias("n"), *(c.alias(name) for name, c in _activity(lambda c: c).items()), F.count_distinct(PRICE).alias("unique_prices"))
    return out.withColumn("passes", _passes()).withColumn("is_flat", F.col("passes") < 3)


def _with_moves(s: DataFrame) -> DataFrame:
    """`_d`: change from the row before; `_run`: how many rows the price has stood, this one included."""
    rows = with_row(s).withColumn("_d", F.col(PRICE) - lag(PRICE)).withColumn("_new", F.when(F.coalesce(F.col(PRICE) != lag(PRICE), F.lit(True)), F.col("rn")))
    return rows.withColumn("_run", F.col("rn") - F.max("_new").over(so_far()) + 1).drop("rn", "_new")


def _activity(over: Callable[[Column], Column]) -> dict[str, Column]:
    """What the tests of activity look at; over: where an aggregate is taken."""
    return {
        "price_cv": ratio(over(F.stddev_pop(PRICE)), over(F.avg(PRICE))), "tick_frequency": ratio(over(F.count_if(F.col("_d") != 0)), over(F.count("_d"))),
        "range_efficiency": F.least(F.lit(1.0), ratio(over(F.max(PRICE)) - over(F.min(PRICE)), over(F.avg(PRICE)))), "signal_strength": ratio(over(F.count_if(F.abs("_d") > 0.001)), over(F.count("_d"))),
        "max_flat": over(F.max("_run")),
    }


def _passes() -> Column:
    # a run of one row is no flat period
    flat = F.when(F.col("max_flat") > 1, F.col("max_flat")).otherwise(F.lit(0))
    tests = (F.col("price_cv") > 0.001, flat < 120, F.col("tick_frequency") > 0.05, F.col("range_efficiency") > 0.01, F.col("signal_strength") > 0.02)
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))


def without_flat(s: DataFrame) -> DataFrame:
    """Rows of the tokens that pass three of the five tests of activity."""
    return _with_moves(s).withColumns(_activity(lambda c: c.over(whole()))).where(_passes() >= 3).select(*s.columns)


def activity_ratio(s: DataFrame, windows: tuple[int, ...] = (10, 30, 60)) -> DataFrame:
    """Share of half-overlapping windows with more than two different prices."""
    rows = with_row(s)
    good, every = F.lit(0), F.lit(0)
    for n in windows:
        frame = in_order().rowsBetween(0, n - 1)
        rows = rows.withColumn(f"_u{n}", F.size(F.collect_set(PRICE).over(frame))).withColumn(f"_f{n}", (F.count("*").over(frame) == n) & (F.col("rn") % (n // 2) == 0))
        good = good + F.count_if(F.col(f"_f{n}") & (F.col(f"_u{n}") > 2))
        every = every + F.count_if(F.col(f"_f{n}"))
    return rows.groupBy(KEY).agg(F.coalesce(ratio(good, every), F.lit(0.0)).alias("activity_ratio"))


def _prices(start: int, end: int) -> Column:
    return F.collect_list(PRICE).over(in_order().rowsBetween(start, end))


def staircase_metrics(prices: Column) -> dict[str, Column]:
    """Of an array of prices: share of different ones, of moves, relative deviation, moves of over 0.01 %, longest flat run."""
    n = F.size(prices)
    zero = F.lit(0.0)
    sum_ = lambda a: F.aggregate(a, zero, lambda acc, x: acc + x)
    mean = sum_(prices) / n
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.abs(F.get(prices, i) - F.get(prices, i - 1)))
    spread = F.sqrt(sum_(F.transform(prices, lambda x: (x - mean) * (x - mean))) / (n - 1))
    run = F.struct(F.lit(0.0).cast("double").alias("p"), F.lit(0).alias("len"), F.lit(0).alias("best"))

    def step(acc, x):
        length = F.when((acc["len"] > 0) & (x == acc["p"]), acc["len"] + 1).otherwise(1)
        return F.struct(x.alias("p"), length.alias("len"), F.greatest(acc["best"], F.when(length > 1, length).otherwise(0)).alias("best"))

    return {
        "unique_ratio": F.size(F.array_distinct(prices)) / n, "variation_ratio": F.size(F.filter(steps, lambda d: d > 0)) / (n - 1), "relative_std": ratio(spread, mean),
        "tick_moves": F.size(F.filter(steps, lambda d: d > mean * 0.0001)), "flat_run": F.aggregate(prices, run, step, lambda acc: acc["best"]),
    }


def staircase_cuts(s: DataFrame, jump: float = 1.0, side: int = 30, unique: float = 0.1, variation: float = 0.1, spread: float = 0.01, ticks: int = 3, run: int = 25) -> DataFrame:
    """First row per token at which a jump of over `jump` has a staircase on either side; a staircase before it cuts `side` rows earlier."""
    rows = _with_cuts(s, jump, side, unique, variation, spread, ticks, run)
    return rows.groupBy(KEY).agg(F.min("_cut").cast("long").alias("cut")).where(F.col("cut").isNotNull())


def _with_cuts(s: DataFrame, jump: float = 1.0, side: int = 30, unique: float = 0.1, variation: float = 0.1, spread: float = 0.01, ticks: int = 3, run: int = 25) -> DataFrame:
    """`rn`, and `_cut`: the first row that goes, where this row has a jump with a staircase."""
    rows = with_row(s).withColumn("_ret", pct_change()).withColumns({"_pre": _prices(-side, -1), "_post": _prices(1, side)})

    def stairs(c: str) -> Column:
        m = staircase_metrics(F.col(c))
        return (m["unique_ratio"] < unique) & (m["variation_ratio"] < variation) & (m["relative_std"] < spread) & (m["tick_moves"] < ticks) | (m["flat_run"] >= run)

    jumps = (F.abs("_ret") > jump) & (F.size("_pre") == side) & (F.size("_post") == side)
    cut = F.when(jumps, F.when(stairs("_post"), F.col("rn")).when(stairs("_pre"), F.greatest(F.lit(0), F.col("rn") - side)))
    return rows.withColumn("_cut", cut).drop("_ret", "_pre", "_post")


def cut_staircases(s: DataFrame, **how) -> DataFrame:
    """Rows before the cut."""
    rows = _with_cuts(s, **how).withColumn("cut", F.min("_cut").over(whole())).drop("_cut")
    return rows.where(F.col("cut").isNull() | (F.col("rn") < F.col("cut"))).drop("rn", "cut")


def corruption_cuts(s: DataFrame, jump: float = 1.0, side: int = 30) -> DataFrame:
    """The stricter variant: after the jump at most three different prices and one move."""
    rows = with_row(s).withColumn("_ret", pct_change()).withColumn("_post", _prices(1, side)).where((F.abs("_ret") > jump) & (F.size("_post") == side))
    m = staircase_metrics(F.col("_post"))
    rows = rows.where((F.size(F.array_distinct("_post")) <= 3) & (m["tick_moves"] <= 1))
    return rows.groupBy(KEY).agg(F.min("rn").alias("cut"))


def listing_artifacts(s: DataFrame, strategy: str = "gentle") -> DataFrame:
    """Rows, with `is_artifact` for an early spike over the median that crashes within the next few rows."""
    first, times, drop, after = LISTING[strategy]
    rows = with_row(s).withColumn("_low", F.min(PRICE).over(in_order().rowsBetween(1, after)))
    rows = rows.withColumns({"_med": F.percentile(PRICE, 0.5).over(whole()), "_n": F.count("*").over(whole())})
    odd = (F.col("rn") < first) & (F.col(PRICE) > times * F.col("_med")) & (F.col("rn") < F.col("_n") - after) & (F.col("_low") < F.col(PRICE) * (1 - drop))
    return rows.withColumn("is_artifact", F.coalesce(odd, F.lit(False)) & (F.col("_n") >= first)).drop("rn", "_med", "_low", "_n")


def without_artifacts(s: DataFrame, strategy: str = "gentle") -> DataFrame:
    return listing_artifacts(s, strategy).where(~F.col("is_artifact")).drop("is_artifact")


def data_errors(s: DataFrame, flag: float = 1e4, replace: float | None = None) -> DataFrame:
    """`is_error` where a return is beyond `flag`; beyond `replace`, if given, the price becomes the mean of its neighbours."""
    rows = s.withColumn("_ret", F.abs(pct_change()))
    rows = rows.withColumn("is_error", F.coalesce(F.col("_ret") > flag, F.lit(False)))
    if replace is not None:
        fixed = F.coalesce((lag(PRICE) + lead(PRICE)) / 2, lag(PRICE))
        rows = rows.withColumn("_fixed", fixed).withColumn(PRICE, F.when(F.coalesce(F.col("_ret") > replace, F.lit(False)), F.col("_fixed")).otherwise(F.col(PRICE))).drop("_fixed")
    return rows.drop("_ret")


def duplicate_means(s: DataFrame) -> DataFrame:
    """One row per token and time: the mean price."""
    return s.groupBy(KEY, TIME).agg(F.min(TIE).alias(TIE), F.avg(PRICE).alias(PRICE))


def minute_means(s: DataFrame) -> DataFrame:
    """Prices on whole minutes: the mean of each minute that has rows."""
    return s.withColumn(TIME, F.date_trunc("minute", TIME)).groupBy(KEY, TIME).agg(F.min(TIE).alias(TIE), F.avg(PRICE).alias(PRICE))


def minute_spine(s: DataFrame) -> DataFrame:
    """Every minute from first to last row of a token on whole minutes; price null where there is none."""
    spine = s.groupBy(KEY).agg(F.min(TIME).alias("_a"), F.max(TIME).alias("_b")).select(KEY, F.explode(F.expr("sequence(_a, _b, interval 1 minute)")).alias(TIME))
    return spine.join(s, [KEY, TIME], "left").select(KEY, TIME, F.coalesce(TIE, F.lit(0)).cast("long").alias(TIE), PRICE)


def spine_gaps(s: DataFrame) -> DataFrame:
    """Minutes from first to last row of a token on whole minutes, and how many of them have no price: counted, not laid out."""
    minutes = (F.unix_seconds(F.max(TIME)) - F.unix_seconds(F.min(TIME))) / 60 + 1
    out = s.groupBy(KEY).agg(minutes.cast("long").alias("minutes"), F.count(PRICE).alias("known"))
    return out.select(KEY, "minutes", (F.col("minutes") - F.col("known")).alias("missing"))


def fill_gaps(s: DataFrame, limit: int = 10, whole_column: bool = False) -> DataFrame:
    """A series on whole minutes with gaps of at most `limit` missing minutes filled linearly; longer ones stay empty (their minutes are left out).

    Each row knows the next one, so a gap is filled where it begins: no minute is laid out that isn't returned, at most `limit` for each row.
    whole_column: if any gap is fillable, all gaps of the token are filled, as is done elsewhere by interpolating the column."""
    rows = s.where(F.col(PRICE).isNotNull()).withColumns({"_next": lead(PRICE), "_until": F.lead(F.unix_seconds(TIME)).over(in_order())})
    rows = rows.withColumn("_size", ((F.col("_until") - F.unix_seconds(TIME)) / 60 - 1).cast("long"))
    gap = F.col("_size") >= 1
    fill = gap & (F.min(F.when(gap, F.col("_size"))).over(whole()) <= limit) if whole_column else gap & (F.col("_size") <= limit)
    rows = rows.withColumn("_fill", fill).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("_fill"), F.col("_size")).otherwise(0))))
    new = F.col("_k") > 0
    value = F.col(PRICE) + (F.col("_next") - F.col(PRICE)) * ratio("_k", F.col("_size") + 1)
    later = F.col(TIME) + F.make_dt_interval(mins=F.col("_k").cast("int"))
    return rows.select(KEY, later.alias(TIME), F.when(new, 0).otherwise(F.coalesce(TIE, F.lit(0))).cast("long").alias(TIE), F.when(new, value).otherwise(F.col(PRICE)).alias(PRICE), new.alias("is_filled"))


def invalid_prices(s: DataFrame, limit: float = 0.05) -> DataFrame:
    """Prices of zero or less are interpolated; tokens with more than `limit` of them go."""
    bad = F.col(PRICE) <= 0
    rows = s.withColumn("_share", F.avg(F.when(bad, 1.0).otherwise(0.0)).over(whole())).where(F.col("_share") <= limit)
    rows = with_row(rows.withColumn("_p", F.when(~bad, F.col(PRICE)))).withColumn("is_fixed", bad)
    return rows.withColumn(PRICE, interpolated("_p", "rn")).where(F.col(PRICE).isNotNull()).drop("_share", "_p", "rn")


def _checked(s: DataFrame, limit: float) -> DataFrame:
    """universal_checks with the token's price ratio, `_r`, kept. All steps are windows over the token, and one sort serves them all."""
    rows = s.repartition(KEY).sortWithinPartitions(KEY, TIME, TIE)
    rows = _with_ratio(trim_death_tail(long_enough(finite_prices(rows)))).where(_within(limit))
    return without_flat(cut_staircases(rows))


def universal_checks(s: DataFrame, horizon: str = "short_term") -> DataFrame:
    """Finite prices, length, death tail, price ratio, staircases and variability, in this order."""
    return _checked(s, RATIO_LIMITS[horizon]).drop("_r")


def clean(s: DataFrame, strategy: str) -> DataFrame:
    """The steps of one strategy, in its order.

    gentle: listing artifacts, data errors, small gaps, invalid prices. minimal: the death tail (it would leak), data errors, invalid
    prices. preserve: the death tail, invalid prices, corruption, critical gaps. aggressive: listing artifacts, wide gaps, data errors,
    invalid prices."""
    artifacts = lambda r: without_artifacts(r, strategy)
    gaps = lambda r: fill_gaps(minute_means(r), GAP_LIMITS[strategy]).drop("is_filled")
    errors = lambda r: data_errors(r, replace=ERROR_LIMITS.get(strategy)).drop("is_error")
    invalid = lambda r: invalid_prices(r, INVALID_LIMITS.get(strategy, INVALID_LIMITS["gentle"])).drop("is_fixed")
    steps = {"gentle": (artifacts, errors, gaps, invalid), "minimal": (trim_death_tail, errors, invalid), "preserve": (trim_death_tail, invalid, cut_corruption, gaps), "aggressive": (artifacts, gaps, errors, invalid)}
    for step in steps[strategy]:
        s = step(s)
    return s


def cut_corruption(s: DataFrame, **how) -> DataFrame:
    """Rows before the token's corruption cut."""
    rows = with_row(s).join(corruption_cuts(s, **how), KEY, "left")
    return rows.where(F.col("cut").isNull() | (F.col("rn") < F.col("cut"))).drop("rn", "cut")


def clean_by_category(s: DataFrame) -> DataFrame:
    """Series with a column category, each cleaned by its category's strategy. s is asked once for each category: store it by category first, so that each reads its own part."""
    parts = [clean(s.where(F.col("category") == category).drop("category"), strategy).select(KEY, TIME, TIE, PRICE).withColumn("category", F.lit(category)) for category, strategy in STRATEGIES.items()]
    return reduce(DataFrame.unionByName, parts)


def graduated(s: DataFrame) -> DataFrame:
    """The three horizons' versions of every series, told apart by `horizon`. They differ by the limit of the price ratio alone, so the checks are made once."""
    horizons = F.array_compact(F.array(*(F.when(_within(limit), F.lit(horizon)) for horizon, limit in RATIO_LIMITS.items())))
    return _checked(s, max(RATIO_LIMITS.values())).withColumn("horizon", F.explode(horizons)).drop("_r")


def clean_investigated(s: DataFrame, advice: DataFrame) -> DataFrame:
    """Tokens advised to go are dropped, those to keep are filled, the others stay as they are. advice: token_id, recommendation."""
    rows = s.join(advice.select(KEY, "recommendation"), KEY, "left").where(F.coalesce(F.col("recommendation") != "remove", F.lit(True)))
    keep = fill_gaps(minute_means(rows.where("recommendation = 'keep_and_clean'").drop("recommendation")), GAP_LIMITS["gentle"]).drop("is_filled")
    rest = rows.where("recommendation is null or recommendation <> 'keep_and_clean'").drop("recommendation")
    return keep.unionByName(rest)


def exclusions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after cleaning per token, and its status."""
    a = before.groupBy(KEY).agg(F.count("*").alias("rows_before"))
    b = after.groupBy(KEY).agg(F.count("*").alias("rows_after"))
    out = a.join(b, KEY, "left").withColumn("rows_after", F.coalesce("rows_after", F.lit(0)))
    return out.withColumn("status", F.when(F.col("rows_after") == 0, "excluded").when(F.col("rows_after") == F.col("rows_before"), "unchanged").otherwise("modified"))


def exclusion_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("tokens"), F.sum(F.col("rows_before") - F.col("rows_after")).alias("rows_lost"))
