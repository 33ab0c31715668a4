"""Technical indicators, one row per row of the series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.ewm import with_ewm
from tickloom.functions.rolling import KEY, PRICE, finite, high, in_order, lag, low, mean, pct_change, ratio, sign, so_far, std, total, whole, with_returns


def bollinger(s: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Bands, position in them, and squeeze: a deviation under 0.8 of its own mean over n rows."""
    rows = s.withColumns({"bb_middle": mean(PRICE, n), "_sd": std(PRICE, n)})
    rows = rows.withColumns({"bb_upper": F.col("bb_middle") + width * F.col("_sd"), "bb_lower": F.col("bb_middle") - width * F.col("_sd"), "bb_squeeze": F.col("_sd") < 0.8 * mean("_sd", n)})
    return rows.withColumn("bb_position", ratio(F.col(PRICE) - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower"))).drop("_sd")


def stochastic(s: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    k = ratio(100 * (F.col(PRICE) - low(PRICE, n)), high(PRICE, n) - low(PRICE, n))
    rows = s.withColumn("stoch_k", k)
    return rows.withColumn("stoch_d", mean("stoch_k", smooth))


def williams_r(s: DataFrame, n: int = 14) -> DataFrame:
    return s.withColumn("williams_r", -100 * ratio(high(PRICE, n) - F.col(PRICE), high(PRICE, n) - low(PRICE, n)))


def rsi(s: DataFrame, n: int = 14) -> DataFrame:
    """With plain means of gains and losses; 100 where there are no losses but gains."""
    d = F.col(PRICE) - lag(PRICE)
    rows = s.withColumns({"_up": F.greatest(d, F.lit(0.0)), "_down": F.greatest(-d, F.lit(0.0))}).withColumn("_d", d)
    rows = rows.withColumns({"_gain": mean(F.when(F.col("_d").isNotNull(), F.col("_up")), n), "_loss": mean(F.when(F.col("_d").isNotNull(), F.col("_down")), n)})
    return rows.withColumn("rsi", 100 * ratio("_gain", F.col("_gain") + F.col("_loss"))).drop("_up", "_down", "_d", "_gain", "_loss")


def atr(s: DataFrame, n: int = 14) -> DataFrame:
    """Mean absolute step."""
    rows = s.withColumn("_step", F.abs(F.col(PRICE) - lag(PRICE)))
    return rows.withColumn("atr", mean("_step", n)).drop("_step")


def roc(n: int):
    return 100 * pct_change(PRICE, n)


def coppock_kst(s: DataFrame) -> DataFrame:
    """Coppock: mean over 10 of ROC 14 + ROC 11. KST: smoothed ROC 10, 15, 20 and 30 weighted 1 to 4."""
    rows = s.withColumns({"_c": roc(14) + roc(11), **{f"_r{n}": roc(n) for n in (10, 15, 20, 30)}})
    kst = mean("_r10", 10) + 2 * mean("_r15", 10) + 3 * mean("_r20", 10) + 4 * mean("_r30", 15)
    return rows.withColumns({"roc_10": F.col("_r10"), "coppock": mean("_c", 10), "kst": kst}).drop("_c", "_r10", "_r15", "_r20", "_r30")


def trix(s: DataFrame, span: int = 15) -> DataFrame:
    """Relative change of a threefold recursive exponential mean."""
    how = {"span": span, "adjust": False}
    rows = with_ewm(s, {"_e1": (PRICE, how), "_e2": ("_e1", how), "_e3": ("_e2", how)})
    return rows.withColumn("trix", 100 * pct_change("_e3")).drop("_e1", "_e2", "_e3")


def efficiency_ratio(s: DataFrame, n: int = 10) -> DataFrame:
    """Net change over n rows by the sum of absolute steps."""
    rows = s.withColumn("_step", F.abs(F.col(PRICE) - lag(PRICE)))
    return rows.withColumn("efficiency_ratio", ratio(F.abs(F.col(PRICE) - lag(PRICE, n)), total("_step", n))).drop("_step")


def vwap_bands(s: DataFrame, anchors: tuple[int, ...] = (5, 60, 240), volume: str | None = None) -> DataFrame:
    """Per anchor n: volume-weighted mean price of the last n rows, bands one price deviation of these rows around it, and the price's relative distance from it.

    Without volume, the size of the return stands in for it; where a return is infinite or NaN, so are the means over it. `vwap` is that of the first anchor. Other values that are not finite count as missing."""
    v = F.col(volume).cast("double") if volume else F.abs(pct_change()) + 1e-10
    rows = s.withColumn("_v", F.when(finite(v) & finite(PRICE), v)).withColumn("_pv", F.col(PRICE) * F.col("_v"))
    rows = rows.withColumn("_odd", (F.lit(volume is None) & v.isNotNull() & ~finite(v) & finite(PRICE)).cast("int"))
    # sums over a frame are differences of running sums, so a row costs the same for every anchor; prices count from their mean, which keeps digits
    rows = rows.withColumn("_p", F.when(finite(PRICE), F.col(PRICE).cast("double"))).withColumn("_d", F.col("_p") - F.avg("_p").over(whole()))
    rows = rows.withColumns({"_d2": F.col("_d") * F.col("_d"), "_step": F.when(F.col("_p") != F.lag("_p").over(in_order()), 1).otherwise(0)})
    sums = {"_sv": F.sum("_v"), "_spv": F.sum("_pv"), "_nv": F.count(F.when((F.col("_odd") > 0) | F.col("_v").isNotNull(), 1)), "_no": F.sum("_odd"), "_sd1": F.sum("_d"), "_sd2": F.sum("_d2"), "_np": F.count("_p"), "_moves": F.sum("_step")}
    rows = rows.withColumns({name: F.coalesce(x.over(so_far()), F.lit(0)) for name, x in sums.items()})
    for n in anchors:
        over = lambda c, k=n: F.col(c) - F.coalesce(F.lag(c, k).over(in_order()), F.lit(0))
        middle = F.when(over("_nv") >= n, F.when(over("_no") > 0, float("nan")).otherwise(ratio(over("_spv"), over("_sv"))))
        square = (over("_sd2") - over("_sd1") * over("_sd1") / n) / (n - 1)
        spread = F.when(over("_np") >= n, F.when(over("_moves", n - 1) == 0, 0.0).otherwise(F.sqrt(F.greatest(square, F.lit(0.0))))) if n > 1 else F.lit(None).cast("double")
        rows = rows.withColumns({f"vwap_{n}": middle, f"_sd_{n}": spread})
    for n in anchors:
        middle, spread = F.col(f"vwap_{n}"), F.col(f"_sd_{n}")
        rows = rows.withColumns({f"vwap_upper_{n}": middle + spread, f"vwap_lower_{n}": middle - spread, f"vwap_distance_{n}": ratio(F.col(PRICE) - middle, middle)})
    return rows.withColumn("vwap", F.col(f"vwap_{anchors[0]}")).drop("_v", "_pv", "_odd", "_p", "_d", "_d2", "_step", *sums, *(f"_sd_{n}" for n in anchors))


def order_imbalance(s: DataFrame, n: int = 20) -> DataFrame:
    """Share of up steps less share of down steps, and the running sum of signs (cumulative delta)."""
    rows = with_returns(s).withColumn("_sign", sign("ret"))
    return rows.withColumns({"imbalance": mean("_sign", n), "cumulative_delta": F.sum("_sign").over(so_far())}).drop("_sign")


def last_signals(s: DataFrame) -> DataFrame:
    """Signals on each token's last row: RSI over- or undersold, price outside its bands, stochastic cross."""
    rows = stochastic(bollinger(rsi(s)))
    last = rows.groupBy(KEY).agg(F.max_by(F.struct("rsi", PRICE, "bb_upper", "bb_lower", "stoch_k", "stoch_d"), F.struct("datetime", "seq")).alias("x")).select(KEY, "x.*")
    return last.select(KEY, F.when(F.col("rsi") > 70, "overbought").when(F.col("rsi") < 30, "oversold").otherwise("neutral").alias("rsi_signal"), F.when(F.col(PRICE) > F.col("bb_upper"), "above").when(F.col(PRICE) < F.col("bb_lower"), "below").otherwise("inside").alias("bb_signal"), F.when(F.col("stoch_k") > F.col("stoch_d"), "bullish").otherwise("bearish").alias("stoch_signal"))


def lazy_features(s: DataFrame) -> DataFrame:
    """SMA 10 and 20, bands of 20, RSI and the kind of move, in one pass over the series."""
    rows = rsi(bollinger(with_returns(s))).withColumns({"sma_10": mean(PRICE, 10), "sma_20": mean(PRICE, 20)})
    kind = F.when(F.col("ret") > 0.1, "pump").when(F.col("ret") < -0.1, "dump").when(F.abs("ret") < 0.001, "flat").otherwise("normal")
    return rows.withColumn("move_type", kind)


