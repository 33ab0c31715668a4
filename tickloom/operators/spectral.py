"""Spectra over time: a series is cut into overlapping segments in the JVM, and every segment is transformed by itself.

Returns and row numbers are made range by range, so one long series is spread over tasks by range, then by segment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import ranges
from tickloom.functions.rolling import KEY, finite_or, with_returns

LEAST = 8


def segments(s: DataFrame, segment: int = 256, rows: int = ranges.ROWS, cell: int = ranges.CELL) -> DataFrame:
    """Returns by half-overlapping segments: token_id, segment (from 0), size (returns of a segment), at (place in it), r. Returns that are not finite are 0.

    A series of fewer returns is one segment; one of fewer than 8 has none."""
    returns = ranges.over_ranges(s, with_returns, before=1, rows=rows, cell=cell)
    numbered = ranges.with_running(returns.withColumn("_one", F.lit(1)), {"_rn": ("count", "_one")}, rows=rows, cell=cell).where(F.col("_rn") >= 2)
    numbered = numbered.select(KEY, (F.col("_rn") - 2).alias("_rn"), finite_or("ret").alias("r"))
    sizes = numbered.groupBy(KEY).agg(F.count("*").alias("_m")).where(F.col("_m") >= LEAST).withColumn("size", F.least(F.lit(segment), "_m")).withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("size") / 2)))
    found = numbered.join(sizes, KEY)
    first = F.greatest(F.lit(0), F.ceil((F.col("_rn") - F.col("size") + 1) / F.col("_step")))
    last = F.least(F.floor(F.col("_rn") / F.col("_step")), F.floor((F.col("_m") - F.col("size")) / F.col("_step")))
    found = found.withColumns({"_a": first, "_b": last}).where(F.col("_a") <= F.col("_b")).withColumn("segment", F.explode(F.sequence("_a", "_b")))
    return found.select(KEY, "segment", "size", (F.col("_rn") - F.col("segment") * F.col("_step")).alias("at"), "r")


def spectrogram(s: DataFrame, segment: int = 256, **how) -> DataFrame:
    """Power by time and frequency: token_id, segment, start (row of its first return), frequency, period, power, of Hann-windowed segments less their mean. The constant part is left out."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["size"].iloc[0])
        r = np.zeros(n)
        r[part["at"].to_numpy()] = part["r"].to_numpy(float)
        power, frequency = np.abs(np.fft.rfft((r - r.mean()) * np.hanning(n)))[1:] ** 2, np.fft.rfftfreq(n)[1:]
        k = int(part["segment"].iloc[0])
        return pd.DataFrame({KEY: part[KEY].iloc[0], "segment": k, "start": k * max(1, n // 2), "frequency": frequency, "period": 1 / frequency, "power": power})

    return segments(s, segment, **how).groupBy(KEY, "segment").applyInPandas(work, f"{KEY} string, segment long, start long, frequency double, period double, power double")


def mean_spectrum(s: DataFrame, segment: int = 256, top: int = 15, **how) -> DataFrame:
    """The spectrogram's mean over segments: the `top` strongest frequencies of each token, with their class of period."""
    from pyspark.sql import Window

    mean = spectrogram(s, segment, **how).groupBy(KEY, "frequency", "period").agg(F.avg("power").alias("power"))
    ranked = mean.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("power"), "frequency"))).where(F.col("rank") <= top)
    p = F.col("period")
    return ranked.withColumn("period_class", F.when(p < 5, "high_frequency").when(p < 30, "short_term").when(p < 120, "medium_term").otherwise("long_term"))
