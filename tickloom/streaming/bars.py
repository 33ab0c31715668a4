"""Structured Streaming over series: windowed bars with a watermark, duplicates, sessions, and state kept per token."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.rolling import KEY, PRICE, TIE, TIME


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Files as they come into a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bars(stream: DataFrame, minutes: int = 5, late: str = "10 minutes", slide: int | None = None) -> DataFrame:
    """OHLC bars of tumbling (or sliding) event-time windows. Rows later than the watermark are left out; works on batch tables too."""
    w = F.window(TIME, f"{minutes} minutes", f"{slide} minutes") if slide else F.window(TIME, f"{minutes} minutes")
    first, last = F.min_by(PRICE, F.struct(TIME, TIE)), F.max_by(PRICE, F.struct(TIME, TIE))
    out = stream.withWatermark(TIME, late).groupBy(KEY, w.alias("w")).agg(first.alias("open"), F.max(PRICE).alias("high"), F.min(PRICE).alias("low"), last.alias("close"), F.count("*").alias("n"))
    return out.select(KEY, F.col("w.start").alias("window_start"), "open", "high", "low", "close", "n")


def without_duplicates(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first row of each (token, time, tie) within the watermark."""
    return stream.withWatermark(TIME, late).dropDuplicatesWithinWatermark([KEY, TIME, TIE]) if stream.isStreaming else stream.dropDuplicates([KEY, TIME, TIE])


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of rows with no gap longer than `gap` between them."""
    out = stream.withWatermark(TIME, late).groupBy(KEY, F.session_window(TIME, gap).alias("w")).agg(F.count("*").alias("n"), F.avg(PRICE).alias("avg_price"))
    return out.select(KEY, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "avg_price")


def running_state(stream: DataFrame, span: int = 12, dead_after: int = 30) -> DataFrame:
    """Per token and trigger: rows so far, recursive exponential mean, length of the run of equal prices at the end, and whether the token is dead by it.

    Rows of a token count in the order (time, tie) within a trigger; state is one small row per token."""
    alpha = 2 / (span + 1)
    out = T.StructType([T.StructField(KEY, T.StringType()), T.StructField("n", T.LongType()), T.StructField("ewm", T.DoubleType()), T.StructField("flat_run", T.LongType()), T.StructField("is_dead", T.BooleanType())])
    kept = T.StructType([T.StructField("n", T.LongType()), T.StructField("ewm", T.DoubleType()), T.StructField("last", T.DoubleType()), T.StructField("run", T.LongType())])

    def step(key, parts: Iterable[pd.DataFrame], state):
        n, ewm, last, run = state.get if state.exists else (0, 0.0, float("nan"), 0)
        rows = pd.concat(list(parts)).sort_values([TIME, TIE])
        for p in rows[PRICE].astype(float):
            ewm = p if n == 0 else alpha * p + (1 - alpha) * ewm
            run = run + 1 if p == last else 1
            last, n = p, n + 1
        state.update((int(n), float(ewm), float(last), int(run)))
        yield pd.DataFrame({KEY: [key[0]], "n": [n], "ewm": [ewm], "flat_run": [run], "is_dead": [run >= dead_after]})

    return stream.groupBy(KEY).applyInPandasWithState(step, out, kept, "update", "NoTimeout")


def merge_statistics(stream: DataFrame, table: str, checkpoint: str):
    """Keeps (token, n, mean) up to date in a Parquet table: each batch is merged, counts add up and means are weighted."""
    from tickloom.operators.acf import merge_weighted

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(KEY).agg(F.count("*").alias("n"), F.avg(PRICE).alias("mean"))
        old_path, new_path = f"{table}/v={epoch - 1}", f"{table}/v={epoch}"
        old = spark.read.parquet(old_path) if epoch else spark.createDataFrame([], f"{KEY} string, n long, mean double")
        merge_weighted(old, new).write.mode("overwrite").parquet(new_path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
