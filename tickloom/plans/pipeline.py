"""The batch pipelines: quality and category, cleaning, features, targets; and the bot's bars, features and split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.rolling import KEY, TIE, TIME
from tickloom.operators import cleaning, features, quality, quant
from tickloom.session import stored


def categorised(s: DataFrame) -> DataFrame:
    """The series with the category of its token, stored by category: the quality report behind it is made once, and each strategy reads its own files."""
    report = quality.assign_category(quality.quality_report(s)).select(KEY, "category")
    return stored(s.join(report, KEY), "categorised", by="category")


def feature_table(s: DataFrame, horizons: tuple[int, ...] = features.HORIZONS) -> DataFrame:
    """Safe features and forward targets side by side, made in one pass: targets come from the whole series, so warm-up rows don't shorten them."""
    return features.safe_features(s, also=features.target_columns(horizons))


def run_pipeline(s: DataFrame, horizons: tuple[int, ...] = features.HORIZONS) -> DataFrame:
    """All four stages: categorise, clean by category, features, targets. What the first two give is stored, and read by the others."""
    cleaned = stored(cleaning.clean_by_category(categorised(s)), "cleaned")
    return feature_table(cleaned.drop("category"), horizons).join(cleaned.select(KEY, "category").distinct(), KEY)


def run_bot_pipeline(s: DataFrame, minutes: int = 5, dead_after: int = 30) -> DataFrame:
    """Bars, death by zero prices, moving features, scaling by the training share, and the split."""
    bars = quant.bot_bars(s, minutes).where(F.col("returns").isNotNull())
    rows = bars.select(KEY, F.col("window_start").alias(TIME), F.lit(0).cast("long").alias(TIE), F.col("avg_price").alias("price"), "volatility", "returns")
    rows = quality.running_zero_count(rows, dead_after)
    return features.minmax_train_scaled(features.bot_features(rows), "price")
