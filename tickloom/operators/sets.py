"""Membership of tokens in categories (folders): overlaps, differences and frequencies. Tables have token_id and category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.rolling import KEY


def members(df: DataFrame) -> DataFrame:
    return df.select(KEY, "category").distinct()


def overlap_pairs(df: DataFrame) -> DataFrame:
    """Tokens shared by each two categories, and their share of the smaller one. The join is by token, so pairs of categories stay few."""
    m = members(df)
    sizes = m.groupBy("category").agg(F.count("*").alias("size"))
    other = m.withColumnsRenamed({KEY: "_k", "category": "other"})
    both = m.join(other, (F.col(KEY) == F.col("_k")) & (F.col("category") < F.col("other"))).groupBy("category", "other").agg(F.count("*").alias("shared"))
    both = both.join(sizes.withColumnRenamed("size", "size_a"), "category").join(sizes.withColumnsRenamed({"category": "other", "size": "size_b"}), "other")
    return both.select("category", "other", "shared", (100.0 * F.col("shared") / F.least("size_a", "size_b")).alias("overlap_pct"))


def multi_category(df: DataFrame) -> DataFrame:
    """Tokens in more than one category, with the sorted list."""
    return members(df).groupBy(KEY).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("category")), ",").alias("categories")).where("n > 1")


def unique_to_category(df: DataFrame) -> DataFrame:
    """Tokens that stand in one category only."""
    return members(df).groupBy(KEY).agg(F.count("*").alias("n"), F.min("category").alias("category")).where("n = 1").select(KEY, "category")


def category_against_rest(df: DataFrame) -> DataFrame:
    """Per category: its tokens, those also found elsewhere, and those not."""
    per = members(df).join(members(df).groupBy(KEY).agg(F.count("*").alias("n")), KEY)
    return per.groupBy("category").agg(F.count("*").alias("tokens"), F.count_if(F.col("n") > 1).alias("elsewhere"), F.count_if(F.col("n") == 1).alias("only_here"))


def overlap_with(df: DataFrame, category: str) -> DataFrame:
    """Per other category: tokens that also stand in the given one."""
    m = members(df)
    base = m.where(F.col("category") == category).select(KEY)
    return m.where(F.col("category") != category).join(base, KEY, "left_semi").groupBy("category").agg(F.count("*").alias("shared"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(KEY).intersect(b.select(KEY))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(KEY).subtract(b.select(KEY))


def top_k_frequency(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most common values, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def shared_values(df: DataFrame, column: str) -> DataFrame:
    """Values that several tokens have, and how many."""
    return df.groupBy(column).agg(F.count_distinct(KEY).alias("tokens")).where("tokens > 1")


def category_distribution(df: DataFrame) -> DataFrame:
    """Tokens per category and their share."""
    n = members(df).groupBy("category").agg(F.count("*").alias("tokens"))
    total = n.agg(F.sum("tokens").alias("_all"))
    return n.crossJoin(F.broadcast(total)).select("category", "tokens", (100.0 * F.col("tokens") / F.col("_all")).alias("pct"))  # one row
