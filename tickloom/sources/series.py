"""Series tables from files, directories, databases and other tables, and the sinks they go to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.rolling import in_order, KEY, PRICE, TIE, TIME

SCHEMA = T.StructType([T.StructField(KEY, T.StringType()), T.StructField(TIME, T.TimestampType()), T.StructField(PRICE, T.DoubleType())])
FILE_SCHEMA = T.StructType(SCHEMA.fields[1:])


def as_series(df: DataFrame, key: str, time: str, price: str, tie: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Any table as a series: columns cast, renamed and pruned; without a tie column, ties in time keep no order of their own."""
    tie_col = F.col(tie) if tie else F.lit(0)
    return df.select(F.col(key).cast("string").alias(KEY), F.col(time).cast("timestamp").alias(TIME), tie_col.cast("long").alias(TIE), F.col(price).cast("double").alias(PRICE), *keep)


def read_directory(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One Parquet file per token, all files under a directory at once; the token is the file's stem, the category its folder."""
    files = spark.read.option("recursiveFileLookup", str(recursive).lower()).schema(FILE_SCHEMA).parquet(path)
    name = F.col("_metadata.file_name")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return files.select(F.regexp_replace(name, r"\.parquet$", "").alias(KEY), TIME, F.lit(0).cast("long").alias(TIE), PRICE, folder.alias("category"))


def catalogue(s: DataFrame) -> DataFrame:
    """Tokens with symbol and address (the parts of the id before and after its first underscore), rows, first and last time."""
    parts = F.split(F.col(KEY), "_", 2)
    return s.groupBy(KEY).agg(F.count("*").alias("n"), F.min(TIME).alias("first_time"), F.max(TIME).alias("last_time")).withColumns({"symbol": parts[0], "address": F.coalesce(F.get(parts, F.lit(1)), F.lit(""))})


def only_tokens(s: DataFrame, tokens: list[str]) -> DataFrame:
    return s.where(F.col(KEY).isin(tokens))


def has_exactly(df: DataFrame, names: tuple[str, ...] = (TIME, PRICE)) -> bool:
    """The schema gate: exactly these columns."""
    return sorted(df.columns) == sorted(names)


def sample_tokens(s: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The rows of n tokens, drawn by a hash of id and seed: the same tokens on any cluster."""
    drawn = s.select(KEY).distinct().orderBy(F.md5(F.concat(F.col(KEY), F.lit(f":{seed}"))), KEY).limit(n)
    return s.join(drawn, KEY, "left_semi")


def cap_per_category(tokens: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most n tokens of each category, drawn by hash. tokens: token_id, category."""
    order = Window.partitionBy("category").orderBy(F.md5(F.concat(F.col(KEY), F.lit(f":{seed}"))), KEY)
    return tokens.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n).drop("pick")


def sample_ratio(tokens: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """A share of the tokens, by hash."""
    mark = F.conv(F.substring(F.md5(F.concat(F.col(KEY), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return tokens.where(mark < ratio)


def first_folder_wins(s: DataFrame, priority: list[str]) -> DataFrame:
    """Of a token that stands in several categories, the rows of the first category in the list."""
    rank = F.array_position(F.lit(priority), F.col("category"))
    best = s.select(KEY, "category").distinct().withColumn("_r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.when(rank == 0, 1 << 30).otherwise(rank), "category"))).where("_r = 1").drop("_r")
    return s.join(best, [KEY, "category"], "left_semi")


def union_of_columns(*tables: DataFrame) -> DataFrame:
    """All rows, with the union of the columns; missing ones are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def union_on_common(*tables: DataFrame) -> DataFrame:
    """All rows, with the columns that every table has, in the first one's order."""
    names = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    out = tables[0].select(names)
    for t in tables[1:]:
        out = out.unionByName(t.select(names))
    return out


def loaded(s: DataFrame) -> DataFrame:
    """The rows with their place in the token's time order."""
    return s.withColumn("row_nr", F.row_number().over(in_order()).cast("long"))


def with_volume_placeholders(s: DataFrame) -> DataFrame:
    """The columns that later steps expect where no volume is known."""
    return s.withColumns({"volume": F.lit(0.0), "buy_volume": F.lit(0.0), "sell_volume": F.lit(0.0), "liquidity": F.lit(1000.0), "imbalance": F.lit(0.0), "imbalance_ratio": F.lit(0.0)})


def write_parquet(df: DataFrame, path: str, by: str | None = "category") -> None:
    """Parquet with zstd, in a folder per category where there is one."""
    out = df.write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy(by) if by and by in df.columns else out).parquet(path)


def export_category(s: DataFrame, tokens: DataFrame, path: str, category: str) -> None:
    """The rows of the tokens of a category, added to the category's folder under path."""
    chosen = s.join(tokens.where(F.col("category") == category).select(KEY).distinct(), KEY, "left_semi")
    chosen.drop("category").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/category={category}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """token_id, category, archetype, cluster_id from a JSON map category -> archetype -> {cluster_id, tokens}."""
    kind = "map<string,map<string,struct<cluster_id:int,tokens:array<string>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"archetype_data {kind}").alias("j")).select(F.explode("j.archetype_data").alias("category", "m"))
    return rows.select("category", F.explode("m").alias("archetype", "x")).select(F.explode("x.tokens").alias(KEY), "category", "archetype", "x.cluster_id")


def read_jdbc(spark: SparkSession, url: str, table: str = "token_prices", **options) -> DataFrame:
    """A database table as a series; the driver's jar must be on the class path. Pass partitionColumn and bounds for parallel reads."""
    return as_series(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), KEY, TIME, PRICE)


def save_table(df: DataFrame, name: str, buckets: int | None = None) -> None:
    """A managed table; bucketed by token, so that later windows and joins by token need no shuffle."""
    out = df.write.mode("overwrite")
    (out.bucketBy(buckets, KEY).sortBy(KEY, TIME) if buckets else out).saveAsTable(name)
