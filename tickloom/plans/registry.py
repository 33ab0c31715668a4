"""Registered queries of the series operators, each with DuckDB SQL for the same rows where SQL can express it.

Series come from events: token_id is event_type (a few long series) or user_id (many short ones), time ts, tie event_id, price value.
Column kinds in a query's list: r rounds to six digits (sums depend on the order of their terms), i is a whole number, t is a time in
microseconds, and the others are taken as they are. Both sides are built from the one list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import ranges
from tickloom.functions import rolling as R
from tickloom.functions.ewm import with_ewm
from tickloom.operators import acf, blocks, cleaning, cross, dtw, features, grouped, indicators, learning, lloyd, outliers, price, quality, quant, sets, spectral, staged
from tickloom.plans import pipeline
from tickloom.sources import gate, series
from tickloom.streaming import bars as streaming
from tickloom.streaming import lives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LONG, SHORT = "event_type", "user_id"
W = "(PARTITION BY token_id ORDER BY datetime, seq)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return series.as_series(table(spark, sf_dir, "events"), key, "ts", "value", "event_id")


def base_sql(key: str) -> str:
    """s: the series; r: with return, row from 0, rows of the token, and launch time."""
    return f"""s AS (SELECT CAST({key} AS VARCHAR) AS token_id, CAST(ts AS TIMESTAMP) AS datetime, event_id AS seq, value AS price FROM events),
r AS (SELECT *, price / lag(price) OVER w - 1 AS ret, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY token_id) AS cnt, min(datetime) OVER (PARTITION BY token_id) AS launch FROM s WINDOW w AS {W})"""


def roll(agg: str, expr: str, n: int, least: int | None = None) -> str:
    """A guarded rolling aggregate in SQL; agg has {} for the expression."""
    over = f"OVER (PARTITION BY token_id ORDER BY datetime, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    call = agg.replace("{}", expr) if "{}" in agg else f"{agg}({expr})"
    return f"(CASE WHEN count({expr}) {over} >= {n if least is None else least} THEN {call} {over} END)"


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) if ":" in c else (c, "") for c in spec.split()]


def rounded(c: Column) -> Column:
    """Six digits, as the SQL rounds: the product with a million to a whole number, halves away from zero. F.round goes by the decimal text instead, and differs where that ends in a 5."""
    scaled = c * 1e6
    return F.when(R.finite(scaled), F.round(scaled) / 1e6).otherwise(c)


def _spark_column(name: str, kind: str):
    c = F.col(name)
    return {"r": rounded(c.cast("double")), "i": c.cast("long"), "t": F.unix_micros(c)}.get(kind, c).alias(name)


def _sql_column(name: str, kind: str) -> str:
    name = f'"{name}"'
    return {"r": f"round(CAST({name} AS DOUBLE), 6) + 0.0 AS {name}", "i": f"CAST({name} AS BIGINT) AS {name}", "t": f"epoch_us({name}) AS {name}"}.get(kind, name)


def register(name: str, spec: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    cols = _columns(spec)
    QUERIES[name] = lambda spark, sf_dir: query(spark, sf_dir).select(*(_spark_column(*c) for c in cols))
    if sql:
        with_, _, body = sql.rpartition("\n;;\n") if "\n;;\n" in sql else ("", "", sql)
        ORACLES[name] = (f"WITH {with_}\n" if with_ else "") + f"SELECT {', '.join(_sql_column(*c) for c in cols)} FROM (\n{body}\n)"


def on_series(name: str, key: str, spec: str, op: Callable[[DataFrame], DataFrame], sql: str | None = None, ctes: str = "") -> None:
    """A query of an operator over the events series. sql: the body, over s, r and ctes."""
    full = None if sql is None else base_sql(key) + (",\n" + ctes if ctes else "") + "\n;;\n" + sql
    register(name, spec, lambda spark, sf_dir: op(events(spark, sf_dir, key)), full)


# --- scans, projections, filters ---------------------------------------------------------------------------------------------------
on_series("series_load_sorted", SHORT, "token_id seq:i price row_nr:i", series.loaded, "SELECT *, rn + 1 AS row_nr FROM r")
on_series("series_catalogue", SHORT, "token_id n:i first_time:t last_time:t symbol address", series.catalogue, "SELECT token_id, count(*) AS n, min(datetime) AS first_time, max(datetime) AS last_time, token_id AS symbol, '' AS address FROM s GROUP BY token_id")
on_series("series_only_tokens", LONG, "token_id seq:i price", lambda s: series.only_tokens(s, ["click", "view"]), "SELECT * FROM s WHERE token_id IN ('click', 'view')")
on_series("series_sample_tokens", SHORT, "token_id seq:i price", lambda s: series.sample_tokens(s, 10), "SELECT * FROM s WHERE token_id IN (SELECT token_id FROM (SELECT DISTINCT token_id FROM s) ORDER BY md5(token_id || ':42'), token_id LIMIT 10)")
on_series("series_volume_placeholders", LONG, "token_id seq:i price volume liquidity imbalance_ratio", series.with_volume_placeholders, "SELECT token_id, seq, price, CAST(0 AS DOUBLE) AS volume, CAST(1000 AS DOUBLE) AS liquidity, CAST(0 AS DOUBLE) AS imbalance_ratio FROM s")
on_series("filter_finite_positive", LONG, "token_id seq:i log_price:r", lambda s: s.where((F.col("price") > 0) & R.finite("price")).withColumn("log_price", F.log("price")), "SELECT token_id, seq, ln(price) AS log_price FROM s WHERE price > 0")
on_series("filter_long_enough", SHORT, "token_id seq:i price", cleaning.long_enough, "SELECT * FROM r WHERE cnt >= 60")
on_series("filter_common_range", SHORT, "token_id seq:i price", cross.common_range, "SELECT s.* FROM s, (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(datetime) AS a, max(datetime) AS b FROM s GROUP BY token_id)) e WHERE datetime BETWEEN e.a AND e.b")
on_series("finite_or_zero", LONG, "token_id seq:i price ret:r", lambda s: features.clean_numbers(R.with_returns(s)), "SELECT token_id, seq, price, coalesce(ret, 0) AS ret FROM r")
on_series("every_kth_row", LONG, "token_id seq:i price", lambda s: R.with_row(s).where("rn % 7 = 0"), "SELECT * FROM r WHERE rn % 7 = 0")
on_series("head_per_token", SHORT, "token_id seq:i rn:i", lambda s: R.with_row(s).where("rn < 5"), "SELECT * FROM r WHERE rn < 5")
register(
    "schema_union_missing_cols", "id:i price:r day kind",
    lambda spark, d: series.union_of_columns(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("price"), F.col("event_type").alias("kind"))),
    "SELECT o_orderkey AS id, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, NULL AS kind FROM orders UNION ALL SELECT event_id, value, NULL, event_type FROM events",
)
register(
    "schema_union_common_cols", "id:i price:r",
    lambda spark, d: series.union_on_common(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), "o_orderstatus"), table(spark, d, "events").select("event_type", F.col("event_id").alias("id"), F.col("value").alias("price"))),
    "SELECT o_orderkey AS id, o_totalprice AS price FROM orders UNION ALL SELECT event_id, value FROM events",
)


def categories(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, SHORT).join(table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("category")), "seq")


CATEGORIES = "s AS (SELECT CAST(user_id AS VARCHAR) AS token_id, ts AS datetime, event_id AS seq, value AS price, event_type AS category FROM events),\nm AS (SELECT DISTINCT token_id, category FROM s)\n;;\n"
ORDER = ["purchase", "signup", "view", "click", "error"]
register("first_folder_wins_dedupe", "token_id category seq:i", lambda spark, d: series.first_folder_wins(categories(spark, d), ORDER), CATEGORIES + f"SELECT s.* FROM s JOIN (SELECT token_id, arg_min(category, list_position({ORDER}, category)) AS best FROM m GROUP BY token_id) b ON s.token_id = b.token_id AND s.category = b.best")
register("category_cap", "token_id category", lambda spark, d: series.cap_per_category(sets.members(categories(spark, d)), 20), CATEGORIES + "SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5(token_id || ':42'), token_id) <= 20")
register("category_sample_ratio", "token_id category", lambda spark, d: series.sample_ratio(sets.members(categories(spark, d)), 0.3), CATEGORIES + "SELECT * FROM m WHERE CAST(('0x' || substr(md5(token_id || ':42'), 1, 8)) AS BIGINT) / 4294967296.0 < 0.3")

# --- rolling -----------------------------------------------------------------------------------------------------------------------
on_series("pct_change", LONG, "token_id seq:i ret:r ret5:r", lambda s: R.with_returns(s).withColumn("ret5", R.pct_change("price", 5)), f"SELECT token_id, seq, ret, price / lag(price, 5) OVER {W} - 1 AS ret5 FROM r")
on_series("log_returns", LONG, "token_id seq:i lr:r", lambda s: s.withColumn("lr", features.log_return()), f"SELECT token_id, seq, ln(price / lag(price) OVER {W}) AS lr FROM s")
on_series("rolling_mean_std_guarded", LONG, "token_id seq:i m20:r s20:r v5:r", lambda s: s.withColumns({"m20": R.mean("price", 20), "s20": R.std("price", 20), "v5": R.rolling(F.var_samp, "price", 5)}), f"SELECT token_id, seq, {roll('avg', 'price', 20)} AS m20, {roll('stddev_samp', 'price', 20)} AS s20, {roll('var_samp', 'price', 5)} AS v5 FROM s")
on_series("rolling_min_max_sum", SHORT, "token_id seq:i lo:r hi:r sum5:r", lambda s: s.withColumns({"lo": R.low("price", 10), "hi": R.high("price", 10), "sum5": R.total("price", 5, 1)}), f"SELECT token_id, seq, {roll('min', 'price', 10)} AS lo, {roll('max', 'price', 10)} AS hi, {roll('sum', 'price', 5, 1)} AS sum5 FROM s")
on_series("rolling_quantile_linear", LONG, "token_id seq:i q25:r q75:r med:r", lambda s: s.withColumns({"q25": R.quantile("price", 0.25, 30), "q75": R.quantile("price", 0.75, 30), "med": R.quantile("price", 0.5, 30)}), f"SELECT token_id, seq, {roll('quantile_cont({}, 0.25)', 'price', 30)} AS q25, {roll('quantile_cont({}, 0.75)', 'price', 30)} AS q75, {roll('quantile_cont({}, 0.5)', 'price', 30)} AS med FROM s")
on_series("rolling_quantile_nearest", SHORT, "token_id seq:i q:r", lambda s: s.withColumn("q", R.quantile_nearest("price", 0.25, 20)), f"SELECT token_id, seq, CASE WHEN count(price) OVER f >= 20 THEN list_sort(list(price) OVER f)[6] END AS q FROM s WINDOW f AS (PARTITION BY token_id ORDER BY datetime, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
on_series("expanding_sharpe", SHORT, "token_id seq:i exp_sharpe:r", features.expanding_sharpe, f"SELECT token_id, seq, CASE WHEN count(ret) OVER c >= 2 THEN avg(ret) OVER c / nullif(stddev_samp(ret) OVER c, 0) END AS exp_sharpe FROM r WINDOW c AS {W}")
on_series("expanding_max_drawdown", SHORT, "token_id seq:i top:r future:r", lambda s: s.withColumns({"top": F.max("price").over(R.so_far()), "future": F.max("price").over(R.from_here())}), "SELECT token_id, seq, max(price) OVER (PARTITION BY token_id ORDER BY datetime, seq ROWS UNBOUNDED PRECEDING) AS top, max(price) OVER (PARTITION BY token_id ORDER BY datetime, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS future FROM s")
on_series("expanding_moments", SHORT, "token_id seq:i exp_var:r exp_q05:r exp_skew:r", features.expanding_moments, f"SELECT token_id, seq, CASE WHEN count(ret) OVER c >= 3 THEN var_samp(ret) OVER c END AS exp_var, CASE WHEN count(ret) OVER c >= 3 THEN quantile_cont(ret, 0.05) OVER c END AS exp_q05, CASE WHEN count(ret) OVER c >= 3 THEN (avg(ret * ret * ret) OVER c - 3 * avg(ret) OVER c * avg(ret * ret) OVER c + 2 * avg(ret) OVER c ** 3) / nullif(var_pop(ret) OVER c, 0) ** 1.5 END AS exp_skew FROM r WINDOW c AS {W}")


def ewm_sql(alpha: float) -> str:
    return f"(SELECT a.token_id, a.seq, sum(b.price * pow(1 - {alpha}, a.rn - b.rn)) / sum(pow(1 - {alpha}, a.rn - b.rn)) AS e FROM r a JOIN r b ON a.token_id = b.token_id AND b.rn <= a.rn GROUP BY a.token_id, a.seq)"


on_series("ewm_adjusted", SHORT, "token_id seq:i ema_12:r ema_26:r ewm_10:r", lambda s: with_ewm(s, {"ema_12": ("price", {"span": 12}), "ema_26": ("price", {"span": 26}), "ewm_10": ("price", {"alpha": 0.1})}), f"SELECT a.token_id, a.seq, a.e AS ema_12, b.e AS ema_26, c.e AS ewm_10 FROM {ewm_sql(2 / 13)} a JOIN {ewm_sql(2 / 27)} b USING (token_id, seq) JOIN {ewm_sql(0.1)} c USING (token_id, seq)")
on_series("rank_dense_ordinal", SHORT, "token_id seq:i dense:i ordinal:i", lambda s: s.withColumns({"dense": F.dense_rank().over(Window.partitionBy("token_id").orderBy("price")), "ordinal": F.row_number().over(Window.partitionBy("token_id").orderBy("price", "seq"))}), "SELECT token_id, seq, dense_rank() OVER (PARTITION BY token_id ORDER BY price) AS dense, row_number() OVER (PARTITION BY token_id ORDER BY price, seq) AS ordinal FROM s")
on_series("flat_runs", SHORT, "token_id max_flat:i", lambda s: quality.flat_runs(s.withColumn("price", F.floor(F.col("price") / 100))), f"SELECT token_id, max(n) AS max_flat FROM (SELECT token_id, g, count(*) AS n FROM (SELECT *, sum(c) OVER {W} AS g FROM (SELECT *, CASE WHEN floor(price / 100) = lag(floor(price / 100)) OVER {W} THEN 0 ELSE 1 END AS c FROM s)) GROUP BY token_id, g) GROUP BY token_id")

# --- resample and fill -------------------------------------------------------------------------------------------------------------


def bucket_sql(seconds: int) -> str:
    return f"time_bucket(INTERVAL {seconds} SECONDS, datetime)"


on_series("ohlc_5m", LONG, "token_id window_start:t open:r high:r low:r close:r n:i avg_price:r volatility:r", quant.market_bars, f"SELECT token_id, {bucket_sql(300)} AS window_start, first(price ORDER BY datetime, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY datetime, seq) AS close, count(*) AS n, avg(price) AS avg_price, stddev_samp(price) AS volatility FROM s GROUP BY ALL")
on_series("bot_bars", LONG, "token_id window_start:t avg_price:r returns:r", lambda s: quant.bot_bars(s, 60), f"SELECT *, avg_price / lag(avg_price) OVER (PARTITION BY token_id ORDER BY window_start) - 1 AS returns FROM (SELECT token_id, {bucket_sql(3600)} AS window_start, avg(price) AS avg_price FROM s GROUP BY ALL)")
on_series("minute_first", LONG, "token_id bucket:t price:r", cross.minute_first, f"SELECT token_id, {bucket_sql(60)} AS bucket, first(price ORDER BY datetime, seq) AS price FROM s GROUP BY ALL")
on_series("duplicate_mean", SHORT, "token_id datetime:t price:r", lambda s: cleaning.duplicate_means(s.withColumn("datetime", F.date_trunc("day", "datetime"))), "SELECT token_id, date_trunc('day', datetime) AS datetime, avg(price) AS price FROM s GROUP BY ALL")
MINUTES = "m AS (SELECT token_id, date_trunc('minute', datetime) AS datetime, avg(price) AS price FROM s GROUP BY ALL),\nspine AS (SELECT token_id, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 MINUTE)) AS datetime FROM m GROUP BY token_id),\nf AS (SELECT spine.token_id, spine.datetime, m.price, epoch(spine.datetime) / 60 AS x FROM spine LEFT JOIN m USING (token_id, datetime)),\ng AS (SELECT *, last_value(price IGNORE NULLS) OVER a AS p0, last_value(CASE WHEN price IS NOT NULL THEN x END IGNORE NULLS) OVER a AS x0, first_value(price IGNORE NULLS) OVER b AS p1, first_value(CASE WHEN price IS NOT NULL THEN x END IGNORE NULLS) OVER b AS x1 FROM f WINDOW a AS (PARTITION BY token_id ORDER BY datetime ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY token_id ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
on_series("minute_spine_gaps", LONG, "token_id minutes:i missing:i", lambda s: cleaning.spine_gaps(cleaning.minute_means(s)), "SELECT token_id, count(*) AS minutes, count(*) FILTER (price IS NULL) AS missing FROM f GROUP BY token_id", MINUTES)
on_series("gap_fill_limited", LONG, "token_id datetime:t price:r is_filled", lambda s: cleaning.fill_gaps(cleaning.minute_means(s), 10), "SELECT token_id, datetime, coalesce(price, p0 + (p1 - p0) * (x - x0) / (x1 - x0)) AS price, price IS NULL AS is_filled FROM g WHERE price IS NOT NULL OR x1 - x0 - 1 <= 10", MINUTES)
on_series("gap_fill_whole_column", LONG, "token_id minutes:i filled:i total:r", lambda s: cleaning.fill_gaps(cleaning.minute_means(s), 10, True).groupBy("token_id").agg(F.count("*").alias("minutes"), F.count_if("is_filled").alias("filled"), (F.sum("price") / 1e6).alias("total")), "SELECT token_id, count(*) AS minutes, count(*) FILTER (price IS NULL) AS filled, sum(coalesce(price, p0 + (p1 - p0) * (x - x0) / (x1 - x0))) / 1e6 AS total FROM g JOIN (SELECT token_id, min(x1 - x0 - 1) FILTER (price IS NULL) AS least FROM g GROUP BY token_id) USING (token_id) WHERE price IS NOT NULL OR least <= 10 GROUP BY token_id", MINUTES)
HOLES = "h AS (SELECT token_id, datetime, seq, rn, CASE WHEN seq % 3 = 0 THEN price END AS p FROM r),\ng AS (SELECT *, last_value(p IGNORE NULLS) OVER a AS p0, last_value(CASE WHEN p IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS x0, first_value(p IGNORE NULLS) OVER b AS p1, first_value(CASE WHEN p IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS x1 FROM h WINDOW a AS (PARTITION BY token_id ORDER BY datetime, seq ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY token_id ORDER BY datetime, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
holes = lambda s: R.with_row(s).withColumn("p", F.when(F.col("seq") % 3 == 0, F.col("price")))
on_series("forward_backward_fill", SHORT, "token_id seq:i ffill:r bfill:r", lambda s: holes(s).withColumns({"ffill": R.forward_fill("p"), "bfill": R.backward_fill("p")}), "SELECT token_id, seq, p0 AS ffill, p1 AS bfill FROM g", HOLES)
on_series("interpolate_linear", SHORT, "token_id seq:i v:r", lambda s: holes(s).withColumn("v", R.interpolated("p", "rn")), "SELECT token_id, seq, coalesce(p, p0 + (p1 - p0) * (rn - x0) / (x1 - x0)) AS v FROM g", HOLES)
on_series("align_outer_fill", LONG, "token_id bucket:t price:r", lambda s: cross.aligned_outer(s, 60), "SELECT token_id, bucket, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY token_id ORDER BY bucket ROWS UNBOUNDED PRECEDING), first_value(price IGNORE NULLS) OVER (PARTITION BY token_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM (SELECT * FROM (SELECT DISTINCT token_id FROM b), (SELECT DISTINCT bucket FROM b)) LEFT JOIN b USING (token_id, bucket)", f"b AS (SELECT token_id, {bucket_sql(3600)} AS bucket, first(price ORDER BY datetime, seq) AS price FROM s GROUP BY ALL)")

# --- quality -----------------------------------------------------------------------------------------------------------------------
on_series("basic_stats", SHORT, "token_id n:i mean_price:r std_price:r min_price:r max_price:r span_hours:r price_range:r cv:r", quality.basic_stats, "SELECT token_id, count(price) AS n, avg(price) AS mean_price, stddev_samp(price) AS std_price, min(price) AS min_price, max(price) AS max_price, (epoch_us(max(datetime)) - epoch_us(min(datetime))) / 3.6e9 AS span_hours, max(price) - min(price) AS price_range, stddev_samp(price) / nullif(avg(price), 0) AS cv FROM s GROUP BY token_id")
on_series("launch_context", SHORT, "token_id launch_year:i launch_month:i launch_weekday:i launch_hour:i is_weekend market_era", quality.launch_context, "SELECT token_id, year(t) AS launch_year, month(t) AS launch_month, isodow(t) - 1 AS launch_weekday, hour(t) AS launch_hour, isodow(t) >= 6 AS is_weekend, CASE year(t) WHEN 2022 THEN '2022_bear' WHEN 2023 THEN '2023_recovery' WHEN 2024 THEN '2024_bull' ELSE '2025_unknown' END AS market_era FROM (SELECT token_id, min(datetime) AS t FROM s GROUP BY token_id)")
STEPS = f"st AS (SELECT *, (epoch_us(datetime) - lag(epoch_us(datetime)) OVER {W}) / 6e7 AS gap, (lag(epoch_us(datetime)) OVER {W} - epoch_us(launch)) / 6e7 AS start_minute FROM r),\ngs AS (SELECT token_id, count(*) FILTER (gap > 1.5) AS total_gaps, coalesce(max(gap) FILTER (gap > 1.5), 0) AS max_gap, coalesce(avg(gap) FILTER (gap > 1.5), 0) AS avg_gap FROM st GROUP BY token_id)"
on_series("gap_rows", SHORT, "token_id seq:i gap_minutes:r start_minute:r kind", lambda s: quality.gaps(s).withColumn("kind", quality.gap_fill_kind(F.col("gap_minutes"))), "SELECT token_id, seq, gap AS gap_minutes, start_minute, CASE WHEN gap <= 1 THEN 'linear' WHEN gap <= 5 THEN 'polynomial' WHEN gap <= 10 THEN 'forward_fill_linear' ELSE 'exclude' END AS kind FROM st WHERE gap > 1.5", STEPS)
on_series("gap_summary", SHORT, "token_id total_gaps:i max_gap:r avg_gap:r", quality.gap_summary, "SELECT * FROM gs", STEPS)
on_series("extreme_movements", SHORT, "token_id max_minute_return:r total_return:r extreme_minutes:i extreme_minute_jump extreme_total_return", quality.extreme_movements, "SELECT token_id, max(abs(ret)) AS max_minute_return, last(price ORDER BY datetime, seq) / first(price ORDER BY datetime, seq) - 1 AS total_return, count(*) FILTER (abs(ret) > 100) AS extreme_minutes, coalesce(max(abs(ret)) > 100, false) AS extreme_minute_jump, coalesce(abs(last(price ORDER BY datetime, seq) / first(price ORDER BY datetime, seq) - 1) > 10000, false) AS extreme_total_return FROM r GROUP BY token_id")
ANOMALIES = "q AS (SELECT token_id, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM s GROUP BY token_id),\nan AS (SELECT token_id, count(*) FILTER (price = 0) AS zero_prices, count(*) FILTER (price < 0) AS negative_prices, count(*) FILTER (ret > 10) AS extreme_up, count(*) FILTER (ret < -0.9) AS extreme_down, count(*) FILTER (abs(ret) > 100) AS jumps, count(*) FILTER (price < q1 - 10 * (q3 - q1) OR price > q3 + 10 * (q3 - q1)) AS iqr_outliers FROM r JOIN q USING (token_id) GROUP BY token_id)"
on_series("price_anomalies", SHORT, "token_id zero_prices:i negative_prices:i extreme_up:i extreme_down:i jumps:i iqr_outliers:i", quality.price_anomalies, "SELECT * FROM an", ANOMALIES)
SCORE = STEPS + ",\nsc AS (SELECT token_id, n_rows, n_times, total_gaps, max_gap, greatest(0.0, least(100.0, 100 - 100.0 * (n_rows - n_times) / n_rows - 100.0 * n_invalid / n_rows - least(total_gaps, 10))) AS quality_score FROM (SELECT token_id, count(*) AS n_rows, count(DISTINCT datetime) AS n_times, count(*) FILTER (price <= 0) AS n_invalid FROM s GROUP BY token_id) JOIN gs USING (token_id))"
on_series("quality_score", SHORT, "token_id n_rows:i n_times:i quality_score:r", quality.quality_score, "SELECT * FROM sc", SCORE)
DEATH = "dd AS (SELECT token_id, count(*) FILTER (rn > coalesce(d, -1)) AS tail_rows FROM (SELECT token_id, rn, max(CASE WHEN price <> last THEN rn END) OVER (PARTITION BY token_id) AS d FROM (SELECT *, last_value(price) OVER (PARTITION BY token_id ORDER BY datetime, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM {0})) GROUP BY token_id)"
on_series("death_duration", SHORT, "token_id tail_rows:i death_hours:i is_dead", quality.death_duration, "SELECT *, floor(tail_rows / 60) AS death_hours, floor(tail_rows / 60) >= 1 AS is_dead FROM dd", DEATH.format("r"))
REPORT = SCORE + ",\n" + ANOMALIES + ",\n" + DEATH.format("r") + ",\nvo AS (SELECT token_id, coalesce(max(abs(ret)) > 100, false) OR coalesce(abs(last(price ORDER BY datetime, seq) / first(price ORDER BY datetime, seq) - 1) > 1000, false) OR coalesce(stddev_samp(ret) > 100, false) OR coalesce(max(price) / min(price) - 1 > 100, false) AS is_extreme, (epoch_us(max(datetime)) - epoch_us(min(datetime))) / 3.6e9 AS hours_covered FROM r GROUP BY token_id),\nrep AS (SELECT *, floor(tail_rows / 60) >= 1 AS is_dead, least(100.0, 100 * n_rows / (hours_covered * 60 + 1)) AS completeness_pct, CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 80 THEN 'good' WHEN quality_score >= 60 THEN 'fair' ELSE 'poor' END AS quality_rating FROM sc JOIN an USING (token_id) JOIN dd USING (token_id) JOIN vo USING (token_id))"
REP = "token_id n_rows:i quality_score:r total_gaps:i max_gap:r iqr_outliers:i is_dead is_extreme hours_covered:r completeness_pct:r quality_rating"
on_series("quality_report", SHORT, REP, quality.quality_report, "SELECT * FROM rep", REPORT)
on_series("quality_summary", SHORT, "tokens:i avg_score:r dead:i extreme:i with_gaps:i avg_hours:r well_rated:i", lambda s: quality.quality_summary(quality.quality_report(s)), "SELECT count(*) AS tokens, avg(quality_score) AS avg_score, count(*) FILTER (is_dead) AS dead, count(*) FILTER (is_extreme) AS extreme, count(*) FILTER (total_gaps > 0) AS with_gaps, avg(hours_covered) AS avg_hours, count(*) FILTER (quality_rating IN ('excellent', 'good')) AS well_rated FROM rep", REPORT)
on_series("recommended_tokens", SHORT, "token_id quality_score:r hours_covered:r", lambda s: quality.recommended(quality.quality_report(s)), "SELECT * FROM rep WHERE hours_covered >= 1 AND quality_score >= 80", REPORT)
on_series("category_assign", SHORT, "token_id category", lambda s: quality.assign_category(quality.quality_report(s)), "SELECT token_id, CASE WHEN total_gaps > 5 OR max_gap > 30 THEN 'tokens_with_gaps' WHEN NOT is_extreme AND NOT is_dead THEN 'normal_behavior_tokens' WHEN is_extreme THEN 'tokens_with_extremes' ELSE 'dead_tokens' END AS category FROM rep", REPORT)
on_series("gap_investigation", SHORT, "token_id severity rows_per_hour:r recommendation", lambda s: quality.investigate_gaps(quality.quality_report(s)), "SELECT token_id, CASE WHEN total_gaps > 10 THEN 'excessive_gaps' WHEN max_gap > 30 THEN 'large_gaps' WHEN max_gap > 5 THEN 'medium_gaps' ELSE 'small_gaps_only' END AS severity, n_rows / nullif(hours_covered, 0) AS rows_per_hour, CASE WHEN total_gaps > 50 OR max_gap > 720 OR quality_score < 50 THEN 'remove' WHEN quality_score >= 80 AND max_gap <= 120 THEN 'keep_and_clean' ELSE 'needs_manual_review' END AS recommendation FROM rep WHERE total_gaps > 5 OR max_gap > 30", REPORT)
on_series("return_anomalies", SHORT, "token_id anomalies:i max_return:r min_return:r", quality.return_anomalies, "SELECT token_id, count(*) FILTER (z > 3) AS anomalies, max(ret) AS max_return, min(ret) AS min_return FROM (SELECT *, abs((ret - avg(ret) OVER p) / nullif(stddev_samp(ret) OVER p, 0)) AS z FROM r WINDOW p AS (PARTITION BY token_id)) GROUP BY token_id")
on_series("length_percentiles", SHORT, "p10:r p50:r p99:r mean:r min:i max:i", quality.length_percentiles, "SELECT quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.99) AS p99, avg(n) AS mean, min(n) AS min, max(n) AS max FROM (SELECT count(*)::DOUBLE AS n FROM s GROUP BY token_id)")
low_as_zero = lambda s: s.withColumn("price", F.when(F.col("price") < 20, 0.0).otherwise(F.col("price")))
on_series("running_zero_death", LONG, "token_id seq:i zero_streak:i cv:r is_dead", lambda s: quality.running_zero_count(low_as_zero(s)), f"SELECT * FROM (SELECT *, z > 30 AS is_dead, z AS zero_streak FROM (SELECT *, sum(CASE WHEN price = 0 THEN 1 ELSE 0 END) OVER {W} AS z, stddev_samp(price) OVER (PARTITION BY token_id) / avg(price) OVER (PARTITION BY token_id) AS cv FROM (SELECT * REPLACE (CASE WHEN price < 20 THEN 0 ELSE price END AS price) FROM s))) WHERE NOT (is_dead AND price = 0)")

# --- outliers ----------------------------------------------------------------------------------------------------------------------
P = "OVER (PARTITION BY token_id)"
on_series("outlier_winsor", SHORT, "token_id seq:i is_outlier capped:r magnitude:r", outliers.winsor, "SELECT *, greatest(least(price, hi), lo) AS capped, price < lo OR price > hi AS is_outlier, abs((price - greatest(least(price, hi), lo)) / greatest(least(price, hi), lo)) AS magnitude FROM (SELECT *, quantile_cont(price, 0.01) OVER p AS lo, quantile_cont(price, 0.99) OVER p AS hi FROM s WINDOW p AS (PARTITION BY token_id))")
on_series("outlier_zscore", SHORT, "token_id seq:i z:r is_outlier", outliers.zscore, f"SELECT *, coalesce(abs(z) > 3, false) AS is_outlier FROM (SELECT *, (price - avg(price) {P}) / nullif(stddev_samp(price) {P}, 0) AS z FROM s)")
on_series("outlier_iqr", SHORT, "token_id seq:i is_outlier", outliers.iqr, f"SELECT *, price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1) AS is_outlier FROM (SELECT *, quantile_cont(price, 0.25) {P} AS q1, quantile_cont(price, 0.75) {P} AS q3 FROM s)")
on_series("outlier_mad", SHORT, "token_id seq:i mz:r is_outlier", outliers.modified_z, f"SELECT *, coalesce(abs(mz) > 3.5, false) AS is_outlier FROM (SELECT *, 0.6745 * (price - med) / nullif(quantile_cont(abs(price - med), 0.5) {P}, 0) AS mz FROM (SELECT *, quantile_cont(price, 0.5) {P} AS med FROM s))")
on_series("outlier_winsor_local", LONG, "token_id flagged:i", lambda s: outliers.local_winsor(R.with_returns(s), nearest=False).groupBy("token_id").agg(F.count_if("is_outlier").alias("flagged")), f"SELECT token_id, count(*) FILTER (ret < lo OR ret > hi) AS flagged FROM (SELECT *, {roll('quantile_cont({}, 0.005)', 'ret', 60)} AS lo, {roll('quantile_cont({}, 0.995)', 'ret', 60)} AS hi FROM r) GROUP BY token_id")
on_series("outlier_winsor_local_nearest", SHORT, "token_id flagged:i", lambda s: outliers.local_winsor(R.with_returns(s)).groupBy("token_id").agg(F.count_if("is_outlier").alias("flagged")), "SELECT token_id, 0 AS flagged FROM s GROUP BY token_id")
on_series("outlier_z_local", LONG, "token_id seq:i is_outlier", lambda s: outliers.local_z(R.with_returns(s)), f"SELECT token_id, seq, coalesce(abs((ret - {roll('avg', 'ret', 60)}) / nullif({roll('stddev_samp', 'ret', 60)}, 0)) > 5, false) AS is_outlier FROM r")
on_series("outlier_iqr_local", LONG, "token_id seq:i is_outlier", lambda s: outliers.local_iqr(R.with_returns(s)), f"SELECT token_id, seq, coalesce(ret < q1 - 3 * (q3 - q1) OR ret > q3 + 3 * (q3 - q1), false) AS is_outlier FROM (SELECT *, {roll('quantile_cont({}, 0.25)', 'ret', 60)} AS q1, {roll('quantile_cont({}, 0.75)', 'ret', 60)} AS q3 FROM r)")
on_series("outlier_mad_local", LONG, "token_id seq:i is_outlier", lambda s: outliers.local_modified_z(R.with_returns(s)), f"SELECT token_id, seq, coalesce(abs(0.6745 * (ret - med) / nullif({roll('quantile_cont({}, 0.5)', 'dev', 60)}, 0)) > 5, false) AS is_outlier FROM (SELECT *, abs(ret - med) AS dev FROM (SELECT *, {roll('quantile_cont({}, 0.5)', 'ret', 60)} AS med FROM r))")
CONSENSUS = f"v AS (SELECT *, CAST(by_winsor AS INT) + CAST(by_z AS INT) + CAST(by_iqr AS INT) + CAST(by_mad AS INT) AS votes FROM (SELECT *, price < lo OR price > hi AS by_winsor, coalesce(abs(price - m) / nullif(sd, 0) > 3, false) AS by_z, price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1) AS by_iqr, coalesce(abs(0.6745 * (price - med) / nullif(quantile_cont(abs(price - med), 0.5) {P}, 0)) > 3.5, false) AS by_mad FROM (SELECT *, quantile_cont(price, 0.01) {P} AS lo, quantile_cont(price, 0.99) {P} AS hi, avg(price) {P} AS m, stddev_samp(price) {P} AS sd, quantile_cont(price, 0.25) {P} AS q1, quantile_cont(price, 0.5) {P} AS med, quantile_cont(price, 0.75) {P} AS q3 FROM s)))"
on_series("outlier_consensus", SHORT, "token_id seq:i votes:i is_outlier", outliers.consensus, "SELECT *, votes >= 2 AS is_outlier FROM v", CONSENSUS)
on_series("outlier_consensus_summary", SHORT, "token_id outliers:i outlier_pct:r by_winsor:i by_iqr:i agreement_winsor_iqr:r", lambda s: outliers.consensus_summary(outliers.consensus(s)), "SELECT token_id, count(*) FILTER (votes >= 2) AS outliers, 100.0 * avg(CAST(votes >= 2 AS INT)) AS outlier_pct, count(*) FILTER (by_winsor) AS by_winsor, count(*) FILTER (by_iqr) AS by_iqr, avg(CAST(by_winsor = by_iqr AS INT)) AS agreement_winsor_iqr FROM v GROUP BY token_id", CONSENSUS)
on_series("winsorize_features", SHORT, "token_id seq:i price:r ret:r", lambda s: outliers.winsorized(R.with_returns(s), ["price", "ret"]), "SELECT token_id, seq, greatest(least(price, ph), pl) AS price, CASE WHEN ret IS NOT NULL THEN greatest(least(ret, rh), rl) END AS ret FROM r, (SELECT quantile_cont(price, 0.005) AS pl, quantile_cont(price, 0.995) AS ph, quantile_cont(ret, 0.005) AS rl, quantile_cont(ret, 0.995) AS rh FROM r)")
on_series("winsorize_per_token", SHORT, "token_id seq:i price:r", lambda s: outliers.winsorized(s, ["price"], per_token=True), f"SELECT token_id, seq, greatest(least(price, quantile_cont(price, 0.995) {P}), quantile_cont(price, 0.005) {P}) AS price FROM s")

# --- cleaning ----------------------------------------------------------------------------------------------------------------------
flat_tail = lambda s: R.with_row(s).withColumn("_n", F.count("*").over(R.whole())).withColumn("price", F.when(F.col("rn") >= F.col("_n") - 70, 5.0).otherwise(F.col("price"))).drop("rn", "_n")
FLAT_TAIL = "ft AS (SELECT * REPLACE (CASE WHEN rn >= cnt - 70 THEN 5.0 ELSE price END AS price) FROM r)"
on_series("trim_death_tail", LONG, "token_id seq:i price:r", lambda s: cleaning.trim_death_tail(flat_tail(s)), "SELECT * FROM (SELECT *, coalesce(max(CASE WHEN abs(price - last) > 0.0001 * abs(last) THEN rn END) OVER (PARTITION BY token_id), -1) AS moved FROM (SELECT *, last_value(price) OVER (PARTITION BY token_id ORDER BY datetime, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM ft)) WHERE cnt - 1 - moved < 60 OR rn <= moved + 2", FLAT_TAIL)
on_series("listing_artifact", SHORT, "token_id seq:i is_artifact", lambda s: cleaning.listing_artifacts(s, "aggressive"), "SELECT token_id, seq, coalesce(rn < 20 AND price > 10 * med AND rn < cnt - 5 AND low < price * 0.1, false) AND cnt >= 20 AS is_artifact FROM (SELECT *, quantile_cont(price, 0.5) OVER (PARTITION BY token_id) AS med, min(price) OVER (PARTITION BY token_id ORDER BY datetime, seq ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS low FROM r)")
on_series("ratio_gate", SHORT, "token_id seq:i", lambda s: cleaning.ratio_gate(s, 300.0), "SELECT * FROM (SELECT *, max(price) OVER (PARTITION BY token_id) / min(price) FILTER (price > 0) OVER (PARTITION BY token_id) AS q FROM s) WHERE q <= 300")
on_series("error_interpolate", SHORT, "token_id seq:i price:r is_error", lambda s: cleaning.data_errors(s, 20.0, 20.0), f"SELECT token_id, seq, coalesce(abs(ret) > 20, false) AS is_error, CASE WHEN abs(ret) > 20 THEN coalesce((lag(price) OVER w + lead(price) OVER w) / 2, lag(price) OVER w) ELSE price END AS price FROM r WINDOW w AS {W}")
on_series("variability_gate", SHORT, "token_id price_cv:r tick_frequency:r range_efficiency:r signal_strength:r unique_prices:i max_flat:i passes:i is_flat", cleaning.variability, f"SELECT *, CAST(price_cv > 0.001 AS INT) + CAST(CASE WHEN max_flat > 1 THEN max_flat ELSE 0 END < 120 AS INT) + CAST(coalesce(tick_frequency > 0.05, false) AS INT) + CAST(range_efficiency > 0.01 AS INT) + CAST(coalesce(signal_strength > 0.02, false) AS INT) AS passes, CAST(price_cv > 0.001 AS INT) + CAST(CASE WHEN max_flat > 1 THEN max_flat ELSE 0 END < 120 AS INT) + CAST(coalesce(tick_frequency > 0.05, false) AS INT) + CAST(range_efficiency > 0.01 AS INT) + CAST(coalesce(signal_strength > 0.02, false) AS INT) < 3 AS is_flat FROM (SELECT token_id, stddev_pop(price) / avg(price) AS price_cv, count(*) FILTER (d <> 0) / nullif(count(d), 0) AS tick_frequency, least(1.0, (max(price) - min(price)) / avg(price)) AS range_efficiency, count(*) FILTER (abs(d) > 0.001) / nullif(count(d), 0) AS signal_strength, count(DISTINCT price) AS unique_prices FROM (SELECT *, price - lag(price) OVER {W} AS d FROM s) GROUP BY token_id) JOIN (SELECT token_id, max(n) AS max_flat FROM (SELECT token_id, g, count(*) AS n FROM (SELECT *, sum(c) OVER {W} AS g FROM (SELECT *, CASE WHEN price = lag(price) OVER {W} THEN 0 ELSE 1 END AS c FROM s)) GROUP BY token_id, g) GROUP BY token_id) USING (token_id)")
on_series("activity_ratio", SHORT, "token_id activity_ratio:r", cleaning.activity_ratio, "SELECT token_id, coalesce((count(*) FILTER (rn % 5 = 0 AND n10 = 10 AND u10 > 2) + count(*) FILTER (rn % 15 = 0 AND n30 = 30 AND u30 > 2) + count(*) FILTER (rn % 30 = 0 AND n60 = 60 AND u60 > 2)) / nullif(count(*) FILTER (rn % 5 = 0 AND n10 = 10) + count(*) FILTER (rn % 15 = 0 AND n30 = 30) + count(*) FILTER (rn % 30 = 0 AND n60 = 60), 0), 0) AS activity_ratio FROM (SELECT *, count(*) OVER a AS n10, count(DISTINCT price) OVER a AS u10, count(*) OVER b AS n30, count(DISTINCT price) OVER b AS u30, count(*) OVER c AS n60, count(DISTINCT price) OVER c AS u60 FROM r WINDOW a AS (PARTITION BY token_id ORDER BY datetime, seq ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), b AS (PARTITION BY token_id ORDER BY datetime, seq ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING), c AS (PARTITION BY token_id ORDER BY datetime, seq ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING)) GROUP BY token_id")
stairs = lambda s: R.with_row(s).withColumn("price", F.when((F.col("rn") >= 100) & (F.col("rn") < 140), 5000.0).otherwise(F.col("price"))).drop("rn")
on_series("staircase_cut", LONG, "token_id cut:i", lambda s: cleaning.staircase_cuts(stairs(s)))
on_series("invalid_price_fix", SHORT, "token_id seq:i price:r is_fixed", lambda s: cleaning.invalid_prices(s.withColumn("price", F.when(F.col("seq") % 50 == 0, 0.0).otherwise(F.col("price"))), 0.05), "SELECT token_id, seq, price = 0 AS is_fixed, coalesce(p, p0 + (p1 - p0) * (rn - x0) / (x1 - x0)) AS price FROM g WHERE share <= 0.05 AND coalesce(p, p0 + (p1 - p0) * (rn - x0) / (x1 - x0)) IS NOT NULL", "z AS (SELECT * REPLACE (CASE WHEN seq % 50 = 0 THEN 0 ELSE price END AS price) FROM r),\nh AS (SELECT *, CASE WHEN price > 0 THEN price END AS p, avg(CASE WHEN price <= 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY token_id) AS share FROM z),\ng AS (SELECT *, last_value(p IGNORE NULLS) OVER a AS p0, last_value(CASE WHEN p IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS x0, first_value(p IGNORE NULLS) OVER b AS p1, first_value(CASE WHEN p IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS x1 FROM h WINDOW a AS (PARTITION BY token_id ORDER BY datetime, seq ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY token_id ORDER BY datetime, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
on_series("clean_by_category", SHORT, "token_id datetime:t price:r category", lambda s: cleaning.clean_by_category(pipeline.categorised(s)))
on_series("graduated_cleaning", SHORT, "horizon token_id seq:i price:r", cleaning.graduated)
on_series("exclusion_counts", SHORT, "status tokens:i rows_lost:i", lambda s: cleaning.exclusion_counts(cleaning.exclusions(s, cleaning.long_enough(s))), "SELECT CASE WHEN n < 60 THEN 'excluded' ELSE 'unchanged' END AS status, count(*) AS tokens, sum(CASE WHEN n < 60 THEN n ELSE 0 END) AS rows_lost FROM (SELECT token_id, count(*) AS n FROM s GROUP BY token_id) GROUP BY 1")

# --- price -------------------------------------------------------------------------------------------------------------------------
STATS = "ps AS (SELECT token_id, min(price) AS min_price, max(price) AS max_price, avg(price) AS mean_price, quantile_cont(price, 0.5) AS median_price, stddev_samp(price) AS std_price, first(price ORDER BY datetime, seq) AS launch_price, last(price ORDER BY datetime, seq) AS last_price, last(price ORDER BY datetime, seq) / first(price ORDER BY datetime, seq) - 1 AS total_return FROM s GROUP BY token_id)"
DRAW = "dg AS (SELECT *, (price - max(price) OVER p) / max(price) OVER p AS dd FROM r WINDOW p AS (PARTITION BY token_id)),\nlo AS (SELECT token_id, first(datetime ORDER BY dd, datetime, seq) AS t0, first(price ORDER BY dd, datetime, seq) AS p0 FROM dg GROUP BY token_id),\ndr AS (SELECT token_id, min(dd) AS max_drawdown, avg(dd) AS avg_drawdown, count(*) FILTER (ret > 0) AS total_up_moves, count(*) FILTER (ret < 0) AS total_down_moves, coalesce((epoch_us(min(datetime) FILTER (datetime > t0 AND price >= p0)) - epoch_us(min(t0))) / 6e7, 0) AS recovery_minutes FROM dg JOIN lo USING (token_id) GROUP BY token_id)"
VOL = f"vv AS (SELECT *, coalesce({roll('stddev_samp', 'ret', 60)}, 0) AS vol FROM r),\nvm AS (SELECT token_id, avg(vol) AS avg_volatility, max(vol) AS max_volatility, stddev_samp(chg) AS volatility_of_volatility FROM (SELECT *, vol / nullif(lag(vol) OVER {W}, 0) - 1 AS chg FROM vv) GROUP BY token_id)"
on_series("price_stats", SHORT, "token_id min_price:r max_price:r mean_price:r median_price:r std_price:r launch_price:r last_price:r total_return:r", price.launched_stats, "SELECT * FROM ps", STATS)
on_series("temporal_features", SHORT, "token_id minutes_to_max:r minutes_to_min:r rows_above_launch:i", price.temporal_features, "SELECT token_id, (epoch_us(first(datetime ORDER BY price DESC, datetime, seq)) - epoch_us(min(datetime))) / 6e7 AS minutes_to_max, (epoch_us(first(datetime ORDER BY price, datetime, seq)) - epoch_us(min(datetime))) / 6e7 AS minutes_to_min, count(*) FILTER (price > p0) AS rows_above_launch FROM (SELECT *, first_value(price) OVER (PARTITION BY token_id ORDER BY datetime, seq) AS p0 FROM s) GROUP BY token_id")
on_series("drawdown_global", SHORT, "token_id max_drawdown:r avg_drawdown:r total_up_moves:i total_down_moves:i recovery_minutes:r", price.drawdown_global, "SELECT * FROM dr", DRAW)
on_series("drawdown_running", SHORT, "token_id max_drawdown:r avg_drawdown:r", price.drawdown_running, f"SELECT token_id, min(dd) AS max_drawdown, avg(dd) AS avg_drawdown FROM (SELECT *, price / max(price) OVER {W} - 1 AS dd FROM s) GROUP BY token_id")
on_series("recovery_time", SHORT, "token_id recovery_minutes:i", price.recovery_time, f"SELECT token_id, coalesce(floor((epoch_us(min(datetime) FILTER (datetime > t0 AND price >= p0)) - epoch_us(min(t0))) / 6e7), 0) AS recovery_minutes FROM (SELECT *, price / max(price) OVER {W} - 1 AS dd, first_value(price) OVER {W} AS p0 FROM s) JOIN (SELECT token_id, first(datetime ORDER BY dd, datetime, seq) AS t0 FROM (SELECT *, price / max(price) OVER {W} - 1 AS dd FROM s) GROUP BY token_id) USING (token_id) GROUP BY token_id")
on_series("volatility_metrics", LONG, "token_id avg_volatility:r max_volatility:r volatility_of_volatility:r", price.volatility_metrics, "SELECT * FROM vm", VOL)
on_series("volatility_clustering", LONG, "token_id clustering:r high_vol_rows:i", price.volatility_clustering, f"SELECT token_id, corr(vol, before) AS clustering, count(*) FILTER (vol > 2 * m) AS high_vol_rows FROM (SELECT *, lag(vol) OVER {W} AS before, avg(vol) OVER (PARTITION BY token_id) AS m FROM (SELECT *, {roll('stddev_samp', 'ret', 20)} AS vol FROM r)) GROUP BY token_id")
on_series("momentum_shifts", LONG, "token_id avg_momentum:r trend_up:i trend_down:i accelerations:i decelerations:i", price.momentum, f"SELECT token_id, avg(sh) AS avg_momentum, count(*) FILTER (tr - before > 0.02) AS trend_up, count(*) FILTER (tr - before < -0.02) AS trend_down, count(*) FILTER (sh - md > 0.01) AS accelerations, count(*) FILTER (sh - md < -0.01) AS decelerations FROM (SELECT *, lag(tr) OVER {W} AS before FROM (SELECT *, coalesce({roll('avg', 'z', 5)}, 0) AS sh, coalesce({roll('avg', 'z', 20)}, 0) AS md, {roll('avg', 'z', 20)} AS tr FROM (SELECT *, coalesce(ret, 0) AS z FROM r))) GROUP BY token_id")
on_series("pattern_class", SHORT, "token_id max_gain:r pattern", price.pattern_class, "SELECT token_id, max_price / launch_price - 1 AS max_gain, CASE WHEN max_price / launch_price - 1 > 5 AND total_return > 2 THEN 'explosive_pump' WHEN max_price / launch_price - 1 > 2 AND total_return > 1 THEN 'steady_climb' WHEN max_price / launch_price - 1 > 3 AND total_return < 0 THEN 'pump_and_dump' WHEN max_drawdown < -0.5 AND total_return < -0.3 THEN 'steady_decline' WHEN avg_volatility > 0.5 THEN 'high_volatility' ELSE 'sideways' END AS pattern FROM ps JOIN dr USING (token_id) JOIN vm USING (token_id)", ",\n".join((STATS, DRAW, VOL)))
on_series("optimal_trade", SHORT, "token_id optimal_return:r entry_minute:i exit_minute:i", price.optimal_trade, "SELECT token_id, greatest(g, 0) AS optimal_return, CASE WHEN g > 0 THEN floor((epoch_us(t) - epoch_us(l)) / 6e7) ELSE 0 END AS entry_minute, CASE WHEN g > 0 THEN floor((epoch_us(x) - epoch_us(l)) / 6e7) ELSE 0 END AS exit_minute FROM (SELECT b.token_id, any_value(b.g) AS g, any_value(b.t) AS t, any_value(b.l) AS l, min(s.datetime) AS x FROM best b JOIN s ON s.token_id = b.token_id AND (s.datetime > b.t OR s.datetime = b.t AND s.seq >= b.q) AND s.price = b.f GROUP BY b.token_id)", "fu AS (SELECT *, max(price) OVER (PARTITION BY token_id ORDER BY datetime, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM r),\nbest AS (SELECT token_id, first((f - price) / price ORDER BY (f - price) / price DESC, datetime, seq) AS g, first(datetime ORDER BY (f - price) / price DESC, datetime, seq) AS t, first(seq ORDER BY (f - price) / price DESC, datetime, seq) AS q, first(f ORDER BY (f - price) / price DESC, datetime, seq) AS f, min(launch) AS l FROM fu GROUP BY token_id)")
on_series("universal_timing", SHORT, "entry_row:i exit_row:i tokens:i mean_return:r win_rate:r", price.universal_timing, "SELECT a.rn AS entry_row, b.rn AS exit_row, count(*) AS tokens, avg(b.price / a.price - 1) AS mean_return, avg(CAST(b.price > a.price AS INT)) AS win_rate FROM r a JOIN r b ON a.token_id = b.token_id AND b.rn > a.rn WHERE a.rn % 10 = 0 AND b.rn % 10 = 0 AND a.rn <= 240 AND b.rn <= 240 GROUP BY ALL")

# --- features and targets ----------------------------------------------------------------------------------------------------------
SAFE_SQL = [("log_returns", "lr")] + [(f"log_returns_mean_{n}", roll("avg", "lr", n)) for n in (10, 30, 60)] + [(f"log_returns_vol_{n}", roll("stddev_samp", "lr", n)) for n in (10, 30, 60)] + [("log_returns_min_30", roll("min", "lr", 30)), ("log_returns_max_30", roll("max", "lr", 30))] + [(f"price_momentum_{n}", f"price / lag(price, {n}) OVER {W} - 1") for n in (10, 30, 60)] + [(f"sma_{n}", roll("avg", "price", n)) for n in (20, 50)] + [("ema_12", "a.e"), ("ema_26", "b.e"), ("macd_line", "a.e - b.e")]
SAFE_SQL += [("bb_upper", f"{roll('avg', 'price', 20)} + 2 * {roll('stddev_samp', 'price', 20)}"), ("bb_lower", f"{roll('avg', 'price', 20)} - 2 * {roll('stddev_samp', 'price', 20)}"), ("bb_position", f"(price - ({roll('avg', 'price', 20)} - 2 * {roll('stddev_samp', 'price', 20)})) / nullif(4 * {roll('stddev_samp', 'price', 20)}, 0)")]
on_series("safe_features", LONG, "token_id seq:i price:r " + " ".join(f"{n}:r" for n, _ in SAFE_SQL), features.safe_features, "SELECT * FROM (SELECT token_id, seq, price, rn, cnt, " + ", ".join(f"{x} AS {n}" for n, x in SAFE_SQL) + f" FROM (SELECT *, ln(price / lag(price) OVER {W}) AS lr FROM r) JOIN {ewm_sql(2 / 13)} a USING (token_id, seq) JOIN {ewm_sql(2 / 27)} b USING (token_id, seq)) WHERE rn >= 60 AND cnt >= 60")
on_series("macd", SHORT, "token_id seq:i macd_line:r", features.macd, f"SELECT a.token_id, a.seq, a.e - b.e AS macd_line FROM {ewm_sql(2 / 13)} a JOIN {ewm_sql(2 / 27)} b USING (token_id, seq)")
on_series("directional_targets", LONG, "token_id seq:i label_15m:r return_15m:r label_60m:r return_60m:r label_720m:r return_720m:r", features.targets, "SELECT token_id, seq, " + ", ".join(f"CASE WHEN lead(price, {h}) OVER w IS NOT NULL THEN CAST(lead(price, {h}) OVER w > price AS INT) END AS label_{h}m, lead(price, {h}) OVER w / price - 1 AS return_{h}m" for h in (15, 60, 720)) + f" FROM s WINDOW w AS {W}")
on_series("forecast_target", LONG, "token_id seq:i target:r", lambda s: features.forecast_target(s, 30), f"SELECT * FROM (SELECT token_id, seq, lead(price, 30) OVER {W} AS target FROM s) WHERE target IS NOT NULL")
on_series("momentum_micro", LONG, "token_id seq:i momentum_3m:r returns_momentum_5m:r volatility_momentum_10m:r momentum_accel_3m:r", features.micro_momentum, f"SELECT *, momentum_3m - lag(momentum_3m, 3) OVER {W} AS momentum_accel_3m FROM (SELECT token_id, datetime, seq, coalesce(price / lag(price, 3) OVER {W} - 1, 0) AS momentum_3m, coalesce({roll('avg', 'ret', 5)}, 0) AS returns_momentum_5m, coalesce({roll('avg', 'abs(ret)', 10)}, 0) AS volatility_momentum_10m FROM r)")
on_series("vol_ratios", LONG, "token_id seq:i volatility_5m:r volatility_ratio_5_15:r volatility_ratio_10_30:r high_vol_period volatility_trend:r", features.volatility_ratios, f"SELECT *, volatility_5m / nullif(v15, 0) AS volatility_ratio_5_15, v10 / nullif(v30, 0) AS volatility_ratio_10_30, volatility_5m > 1.5 * v15 AS high_vol_period, volatility_5m - lag(volatility_5m, 5) OVER {W} AS volatility_trend FROM (SELECT *, {roll('avg', 'abs(ret)', 5)} AS volatility_5m, {roll('avg', 'abs(ret)', 10)} AS v10, {roll('avg', 'abs(ret)', 15)} AS v15, {roll('avg', 'abs(ret)', 30)} AS v30 FROM r)")
on_series("order_flow", LONG, "token_id seq:i up_ticks_5m:r order_imbalance_10m:r order_flow_ratio_5m:r large_buy_signal:r recent_large_sells:r", features.order_flow, f"SELECT *, u10 - d10 AS order_imbalance_10m, (up_ticks_5m - d5) / (up_ticks_5m + d5 + 1) AS order_flow_ratio_5m, {roll('sum', 'ls', 10)} AS recent_large_sells FROM (SELECT *, {roll('sum', 'CAST(ret > 0 AS INT)', 5)} AS up_ticks_5m, {roll('sum', 'CAST(ret < 0 AS INT)', 5)} AS d5, {roll('sum', 'CAST(ret > 0 AS INT)', 10)} AS u10, {roll('sum', 'CAST(ret < 0 AS INT)', 10)} AS d10, CAST(ret > 2 * {roll('stddev_samp', 'ret', 30)} AS INT) AS large_buy_signal, CAST(ret < -2 * {roll('stddev_samp', 'ret', 30)} AS INT) AS ls FROM r)")
on_series("range_position", LONG, "token_id seq:i distance_from_low_30m:r position_in_range_30m:r distance_from_round:r round_number_tests:r spread_proxy:r spread_widening", features.range_position, f"SELECT *, price - lo AS distance_from_low_30m, (price - lo) / (hi - lo + 1e-10) AS position_in_range_30m, price % 1.0 AS distance_from_round, {roll('sum', 'CAST(price % 1.0 < 0.1 AS INT)', 10)} AS round_number_tests, {roll('avg', 'abs(ret)', 3)} AS spread_proxy, {roll('avg', 'abs(ret)', 3)} > 1.5 * {roll('avg', 'abs(ret)', 15)} AS spread_widening FROM (SELECT *, {roll('min', 'price', 30)} AS lo, {roll('max', 'price', 30)} AS hi FROM r)")
on_series("noise_signal", LONG, "token_id seq:i trend_strength_5m:r signal_noise_ratio_5m:r reversals_10m:r consecutive_up_10m:r variance_ratio_10_5:r autocorr_1_approx:r", features.noise_signal, f"SELECT *, abs({roll('avg', 'ret', 5)}) / ({roll('stddev_samp', 'ret', 5)} + 1e-10) AS trend_strength_5m, abs({roll('avg', 'ret', 5)}) / nullif({roll('avg', 'abs(ret)', 5)}, 0) AS signal_noise_ratio_5m, {roll('sum', 'CAST(ret > 0 AND b < 0 AS INT)', 10)} AS reversals_10m, {roll('sum', 'CAST(ret > 0 AND b > 0 AS INT)', 10)} AS consecutive_up_10m, {roll('var_samp', 'ret', 10)} / (2 * {roll('var_samp', 'ret', 5)} + 1e-10) AS variance_ratio_10_5, {roll('avg', 'ret * b', 10)} AS autocorr_1_approx FROM (SELECT *, lag(ret) OVER {W} AS b FROM r)")
on_series("momentum_persistence", LONG, "token_id seq:i momentum_consistency_10m:r momentum_strength_5m:r momentum_acceleration:r", features.momentum_persistence, f"SELECT *, abs({roll('sum', 'sign(ret)', 10)}) / 10.0 AS momentum_consistency_10m, abs({roll('sum', 'ret', 5)}) / nullif({roll('sum', 'abs(ret)', 5)}, 0) AS momentum_strength_5m, s3 - lag(s3, 3) OVER {W} AS momentum_acceleration FROM (SELECT *, {roll('sum', 'ret', 3)} AS s3 FROM r)")
on_series("tick_patterns", LONG, "token_id seq:i zero_returns_10m:r small_moves_10m:r large_moves_10m:r new_highs_10m:r new_lows_10m:r", features.tick_patterns, f"SELECT token_id, seq, {roll('sum', 'CAST(ret = 0 AS INT)', 10)} AS zero_returns_10m, {roll('sum', 'CAST(abs(ret) < 0.5 * m AS INT)', 10)} AS small_moves_10m, {roll('sum', 'CAST(abs(ret) > 2 * m AS INT)', 10)} AS large_moves_10m, {roll('sum', 'CAST(price = hi AS INT)', 10)} AS new_highs_10m, {roll('sum', 'CAST(price = lo AS INT)', 10)} AS new_lows_10m FROM (SELECT *, {roll('avg', 'abs(ret)', 30)} AS m, {roll('max', 'price', 30)} AS hi, {roll('min', 'price', 30)} AS lo FROM r)")
on_series("log_return_stats", SHORT, "token_id mean_lr:r std_lr:r sharpe:r recent_change:r", features.log_return_stats, f"SELECT token_id, avg(lr) AS mean_lr, stddev_pop(lr) AS std_lr, avg(lr) / nullif(stddev_pop(lr), 0) AS sharpe, avg(lr) FILTER (rn >= cnt - 10) - avg(lr) AS recent_change FROM (SELECT *, ln(price / lag(price) OVER {W}) AS lr FROM r) GROUP BY token_id")
MOM = f"x AS (SELECT *, ln(price / lag(price) OVER {W}) AS x FROM r),\nmm AS (SELECT token_id, count(x) AS n, avg(x) AS m, quantile_cont(x, 0.05) AS var_95, quantile_cont(x, 0.01) AS var_99 FROM x WHERE x IS NOT NULL GROUP BY token_id),\nm2 AS (SELECT token_id, any_value(n) AS n, sqrt(avg((x - m) ** 2)) AS std, avg((x - m) ** 3) / pow(avg((x - m) ** 2), 1.5) AS skew, avg((x - m) ** 4) / pow(avg((x - m) ** 2), 2) - 3 AS kurt, sqrt(avg(CASE WHEN x < m THEN (x - m) ** 2 END)) AS semi_deviation, any_value(var_95) AS var_95, avg(CASE WHEN x <= var_95 THEN x END) AS es_95 FROM x JOIN mm USING (token_id) WHERE x IS NOT NULL GROUP BY token_id)"
on_series("jarque_bera", SHORT, "token_id n:i std:r skew:r kurt:r semi_deviation:r var_95:r es_95:r jarque_bera:r jb_p:r", features.moments, "SELECT *, n / 6.0 * (skew ** 2 + kurt ** 2 / 4) AS jarque_bera, exp(-n / 12.0 * (skew ** 2 + kurt ** 2 / 4)) AS jb_p FROM m2", MOM)
on_series("split_80_20", SHORT, "token_id seq:i split", features.split_80_20, "SELECT token_id, seq, CASE WHEN rn < floor(cnt * 0.8) THEN 'train' ELSE 'test' END AS split FROM r")
on_series("minmax_train_scale", SHORT, "token_id seq:i scaled:r", features.minmax_train_scaled, "SELECT token_id, seq, (price - lo) / nullif(hi - lo, 0) AS scaled FROM (SELECT *, min(CASE WHEN rn < floor(cnt * 0.8) THEN price END) OVER (PARTITION BY token_id) AS lo, max(CASE WHEN rn < floor(cnt * 0.8) THEN price END) OVER (PARTITION BY token_id) AS hi FROM r)")
on_series("early_features", SHORT, "token_id cumulative_return:r max_return:r cv:r slope:r up_share:r", features.early_features, "SELECT token_id, last(price ORDER BY rn) / first(price ORDER BY rn) - 1 AS cumulative_return, max(ret) AS max_return, stddev_samp(price) / avg(price) AS cv, regr_slope(price, rn) AS slope, avg(CAST(ret > 0 AS INT)) AS up_share FROM r WHERE rn <= 10 GROUP BY token_id")
on_series("bot_features", SHORT, "token_id seq:i ma_5:r ma_15:r vol_std_5:r macd_stub:r initial_dump_flag", features.bot_features, f"SELECT token_id, seq, {roll('avg', 'price', 5)} AS ma_5, {roll('avg', 'price', 15)} AS ma_15, {roll('stddev_samp', 'ret', 5)} AS vol_std_5, {roll('avg', 'price', 5)} - {roll('avg', 'price', 15)} AS macd_stub, coalesce(max(CAST(rn <= 2 AND price / p0 - 1 < -0.1 AS INT)) OVER (PARTITION BY token_id), 0) = 1 AS initial_dump_flag FROM (SELECT *, first_value(price) OVER {W} AS p0 FROM r)")
on_series("sequences", SHORT, "token_id seq:i first:r total:r", lambda s: features.sequences(s, 10).select("token_id", "seq", F.col("sequence")[0][0].alias("first"), F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0]).alias("total")), f"SELECT * FROM (SELECT token_id, seq, lag(price, 9) OVER {W} AS first, {roll('sum', 'price', 10)} AS total FROM s) WHERE total IS NOT NULL")
on_series("leakage_constant_columns", SHORT, "column n:i is_constant", lambda s: features.constant_columns(s.withColumn("one", F.lit(1.0)), ["price", "one"]), "SELECT 'price' AS \"column\", count(DISTINCT price) AS n, false AS is_constant FROM s UNION ALL SELECT 'one', 1, true")

# --- indicators --------------------------------------------------------------------------------------------------------------------
on_series("bollinger", LONG, "token_id seq:i bb_upper:r bb_lower:r bb_squeeze bb_position:r", indicators.bollinger, f"SELECT *, m + 2 * sd AS bb_upper, m - 2 * sd AS bb_lower, sd < 0.8 * {roll('avg', 'sd', 20)} AS bb_squeeze, (price - (m - 2 * sd)) / nullif(4 * sd, 0) AS bb_position FROM (SELECT *, {roll('avg', 'price', 20)} AS m, {roll('stddev_samp', 'price', 20)} AS sd FROM s)")
on_series("stochastic", LONG, "token_id seq:i stoch_k:r stoch_d:r", indicators.stochastic, f"SELECT *, {roll('avg', 'stoch_k', 3)} AS stoch_d FROM (SELECT *, 100 * (price - {roll('min', 'price', 14)}) / nullif({roll('max', 'price', 14)} - {roll('min', 'price', 14)}, 0) AS stoch_k FROM s)")
on_series("williams_r", LONG, "token_id seq:i williams_r:r", indicators.williams_r, f"SELECT *, -100 * ({roll('max', 'price', 14)} - price) / nullif({roll('max', 'price', 14)} - {roll('min', 'price', 14)}, 0) AS williams_r FROM s")
on_series("rsi_simple", LONG, "token_id seq:i rsi:r", indicators.rsi, f"SELECT *, 100 * {roll('avg', 'up', 14)} / nullif({roll('avg', 'up', 14)} + {roll('avg', 'dn', 14)}, 0) AS rsi FROM (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS dn FROM (SELECT *, price - lag(price) OVER {W} AS d FROM s))")
on_series("atr", LONG, "token_id seq:i atr:r", indicators.atr, f"SELECT *, {roll('avg', 'd', 14)} AS atr FROM (SELECT *, abs(price - lag(price) OVER {W}) AS d FROM s)")
on_series("coppock_kst", LONG, "token_id seq:i roc_10:r coppock:r kst:r", indicators.coppock_kst, f"SELECT *, r10 AS roc_10, {roll('avg', 'c', 10)} AS coppock, {roll('avg', 'r10', 10)} + 2 * {roll('avg', 'r15', 10)} + 3 * {roll('avg', 'r20', 10)} + 4 * {roll('avg', 'r30', 15)} AS kst FROM (SELECT *, " + ", ".join(f"100 * (price / lag(price, {n}) OVER {W} - 1) AS r{n}" for n in (10, 15, 20, 30)) + f", 100 * (price / lag(price, 14) OVER {W} - 1) + 100 * (price / lag(price, 11) OVER {W} - 1) AS c FROM s)")
on_series("efficiency_ratio", LONG, "token_id seq:i efficiency_ratio:r", indicators.efficiency_ratio, f"SELECT *, abs(price - lag(price, 10) OVER {W}) / nullif({roll('sum', 'd', 10)}, 0) AS efficiency_ratio FROM (SELECT *, abs(price - lag(price) OVER {W}) AS d FROM s)")
on_series("order_imbalance", LONG, "token_id seq:i imbalance:r cumulative_delta:r", indicators.order_imbalance, f"SELECT *, {roll('avg', 'sign(ret)', 20)} AS imbalance, sum(sign(ret)) OVER (PARTITION BY token_id ORDER BY datetime, seq ROWS UNBOUNDED PRECEDING) AS cumulative_delta FROM r")
on_series("lazy_features", SHORT, "token_id seq:i sma_10:r move_type", indicators.lazy_features, f"SELECT *, {roll('avg', 'price', 10)} AS sma_10, CASE WHEN ret > 0.1 THEN 'pump' WHEN ret < -0.1 THEN 'dump' WHEN abs(ret) < 0.001 THEN 'flat' ELSE 'normal' END AS move_type FROM r")


# prices over an odd number: quotients of whole numbers would fall on the middle between two roundings
def shipments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("_tie", (F.col("l_orderkey") * 1000000 + F.col("l_partkey")) * 100 + F.col("l_linenumber")).withColumn("_price", F.col("l_extendedprice").cast("double") / 3141.592653589793)
    return series.as_series(rows, "l_returnflag", "l_shipdate", "_price", "_tie", ("l_quantity",))


VWAP = "SELECT token_id, seq, " + ", ".join(f"{roll('sum', 'price * v', n)} / nullif({roll('sum', 'v', n)}, 0) AS w{n}, {roll('stddev_samp', 'price', n)} AS d{n}" for n in (5, 60, 240)) + ", price FROM "
VWAP_COLUMNS = "SELECT *, w5 AS vwap, " + ", ".join(f"w{n} AS vwap_{n}, w{n} + d{n} AS vwap_upper_{n}, w{n} - d{n} AS vwap_lower_{n}, (price - w{n}) / w{n} AS vwap_distance_{n}" for n in (5, 60, 240)) + " FROM "
VWAP_SPEC = "token_id seq:i vwap:r " + " ".join(f"vwap_{n}:r vwap_upper_{n}:r vwap_lower_{n}:r vwap_distance_{n}:r" for n in (5, 60, 240))
register("vwap_bands", VWAP_SPEC, lambda spark, d: ranges.over_ranges(shipments(spark, d), lambda s: indicators.vwap_bands(s, volume="l_quantity"), before=239, rows=20_000), "s AS (SELECT l_returnflag AS token_id, l_shipdate AS datetime, (l_orderkey * 1000000 + l_partkey) * 100 + l_linenumber AS seq, CAST(l_extendedprice AS DOUBLE) / CAST(3141.592653589793 AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS v FROM lineitem)\n;;\n" + f"{VWAP_COLUMNS} ({VWAP} s)")
on_series("vwap_by_returns", SHORT, "token_id seq:i vwap:r vwap_upper_5:r vwap_60:r vwap_distance_60:r", indicators.vwap_bands, f"{VWAP_COLUMNS} ({VWAP} (SELECT *, abs(ret) + 1e-10 AS v FROM r))")
on_series("trix", SHORT, "token_id seq:i trix:r", indicators.trix)
on_series("last_signals", SHORT, "token_id rsi_signal bb_signal stoch_signal", indicators.last_signals, f"SELECT token_id, CASE WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_signal, CASE WHEN price > m + 2 * sd THEN 'above' WHEN price < m - 2 * sd THEN 'below' ELSE 'inside' END AS bb_signal, CASE WHEN k > {roll('avg', 'k', 3)} THEN 'bullish' ELSE 'bearish' END AS stoch_signal FROM (SELECT *, 100 * {roll('avg', 'up', 14)} / nullif({roll('avg', 'up', 14)} + {roll('avg', 'dn', 14)}, 0) AS rsi, {roll('avg', 'price', 20)} AS m, {roll('stddev_samp', 'price', 20)} AS sd, 100 * (price - {roll('min', 'price', 14)}) / nullif({roll('max', 'price', 14)} - {roll('min', 'price', 14)}, 0) AS k FROM (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS dn FROM (SELECT *, price - lag(price) OVER {W} AS d FROM r))) QUALIFY rn = cnt - 1")

# --- risk --------------------------------------------------------------------------------------------------------------------------
on_series("sharpe_sortino", SHORT, "token_id n:i sharpe:r sortino:r", quant.sharpe_sortino, "SELECT token_id, count(ret) AS n, CASE WHEN stddev_samp(ret) > 0 THEN greatest(-10, least(10, avg(ret) / stddev_samp(ret))) ELSE 0 END AS sharpe, CASE WHEN count(*) FILTER (ret < 0) = 0 THEN CASE WHEN avg(ret) > 0 THEN 10 ELSE 0 END ELSE coalesce(greatest(-10, least(10, avg(ret) / nullif(stddev_samp(ret) FILTER (ret < 0), 0))), 0) END AS sortino FROM r GROUP BY token_id")
on_series("information_ratio", SHORT, "token_id information_ratio:r", quant.information_ratio, "SELECT token_id, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252.0 * 24 * 60) AS information_ratio FROM r GROUP BY token_id")
on_series("var_cvar", SHORT, "token_id var_95:r var_99:r cvar_95:r cvar_99:r", quant.var_cvar, "SELECT token_id, any_value(v5) AS var_95, any_value(v1) AS var_99, avg(ret) FILTER (ret <= v5) AS cvar_95, avg(ret) FILTER (ret <= v1) AS cvar_99 FROM r JOIN (SELECT token_id, quantile_cont(ret, 0.05) AS v5, quantile_cont(ret, 0.01) AS v1 FROM r GROUP BY token_id) USING (token_id) GROUP BY token_id")
on_series("omega_ulcer", SHORT, "token_id omega:r ulcer:r downside_deviation:r", quant.omega_ulcer, f"SELECT token_id, sum(ret) FILTER (ret > 0) / nullif(sum(-ret) FILTER (ret < 0), 0) AS omega, sqrt(avg(dd ** 2)) AS ulcer, stddev_samp(ret) FILTER (ret < 0) AS downside_deviation FROM (SELECT *, price / max(price) OVER {W} - 1 AS dd FROM r) GROUP BY token_id")
on_series("risk_table", SHORT, "token_id annual_volatility:r annual_sharpe:r total_return:r max_drawdown:r", quant.risk_table, f"SELECT token_id, stddev_samp(ret) * sqrt(525600.0) AS annual_volatility, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(525600.0) AS annual_sharpe, last(price ORDER BY datetime, seq) / first(price ORDER BY datetime, seq) - 1 AS total_return, min(dd) AS max_drawdown FROM (SELECT *, price / max(price) OVER {W} - 1 AS dd FROM r) GROUP BY token_id")
RR = "fr AS (SELECT token_id, h AS horizon, f AS x FROM (" + " UNION ALL ".join(f"SELECT token_id, cnt, {h} AS h, lead(price, {h}) OVER {W} / price - 1 AS f FROM r" for h in (5, 15, 30, 60)) + ") WHERE f IS NOT NULL AND cnt >= greatest(3 * h, 50)),\nrr AS (SELECT *, coalesce(avg_gain / nullif(abs(avg_loss), 0), 0) AS rr, win_rate * avg_gain + (1 - win_rate) * avg_loss AS expected_value FROM (SELECT token_id, horizon, count(*) AS trades, avg(CAST(x > 0 AS INT)) AS win_rate, coalesce(avg(x) FILTER (x > 0), 0) AS avg_gain, coalesce(avg(x) FILTER (x <= 0), 0) AS avg_loss, coalesce(avg(x) / nullif(stddev_samp(x), 0), 0) AS sharpe FROM fr GROUP BY ALL))"
on_series("risk_reward_horizons", SHORT, "token_id horizon:i trades:i win_rate:r avg_gain:r avg_loss:r sharpe:r rr:r expected_value:r", quant.risk_reward, "SELECT * FROM rr", RR)
on_series("horizon_summary", SHORT, "horizon:i sharpe:r win_rate:r rr:r", lambda s: quant.horizon_summary(quant.risk_reward(s)), "SELECT horizon, avg(sharpe) AS sharpe, avg(win_rate) AS win_rate, avg(rr) AS rr FROM rr GROUP BY horizon", RR)
on_series("holding_period", SHORT, "token_id period:i trades:i mean_return:r win_rate:r", quant.holding_period, "SELECT token_id, period, count(*) AS trades, avg(x) AS mean_return, avg(CAST(x > 0 AS INT)) AS win_rate FROM (" + " UNION ALL ".join(f"SELECT token_id, rn, {p} AS period, lead(price, {p}) OVER {W} / price - 1 AS x FROM r" for p in (5, 10, 20, 40)) + ") WHERE x IS NOT NULL AND rn % (period // 2) = 0 GROUP BY ALL")
# the ratio's logarithm: a year's growth at a minute's pace is large
on_series("calmar", SHORT, "token_id max_drawdown:r log_calmar:r", lambda s: quant.calmar(s).withColumn("log_calmar", F.signum("calmar") * F.log1p(F.abs("calmar"))), f"SELECT token_id, max_drawdown, sign(c) * ln(1 + abs(c)) AS log_calmar FROM (SELECT *, (exp(least(ln(b / a) * 525600 / n, 50.0)) - 1) / nullif(abs(max_drawdown), 0) AS c FROM (SELECT token_id, count(*) AS n, first(price ORDER BY rn) AS a, last(price ORDER BY rn) AS b, min(dd) AS max_drawdown FROM (SELECT *, price / max(price) OVER {W} - 1 AS dd FROM r) GROUP BY token_id))")

# --- regimes and microstructure ----------------------------------------------------------------------------------------------------
REGIME = f"rg AS (SELECT *, CASE WHEN sh > lg AND v < vm THEN 'uptrend' WHEN sh < lg AND v < vm THEN 'downtrend' WHEN v > vm THEN 'high_volatility' ELSE 'ranging' END AS regime FROM (SELECT *, {roll('avg', 'v', 100, 1)} AS vm FROM (SELECT *, {roll('avg', 'price', 15, 1)} AS sh, {roll('avg', 'price', 60, 1)} AS lg, {roll('stddev_samp', 'ret', 30, 2)} AS v FROM r)))"
on_series("regime_counts", LONG, "token_id regime n:i", quant.regime_counts, "SELECT token_id, regime, count(*) AS n FROM rg GROUP BY ALL", REGIME)
on_series("microstructure", LONG, "token_id avg_rv_1h:r vol_of_vol:r avg_amihud:r avg_efficiency:r avg_velocity:r roll_spread:r", quant.microstructure, f"SELECT token_id, avg(rv) AS avg_rv_1h, stddev_samp(rv) AS vol_of_vol, avg(abs(ret) / (v + 1e-10)) AS avg_amihud, avg(ef) AS avg_efficiency, avg(v) AS avg_velocity, CASE WHEN covar_samp(ret, b) < 0 THEN 2 * sqrt(-covar_samp(ret, b)) ELSE 0 END AS roll_spread FROM (SELECT *, {roll('stddev_samp', 'ret', 60, 30)} * sqrt(525600.0) AS rv, abs(price - lag(price, 60) OVER {W}) / nullif({roll('sum', 'v', 60, 30)}, 0) AS ef FROM (SELECT *, abs(price - lag(price) OVER {W}) AS v, lag(ret) OVER {W} AS b FROM r)) GROUP BY token_id")
on_series("kyle_lambda", LONG, "token_id n:i kyle_lambda:r r_squared:r", quant.kyle_lambda, f"SELECT token_id, count(*) AS n, regr_slope(ret, sv) AS kyle_lambda, corr(ret, sv) ** 2 AS r_squared FROM (SELECT *, quantile_cont(ret, 0.025) OVER p AS lo, quantile_cont(ret, 0.975) OVER p AS hi FROM (SELECT *, sign(ret) * abs(ret) * {roll('stddev_samp', 'ret', 120, 60)} AS sv FROM r) WHERE ret IS NOT NULL AND sv IS NOT NULL WINDOW p AS (PARTITION BY token_id)) WHERE ret BETWEEN lo AND hi AND abs(sv) > 1e-10 GROUP BY token_id HAVING count(*) > 15")
on_series("liquidity", LONG, "token_id amihud:r roll_spread:r liquidity_score:r", quant.liquidity, f"SELECT *, 0.4 / (1 + amihud) + 0.3 / (1 + roll_spread) + 0.3 * moving AS liquidity_score FROM (SELECT token_id, avg(abs(ret) / price) AS amihud, CASE WHEN covar_samp(ret, b) < 0 THEN 2 * sqrt(-covar_samp(ret, b)) ELSE 0 END AS roll_spread, avg(CAST(ret <> 0 AS INT)) AS moving FROM (SELECT *, lag(ret) OVER {W} AS b FROM r) GROUP BY token_id)")
on_series("autocorr_rolling", SHORT, "token_id seq:i return_autocorr:r", quant.autocorr_rolling, f"SELECT token_id, seq, {roll('avg', 'dx * dy', 120, 30)} / nullif(sqrt({roll('avg', 'dx * dx', 120, 30)} * {roll('avg', 'dy * dy', 120, 30)}), 0) AS return_autocorr FROM (SELECT *, ret - {roll('avg', 'ret', 120, 30)} AS dx, b - {roll('avg', 'b', 120, 30)} AS dy FROM (SELECT *, lag(ret) OVER {W} AS b FROM r))")
MOMENTA = [f"{k}{n}" for n in (10, 30, 60) for k in ("m", "s")]
on_series("momentum_quality", SHORT, "token_id seq:i momentum_10:r momentum_quality:r", quant.momentum_quality, "SELECT token_id, seq, m10 AS momentum_10, (" + " + ".join(f"coalesce(z_{x}, 0)" for x in MOMENTA) + ") / nullif(" + " + ".join(f"CAST(z_{x} IS NOT NULL AS INT)" for x in MOMENTA) + ", 0) AS momentum_quality FROM (SELECT *, " + ", ".join(f"({x} - avg({x}) OVER p) / (stddev_samp({x}) OVER p + 1e-10) AS z_{x}" for x in MOMENTA) + " FROM (SELECT *, " + ", ".join(f"price / lag(price, {n}) OVER {W} - 1 AS m{n}, 1 / ({roll('stddev_samp', 'ret', n, 2)} + 1e-10) AS s{n}" for n in (10, 30, 60)) + " FROM r) WINDOW p AS (PARTITION BY token_id))")
on_series("volume_profile", LONG, "token_id bin:i n:i is_poc is_high", lambda s: quant.volume_profile(s, 10), "SELECT token_id, bin, n, bin = first(bin) OVER (PARTITION BY token_id ORDER BY n DESC, bin) AS is_poc, n > quantile_cont(n, 0.7) OVER (PARTITION BY token_id) AS is_high FROM (SELECT token_id, least(9, len(list_filter(e, lambda x: x <= price)) - 1) AS bin, count(*) AS n FROM s JOIN (SELECT token_id, quantile_cont(price, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM s GROUP BY token_id) USING (token_id) GROUP BY token_id, bin)")
on_series("market_profile", LONG, "token_id bucket:i n:i is_poc in_value_area", quant.market_profile, "SELECT token_id, bucket, n, rk = 1 AS is_poc, coalesce(bf, 0) < 0.7 * al AS in_value_area FROM (SELECT *, row_number() OVER o AS rk, sum(n) OVER (PARTITION BY token_id ORDER BY n DESC, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf, sum(n) OVER (PARTITION BY token_id) AS al FROM (SELECT token_id, least(19, floor((price - lo) / (hi - lo) * 20)) AS bucket, count(*) AS n FROM (SELECT *, min(price) OVER (PARTITION BY token_id) AS lo, max(price) OVER (PARTITION BY token_id) AS hi FROM s) GROUP BY ALL) WINDOW o AS (PARTITION BY token_id ORDER BY n DESC, bucket))")
on_series("vol_surface", LONG, "token_id window:i p10:r p50:r p90:r", quant.volatility_surface, "SELECT token_id, win AS \"window\", quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90 FROM (" + " UNION ALL ".join(f"SELECT token_id, {n} AS win, {roll('stddev_samp', 'ret', n)} * sqrt(525600.0 / {n}) AS v FROM r" for n in (5, 15, 30, 60)) + ") WHERE v IS NOT NULL GROUP BY ALL")
SEGMENT = "sg AS (SELECT *, least(floor(rn / greatest(1, cnt // 4)), 3) AS segment FROM r),\nls AS (SELECT token_id, segment, count(*) AS n, last(price ORDER BY datetime, seq) / first(price ORDER BY datetime, seq) - 1 AS segment_return, stddev_samp(ret) AS volatility, avg(CAST(ret > 0 AS INT)) AS win_rate, corr(price, rn) AS trend FROM sg GROUP BY ALL)"
on_series("lifecycle_segments", SHORT, "token_id segment:i n:i segment_return:r volatility:r win_rate:r", quant.lifecycle_segments, "SELECT * FROM ls", SEGMENT)
on_series("segment_pivot", SHORT, "token_id segment_0:r segment_1:r segment_2:r segment_3:r", quant.segment_pivot, "SELECT token_id, " + ", ".join(f"max(segment_return) FILTER (segment = {k}) AS segment_{k}" for k in range(4)) + " FROM ls GROUP BY token_id", SEGMENT)
on_series("distribution_evolution", LONG, "token_id period:i n:i mean:r std:r q05:r q95:r", quant.distribution_evolution, "SELECT token_id, least(floor((rn - 1) / greatest(1, (cnt - 1) // 5)), 4) AS period, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, quantile_cont(ret, 0.05) AS q05, quantile_cont(ret, 0.95) AS q95 FROM r WHERE ret IS NOT NULL GROUP BY ALL")
on_series("entry_exit_moment", SHORT, "entry_row:i exit_row:i n:i mean_return:r std_return:r", lambda s: quant.entry_exit_moment(s, 240), "SELECT a.rn AS entry_row, b.rn AS exit_row, count(*) AS n, avg(b.price / a.price - 1) AS mean_return, stddev_samp(b.price / a.price - 1) AS std_return FROM r a JOIN r b ON a.token_id = b.token_id AND b.rn > a.rn WHERE a.rn < 240 AND b.rn < 240 GROUP BY ALL")
on_series("trade_timing", SHORT, "entry_row:i lag:i n:i mean_return:r", lambda s: quant.trade_timing(s, most=240), "SELECT rn AS entry_row, k AS lag, count(*) AS n, avg(x) AS mean_return FROM (" + " UNION ALL ".join(f"SELECT rn, {k} AS k, lead(price, {k}) OVER {W} / price - 1 AS x FROM r" for k in (1, 5, 10, 30)) + ") WHERE rn < 240 AND x IS NOT NULL GROUP BY ALL")
on_series("bar_patterns", LONG, "token_id bars:i green:r doji:r avg_body:r", lambda s: quant.bar_patterns(s, 60), f"SELECT token_id, count(*) AS bars, avg(CAST(c > o AS INT)) AS green, avg(CAST(abs(c - o) <= 0.1 * (h - l) AS INT)) AS doji, avg(abs(c - o)) AS avg_body FROM (SELECT token_id, {bucket_sql(3600)} AS b, first(price ORDER BY datetime, seq) AS o, last(price ORDER BY datetime, seq) AS c, max(price) AS h, min(price) AS l FROM s GROUP BY ALL) GROUP BY token_id")
on_series("sl_tp_first_hit", SHORT, "token_id sl tp trades:i wins:i mean_result:r", quant.sl_tp_grid)
on_series("pump_analysis", SHORT, "token_id vol5:r peak_ratio:r row_of_gain:r is_pump", quant.pump_analysis, "SELECT token_id, any_value(vol5) AS vol5, max(price) / any_value(base) AS peak_ratio, min(rn) FILTER (price >= 1.5 * base) AS row_of_gain, any_value(vol5) > 0.8 AND max(price) / any_value(base) > 1.5 AS is_pump FROM (SELECT *, stddev_pop(CASE WHEN rn BETWEEN 1 AND 5 THEN ret END) OVER (PARTITION BY token_id) AS vol5, max(CASE WHEN rn = 5 THEN price END) OVER (PARTITION BY token_id) AS base FROM r) WHERE rn > 5 GROUP BY token_id")

# --- across series -----------------------------------------------------------------------------------------------------------------
HOURS = f"b AS (SELECT token_id, {bucket_sql(3600)} AS bucket, first(price ORDER BY datetime, seq) AS price FROM s GROUP BY ALL),\nlr AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY token_id ORDER BY bucket)) AS x FROM b),\npr AS (SELECT a.token_id AS token_a, c.token_id AS token_b, count(*) AS n, corr(a.x, c.x) AS correlation FROM lr a JOIN lr c ON a.bucket = c.bucket AND a.token_id < c.token_id WHERE a.x IS NOT NULL AND c.x IS NOT NULL GROUP BY ALL HAVING count(*) >= 30)"
on_series("corr_pairs", LONG, "token_a token_b n:i correlation:r strength", cross.corr_pairs, "SELECT *, CASE WHEN abs(correlation) >= 0.8 THEN 'very_strong' WHEN abs(correlation) >= 0.6 THEN 'strong' WHEN abs(correlation) >= 0.4 THEN 'moderate' WHEN abs(correlation) >= 0.2 THEN 'weak' ELSE 'very_weak' END AS strength FROM pr", HOURS)
on_series("corr_summary", LONG, "pairs:i mean:r max:r min:r strong:i", lambda s: cross.corr_summary(cross.corr_pairs(s)), "SELECT count(*) AS pairs, avg(correlation) AS mean, max(correlation) AS max, min(correlation) AS min, count(*) FILTER (abs(correlation) >= 0.5) AS strong FROM pr", HOURS)
on_series("corr_rolling_pairs", LONG, "token_a token_b bucket:t correlation:r", cross.corr_rolling_pairs, "SELECT a.token_id AS token_a, c.token_id AS token_b, a.bucket, CASE WHEN count(*) OVER w >= 60 THEN corr(a.price, c.price) OVER w END AS correlation FROM b a JOIN b c ON a.bucket = c.bucket AND a.token_id < c.token_id WINDOW w AS (PARTITION BY a.token_id, c.token_id ORDER BY a.bucket ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)", HOURS)
on_series("spearman_pairs", LONG, "token_a token_b n:i spearman:r", cross.spearman_pairs, "SELECT token_a, token_b, count(*) AS n, corr(rx, ry) AS spearman FROM (SELECT *, rank() OVER (PARTITION BY token_a, token_b ORDER BY x) + (count(*) OVER (PARTITION BY token_a, token_b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY token_a, token_b ORDER BY y) + (count(*) OVER (PARTITION BY token_a, token_b, y) - 1) / 2.0 AS ry FROM (SELECT a.token_id AS token_a, c.token_id AS token_b, a.price AS x, c.price AS y FROM r a JOIN r c ON a.rn = c.rn AND a.token_id < c.token_id)) GROUP BY ALL")
on_series("lifecycle_align", SHORT, "rn:i tokens:i mean_price:r", lambda s: cross.lifecycle(s).groupBy("rn").agg(F.count("*").alias("tokens"), F.avg("price").alias("mean_price")), "SELECT rn, count(*) AS tokens, avg(price) AS mean_price FROM r GROUP BY rn")
on_series("normalised", SHORT, "token_id seq:i by_first:r robust:r", cross.normalised, f"SELECT token_id, seq, price / first_value(price) OVER {W} AS by_first, (price - quantile_cont(price, 0.5) OVER (PARTITION BY token_id)) / nullif(quantile_cont(price, 0.75) OVER (PARTITION BY token_id) - quantile_cont(price, 0.25) OVER (PARTITION BY token_id), 0) AS robust FROM s")
on_series("kendall_pairs", LONG, "token_a token_b n:i kendall:r", cross.kendall_pairs, "SELECT token_a, token_b, n, k AS kendall FROM (SELECT a.token_a, a.token_b, any_value(a.n) AS n, sum(sign(a.x - c.x) * sign(a.y - c.y)) / sqrt(CAST(count(*) FILTER (a.x <> c.x) AS DOUBLE) * count(*) FILTER (a.y <> c.y)) AS k FROM pp a JOIN pp c ON a.token_a = c.token_a AND a.token_b = c.token_b AND a.rn < c.rn GROUP BY ALL)", "pp AS (SELECT a.token_id AS token_a, c.token_id AS token_b, a.rn, a.price AS x, c.price AS y, count(*) OVER (PARTITION BY a.token_id, c.token_id) AS n FROM r a JOIN r c ON a.rn = c.rn AND a.token_id < c.token_id)")
on_series("pca_series", SHORT, "component:i explained:r column loading:r", lambda s: cross.pca_summary(cross.token_matrix(s, 12), [f"r{k}" for k in range(1, 13)], 3))

# --- sets --------------------------------------------------------------------------------------------------------------------------
register("overlap_pairs", "category other shared:i overlap_pct:r", lambda spark, d: sets.overlap_pairs(categories(spark, d)), CATEGORIES + "SELECT category, other, shared, 100.0 * shared / least(x.n, y.n) AS overlap_pct FROM (SELECT a.category, b.category AS other, count(*) AS shared FROM m a JOIN m b ON a.token_id = b.token_id AND a.category < b.category GROUP BY ALL) p JOIN (SELECT category AS c, count(*) AS n FROM m GROUP BY 1) x ON x.c = p.category JOIN (SELECT category AS c, count(*) AS n FROM m GROUP BY 1) y ON y.c = p.other")
register("multi_category", "token_id n:i categories", lambda spark, d: sets.multi_category(categories(spark, d)), CATEGORIES + "SELECT token_id, count(*) AS n, string_agg(category, ',' ORDER BY category) AS categories FROM m GROUP BY token_id HAVING count(*) > 1")
register("unique_to_category", "token_id category", lambda spark, d: sets.unique_to_category(categories(spark, d)), CATEGORIES + "SELECT token_id, min(category) AS category FROM m GROUP BY token_id HAVING count(*) = 1")
register("category_against_rest", "category tokens:i elsewhere:i only_here:i", lambda spark, d: sets.category_against_rest(categories(spark, d)), CATEGORIES + "SELECT category, count(*) AS tokens, count(*) FILTER (n > 1) AS elsewhere, count(*) FILTER (n = 1) AS only_here FROM (SELECT *, count(*) OVER (PARTITION BY token_id) AS n FROM m) GROUP BY category")
register("overlap_with_category", "category shared:i", lambda spark, d: sets.overlap_with(categories(spark, d), "view"), CATEGORIES + "SELECT category, count(*) AS shared FROM m WHERE category <> 'view' AND token_id IN (SELECT token_id FROM m WHERE category = 'view') GROUP BY category")
register("set_difference", "token_id", lambda spark, d: sets.difference(categories(spark, d).where("category = 'view'"), categories(spark, d).where("category = 'click'")), CATEGORIES + "SELECT token_id FROM m WHERE category = 'view' EXCEPT SELECT token_id FROM m WHERE category = 'click'")
register("set_intersection", "token_id", lambda spark, d: sets.intersection(categories(spark, d).where("category = 'view'"), categories(spark, d).where("category = 'click'")), CATEGORIES + "SELECT token_id FROM m WHERE category = 'view' INTERSECT SELECT token_id FROM m WHERE category = 'click'")
register("category_distribution", "category tokens:i pct:r", lambda spark, d: sets.category_distribution(categories(spark, d)), CATEGORIES + "SELECT category, count(*) AS tokens, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM m GROUP BY category")
register("top_k_frequency", "user_id:i n:i", lambda spark, d: sets.top_k_frequency(table(spark, d, "events"), "user_id"), "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
register("shared_values", "category tokens:i", lambda spark, d: sets.shared_values(categories(spark, d), "category"), CATEGORIES + "SELECT category, count(DISTINCT token_id) AS tokens FROM s GROUP BY category HAVING count(DISTINCT token_id) > 1")

# --- autocorrelation, death and behaviour ------------------------------------------------------------------------------------------
SAFE = f"sr AS (SELECT token_id, datetime, seq, CASE WHEN abs(x) > 1 THEN ln(x + 1) ELSE x END AS ret FROM (SELECT *, ret AS x FROM r)),\nde AS (SELECT *, ret - avg(ret) OVER (PARTITION BY token_id) AS d FROM sr WHERE ret IS NOT NULL),\nac AS (SELECT token_id, lag, n, acf FROM (" + " UNION ALL ".join(f"SELECT token_id, {k} AS lag, count(*) AS n, sum(d * dl) / nullif(sum(d * d), 0) AS acf FROM (SELECT *, {'lag(d, ' + str(k) + ') OVER ' + W if k else 'd'} AS dl FROM de) GROUP BY token_id" for k in range(11)) + "))"
on_series("acf_lags", SHORT, "token_id lag:i n:i acf:r", lambda s: acf.acf_lags(acf.safe_returns(s)), "SELECT * FROM ac", SAFE)
on_series("acf_distribution", SHORT, "lag:i mean:r std:r median:r q25:r q75:r beyond:i", lambda s: acf.acf_distribution(acf.acf_lags(acf.safe_returns(s))), "SELECT lag, avg(acf) AS mean, stddev_pop(acf) AS std, quantile_cont(acf, 0.5) AS median, quantile_cont(acf, 0.25) AS q25, quantile_cont(acf, 0.75) AS q75, count(*) FILTER (abs(acf) > 0.1) AS beyond FROM ac GROUP BY lag", SAFE)
on_series("acf_decay", SHORT, "token_id bound:r significant_lags:i first_zero:r", lambda s: acf.acf_decay(acf.acf_lags(acf.safe_returns(s))), "SELECT token_id, max(1.96 / sqrt(n)) AS bound, count(*) FILTER (lag > 0 AND abs(acf) > 1.96 / sqrt(n)) AS significant_lags, min(lag) FILTER (lag > 0 AND acf <= 0) AS first_zero FROM ac GROUP BY token_id", SAFE)
DEAD = FLAT_TAIL + f",\nzz AS (SELECT *, (price - lag(price) OVER {W}) / (lag(price) OVER {W} + 1e-12) AS z FROM ft),\nav AS (SELECT *, rn >= 4 AND max(price) OVER f > min(price) OVER f AND (max(price) OVER f - min(price) OVER f) / avg(price) OVER f >= 0.001 AND stddev_pop(z) OVER g >= 1e-6 AS active FROM zz WINDOW f AS (PARTITION BY token_id ORDER BY datetime, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), g AS (PARTITION BY token_id ORDER BY datetime, seq ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)),\nlt AS (SELECT token_id, count(*) AS n, coalesce(max(rn + 1) FILTER (active), 0) AS last FROM av GROUP BY token_id),\ndm AS (SELECT token_id, n, CASE WHEN n < 31 THEN NULL WHEN last = 0 THEN 0 WHEN n - last >= 30 THEN last END AS death_minute FROM lt)"
on_series("death_detect", LONG, "token_id n:i death_minute:r is_dead lifespan_minutes:i", lambda s: acf.death(flat_tail(s)), "SELECT *, death_minute IS NOT NULL AS is_dead, coalesce(death_minute, n) AS lifespan_minutes FROM dm", DEAD)
on_series("lifespan_class", SHORT, "token_id lifespan_class", lambda s: acf.death(s).select("token_id", acf.lifespan_class("n", 60, 80).alias("lifespan_class")), "SELECT token_id, CASE WHEN count(*) < 60 THEN 'sprint' WHEN count(*) < 80 THEN 'standard' ELSE 'marathon' END AS lifespan_class FROM s GROUP BY token_id")
on_series("death_features", LONG, "token_id death_minute:r death_type death_velocity:r death_completeness:r final_price_ratio:r", lambda s: acf.death_features(flat_tail(s)), "SELECT token_id, death_minute, CASE WHEN death_minute <= 0 THEN NULL WHEN death_minute < 5 THEN 'immediate' WHEN death_minute < 60 THEN 'sudden' WHEN death_minute < 360 THEN 'gradual' WHEN death_minute IS NOT NULL THEN 'extended' END AS death_type, CASE WHEN death_minute >= 10 THEN (pb - pa) / pb END AS death_velocity, CASE WHEN death_minute > 0 THEN 1 - pf / top END AS death_completeness, pf / top AS final_price_ratio FROM (SELECT token_id, any_value(death_minute) AS death_minute, max(price) FILTER (rn = death_minute - 10) AS pb, max(price) FILTER (rn = death_minute) AS pa, max(price) FILTER (death_minute IS NULL OR rn < death_minute) AS top, max(price) FILTER (rn = coalesce(least(death_minute + 30, n - 1), n - 1)) AS pf FROM ft JOIN dm USING (token_id) GROUP BY token_id)", DEAD)
on_series("features_15", SHORT, "token_id mean_return:r std_return:r max_drawdown:r volatility_5min:r return_5min:r max_return_1min:r trend_direction_5min:r price_change_ratio_5min:r pump_velocity_5min:r acf_lag_1:r acf_lag_5:r acf_lag_10:r", acf.features_15, f"SELECT token_id, avg(z) AS mean_return, stddev_pop(z) AS std_return, max((top - price) / top) AS max_drawdown, stddev_pop(z) FILTER (rn <= 5) AS volatility_5min, (max(price) FILTER (rn = least(5, cnt - 1)) - max(price) FILTER (rn = 0)) / (max(price) FILTER (rn = 0) + 1e-12) AS return_5min, max(abs(z)) FILTER (rn <= 5) AS max_return_1min, regr_slope(price, rn) FILTER (rn <= 5) AS trend_direction_5min, (max(price) FILTER (rn <= 5) - min(price) FILTER (rn <= 5)) / max(price) FILTER (rn = 0) AS price_change_ratio_5min, coalesce(avg(z) FILTER (rn <= 5 AND z > 0), 0) AS pump_velocity_5min, " + ", ".join(f"coalesce(sum(d * d{k}) / nullif(sum(d * d), 0), 0) AS acf_lag_{k}" for k in (1, 5, 10)) + f" FROM (SELECT *, lag(d) OVER {W} AS d1, lag(d, 5) OVER {W} AS d5, lag(d, 10) OVER {W} AS d10 FROM (SELECT *, z - avg(z) OVER (PARTITION BY token_id) AS d FROM (SELECT *, (price - lag(price) OVER {W}) / (lag(price) OVER {W} + 1e-12) AS z, max(price) OVER {W} AS top FROM r))) GROUP BY token_id")
FEATURES = ["mean_return", "std_return", "max_drawdown", "acf_lag_1", "return_5min"]
on_series("behaviour_rules", SHORT, "cluster:i tokens:i mean_return:r std_return:r lifespan_minutes:r behaviour", lambda s: acf.behaviour(learning.kmeans(acf.features_15(s), FEATURES, 4)))
on_series("cluster_summary", SHORT, "cluster:i tokens:i pct_dead:r archetype", lambda s: acf.archetype_name(acf.cluster_summary(learning.kmeans(acf.features_15(s), FEATURES, 4))))
on_series("archetype_aggregate", SHORT, "grp:i n:i mean:r median:r p95:r positive_rate:r winsorized_mean:r extreme_gain_rate:r", lambda s: acf.archetype_aggregate(quality.total_return_series(s).where("ret is not null").withColumn("grp", F.pmod(F.col("token_id").cast("int"), F.lit(4))), "grp", "ret"), "SELECT grp, count(*) AS n, avg(ret) AS mean, any_value(q50) AS median, any_value(q95) AS p95, avg(CAST(ret > 0 AS INT)) AS positive_rate, avg(greatest(least(ret, q95), q05)) AS winsorized_mean, avg(CAST(ret > 1 AS INT)) AS extreme_gain_rate FROM (SELECT *, CAST(token_id AS INT) % 4 AS grp FROM r WHERE ret IS NOT NULL) JOIN (SELECT CAST(token_id AS INT) % 4 AS grp, quantile_cont(ret, 0.05) AS q05, quantile_cont(ret, 0.5) AS q50, quantile_cont(ret, 0.95) AS q95 FROM r WHERE ret IS NOT NULL GROUP BY 1) USING (grp) GROUP BY grp")
on_series("return_signs", SHORT, "horizon:i n:i positive:r negative:r", acf.return_signs, "SELECT horizon, count(*) AS n, avg(CAST(x > 0 AS INT)) AS positive, avg(CAST(x < 0 AS INT)) AS negative FROM (" + " UNION ALL ".join(f"SELECT {h} AS horizon, lead(price, {h}) OVER {W} / price - 1 AS x FROM s" for h in (15, 60)) + ") WHERE x IS NOT NULL GROUP BY horizon")
halves = lambda s, h: s.where(f"seq % 2 = {h}").groupBy("token_id").agg(F.count("*").alias("n"), F.avg("price").alias("mean"))
on_series("incremental_merge", SHORT, "token_id n:i total:r", lambda s: acf.merge_weighted(halves(s, 0), halves(s, 1)).withColumn("total", F.col("n") * F.col("mean")), "SELECT token_id, count(*) AS n, sum(price) AS total FROM s GROUP BY token_id")

# --- support for models ------------------------------------------------------------------------------------------------------------
FOLDS = "SELECT token_id, seq, fold, CASE WHEN rn < e THEN 'train' ELSE 'test' END AS role FROM (SELECT *, {train} + fold * {step} AS e FROM (SELECT *, unnest(range(0, CAST(floor((cnt - {off} - {test} - {train}) / {step}) AS BIGINT) + 1)) AS fold FROM {rows})) WHERE rn >= {start} AND rn < e OR rn >= e + {gap} AND rn < e + {gap} + {test}"
PLAN = "pn AS (SELECT *, CASE WHEN cnt < 200 THEN 60 WHEN cnt < 400 THEN 120 WHEN cnt < 600 THEN 180 WHEN cnt < 1200 THEN 480 WHEN cnt < 1800 THEN 720 ELSE 960 END AS train, CASE WHEN cnt < 400 THEN 30 WHEN cnt < 600 THEN 60 WHEN cnt < 1200 THEN 120 WHEN cnt < 1800 THEN 180 ELSE 240 END AS st FROM r),\npf AS (SELECT *, CASE WHEN floor((cnt - train) / st) < 2 THEN greatest(floor((cnt - train) / 2), 30) ELSE st END AS step FROM pn)"
on_series("walk_forward_folds", SHORT, "token_id seq:i fold:i role", lambda s: learning.walk_forward(s, (30, 10, 10), buffer=5), FOLDS.format(train=30, step=10, test=10, off=5, gap=5, start=0, rows="r"))
on_series("walk_forward_adaptive", LONG, "token_id seq:i fold:i role", lambda s: learning.walk_forward(s, horizon=100), FOLDS.format(train="train", step="step", test="step", off=100, gap=0, start=0, rows="pf"), PLAN)
on_series("walk_forward_sliding", LONG, "token_id seq:i fold:i role", lambda s: learning.walk_forward(s, "memecoin_short", horizon=60, sliding=True, most_folds=10), "SELECT * FROM (" + FOLDS.format(train=120, step=30, test=30, off=60, gap=0, start="e - 120", rows="r") + ") WHERE fold < 10")
guesses = lambda s: R.with_returns(s).where("ret is not null").select("ret", (F.col("ret") > 0).cast("int").alias("y_true"), (F.col("price") > 100).cast("int").alias("y_pred"), F.round("price").alias("y_proba"))
GUESSES = "gu AS (SELECT ret, CAST(ret > 0 AS INT) AS t, CAST(price > 100 AS INT) AS g, price FROM r WHERE ret IS NOT NULL),\ncm AS (SELECT CAST(count(*) FILTER (t = 1 AND g = 1) AS DOUBLE) AS tp, count(*) FILTER (t = 0 AND g = 1) AS fp, count(*) FILTER (t = 1 AND g = 0) AS fn, count(*) FILTER (t = 0 AND g = 0) AS tn, sum(abs(ret)) FILTER (t = 1 AND g = 1) AS hit, sum(abs(ret)) FILTER (t = 1) AS al, sum(abs(ret)) FILTER (g = 1) AS said FROM gu)"
on_series("confusion_metrics", SHORT, "tp:i fp:i fn:i tn:i accuracy:r precision:r recall:r f1:r", lambda s: learning.confusion(guesses(s)), "SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM cm", GUESSES)
on_series("return_weighted_recall", SHORT, "weighted_recall:r weighted_precision:r f1:r hybrid_f1:r", lambda s: learning.return_weighted(guesses(s)), "SELECT hit / al AS weighted_recall, hit / said AS weighted_precision, 2 * tp / (2 * tp + fp + fn) AS f1, (2 * (hit / al) * (hit / said) / (hit / al + hit / said) + 2 * tp / (2 * tp + fp + fn)) / 2 AS hybrid_f1 FROM cm", GUESSES)
on_series("roc_auc", SHORT, "auc:r", lambda s: learning.roc_auc(guesses(s)), "SELECT (sum(rk) FILTER (t = 1) - count(*) FILTER (t = 1) * (count(*) FILTER (t = 1) + 1) / 2.0) / (CAST(count(*) FILTER (t = 1) AS DOUBLE) * count(*) FILTER (t = 0)) AS auc FROM (SELECT t, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rk FROM (SELECT t, round(price) AS y FROM gu))", GUESSES)
on_series("trading_metrics", SHORT, "sharpe:r win_rate:r", lambda s: learning.trading_metrics(guesses(s)), "SELECT (avg(ret) - 0.02 / 252) / stddev_samp(ret) * sqrt(252.0) AS sharpe, avg(CAST(ret > 0 AS INT)) AS win_rate FROM gu", GUESSES)
on_series("kmeans_archetypes", SHORT, "cluster:i tokens:i " + " ".join(f"{c}:r" for c in FEATURES), lambda s: learning.kmeans(acf.features_15(s), FEATURES, 4).groupBy("cluster").agg(F.count("*").alias("tokens"), *(F.avg(c).alias(c) for c in FEATURES)))

# --- sequential kernels, without SQL -----------------------------------------------------------------------------------------------
on_series("hurst", LONG, "token_id hurst:r", grouped.hurst)
on_series("fft_cycles", LONG, "token_id rank:i period:r power:r entropy:r", grouped.fft_cycles)
on_series("welch_spectrum", LONG, "token_id rank:i period:r period_class", grouped.welch)
on_series("pacf", LONG, "token_id lag:i pacf:r", grouped.pacf)
on_series("entry_exit_nonoverlap", SHORT, "entry_window:i exit_window:i tokens:i trades:i mean_return:r low:r high:r", lambda s: grouped.matrix_with_bounds(grouped.entry_exit_nonoverlap(s)))
on_series("rsi_divergence", SHORT, "token_id divergence", grouped.rsi_divergence)
on_series("elliott_waves", LONG, "token_id start_row:i end_row:i wave_1:r wave_2:r wave_3:r wave_4:r", grouped.elliott)
on_series("higuchi_dimension", SHORT, "token_id fractal_dimension:r", grouped.higuchi)
on_series("rolling_entropy", LONG, "token_id row:i entropy:r", grouped.rolling_entropy)
on_series("paper_trading", SHORT, "token_id exit_row:i profit:r", grouped.paper_trading, f"SELECT token_id, exit_row, 100 * 0.997 / (p0 * 1.01) * (price * 0.99) * 0.997 - 100 AS profit FROM (SELECT token_id, rn AS exit_row, price, first(price) OVER {W} AS p0, max(price) OVER {W} AS top, cnt FROM r) t WHERE exit_row >= 1 AND p0 <> 0 AND (price <= top * 0.8 OR price <= p0 * 1.01 * 0.95 OR exit_row = cnt - 1) QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY exit_row) = 1")

# --- streaming operators over a batch table (the tests run them as streams) ----------------------------------------------------------
on_series("stream_ohlc_watermark", LONG, "token_id window_start:t open:r high:r low:r close:r n:i", streaming.bars, f"SELECT token_id, {bucket_sql(300)} AS window_start, first(price ORDER BY datetime, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY datetime, seq) AS close, count(*) AS n FROM s GROUP BY ALL")
on_series("stream_dedupe", SHORT, "token_id seq:i", lambda s: streaming.without_duplicates(s.unionByName(s)), "SELECT token_id, seq FROM s")
on_series("stream_sessions", SHORT, "token_id sessions:i rows:i", lambda s: streaming.sessions(s, "120 minutes").groupBy("token_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("rows")), f"SELECT token_id, sum(c) AS sessions, count(*) AS rows FROM (SELECT token_id, CASE WHEN epoch_us(datetime) - lag(epoch_us(datetime)) OVER {W} < 7200000000 THEN 0 ELSE 1 END AS c FROM s) GROUP BY token_id")

# --- pipelines ---------------------------------------------------------------------------------------------------------------------
on_series("bot_pipeline", LONG, "token_id datetime:t split scaled:r ma_5:r vol_std_5:r", lambda s: pipeline.run_bot_pipeline(s, 60))
on_series("feature_pipeline", LONG, "token_id seq:i sma_50:r log_returns_vol_60:r label_60m:i return_60m:r return_720m:r", pipeline.feature_table, f"SELECT * FROM (SELECT token_id, seq, rn, {roll('avg', 'price', 50)} AS sma_50, {roll('stddev_samp', 'ln(price / p1)', 60)} AS log_returns_vol_60, CASE WHEN p60 > price THEN 1 WHEN p60 <= price THEN 0 END AS label_60m, p60 / price - 1 AS return_60m, p720 / price - 1 AS return_720m FROM (SELECT *, lag(price) OVER {W} AS p1, lead(price, 60) OVER {W} AS p60, lead(price, 720) OVER {W} AS p720 FROM r)) WHERE rn >= 60")
on_series("batch_pipeline", SHORT, "token_id datetime:t category sma_50:r return_15m:r", pipeline.run_pipeline)
on_series("leakage_names", SHORT, "column is_safe", lambda s: features.name_report(acf.features_15(s).select("mean_return", "max_drawdown", "lifespan_minutes").withColumn("Granularity_5", F.lit(1))), "SELECT * FROM (VALUES ('mean_return', true), ('max_drawdown', false), ('lifespan_minutes', true), ('Granularity_5', false)) AS v(\"column\", is_safe)")
on_series("bot_autocorrelation", SHORT, "token_id " + " ".join(f"acf_lag_{k}:r" for k in range(1, 11)), features.bot_autocorrelation, "SELECT token_id, " + ", ".join(f"coalesce(CASE WHEN count(*) > 10 THEN sum(d * l{k}) / nullif(sum(d * d), 0) END, 0) AS acf_lag_{k}" for k in range(1, 11)) + " FROM (SELECT *, " + ", ".join(f"lag(d, {k}) OVER w AS l{k}" for k in range(1, 11)) + " FROM (SELECT *, ret - avg(ret) OVER (PARTITION BY token_id) AS d FROM r WHERE ret IS NOT NULL) WINDOW w AS (PARTITION BY token_id ORDER BY datetime, seq)) GROUP BY token_id")
on_series("best_horizon", SHORT, "token_id horizon:i sharpe:r", lambda s: quant.best_horizon(quant.risk_reward(s)), "SELECT token_id, horizon, sharpe FROM rr QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY sharpe DESC, horizon) = 1", RR)
register("label_columns", "token_id seq:i category cluster:i", lambda spark, d: acf.label_columns(events(spark, d, SHORT), sets.members(categories(spark, d)).where("category = 'purchase'").withColumn("cluster", F.length("token_id"))), CATEGORIES + "SELECT s.token_id, s.seq, m.category, length(m.token_id) AS cluster FROM s LEFT JOIN (SELECT * FROM m WHERE category = 'purchase') m ON m.token_id = s.token_id")
on_series("death_times", LONG, "bucket:i tokens:i", lambda s: acf.death_times(flat_tail(s)), "SELECT floor(death_minute / 60) * 60 AS bucket, count(*) AS tokens FROM dm WHERE death_minute IS NOT NULL GROUP BY 1", DEAD)

# --- long series by ranges -----------------------------------------------------------------------------------------------------------
SPLIT = {"rows": 500, "cell": 3600}
on_series("running_ranges", LONG, "token_id seq:i total:r n:i top:r least:r", lambda s: ranges.with_running(s, {"total": ("sum", "price"), "n": ("count", "price"), "top": ("max", "price"), "least": ("min", "price")}, **SPLIT), f"SELECT token_id, seq, sum(price) OVER w AS total, count(price) OVER w AS n, max(price) OVER w AS top, min(price) OVER w AS least FROM s WINDOW w AS (PARTITION BY token_id ORDER BY datetime, seq ROWS UNBOUNDED PRECEDING)")
# weights beyond 400 rows are under 1e-18
on_series("ewm_ranges", LONG, "token_id seq:i ema_12:r ewm_10:r", lambda s: ranges.with_ewm_ranges(s, {"ema_12": ("price", {"span": 12}), "ewm_10": ("price", {"alpha": 0.1})}, **SPLIT), "SELECT a.token_id, a.seq, " + ", ".join(f"sum(b.price * pow(1 - {q}, a.rn - b.rn)) / sum(pow(1 - {q}, a.rn - b.rn)) AS {n}" for n, q in (("ema_12", 2 / 13), ("ewm_10", 0.1))) + " FROM r a JOIN r b ON a.token_id = b.token_id AND b.rn BETWEEN a.rn - 400 AND a.rn GROUP BY a.token_id, a.seq")
on_series("rolling_ranges", LONG, "token_id seq:i m20:r hi30:r q25:r ahead:r", lambda s: ranges.over_ranges(s, lambda x: x.withColumns({"m20": R.mean("price", 20), "hi30": R.high("price", 30), "q25": R.quantile("price", 0.25, 30), "ahead": R.lead("price", 15)}), 29, 15, **SPLIT), f"SELECT token_id, seq, {roll('avg', 'price', 20)} AS m20, {roll('max', 'price', 30)} AS hi30, {roll('quantile_cont({}, 0.25)', 'price', 30)} AS q25, lead(price, 15) OVER {W} AS ahead FROM s")

# --- correlation by blocks of tokens -------------------------------------------------------------------------------------------------
DAYS = f"b AS (SELECT token_id, {bucket_sql(86400)} AS bucket, first(price ORDER BY datetime, seq) AS price FROM s GROUP BY ALL),\nlr AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY token_id ORDER BY bucket)) AS x FROM b)"
PAIRS_SQL = "SELECT *, CASE WHEN abs(correlation) >= 0.8 THEN 'very_strong' WHEN abs(correlation) >= 0.6 THEN 'strong' WHEN abs(correlation) >= 0.4 THEN 'moderate' WHEN abs(correlation) >= 0.2 THEN 'weak' ELSE 'very_weak' END AS strength FROM (SELECT a.token_id AS token_a, c.token_id AS token_b, count(*) AS n, corr(a.x, c.x) AS correlation FROM lr a JOIN lr c ON a.bucket = c.bucket AND a.token_id < c.token_id WHERE a.x IS NOT NULL AND c.x IS NOT NULL GROUP BY ALL HAVING count(*) >= {least})"
on_series("corr_blocks", SHORT, "token_a token_b n:i correlation:r strength", lambda s: blocks.corr_blocks(s, 1440, 10, 0.5), PAIRS_SQL.format(least=10) + " WHERE abs(correlation) >= 0.5", DAYS)
ALIGNED = """ends AS (SELECT max(lo) AS a, min(hi) AS b FROM (SELECT min(datetime) AS lo, max(datetime) AS hi FROM s GROUP BY token_id)),
inside AS (SELECT s.* FROM s, ends WHERE datetime BETWEEN a AND b AND price > 0),
ret AS (SELECT token_id, datetime, ln(price) - lag(ln(price)) OVER (PARTITION BY token_id ORDER BY datetime, seq) AS x FROM inside),
m AS (SELECT token_id, time_bucket(INTERVAL 1 MINUTE, datetime) AS bucket, first(x ORDER BY datetime) AS x FROM ret WHERE x IS NOT NULL GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT token_id FROM m), (SELECT DISTINCT bucket FROM m)),
lr AS (SELECT token_id, bucket, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY token_id ORDER BY bucket ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (PARTITION BY token_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM grid LEFT JOIN m USING (token_id, bucket))"""
on_series("correlation_driver", LONG, "token_a token_b n:i correlation:r strength alignment", lambda s: blocks.correlate(s, significant=0.0), "SELECT *, 'outer' AS alignment FROM (" + PAIRS_SQL.format(least=30) + ")", ALIGNED)

# --- warping, clusters, spectra over time, rules, stages ------------------------------------------------------------------------------
on_series("dtw_distances", LONG, "token_a token_b distance:r", dtw.dtw_distances)
on_series("dtw_clusters", LONG, "token_id cluster rows:i n_tokens:i avg_rows:r std_rows:r", lambda s: dtw.dtw_clusters(s, 2))
on_series("k_selection", SHORT, "k:i within:r gap:r gap_sd:r davies_bouldin:r elbow_distance:r by_gap by_elbow", lambda s: lloyd.k_selection(acf.features_15(s), FEATURES))
on_series("consensus_clusters", SHORT, "token_id cluster stability:r", lambda s: lloyd.consensus(acf.features_15(s), FEATURES, 4))
on_series("unified_or_separate", SHORT, "lifespan tokens:i silhouette_unified:r silhouette_separate:r ari:r decision", lambda s: lloyd.unified_or_separate(acf.features_15(s).join(s.groupBy("token_id").agg(acf.lifespan_class(F.count("*"), 60, 80).alias("lifespan")), "token_id"), FEATURES, 3, "lifespan"))
SEGMENTS = """x AS (SELECT token_id, rn - 1 AS rn, CASE WHEN isfinite(ret) THEN ret ELSE 0 END AS r, least(256, cnt - 1) AS n, cnt - 1 AS m FROM r WHERE rn >= 1 AND cnt >= 9),
g AS (SELECT *, greatest(1, n // 2) AS step FROM x),
cut AS (SELECT token_id, n, step, segment, rn - segment * step AS pos, r - avg(r) OVER (PARTITION BY token_id, segment) AS d FROM (SELECT *, unnest(range(CAST(greatest(0, ceil((rn - n + 1) / step)) AS BIGINT), CAST(least(rn // step, (m - n) // step) AS BIGINT) + 1)) AS segment FROM g)),
f AS (SELECT token_id, segment, any_value(step) AS step, k / any_value(n) AS frequency, pow(sum(w * d * cos(2 * pi() * k * pos / n)), 2) + pow(sum(w * d * sin(2 * pi() * k * pos / n)), 2) AS power FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * pos / (n - 1)) AS w FROM cut), range(1, 129) q(k) WHERE 2 * k <= n GROUP BY token_id, segment, k)"""
# powers span many sizes: as decibels
on_series("spectrogram", LONG, "token_id segment:i start:i frequency:r decibels:r", lambda s: spectral.spectrogram(s, **SPLIT).withColumn("decibels", 10 * F.log10("power")), "SELECT *, segment * step AS start, 10 * log10(power) AS decibels FROM f", SEGMENTS)
on_series("mean_spectrum", LONG, "token_id rank:i period:r decibels:r period_class", lambda s: spectral.mean_spectrum(s, **SPLIT).withColumn("decibels", 10 * F.log10("power")), "SELECT *, 10 * log10(power) AS decibels, CASE WHEN period < 5 THEN 'high_frequency' WHEN period < 30 THEN 'short_term' WHEN period < 120 THEN 'medium_term' ELSE 'long_term' END AS period_class FROM (SELECT token_id, 1 / frequency AS period, avg(power) AS power, row_number() OVER (PARTITION BY token_id ORDER BY avg(power) DESC, frequency) AS rank FROM f GROUP BY token_id, frequency) WHERE rank <= 15", SEGMENTS)


def early_table(s: DataFrame) -> DataFrame:
    """Early features of each token with when it began and how long it lived."""
    life = s.groupBy("token_id").agg(F.count("*").alias("rows"), F.unix_micros(F.min("datetime")).alias("began"))
    return features.early_features(s).join(life, "token_id").withColumn("lifespan", acf.lifespan_class("rows", 60, 80))


EARLY = ["cumulative_return", "max_return", "min_return", "cv", "slope", "log_slope", "up_share", "volatility"]


def early_rules(s: DataFrame) -> DataFrame:
    tokens = early_table(s)
    return learning.rule_quality(tokens, learning.rules_table(learning.early_rules(tokens, EARLY, "lifespan", depth=4), EARLY), "lifespan")


def two_stage(s: DataFrame) -> DataFrame:
    tokens = early_table(s).withColumns({"sprint": (F.col("lifespan") == "sprint").cast("int"), "marathon": F.when(F.col("lifespan") != "sprint", (F.col("lifespan") == "marathon").cast("int"))})
    return staged.fold_metrics(staged.two_stage(tokens, EARLY, "sprint", "marathon", "began", folds=4, rounds=5, depth=3), "sprint", "marathon")


on_series("early_rules", SHORT, "rule:i feature low:r high:r class support:i purity:r", early_rules)
on_series("two_stage_metrics", SHORT, "fold:i tokens:i recall:r precision:r f1:r passed:i recall_2:r precision_2:r false_negative_rate_2:r", two_stage)
register("schema_gate", "file columns:i rows:i verdict", lambda spark, d: gate.judged(gate.footers(spark, d), ("item_id", "text")).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.size("columns").alias("columns"), "rows", "verdict"))

# prices in steps of a hundred, so that they stand still now and then
LIVES_SQL = f"""x AS (SELECT token_id, datetime, seq, floor(price / 100) AS price, epoch_us(datetime) // 1000 AS ms FROM s),
g AS (SELECT *, coalesce(ms - lag(ms) OVER {W} > 86400000, true) AS gone, coalesce(lead(ms) OVER {W} - ms > 86400000, false) AS ends, coalesce(price <> lag(price) OVER {W}, true) AS moved FROM x),
l AS (SELECT *, count(*) FILTER (gone) OVER {W} AS life, count(*) FILTER (gone OR moved) OVER {W} AS run FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY token_id, life ORDER BY datetime, seq) AS rows, row_number() OVER (PARTITION BY token_id, run ORDER BY datetime, seq) AS k FROM l),
b AS (SELECT *, lag(k) OVER {W} AS before FROM k)"""
on_series("life_events", SHORT, "token_id event at:t rows:i", lambda s: lives.life_events_of_table(s.withColumn("price", F.floor(F.col("price") / 100)), 3, 86_400), "SELECT token_id, 'moving' AS event, datetime AS at, rows FROM b WHERE k = 1 AND NOT gone AND before >= 3 UNION ALL SELECT token_id, 'flat', datetime, rows FROM b WHERE k = 3 UNION ALL SELECT token_id, 'silent', make_timestamp((ms + 86400000) * 1000), rows FROM b WHERE ends", LIVES_SQL)
