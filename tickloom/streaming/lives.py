"""Lives of tokens on a stream: state with event-time timers, and a table that is kept up to date bucket by bucket.

A token's life begins with its first row and ends when it falls silent for `silent` seconds of event time; the next row begins another. In a
life, `flat` is told when the price has stood still for `dead_after` rows, `moving` when it moves again after that, `silent` at the end,
`silent` seconds after the last row. What is told doesn't depend on how rows fall into triggers, as long as a token's rows come in order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tickloom.functions.rolling import KEY, PRICE, TIE, TIME, in_order

EVENTS = f"{KEY} string, event string, at timestamp, rows long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lives(StatefulProcessor):
    """State of a token: rows of its life, last price, length of the run of equal prices, and the last row's time in milliseconds. A timer waits for its silence."""

    def __init__(self, dead_after: int, silent: int):
        self.dead_after, self.silent = dead_after, silent * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "rows long, price double, run long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        part = pd.concat(list(rows)).sort_values([TIME, TIE])
        at = part[TIME].to_numpy("datetime64[ms]").astype(np.int64)
        price = part[PRICE].to_numpy(float)
        n, last_price, run, last = self.life.get() if self.life.exists() else (0, float("nan"), 0, None)
        if last is not None:
            self.handle.deleteTimer(last + self.silent)
        gone = np.diff(at, prepend=at[0] if last is None else last) > self.silent
        moves = np.concatenate([[True], price[1:] != price[:-1]])
        starts = np.flatnonzero(moves | gone)
        found = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):  # a run of equal prices, not a row
            if gone[a]:
                found.append(("silent", (last if a == 0 else int(at[a - 1])) + self.silent, n))
                n, run, last_price = 0, 0, float("nan")
            if price[a] != last_price:
                if run >= self.dead_after:
                    found.append(("moving", int(at[a]), n + 1))
                run = 0
            if run < self.dead_after <= run + b - a:
                k = self.dead_after - run
                found.append(("flat", int(at[a + k - 1]), n + k))
            n, run, last_price = n + b - a, run + b - a, float(price[a])
        self.life.update((n, last_price, run, int(at[-1])))
        self.handle.registerTimer(int(at[-1]) + self.silent)
        if found:
            yield self._told(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.life.exists():
            n, _, _, last = self.life.get()
            self.life.clear()  # the state ends with the life
            yield self._told(key, [("silent", last + self.silent, n)])

    def _told(self, key, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({KEY: key[0], "event": [f[0] for f in found], "at": pd.to_datetime([f[1] for f in found], unit="ms"), "rows": [f[2] for f in found]})

    def close(self) -> None:
        pass


def life_events(stream: DataFrame, dead_after: int = 30, silent: int = 3600, late: str = "10 minutes") -> DataFrame:
    """token_id, event (flat, moving or silent), at, rows (of the life so far). Needs a session whose state store is RocksDB (STORE)."""
    rows = stream.select(KEY, TIME, TIE, PRICE).withWatermark(TIME, late)
    return rows.groupBy(KEY).transformWithStateInPandas(Lives(dead_after, silent), EVENTS, "Append", "EventTime")


def life_events_of_table(s: DataFrame, dead_after: int = 30, silent: int = 3600) -> DataFrame:
    """The same events of a whole table. The last life of a token has no end yet."""
    w = in_order()
    seconds = F.unix_millis(TIME)
    rows = s.withColumns({"_gone": F.coalesce(seconds - F.lag(seconds).over(w) > silent * 1000, F.lit(True)), "_ends": F.coalesce(F.lead(seconds).over(w) - seconds > silent * 1000, F.lit(False)), "_moved": F.coalesce(F.col(PRICE) != F.lag(PRICE).over(w), F.lit(True))})
    rows = rows.withColumns({"_life": F.count_if("_gone").over(w), "_run": F.count_if(F.col("_gone") | F.col("_moved")).over(w)})
    in_life, in_run = Window.partitionBy(KEY, "_life").orderBy(TIME, TIE), Window.partitionBy(KEY, "_run").orderBy(TIME, TIE)
    rows = rows.withColumns({"rows": F.row_number().over(in_life).cast("long"), "_k": F.row_number().over(in_run)})
    rows = rows.withColumn("_before", F.lag("_k").over(w))
    told = F.array(
        F.when((F.col("_k") == 1) & ~F.col("_gone") & (F.col("_before") >= dead_after), F.struct(F.lit("moving").alias("event"), F.col(TIME).alias("at"))), F.when(F.col("_k") == dead_after, F.struct(F.lit("flat").alias("event"), F.col(TIME).alias("at"))),
        F.when(F.col("_ends"), F.struct(F.lit("silent").alias("event"), F.timestamp_millis(seconds + silent * 1000).alias("at"))),
    )
    return rows.select(KEY, "rows", F.explode(F.filter(told, lambda t: t.isNotNull())).alias("t")).select(KEY, "t.event", "t.at", "rows")


# --- statistics kept up to date by buckets -----------------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, table: str) -> list[int]:
    """The epochs whose manifests are complete, in order."""
    where, fs = _files(spark, f"{table}/manifest")
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(where) if f.getPath().getName().endswith(".json")) if fs.exists(where) else []


def manifest(spark: SparkSession, table: str, epoch: int) -> dict[str, str]:
    """bucket -> folder of its rows, as of an epoch."""
    return json.loads(spark.read.text(f"{table}/manifest/{epoch}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, table: str, epoch: int, of: dict[str, str]) -> None:
    """A manifest appears whole: it is written under another name and renamed."""
    draft, fs = _files(spark, f"{table}/manifest/.{epoch}-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(of).encode()))
    out.close()
    if not fs.rename(draft, _files(spark, f"{table}/manifest/{epoch}.json")[0]):
        raise OSError(f"manifest {epoch} of {table} is there already")


def upsert(batch: DataFrame, epoch: int, table: str, buckets: int = 64) -> None:
    """Merges a batch's counts and means by token into the table: only the buckets that the batch touches are written anew, and the manifest is swapped last.

    An epoch that is published already changes nothing, so a trigger that is repeated counts once."""
    from tickloom.operators.acf import merge_weighted

    spark = batch.sparkSession
    known = manifests(spark, table)
    if epoch in known:
        return
    of = manifest(spark, table, known[-1]) if known else {}
    new = batch.groupBy(KEY).agg(F.count("*").alias("n"), F.avg(PRICE).alias("mean")).withColumn("bucket", F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int"))
    folder = f"{table}/data/{epoch}-{uuid.uuid4().hex}"
    new.write.partitionBy("bucket").parquet(f"{folder}-new")
    new = spark.read.parquet(f"{folder}-new") if _files(spark, f"{folder}-new")[1].exists(_files(spark, f"{folder}-new")[0]) else new
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most as many as there are buckets
    if touched:
        old = [of[str(b)] for b in touched if str(b) in of]
        before = spark.read.schema(f"{KEY} string, n long, mean double").parquet(*old) if old else spark.createDataFrame([], f"{KEY} string, n long, mean double")
        merged = merge_weighted(before, new.select(KEY, "n", "mean")).withColumn("bucket", F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int"))
        merged.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        of = of | {str(b): f"{folder}/bucket={b}" for b in touched}
    draft, fs = _files(spark, f"{folder}-new")
    fs.delete(draft, True)
    _publish(spark, table, epoch, of)


def keep_statistics(stream: DataFrame, table: str, checkpoint: str, buckets: int = 64):
    """A stream's counts and means by token, kept in a table of buckets: start() it."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: upsert(batch, epoch, table, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def read_statistics(spark: SparkSession, table: str) -> DataFrame:
    """The table as of its last complete manifest: token_id, n, mean."""
    known = manifests(spark, table)
    paths = sorted(manifest(spark, table, known[-1]).values()) if known else []
    shape = f"{KEY} string, n long, mean double"
    return spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)


def clear_old(spark: SparkSession, table: str, keep: int = 2) -> None:
    """Deletes manifests before the last `keep`, and the folders that none of these names: what readers of older ones still used, and what killed triggers left."""
    known = manifests(spark, table)
    for epoch in known[:-keep]:
        where, fs = _files(spark, f"{table}/manifest/{epoch}.json")
        fs.delete(where, False)
    used = {path.rsplit("/", 2)[-2] for epoch in known[-keep:] for path in manifest(spark, table, epoch).values()}
    used_buckets = {"/".join(path.rsplit("/", 2)[-2:]) for epoch in known[-keep:] for path in manifest(spark, table, epoch).values()}
    where, fs = _files(spark, f"{table}/data")
    for folder in fs.listStatus(where) if fs.exists(where) else []:
        name = folder.getPath().getName()
        if name not in used:
            fs.delete(folder.getPath(), True)
            continue
        for bucket in fs.listStatus(folder.getPath()):
            if bucket.isDirectory() and f"{name}/{bucket.getPath().getName()}" not in used_buckets:
                fs.delete(bucket.getPath(), True)
