"""Correlation of very many series: blocks of tokens meet as matrices, and only pairs of tokens travel on.

Values are laid out as sparse matrices of a block of tokens by a chunk of time; every two blocks meet once, chunk by chunk, and give
counts and sums of all their pairs by matrix products, with a mask of what is there. Blocks travel by districts, which a task can hold
two of: a value is sent once for each district, not for each block or token, where a join of pairs makes tokens x tokens x times rows.
What is not significant is dropped inside the block pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.rolling import KEY, PRICE, finite, ln, quotient
from tickloom.operators.cross import aligned_outer, common_range, minute_first, strength

BLOCK, CHUNK = 256, 1024
#: Bytes of values in a district, about, and districts where there are blocks enough (a task for each two of them).
HELD, DISTRICTS = 64 << 20, 16
_CELL = np.dtype([("token", "<u4"), ("at", "<i8"), ("value", "<f8")])


def pair_correlations(values: DataFrame, time: str, value: str, least: int = 30, significant: float = 0.0, block: int = BLOCK, chunk: int = CHUNK, held: int = HELD) -> DataFrame:
    """Pearson correlation of each two tokens over the times that both have: token_a < token_b, n, correlation.

    values: token_id (string), a whole-number column `time`, one row per token and time; nulls and NaN count as missing, and a pair that meets an infinite value
    has the correlation NaN. Pairs that share fewer than `least`
    times, have a constant side or fall under `significant` in size are left out. block: tokens of a block, about; chunk: span of time whose values stand in one matrix; held: bytes of a district, about."""
    rows = values.select(KEY, F.col(time).cast("long").alias("_t"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    tokens = rows.groupBy(KEY).agg(F.coalesce(F.avg(F.when(finite("_v"), F.col("_v"))), F.lit(0.0)).alias("_mean"), F.count("*").alias("_n"))
    found = tokens.agg(F.count("*").alias("tokens"), F.sum("_n").alias("n")).first()
    tokens, blocks = tokens.drop("_n"), max(1, -(-found.tokens // block))
    districts = min(blocks, max(DISTRICTS, -(-(found.n or 0) * _CELL.itemsize // held)))
    tokens = tokens.withColumn("_block", F.pmod(F.xxhash64(KEY), F.lit(blocks)).cast("int"))
    tokens = tokens.withColumn("_no", F.row_number().over(Window.partitionBy("_block").orderBy(KEY)) - 1)
    cells = rows.join(tokens, KEY).select("_block", F.floor(F.col("_t") / chunk).alias("_chunk"), F.struct(F.col("_no").alias("token"), F.col("_t").alias("at"), (F.col("_v") - F.col("_mean")).alias("value")).alias("c"))
    parts = cells.groupBy("_block", "_chunk").agg(F.collect_list("c").alias("cells"))  # block x chunk cells at most

    def pack(batches):
        for b in batches:
            raw = []
            for cells in b.column(2):
                flat = cells.values
                out = np.empty(len(flat), _CELL)
                for name in _CELL.names:
                    out[name] = flat.field(name).to_numpy(zero_copy_only=False)
                raw.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), pa.nulls(b.num_rows, pa.list_(pa.string()))], names=["block", "chunk", "cells", "names"])

    packed = parts.mapInArrow(pack, "block int, chunk bigint, cells binary, names array<string>")
    names = tokens.groupBy("_block").agg(F.sort_array(F.collect_list(KEY)).alias("names")).select(F.col("_block").alias("block"), F.lit(-(1 << 62)).alias("chunk"), F.lit(None).cast("binary").alias("cells"), "names")
    own = F.pmod(F.col("block"), F.lit(districts))
    meet = packed.unionByName(names).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(districts - 1))))
    meet = meet.select(F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "block", "chunk", "cells", "names")

    def dense(c: np.ndarray, n: int, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, there = np.zeros((n, len(times))), np.zeros((n, len(times)))
        at = np.searchsorted(times, c["at"])
        x[c["token"], at] = c["value"]
        there[c["token"], at] = 1.0
        return x, there

    def finished(pair, names, sums):
        n, sx, sy, sxx, syy, sxy, odd = sums
        with np.errstate(invalid="ignore", divide="ignore"):
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            # what rounding leaves of a constant side is no variance
            flat = (vx <= 1e-12 * np.maximum(sxx, 1e-300)) | (vy <= 1e-12 * np.maximum(syy, 1e-300))
            r = np.where(flat, np.nan, (sxy - sx * sy / n) / np.sqrt(vx * vy))
            r = np.where(odd > 0, np.nan, r)
        keep = (n >= least) & ((np.abs(r) >= significant) | (odd > 0))
        if pair[0] == pair[1]:
            keep &= np.triu(np.ones_like(keep, bool), 1)
        a, b = np.nonzero(keep)
        left, right = np.array(names[0], object)[a], np.array(names[1], object)[b]
        swap = left > right
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        return pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(n[a, b].astype(np.int64)), pa.array(r[a, b])], names=["token_a", "token_b", "n", "correlation"])

    def pair_of(x_cells: dict, y_cells: dict, n: int, m: int, same: bool):
        """Sums of two blocks over the chunks that both have."""
        sums = None
        for part in sorted(x_cells.keys() & y_cells.keys()):
            a, b = x_cells[part], y_cells[part]
            times = np.unique(a["at"]) if same else np.intersect1d(a["at"], b["at"])
            if not len(times):
                continue
            x, mx = dense(a[np.isin(a["at"], times)], n, times)
            y, my = (x, mx) if same else dense(b[np.isin(b["at"], times)], m, times)
            # values that are not finite make no sums, but are counted where they meet another
            bx, by = ~np.isfinite(x), ~np.isfinite(y)
            odd = bx @ my.T + mx @ by.T if bx.any() or by.any() else np.zeros((n, m))
            x, y = np.where(bx, 0.0, x), np.where(by, 0.0, y)
            new = (mx @ my.T, x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T, x @ y.T, odd)
            sums = new if sums is None else tuple(a + b for a, b in zip(sums, new, strict=True))
        return sums

    def meeting(pair, held, names):
        """All pairs of blocks of two districts."""
        left, right = ([b for b in sorted(names) if b % districts == d] for d in pair)
        for a in left:
            for b in right:
                if pair[0] == pair[1] and b < a:
                    continue
                sums = pair_of(held.get(a, {}), held.get(b, {}), len(names[a]), len(names[b]), a == b)
                if sums is not None:
                    yield finished((a, b), (names[a], names[b]), sums)

    def work(batches):
        pair, held, names = None, {}, {}
        for batch in batches:
            for i, j, block, part, cells, own in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (i, j) != pair:
                    if pair is not None:
                        yield from meeting(pair, held, names)
                    pair, held, names = (i, j), {}, {}
                if own is not None:
                    names[block] = own
                else:
                    held.setdefault(block, {})[part] = np.frombuffer(cells, _CELL)
        if pair is not None:
            yield from meeting(pair, held, names)

    # two districts go to a task of their own; small or not, tasks are not merged
    place = F.col("j") * (F.col("j") + 1) / 2 + F.col("i")
    meet = meet.repartitionById(districts * (districts + 1) // 2, place.cast("int")).sortWithinPartitions("i", "j")
    return meet.mapInArrow(work, "token_a string, token_b string, n bigint, correlation double")


def log_returns_by_bucket(s: DataFrame, minutes: int = 60) -> DataFrame:
    """Log returns from bucket to bucket of minutes: token_id, at (number of the bucket), r."""
    along = Window.partitionBy(KEY).orderBy("bucket")
    rows = minute_first(s, minutes).withColumn("r", ln(quotient(PRICE, F.lag(PRICE).over(along))))
    rows = rows.withColumn("r", F.nanvl("r", F.lit(float("inf"))))  # zero by zero is a return, if none that is finite
    return rows.where(F.col("r").isNotNull()).select(KEY, F.floor(F.unix_seconds("bucket") / (60 * minutes)).alias("at"), "r")


def corr_blocks(s: DataFrame, minutes: int = 60, least: int = 30, significant: float = 0.0, **how) -> DataFrame:
    """As cross.corr_pairs, for very many tokens: log returns of buckets, by blocks of tokens."""
    return pair_correlations(log_returns_by_bucket(s, minutes), "at", "r", least, significant, **how).withColumn("strength", strength(F.col("correlation")))


#: Shared times that the inner and the outer alignment need, rows that a token needs, and the size from which a correlation counts.
INNER_LEAST, OUTER_LEAST, TOKEN_LEAST, SIGNIFICANT = 50, 30, 10, 0.5


def synchronised(s: DataFrame) -> tuple[DataFrame, str]:
    """Log returns at common times, and the kind of alignment: `inner` where all tokens share at least 50 times within their common range, `outer`
    (filled forward, then backward) where there are at least 30 times in all, else `minute` (the first price of each minute). token_id, at, r.

    Two small counts decide; only the alignment that is chosen is carried out."""
    returns = lambda rows, time: rows.withColumn("r", F.log(PRICE) - F.log(F.lag(PRICE).over(Window.partitionBy(KEY).orderBy(time)))).where(F.col("r").isNotNull())
    within = common_range(s).where(F.col(PRICE) > 0)
    long = within.groupBy(KEY).agg(F.count("*").alias("_n")).where(F.col("_n") >= TOKEN_LEAST).select(KEY)
    rows = returns(within.join(long, KEY, "left_semi"), "datetime").groupBy(KEY, F.unix_micros("datetime").alias("at")).agg(F.first("r").alias("r"))
    tokens = rows.select(KEY).distinct().count()
    times = rows.groupBy("at").agg(F.count("*").alias("k"))
    found = times.agg(F.count_if(F.col("k") == tokens).alias("shared"), F.count("*").alias("times")).first()
    if tokens >= 2 and found.shared >= INNER_LEAST:
        return rows.join(times.where(F.col("k") == tokens), "at", "left_semi").select(KEY, "at", "r"), "inner"
    if tokens >= 2 and found.times >= OUTER_LEAST:
        filled = aligned_outer(rows.select(KEY, F.timestamp_micros("at").alias("datetime"), F.lit(0).alias("seq"), F.col("r").alias(PRICE)), 1)
        return filled.select(KEY, F.unix_micros("bucket").alias("at"), F.col(PRICE).alias("r")), "outer"
    minute = returns(minute_first(s.where(F.col(PRICE) > 0), 1), "bucket")
    return minute.select(KEY, F.unix_micros("bucket").alias("at"), "r"), "minute"


def correlate(s: DataFrame, least: int = 30, significant: float = SIGNIFICANT, **how) -> DataFrame:
    """The whole correlation analysis: aligned returns, all pairs by blocks, the significant ones with their labels and the kind of alignment."""
    rows, kind = synchronised(s)
    return pair_correlations(rows, "at", "r", least, significant, **{"chunk": 64 * 60_000_000} | how).withColumns({"strength": strength(F.col("correlation")), "alignment": F.lit(kind)})
