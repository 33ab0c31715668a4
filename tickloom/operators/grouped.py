"""Algorithms that are sequential or need linear algebra: one vectorised pass over each token's rows (a token's series fits a task)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.ranges import CELL, cell_of
from tickloom.functions.rolling import KEY, PRICE, TIE, TIME, with_row

#: Rows of a range of a long series.
RANGE = 65_536


_ARROW = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _as_table(token, schema: str, rows) -> pa.Table:
    """A token's rows (a list of tuples, or a tuple of columns) as a table of `token_id string, ` + schema."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = rows if isinstance(rows, tuple) else list(zip(*rows, strict=True)) or [()] * len(names)
    arrays = [pa.array(c, _ARROW[k], from_pandas=True) for c, k in zip(columns, kinds, strict=True)]
    return pa.table([pa.repeat(pa.scalar(token, pa.string()), len(arrays[0])), *arrays], names=[KEY, *names])


def _per_token(s: DataFrame, schema: str, work) -> DataFrame:
    """work(prices as an array in time order) -> a token's rows (see _as_table).

    Spark sorts the rows of each cell of time, so a Python worker gets the prices of a token and nothing else: eight bytes a row."""
    order = F.struct(F.col(TIME).isNull(), F.col(TIME), F.col(TIE).isNull(), F.col(TIE), F.col(PRICE).cast("double").alias("p"))
    at = F.when(F.col(TIME).isNull(), F.lit(1 << 40)).otherwise(cell_of(TIME, CELL))  # rows without a time come last
    cells = s.groupBy(KEY, at.alias("_cell")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["p"]).alias("_p"))

    def run(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, found = [], []
        for b in parts:
            found.append(b.column(b.schema.get_field_index("_cell")).to_numpy())
            lists = b.column(b.schema.get_field_index("_p"))
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())
            whole += np.split(values, ends[:-1])
        whole = np.concatenate([whole[k] for k in np.argsort(np.concatenate(found), kind="stable").tolist()])
        yield from _as_table(key[0].as_py(), schema, work(whole)).to_batches(max_chunksize=100_000)

    return cells.groupBy(KEY).applyInArrow(run, f"{KEY} string, {schema}")


def _returns(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        r = p[1:] / p[:-1]
    r -= 1
    r[~np.isfinite(r)] = 0.0
    return r


def hurst(s: DataFrame, lags: int = 20) -> DataFrame:
    """Slope of the logarithm of the rescaled range, over chunks of log returns of 2 to lags - 1 rows, on that of the chunk's size; null for fewer than 2 * lags rows or returns."""

    def work(p):
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.log(p[1:] / p[:-1])
        r = r[np.isfinite(r)]
        if min(len(p), len(r)) < 2 * lags:
            return [(None,)]
        ranges = []
        for n in range(2, lags):
            chunks = r[: len(r) // n * n].reshape(-1, n)
            sd = chunks.std(1)
            dev = np.cumsum(chunks - chunks.mean(1, keepdims=True), 1)
            if (sd > 0).any():
                ranges.append(((np.ptp(dev, 1))[sd > 0] / sd[sd > 0]).mean())
        if len(ranges) < 2:
            return [(None,)]
        x, y = np.log(np.arange(2, 2 + len(ranges))), np.log(np.maximum(ranges, 1e-300))
        return [(float(np.polyfit(x, y, 1)[0]),)]

    return _per_token(s, "hurst double", work)


def fft_cycles(s: DataFrame, top: int = 5) -> DataFrame:
    """The strongest periods of the returns' power spectrum, with power, share, and whether a peak is over the 90th percentile; spectral entropy."""

    def work(p):
        r = _returns(p)
        if len(r) < 8:
            return []
        n = len(r)
        r -= r.mean()
        power = np.fft.rfft(r)[1:]
        del r  # a long series leaves little room for copies
        power = np.abs(power)
        power *= power
        freq = np.fft.rfftfreq(n)[1:]
        total = power.sum()
        share = power / total if total else power
        entropy = float(-(share[share > 0] * np.log(share[share > 0])).sum() / np.log(len(share))) if len(share) > 1 else 0.0
        limit = np.percentile(power, 90)
        order = np.argsort(-power, kind="stable")[:top]
        return [(k + 1, float(1 / freq[j]), float(power[j]), float(share[j]), bool(power[j] > limit), entropy) for k, j in enumerate(order)]

    return _per_token(s, "rank int, period double, power double, share double, is_peak boolean, entropy double", work)


def welch(s: DataFrame, segment: int = 256) -> DataFrame:
    """Averaged Hann-windowed periodograms of half-overlapping segments: the 15 strongest frequencies and their class of period."""

    def work(p):
        r = _returns(p)
        n = min(segment, len(r))
        if n < 8:
            return []
        w = np.hanning(n)
        parts = [np.abs(np.fft.rfft((r[k : k + n] - r[k : k + n].mean()) * w)) ** 2 for k in range(0, len(r) - n + 1, max(1, n // 2))]
        power, freq = np.mean(parts, 0)[1:], np.fft.rfftfreq(n)[1:]
        kind = lambda t: "high_frequency" if t < 5 else "short_term" if t < 30 else "medium_term" if t < 120 else "long_term"
        return [(k + 1, float(1 / freq[j]), float(power[j]), kind(1 / freq[j])) for k, j in enumerate(np.argsort(-power, kind="stable")[:15])]

    return _per_token(s, "rank int, period double, power double, period_class string", work)


def pacf(s: DataFrame, lags: int = 10) -> DataFrame:
    """Partial autocorrelation of returns by Durbin and Levinson's recursion."""

    def work(p):
        r = _returns(p)
        d = r - r.mean()
        below = (d * d).sum()
        if not below or len(r) <= lags:
            return []
        rho = [float((d[k:] * d[: len(d) - k]).sum() / below) for k in range(lags + 1)]
        phi, out = np.zeros((lags + 1, lags + 1)), []
        for k in range(1, lags + 1):
            above = rho[k] - sum(phi[k - 1, j] * rho[k - j] for j in range(1, k))
            under = 1 - sum(phi[k - 1, j] * rho[j] for j in range(1, k))
            phi[k, k] = above / under if under else 0.0
            for j in range(1, k):
                phi[k, j] = phi[k - 1, j] - phi[k, k] * phi[k - 1, k - j]
            out.append((k, float(phi[k, k])))
        return out

    return _per_token(s, "lag int, pacf double", work)


def entry_exit_nonoverlap(s: DataFrame, entries: tuple[int, ...] = (5, 10, 20), exits: tuple[int, ...] = (5, 10, 20), strategy: str = "momentum", least: float = 0.0) -> DataFrame:
    """Trades that don't overlap, per pair of windows: momentum buys after a rise over the entry window, mean_reversion after a fall, breakout at a new high; each is sold after the exit window."""

    def work(p):
        out = []
        for a in entries:
            for b in exits:
                got, i = [], a
                while i + b < len(p):
                    past = p[i - a : i]
                    move = p[i] / past[0] - 1 if past[0] else 0.0
                    go = move > least if strategy == "momentum" else move < -least if strategy == "mean_reversion" else p[i] > past.max()
                    if go and p[i]:
                        got.append(p[i + b] / p[i] - 1)
                        i += b
                    else:
                        i += 1
                out.append((a, b, len(got), float(np.mean(got)) if got else None))
        return out

    return _per_token(s, "entry_window int, exit_window int, trades int, mean_return double", work)


def matrix_with_bounds(trades: DataFrame) -> DataFrame:
    """Mean over tokens per pair of windows, with a 95 % confidence interval."""
    out = trades.where("trades > 0").groupBy("entry_window", "exit_window").agg(F.count("*").alias("tokens"), F.sum("trades").alias("trades"), F.avg("mean_return").alias("mean_return"), F.stddev_samp("mean_return").alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("tokens")
    return out.withColumns({"low": F.col("mean_return") - half, "high": F.col("mean_return") + half})


def rsi_divergence(s: DataFrame, n: int = 14, last: int = 50) -> DataFrame:
    """Of the last two price peaks in the last 50 rows: price and RSI moving apart is a divergence."""

    def work(p):
        d = np.diff(p, prepend=p[:1])
        gain, loss = (pd.Series(np.maximum(sign * d, 0)).rolling(n).mean().to_numpy() for sign in (1, -1))
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = 100 * gain / (gain + loss)
        start = max(1, len(p) - last)
        peaks = [k for k in range(start, len(p) - 1) if p[k] > p[k - 1] and p[k] >= p[k + 1] and np.isfinite(rsi[k])]
        if len(peaks) < 2:
            return [("none",)]
        a, b = peaks[-2:]
        return [("bearish" if p[b] > p[a] and rsi[b] < rsi[a] else "bullish" if p[b] < p[a] and rsi[b] > rsi[a] else "none",)]

    return _per_token(s, "divergence string", work)


def _peaks(p: np.ndarray, distance: int) -> np.ndarray:
    """Rows of local maxima (the middle of a flat top), of which the higher of two less than `distance` rows apart stays."""
    if not len(p):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    last = np.concatenate([first[1:], [len(p)]]) - 1
    v = p[first]
    top = np.zeros(len(v), bool)
    top[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    at = (first[top] + last[top]) // 2
    # from the highest down: one that stays bars those beside it
    low, high = np.searchsorted(at, at - distance, "right"), np.searchsorted(at, at + distance, "left")
    kept, barred = np.zeros(len(at), bool), np.zeros(len(at), bool)
    for k in np.lexsort((-at, -p[at])):
        if not barred[k]:
            kept[k] = True
            barred[low[k] : high[k]] = True
    return at[kept].astype(np.int64)


def elliott(s: DataFrame, distance: int = 20, least_move: float = 0.05) -> DataFrame:
    """Every run of five neighbouring extremes, at least `distance` rows apart within their kind, whose first move is over least_move of its price: rows and the four moves."""

    def work(p):
        ends = np.sort(np.concatenate([_peaks(p, distance), _peaks(-p, distance)]))
        if len(ends) < 5:
            return []
        moves = np.diff(p[ends])
        at = np.flatnonzero(np.abs(moves[: len(ends) - 4]) > p[ends[: len(ends) - 4]] * least_move)
        return (ends[at], ends[at + 4], *(moves[at + k] for k in range(4)))

    return _per_token(s, "start_row int, end_row int, wave_1 double, wave_2 double, wave_3 double, wave_4 double", work)


def higuchi(s: DataFrame, most: int = 8) -> DataFrame:
    """Higuchi's fractal dimension of the price curve."""

    def work(p):
        n, xs, ys = len(p), [], []
        for k in range(1, most + 1):
            lengths = []
            for m in range(k):
                steps = (n - 1 - m) // k
                if steps > 0:
                    lengths.append(np.abs(np.diff(p[m : m + steps * k + 1 : k])).sum() * (n - 1) / (steps * k * k))
            if lengths and np.mean(lengths) > 0:
                xs.append(np.log(1 / k))
                ys.append(np.log(np.mean(lengths)))
        return [(float(np.polyfit(xs, ys, 1)[0]) if len(xs) > 2 else None,)]

    return _per_token(s, "fractal_dimension double", work)


def rolling_entropy(s: DataFrame, n: int = 60, bins: int = 10) -> DataFrame:
    """Entropy of the histogram of the last n returns, and its share of the largest possible.

    A series is cut into ranges of rows, each with the n rows before it, so a task holds one range."""
    size = max(RANGE, n)
    rows = with_row(s)
    part = F.floor(F.col("rn") / size)
    rows = rows.select(KEY, "rn", F.col(PRICE).cast("double").alias("p"), F.explode(F.when(F.col("rn") % size >= size - n, F.array(part, part + 1)).otherwise(F.array(part))).alias("_part"))
    schema = "row int, entropy double, relative_entropy double"

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.select(["rn", "p"]).sort_by("rn")
        if not table.num_rows:
            return _as_table(key[0].as_py(), schema, [])
        begin = table["rn"][0].as_py()
        row, h, share = work(table["p"].to_numpy())
        own = row + begin >= key[1].as_py() * size
        return _as_table(key[0].as_py(), schema, ((row + begin)[own], h[own], share[own]))

    def work(p):
        r = _returns(p)
        out = [np.zeros(0)]
        for lo in range(0, len(r) - n + 1, 4096):  # so many windows at once
            w = np.lib.stride_tricks.sliding_window_view(r[lo : lo + 4096 + n - 1], n)
            least, most = w.min(1, keepdims=True), w.max(1, keepdims=True)
            flat = most == least
            least, most = np.where(flat, least - 0.5, least), np.where(flat, most + 0.5, most)
            k = np.minimum(((w - least) / (most - least) * bins).astype(np.int64), bins - 1)
            q = np.stack([(k == j).mean(1) for j in range(bins)], 1)
            out.append(-(q * np.log(np.where(q > 0, q, 1))).sum(1))
        h = np.concatenate(out)
        return n + np.arange(len(h)), h, h / np.log(bins)

    return rows.groupBy(KEY, "_part").applyInArrow(run, f"{KEY} string, {schema}")


def paper_trading(s: DataFrame, stake: float = 100.0, trailing: float = 0.2, stop: float = 0.05, fee: float = 0.003, slippage: float = 0.01) -> DataFrame:
    """Buy at the first row, sell when the price falls by `trailing` from its high or by `stop` under the entry, else at the last row."""

    def work(p):
        if len(p) < 2 or not p[0]:
            return []
        entry, top, k = p[0] * (1 + slippage), p[0], 0
        for k in range(1, len(p)):
            top = max(top, p[k])
            if p[k] <= top * (1 - trailing) or p[k] <= entry * (1 - stop):
                break
        out = p[k] * (1 - slippage)
        money = stake * (1 - fee) / entry * out * (1 - fee)
        return [(k, float(entry), float(out), float(money - stake))]

    return _per_token(s, "exit_row int, entry_price double, exit_price double, profit double", work)


def dtw_pairs(s: DataFrame, most: int = 60, band: int = 10) -> DataFrame:
    """Dynamic time warping distance of each two tokens' normalised early prices, within a band. For small sets of tokens: its result is all their pairs."""
    from tickloom.operators.cross import _pairs, lifecycle

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rn")
        x, y = part["x"].to_numpy(float), part["y"].to_numpy(float)
        x, y = ((v - v.mean()) / (v.std() or 1.0) for v in (x, y))
        n = len(x)
        d = np.full((n + 1, n + 1), np.inf)
        d[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(max(1, i - band), min(n, i + band) + 1):
                d[i, j] = abs(x[i - 1] - y[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
        return pd.DataFrame({"token_a": [part["token_a"].iloc[0]], "token_b": [part["token_b"].iloc[0]], "distance": [float(d[n, n])]})

    return _pairs(lifecycle(s).where(F.col("rn") < most), "rn", PRICE).groupBy("token_a", "token_b").applyInPandas(work, "token_a string, token_b string, distance double")
