"""Windows over very long series in several tasks: a series is cut into ranges of rows, and what crosses a cut is carried over.

Rows are counted by cells of time (a small table, made with partial counts); runs of cells that start within the same `rows` rows make a
range. For frames of bounded reach a range also gets the cells that hold the rows before and after it that its frames look at; for
running totals and exponential means each range is summed up in one row, and these rows are scanned in order. So a series of any length
spreads over as many tasks as it has ranges, and no task has more than a range and its halo. Rows without a time come first, in a cell
of their own. A cell is never cut: choose `cell` (seconds) so that it holds well under `rows` rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.rolling import KEY, TIE, TIME, so_far

ROWS, CELL = 100_000, 3600


def cell_of(time: str, cell: int) -> Column:
    return F.coalesce(F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / cell), F.lit(-(1 << 40)))


def layout(s: DataFrame, before: int, after: int, rows: int, cell: int) -> DataFrame:
    """Per token and cell, the ranges that need it: token, cell, range, and the first and last cell that are the range's own.

    before, after: rows that frames look back and ahead."""
    cells = s.groupBy(F.col(KEY), cell_of(TIME, cell).alias("_cell")).agg(F.count("*").alias("_n"))
    in_order = Window.partitionBy(KEY).orderBy("_cell")
    cells = cells.withColumn("_upto", F.sum("_n").over(in_order)).withColumn("_start", F.col("_upto") - F.col("_n"))
    cells = cells.withColumn("_range", F.dense_rank().over(Window.partitionBy(KEY).orderBy(F.floor(F.col("_start") / rows))))
    cells = cells.withColumns({"_prev": F.coalesce(F.lag("_range").over(in_order), "_range"), "_next": F.coalesce(F.lead("_range").over(in_order), "_range")})
    first, last = F.col("_range"), F.col("_range")
    if after:  # ranges that end less than `after` rows before this cell
        first = F.min("_prev").over(Window.partitionBy(KEY).orderBy("_start").rangeBetween(-after, 0))
    if before:  # ranges that start less than `before` rows after it
        last = F.max("_next").over(Window.partitionBy(KEY).orderBy("_upto").rangeBetween(0, before))
    needed = cells.withColumns({"_first": first, "_last": last}).select(KEY, "_cell", F.explode(F.sequence("_first", "_last")).alias("_range"))
    own = cells.groupBy(KEY, "_range").agg(F.min("_cell").alias("_from"), F.max("_cell").alias("_to"))
    return needed.join(own.withColumnRenamed(KEY, "_token"), F.col(KEY).eqNullSafe(F.col("_token")) & (needed["_range"] == own["_range"])).select(KEY, "_cell", needed["_range"], "_from", "_to")


def in_ranges(s: DataFrame, before: int = 0, after: int = 0, rows: int = ROWS, cell: int = CELL, tasks: int | None = None) -> DataFrame:
    """The rows of each range with its halo. token_id becomes a struct (token, range, first and last own cell), so any operator takes a range for a token.

    tasks: partitions to deal the ranges into, by default as many as Spark's shuffles have."""
    plan = layout(s, before, after, rows, cell).withColumnsRenamed({KEY: "_token", "_cell": "_of"})
    out = s.withColumn("_cell", cell_of(TIME, cell)).join(plan, F.col(KEY).eqNullSafe(F.col("_token")) & (F.col("_cell") == F.col("_of")))
    key = F.struct(F.col(KEY).alias("token"), F.col("_range").alias("part"), F.col("_from").alias("first"), F.col("_to").alias("last"))
    out = out.withColumn(KEY, key).select(*s.columns)
    return out.repartition(tasks, KEY) if tasks else out


def whole_again(s: DataFrame, cell: int = CELL) -> DataFrame:
    """Without the halo rows, and with the tokens as they were."""
    return s.where(cell_of(TIME, cell).between(F.col(KEY)["first"], F.col(KEY)["last"])).withColumn(KEY, F.col(KEY)["token"])


def over_ranges(s: DataFrame, operator: Callable[[DataFrame], DataFrame], before: int, after: int = 0, rows: int = ROWS, cell: int = CELL, tasks: int | None = None) -> DataFrame:
    """operator(s), range by range. The operator keeps token and time, and a row depends on no more than `before` rows before and `after` rows after it."""
    return whole_again(operator(in_ranges(s, before, after, rows, cell, tasks)), cell)


#: Aggregates that go on from range to range: how to sum a range up, and how to add what came before.
_RUNNING: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest), "min": (F.min, F.least),
    "product": (F.product, lambda a, b: F.coalesce(a * b, a, b)), "first": (lambda c: F.first(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)), "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(a, b)),
}
_AGAIN = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "product": F.product, "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True)}


def with_running(s: DataFrame, wanted: dict[str, tuple[str, str]], rows: int = ROWS, cell: int = CELL, tasks: int | None = None) -> DataFrame:
    """Adds running aggregates from the token's start to each row: name -> (sum, count, max, min, product, first or last, column).

    first and last pass over nulls (last is a forward fill)."""
    parts = in_ranges(s, 0, 0, rows, cell, tasks)
    local = parts.withColumns({name: (_product if how == "product" else _RUNNING[how][0])(F.col(column)).over(so_far()) for name, (how, column) in wanted.items()})
    # the last row of each range holds its sums
    ends = local.groupBy(KEY).agg(F.max_by(F.struct(*(F.col(n).alias(f"_{k}") for k, n in enumerate(wanted))), F.struct(TIME, TIE)).alias("_end"))
    before = Window.partitionBy(F.col(KEY)["token"]).orderBy(F.col(KEY)["part"]).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(KEY).alias("_key"), *((_product if how == "product" else _AGAIN[how])(F.col(f"_end._{k}")).over(before).alias(f"_{k}") for k, (how, _) in enumerate(wanted.values())))
    out = local.join(carried, F.col(KEY) == F.col("_key"))
    out = out.withColumns({name: _RUNNING[how][1](F.col(name), F.col(f"_{k}")) for k, (name, (how, _)) in enumerate(wanted.items())})
    return whole_again(out.select(*s.columns, *wanted), cell)


class _product:  # noqa: N801  stands where an aggregate function stands
    """A running product: signs, zeros and logarithms go on by themselves, for no window function multiplies."""

    def __init__(self, column: Column):
        self.column = column

    def over(self, window) -> Column:
        c = self.column.cast("double")
        zeros = F.count_if(c == 0).over(window)
        odd = F.count_if(c < 0).over(window) % 2
        size = F.exp(F.sum(F.when(c != 0, F.log(F.abs(c)))).over(window))
        return F.when(F.count(c).over(window) > 0, F.when(zeros > 0, 0.0).otherwise(F.when(odd == 1, -1.0).otherwise(1.0) * F.coalesce(size, F.lit(1.0))))


def _decay(how: dict) -> float:
    """1 - alpha of pandas' ewm arguments."""
    if "alpha" in how:
        return 1 - how["alpha"]
    return 1 - 2 / (how["span"] + 1)


def _scan(x: np.ndarray, q: float, adjust: bool, state: tuple[float, float]) -> tuple[np.ndarray, tuple[float, float]]:
    """Exponential means of x from a state (weighted sum, weight) on, and the state after it. Nulls add nothing, but let weights decay.

    Without adjust the weight before a value is 1, or less by what the nulls between let it decay, and the value's own is 1 - q."""
    some = ~np.isnan(x)
    if adjust:
        decayed = q ** np.arange(1, len(x) + 1)
        total = pd.Series(np.where(some, x, 0.0)).ewm(alpha=1 - q).sum().to_numpy() + decayed * state[0]
        weight = pd.Series(some.astype(float)).ewm(alpha=1 - q).sum().to_numpy() + decayed * state[1]
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.where(weight > 0, total / weight, np.nan)
        return out, (float(total[-1]), float(weight[-1])) if len(x) else state
    # the mean so far goes in as a value of its own, followed by the nulls that came since
    mean, gap = (state[0], int(round(state[1]))) if state[1] >= 0 else (np.nan, 0)
    lead = np.concatenate([[mean], np.full(gap, np.nan)]) if state[1] >= 0 else np.zeros(0)
    out = pd.Series(np.concatenate([lead, x])).ewm(alpha=1 - q, adjust=False).mean().to_numpy()[len(lead) :]
    at = np.flatnonzero(some)
    if len(at):
        return out, (float(out[at[-1]]), float(len(x) - 1 - at[-1]))
    return out, (state[0], state[1] + len(x)) if state[1] >= 0 else state


def _summary(x: np.ndarray, q: float, adjust: bool) -> tuple[float, float, float, float]:
    """What a range does to a state: with adjust (sum, weight, decay, -); without, (nulls at its start or -1 if it has no value, first value, factor and addend of the mean after the first value up to the end)."""
    some = np.flatnonzero(~np.isnan(x))
    if adjust:
        _, (total, weight) = _scan(x, q, True, (0.0, 0.0))
        return total, weight, q ** len(x), 0.0
    if not len(some):
        return -1.0, float(len(x)), 1.0, 0.0
    # the mean is an affine function of the mean after the first value
    own = x[some[0] :].copy()
    own[0] = 0.0
    zero = pd.Series(own).ewm(alpha=1 - q, adjust=False).mean().to_numpy()
    gaps = np.diff(some)
    factor = float(np.prod(q**gaps / (q**gaps + (1 - q)))) if len(gaps) else 1.0
    return float(some[0]), float(x[some[0]]), factor, float(zero[some[-1] - some[0]])


def _carried(state: tuple[float, float], mark: tuple[float, float, float, float], size: int, trailing: int, q: float, adjust: bool) -> tuple[float, float]:
    if adjust:
        return mark[0] + mark[2] * state[0], mark[1] + mark[2] * state[1]
    lead, first, factor, addend = mark
    if lead < 0:
        return state if state[1] < 0 else (state[0], state[1] + size)
    if state[1] >= 0:
        w = q ** (state[1] + lead + 1)
        first = (w * state[0] + (1 - q) * first) / (w + 1 - q)
    return factor * first + addend, float(trailing)


def with_ewm_ranges(s: DataFrame, wanted: dict[str, tuple[str, dict]], rows: int = ROWS, cell: int = CELL, tasks: int | None = None) -> DataFrame:
    """Adds exponential means over whole series: name -> (source column, pandas ewm arguments span or alpha, and adjust). A name may be a later one's source.

    Each range is summed up in one row, these rows are scanned token by token, and each range starts from the state that it inherits."""
    out, left = s, dict(wanted)
    while left:
        now = {n: w for n, w in left.items() if w[0] not in left}
        out = _ewm_level(out, now, rows, cell, tasks)
        left = {n: w for n, w in left.items() if n not in now}
    return out


def _ewm_level(s: DataFrame, wanted: dict[str, tuple[str, dict]], rows: int, cell: int, tasks: int | None) -> DataFrame:
    how = [(source, _decay(h), h.get("adjust", True)) for source, h in wanted.values()]
    base = in_ranges(s, 0, 0, rows, cell, tasks).withColumns({"_token": F.coalesce(F.col(KEY)["token"].cast("string"), F.lit("\0")), "_part": F.col(KEY)["part"].cast("int")})
    base = base.withColumn("_row", F.row_number().over(Window.partitionBy("_token", "_part").orderBy(TIME, TIE)))
    light = base.select("_token", "_part", "_row", *(F.col(c).cast("double").alias(f"_x{k}") for k, (c, _, _) in enumerate(how)))

    def values(part: pd.DataFrame) -> list[np.ndarray]:
        return [part[f"_x{k}"].to_numpy(float) for k in range(len(how))]

    def sum_up(part: pd.DataFrame) -> pd.DataFrame:
        each = values(part.sort_values("_row"))
        trailing = [len(x) - 1 - int(np.flatnonzero(~np.isnan(x))[-1]) if (~np.isnan(x)).any() else 0 for x in each]
        marks = [list(_summary(x, q, adjust)) for x, (_, q, adjust) in zip(each, how, strict=True)]
        return pd.DataFrame({"_token": part["_token"].iloc[:1].to_list(), "_part": part["_part"].iloc[:1].to_list(), "size": [len(part)], "trailing": [trailing], "marks": [marks]})

    def scan(ends: pd.DataFrame) -> pd.DataFrame:
        ends = ends.sort_values("_part")
        states, found = [(0.0, 0.0) if adjust else (0.0, -1.0) for _, _, adjust in how], []
        for size, trailing, each in zip(ends["size"], ends["trailing"], ends["marks"], strict=True):
            found.append([list(x) for x in states])
            states = [_carried(st, tuple(m), size, t, q, adjust) for st, m, t, (_, q, adjust) in zip(states, each, trailing, how, strict=True)]
        return pd.DataFrame({"_token": ends["_token"], "_part": ends["_part"], "states": found})

    def means(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_row")
        states = part["states"].iloc[0]
        found = {name: _scan(x, q, adjust, tuple(st))[0] for name, x, (_, q, adjust), st in zip(wanted, values(part), how, states, strict=True)}
        return pd.DataFrame({"_token": part["_token"], "_part": part["_part"], "_row": part["_row"], **found})

    range_of = "_token string, _part int"
    ends = light.groupBy("_token", "_part").applyInPandas(sum_up, f"{range_of}, size bigint, trailing array<bigint>, marks array<array<double>>")
    states = ends.groupBy("_token").applyInPandas(scan, f"{range_of}, states array<array<double>>")
    found = light.join(states, ["_token", "_part"]).groupBy("_token", "_part").applyInPandas(means, f"{range_of}, _row int, " + ", ".join(f"`{n}` double" for n in wanted))
    return base.join(found, ["_token", "_part", "_row"]).withColumn(KEY, F.col(KEY)["token"]).select(*s.columns, *wanted)
