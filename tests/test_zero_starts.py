"""Series that begin at a price of zero, or hold negative prices, against the queries' SQL, to the last bit of what both round to six digits."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

duckdb = pytest.importorskip("duckdb")

from tickloom.operators import acf, cross  # noqa: E402
from tickloom.plans import registry  # noqa: E402

KINDS = ("click", "view")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    begins = {1: [0.0, 0.0, 3.5], 2: [0.0, 8.25], 3: [4.0, 0.0, 0.0, 2.0], 4: [5.0, -2.5, 1.0]}
    rows = []
    for user in range(1, 7):
        values = begins.get(user, [])
        values = [0.0] * 70 if user == 5 else values + [round((k * 37 + user * 11) % 101 / 4 + 0.25, 2) for k in range(80 - len(values))]
        rows += [(k, user, v) for k, v in enumerate(values)]
    rows.sort()
    start = datetime.datetime(2024, 1, 1)
    table = {"event_id": list(range(len(rows))), "ts": [start + datetime.timedelta(seconds=977 * k) for k in range(len(rows))], "user_id": [u for _, u, _ in rows], "event_type": [KINDS[k % 2] for k in range(len(rows))], "value": [v for _, _, v in rows]}
    pq.write_table(pa.table(table | {"ts": pa.array(table["ts"], pa.timestamp("us")), "props": ['{"k": 1}'] * len(rows)}), folder / "events.parquet")
    return str(folder)


NAMES = "drawdown_running price_stats pattern_class drawdown_global optimal_trade universal_timing outlier_winsor momentum_persistence log_returns directional_targets early_features extreme_movements quality_report last_signals order_imbalance lifecycle_segments omega_ulcer liquidity pump_analysis normalised".split()


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_those_of_the_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{odd}/events.parquet'")
    theirs = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    want = theirs.fetchall()
    text = lambda rows: sorted(tuple(repr(x) for x in r) for r in rows)  # noqa: E731  NaN is not null
    assert text(tuple(r) for r in registry.QUERIES[name](spark, odd).select(columns).collect()) == text(want)


def test_last_signals_compare_stochastics_as_the_sql_makes_them(spark, tmp_path):
    """A last price at the top twice over: 100 or a bit more by the order of the operations, which decides between bullish and bearish."""
    rng_rows, k = [], 0
    for user in range(400):
        top = [round(10 + (user * 7919 + j * 104729) % 9973 / 100, 2) for j in range(20)]
        low = round(0.01 + user % 97 / 100, 2)
        values = [*top[:17], *sorted(round(120 + x + user / 100, 2) for x in top[17:])]
        values[9] = low
        rng_rows += [(k + j, user, v) for j, v in enumerate(values)]
        k += len(values)
    start = datetime.datetime(2024, 1, 1)
    table = pa.table({"event_id": [r[0] for r in rng_rows], "ts": pa.array([start + datetime.timedelta(seconds=r[0]) for r in rng_rows], pa.timestamp("us")), "user_id": [r[1] for r in rng_rows], "event_type": ["click"] * len(rng_rows), "value": [r[2] for r in rng_rows]})
    pq.write_table(table, tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = {r[0]: r[1:] for r in con.execute(registry.ORACLES["last_signals"]).fetchall()}
    got = {r.token_id: (r.rsi_signal, r.bb_signal, r.stoch_signal) for r in registry.QUERIES["last_signals"](spark, str(tmp_path)).collect()}
    assert got == want and len({v[2] for v in want.values()}) == 2


def test_early_features_of_a_series_from_zero(spark):
    rows = [("a", datetime.datetime(2024, 1, 1, 0, k), k, p) for k, p in enumerate([0.0, 2.0, 1.0, 4.0])]
    got = acf.features_15(spark.createDataFrame(rows, "token_id string, datetime timestamp, seq long, price double")).first()
    assert got.max_drawdown != got.max_drawdown and got.price_change_ratio_5min == float("inf")


def test_correlation_of_constant_windows_is_nan(spark):
    """It ended the query before."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(t, start + datetime.timedelta(hours=k), k, 5.0 if t == "a" and k < 8 else float(k * k % 7)) for t in "ab" for k in range(12)]
    got = cross.corr_rolling_pairs(spark.createDataFrame(rows, "token_id string, datetime timestamp, seq long, price double"), 60, 4).orderBy("bucket").collect()
    values = [r.correlation for r in got]
    assert values[:3] == [None] * 3 and all(v != v for v in values[3:8]) and values[11] == pytest.approx(1.0)
