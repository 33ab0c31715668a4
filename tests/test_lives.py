"""Lives told on a stream equal those of the whole table, whatever the triggers; upserts survive a killed trigger and touch only their buckets."""

import datetime
import os
import random

import pytest

from tickloom.streaming import bars, lives

START = datetime.datetime(2024, 1, 1)
SHAPE = "token_id string, datetime timestamp, seq long, price double"


def rows_of(seed=1):
    rng = random.Random(seed)
    out = []
    for t in range(9):
        at, price = rng.randint(0, 50), 5.0
        for k in range(120):
            at += rng.choice([1, 1, 2, 3, 20 if t % 3 == 0 else 1, 90 if k % 37 == 36 else 1])
            price = price if rng.random() < 0.75 else float(rng.randint(1, 9))
            out.append((f"t{t}", START + datetime.timedelta(minutes=at), k, price))
    return sorted(out, key=lambda r: r[1])


def plain(rows, dead_after, silent):
    out, state = [], {}
    for token, at, _, price in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        n, last_price, run, last = state.get(token, (0, None, 0, None))
        if last is not None and (at - last).total_seconds() > silent:
            out.append((token, "silent", last + datetime.timedelta(seconds=silent), n))
            n, last_price, run = 0, None, 0
        if price != last_price:
            if run >= dead_after:
                out.append((token, "moving", at, n + 1))
            run = 0
        run, n = run + 1, n + 1
        if run == dead_after:
            out.append((token, "flat", at, n))
        state[token] = (n, price, run, at)
    return sorted(out), state


@pytest.mark.parametrize("dead_after,silent", [(5, 1800), (1, 1200), (12, 100_000)])
def test_events_of_a_table(spark, dead_after, silent):
    rows = rows_of()
    got = lives.life_events_of_table(spark.createDataFrame(rows, SHAPE), dead_after, silent)
    assert sorted(map(tuple, got.collect())) == plain(rows, dead_after, silent)[0]


def written(spark, rows, folder, parts):
    for k in range(parts):
        some = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(some, SHAPE).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("parts", [1, 6])
def test_events_of_a_stream(spark, tmp_path, parts):
    rows = rows_of(4)
    written(spark, rows, tmp_path / "in", parts)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lives.STORE)
    try:
        for _ in range(2):  # again from the checkpoint, with rows long after: the timers of all others go off
            stream = bars.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SHAPE).schema)
            lives.life_events(stream, 5, 1800, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
            if not os.path.exists(tmp_path / "late"):
                os.mkdir(tmp_path / "late")
                late = [("z", START + datetime.timedelta(days=30), 0, 1.0)]
                written(spark, late, tmp_path / "in", 1)
                written(spark, [("z", START + datetime.timedelta(days=30, seconds=1), 1, 1.0)], tmp_path / "in", 1)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want, state = plain(rows, 5, 1800)
    ends = [(t, "silent", last + datetime.timedelta(seconds=1800), n) for t, (n, _, _, last) in state.items()]
    assert sorted(map(tuple, spark.read.schema(lives.EVENTS).parquet(str(tmp_path / "out")).collect())) == sorted(want + ends)


def test_upserts(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = [(f"t{k % 40}", START + datetime.timedelta(minutes=k), k, float(rng.randint(1, 99))) for k in range(400)] + [("t3", START + datetime.timedelta(days=1), 900 + k, 7.0) for k in range(5)]
    table = str(tmp_path / "table")
    written(spark, rows[:200], tmp_path / "in", 1)
    written(spark, rows[200:400], tmp_path / "in", 1)
    stream = lambda: bars.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SHAPE).schema)
    publish, calls = lives._publish, []

    def killed(*args):
        calls.append(args[2])
        if len(calls) == 2:
            raise RuntimeError("killed before the manifest")
        publish(*args)

    monkeypatch.setattr(lives, "_publish", killed)
    with pytest.raises(Exception, match="killed"):
        lives.keep_statistics(stream(), table, str(tmp_path / "check"), 8).start().awaitTermination()
    assert lives.manifests(spark, table) == [0] and lives.read_statistics(spark, table).agg({"n": "sum"}).first()[0] == 200
    lives.keep_statistics(stream(), table, str(tmp_path / "check"), 8).start().awaitTermination()
    monkeypatch.setattr(lives, "_publish", publish)

    def want(rows):
        by = {}
        for t, _, _, p in rows:
            by.setdefault(t, []).append(p)
        return {t: (len(p), pytest.approx(sum(p) / len(p))) for t, p in by.items()}

    got = lambda: {r.token_id: (r.n, r.mean) for r in lives.read_statistics(spark, table).collect()}
    assert got() == want(rows[:400]) and lives.manifests(spark, table) == [0, 1]
    before = lives.manifest(spark, table, 1)
    written(spark, rows[400:], tmp_path / "in", 1)
    lives.keep_statistics(stream(), table, str(tmp_path / "check"), 8).start().awaitTermination()
    after = lives.manifest(spark, table, 2)
    assert got() == want(rows) and sum(before[b] != after[b] for b in after) == 1  # one token, one bucket
    lives.upsert(spark.createDataFrame(rows[:50], SHAPE), 2, table, 8)  # an epoch that is published counts once
    assert got() == want(rows)
    lives.clear_old(spark, table, keep=1)
    assert got() == want(rows) and lives.manifests(spark, table) == [2]
    left = {f"{d}/{b}" for d in os.listdir(f"{table}/data") for b in os.listdir(f"{table}/data/{d}") if b.startswith("bucket=")}
    assert left == {"/".join(p.rsplit("/", 2)[-2:]) for p in after.values()}
