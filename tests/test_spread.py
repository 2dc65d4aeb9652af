"""One caller's bucket over many tasks against one loop; batches committed once; windowed counts."""

import datetime
import os
import random

import pytest
from test_lifetimes import batches

from veilspark.operators import admission
from veilspark.operators.admission import admit_spread, rate_limit
from veilspark.streaming.stateless import drain_epochs, drain_window_counts, live_window_counts, read_epochs, write_epoch

REQ = "caller string, request_id long, ts_ms long, route string, allowed string"


def exact_loop(rows, limit, window):
    """One bucket per caller in whole units of 1 / window."""
    state, out = {}, {}
    for caller, rid, ts, *_ in sorted(rows, key=lambda r: (r[2], r[1])):
        units, last = state.get(caller, (limit * window, ts))
        if ts > last:
            units, last = min(limit * window, units + (ts - last) * limit), ts
        passed = units >= window
        units -= window if passed else 0
        out[rid] = (passed, 0 if passed else -(-(window - units) // limit), units // window if passed else 0)
        state[caller] = (units, last)
    return out


def some_requests(kind, n=900):
    draw, clock, rows = random.Random(kind), 1_000, []
    pauses = {"busy": [0, 0, 0, 1, 3], "calm": [50, 90, 400], "even": [33, 34], "mixed": [0, 0, 5, 30, 2_000], "burst": [0]}[kind]
    for i in range(n):
        clock += draw.choice(pauses)
        caller = draw.choices(["hot", None, "c1", "c2"], [20, 2, 1, 1])[0]
        rows.append((caller, i, clock, "/v1/redact", "x"))
    draw.shuffle(rows)
    return rows


@pytest.fixture
def many_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["busy", "calm", "even", "mixed", "burst"])
@pytest.mark.parametrize("limit,window", [(3, 100), (7, 1_000)])
def test_spread_equals_one_loop(spark, many_ranges, kind, limit, window):
    rows = some_requests(kind)
    df = spark.createDataFrame(rows, REQ).repartition(4)
    done = admit_spread(df, limit, window)
    assert done.columns == ["caller", "request_id", "ts_ms", "route", "allowed", "retry_after_ms", "remaining"]
    got = {r.request_id: (r.allowed, r.retry_after_ms, r.remaining) for r in done.collect()}
    assert got == exact_loop(rows, limit, window)


def test_a_busy_caller_is_decided_in_one_round(spark, many_ranges, monkeypatch):
    rounds = []
    replay = admission._replay
    monkeypatch.setattr(admission, "_replay", lambda *a: rounds.append(a[2]) or replay(*a))
    rows = some_requests("busy")
    assert admit_spread(spark.createDataFrame(rows, REQ), 3, 100).where("caller = 'hot'").count() > 500
    assert rounds.count(True) <= 2


def test_rate_limit_spread(spark):
    rows = [(c, i, t, r, "x") for i, (c, _, t, r, _) in enumerate(some_requests("mixed", 200))]
    rows += [("hot", 900 + i, 1_000 + i, "/health", "x") for i in range(20)]
    df = spark.createDataFrame(rows, REQ)
    got = {r.request_id: (r.allowed, r.retry_after_ms, r.retry_after_sec) for r in rate_limit(df, 2, 1, spread=True).collect()}
    want = exact_loop([r for r in rows if r[3] != "/health"], 2, 1_000)
    assert {k: v[:2] for k, v in got.items() if k < 900} == {k: v[:2] for k, v in want.items()}
    assert all(got[k] == (True, 0, None) for k in range(900, 920))
    assert all(v[2] == (None if v[0] else max(1, -(-v[1] // 1000))) for v in got.values())


def test_spread_of_nothing_and_refusals(spark):
    df = spark.createDataFrame(some_requests("calm", 3), REQ)
    assert admit_spread(df.limit(0), 3, 100).count() == 0
    for limit, window in ((0, 100), (3, 0)):
        with pytest.raises(ValueError):
            admit_spread(df, limit, window)


EVENTS = "id long, route string, ts timestamp"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_a_batch_that_comes_again_is_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", at(0)), (2, "b", at(1))], EVENTS)
    path = str(tmp_path / "out")
    assert read_epochs(spark, path, EVENTS).count() == 0
    write = write_epoch(path)
    write(df, 0)
    write(df, 0)  # the commit of the batch was lost, so it comes again
    write(df.limit(1), 1)
    os.remove(f"{path}/epoch-1/_SUCCESS")  # killed before its job committed
    assert sorted(r.id for r in read_epochs(spark, path, EVENTS).collect()) == [1, 2]
    write(df, 1)
    assert sorted(r.id for r in read_epochs(spark, path, EVENTS).collect()) == [1, 1, 2, 2]
    stream = batches(spark, [[(1, "a", at(0))], [(2, "b", at(1))], [(3, "c", None)]], EVENTS, str(tmp_path))
    assert sorted(r.id for r in drain_epochs(stream, str(tmp_path / "run")).collect()) == [1, 2, 3]
    # A second run over the same progress finds nothing new and adds nothing.
    assert drain_epochs(stream, str(tmp_path / "run")).count() == 3


def test_window_counts_take_late_rows(spark, tmp_path):
    parts = [
        [(1, "a", at(5)), (2, "a", at(65)), (3, None, at(70))],
        [(4, "a", at(300)), (5, "a", at(310))],
        [(10, "a", at(320))],
        [(6, "a", at(1)), (7, "b", at(2)), (8, "a", None)],  # five hours late, and one without a time
        [(9, "a", at(600))],
    ]
    rows = [r for p in parts for r in p if r[2]]
    want = {}
    for _, route, ts in rows:
        key = (ts.replace(minute=0), route)
        want[key] = want.get(key, 0) + 1
    stream = batches(spark, parts, EVENTS, str(tmp_path))
    got = drain_window_counts(stream, str(tmp_path / "w")).collect()
    assert {(r.window_start, r.route): r.requests for r in got} == want
    # With a watermark closed windows are given once, and the late rows are not in them.
    out = f"{tmp_path}/live"
    query = (
        live_window_counts(stream, "1 hour").writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    closed = {(r.window_start, r.route): r.requests for r in spark.read.parquet(out).collect()}
    assert closed == {k: v - (k == (at(0), "a")) for k, v in want.items() if k[0] < at(480) and k != (at(0), "b")}
