"""Streaming operators over several micro-batches equal the batch result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import access, effects
from runlens.session import scratch_path
from runlens.streaming import operators as S
from runlens.streaming.runner import Upserts, append_run, each_batch, file_stream, update_run


def arrivals(spark, batches, schema):
    """One file per batch, taken one by one."""
    path = scratch_path(spark, "arrive")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    return df, file_stream(spark, df.schema, path, files_per_batch=1)


def at(seconds):
    return dt.datetime(2026, 3, 1) + dt.timedelta(seconds=seconds)


def place(spark):
    return scratch_path(spark, "out"), scratch_path(spark, "state")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_running_counts(spark):
    def line(i):
        return (i, f'ip - - "GET /o/{i % 4}/x{i % 3} HTTP" {500 if i % 5 == 0 else 200} 1' if i % 7 else "bad")

    df, live = arrivals(spark, [[line(i) for i in range(b * 20, b * 20 + 20)] for b in range(3)], "line_no long, value string")
    got = update_run(S.running_rates(live), *place(spark), keys=["endpoint"])
    want = access.endpoint_rates(access.parse(df)).drop("first_line")
    assert rows_of(got.select(want.columns)) == rows_of(want)


def test_coalesced_effects(spark):
    schema = "run_id long, seq long, node long, kind string, op string, target string, fn string, handled string, n_rows long, n_bytes long, t_ms double"
    r = random.Random(1)
    rows = [(r.randrange(2), i, i, "file", "write", r.choice("ab"), "f", r.choice([None, "redirected"]), r.choice([None, 3]), None, float(i)) for i in range(60)]
    df, live = arrivals(spark, [rows[:20], rows[20:40], rows[40:]], schema)
    keys = ["run_id", "kind", "op", "target", "fn", "handled"]
    got = update_run(effects.coalesce_io(live), *place(spark), keys=keys)
    want = effects.coalesce_io(df)
    assert rows_of(got.select(want.columns)) == rows_of(want)


def test_first_calls_across_batches(spark):
    r = random.Random(2)
    rows = [(1, 1 if i % 3 else 2, r.choice("fg"), i, at(i)) for i in range(90)]
    df, live = arrivals(spark, [rows[:10], rows[10:11], rows[11:]], "run_id long, parent long, fn string, node long, ts timestamp")
    got = update_run(S.first_calls(live), *place(spark), keys=["run_id", "parent", "fn"]).collect()
    want = {}
    for _, p, f, n, _ in rows:
        nodes, seen = want.get((p, f), ([], 0))
        want[(p, f)] = ((nodes + [n])[:3], seen + 1)
    assert {(x.parent, x.fn): (x.nodes, x.seen) for x in got} == want


def test_idle_keys_are_forgotten(spark):
    """Open calls and counts go when the watermark is an hour past their last event; what is still alive stays."""
    hour = 3600
    schema = "run_id long, thread long, seq long, fn string, is_start boolean, t_ms double, ts timestamp"
    batches = [
        [(1, i, 1, "f", True, 0.0, at(0)) for i in range(40)],  # forty threads that never end their call
        [(1, 99, 2, "f", True, 0.0, at(5 * hour))], [(1, 99, 3, "f", True, 1.0, at(5 * hour + 1))],
        [(1, 0, 4, "f", False, 9.0, at(5 * hour + 2)), (1, 99, 5, "f", False, 9.0, at(5 * hour + 2))],
    ]
    _, live = arrivals(spark, batches, schema)
    out, state = place(spark)
    q = S.paired_calls(live).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append")
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    # the call of thread 0 was dropped before its end came
    assert [(r.thread, r.seq, r.end_seq) for r in spark.read.parquet(out).collect()] == [(99, 3, 5)]
    counts = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(counts) >= 40 and counts[-1] < 10


def test_upserts_read_few_runs(spark):
    path = scratch_path(spark, "upserts")
    table, want = Upserts(spark, path, ["k"]), {}
    for batch in range(21):
        rows = [(k, batch * 10 + k, None if k % 2 else "x") for k in range(batch % 5, 40, 1 + batch % 3)]
        want.update({k: (v, s) for k, v, s in rows})
        df = spark.createDataFrame(rows, "k long, v long, s string")
        table.save(df, batch)
        if batch in (3, 9):
            table.save(df, batch)  # a batch that runs again
    assert {r.k: (r.v, r.s) for r in table.table().collect()} == want
    assert len(table.paths()) <= 3 * 3


@pytest.mark.parametrize("cuts", [[40], [7, 9, 25]])
def test_window_alerts_whatever_the_batches(spark, cuts):
    status = lambda i: 500 if i % (2 if i < 20 else 30) == 0 else 200
    lines = [(i, f'ip - - "GET /p{i % 7}/{i} HTTP" {status(i)} 1' if i != 5 else "bad", at(i * 600)) for i in range(40)]
    parts = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, 40]) if a < b] + [[(99, "bad", at(86_400))]]
    _, live = arrivals(spark, parts, "line_no long, value string, ts timestamp")
    out, state = place(spark)
    each_batch(S.window_rates(live, "1 hour", "10 minutes"), state, S.window_alert_batch(out))
    got = {r.start.hour: (r.subject, r.body) for r in spark.read.parquet(out).collect()}
    assert sorted(got) == [0, 1, 2, 3, 5]
    assert got[0] == ("Error rate 60.0% in the traffic", "/p0/:id: 1 errors\n/p2/:id: 1 errors\n/p4/:id: 1 errors\n/p1/:id: 0 errors\n/p3/:id: 0 errors")
    assert got[5][0] == "Error rate 16.7% in the traffic"


def test_call_stack(spark):
    done = S.match_calls([], [(1, "a", True, 0.0), (2, "b", True, 1.0), (3, "c", True, 2.0), (4, "b", False, 5.0), (5, "x", False, 6.0), (6, "a", False, 9.0), (7, "a", False, 9.5)])
    # c is thrown away with b's end, ends without a call are ignored
    assert done == ([], [(2, 4, "b", 1, 4.0), (1, 6, "a", 0, 9.0)])


def test_call_stack_across_batches(spark):
    r = random.Random(3)
    rows = [(1, i % 2, i, r.choice("fgh"), r.random() < 0.55, float(i), at(i)) for i in range(120)]
    df, live = arrivals(spark, [rows[:30], rows[30:70], rows[70:]], "run_id long, thread long, seq long, fn string, is_start boolean, t_ms double, ts timestamp")
    out = append_run(S.paired_calls(live), *place(spark))
    want = []
    for thread in (0, 1):
        _, done = S.match_calls([], [x[2:6] for x in rows if x[1] == thread])
        want += [(1, thread, *d) for d in done]
    assert sorted(tuple(x) for x in out.collect()) == sorted(want)


def test_call_stacks_share_rows_of_state(spark):
    """Many threads, nulls among their keys: few rows of state, and the calls of each thread as if it were alone."""
    r, big = random.Random(4), 2**60 + 1
    keys = [(run, thread) for run in [*range(2000), big, None] for thread in (0, 1, None)]
    rows = [(run, thread, i * 9000 + j, r.choice("fg"), r.random() < 0.6, float(i), at(i)) for i in range(3) for j, (run, thread) in enumerate(keys)]
    size = len(keys)
    schema = "run_id long, thread long, seq long, fn string, is_start boolean, t_ms double, ts timestamp"
    _, live = arrivals(spark, [rows[:size], rows[size : 2 * size], rows[2 * size :]], schema)
    out, state = place(spark)
    q = S.paired_calls(live).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append")
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    per = {}
    for run, thread, *event, _ in rows:
        per.setdefault((run, thread), []).append(event)
    want = [(*k, *d) for k, events in per.items() for d in S.match_calls([], events)[1]]
    assert sorted(map(repr, map(tuple, spark.read.parquet(out).collect()))) == sorted(map(repr, want))
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= S.STACKS


def test_idle_threads_leave_a_shared_row(spark, monkeypatch):
    """Threads that share a row of state are forgotten one by one, each by its own last event."""
    monkeypatch.setattr(S, "STACKS", 1)
    hour = 3600
    batches = [
        [(1, 0, 1, "f", True, 0.0, at(0)), (1, 1, 2, "f", True, 0.0, at(0))],
        [(1, 1, 3, "g", True, 1.0, at(5 * hour))], [(1, 1, 4, "g", False, 2.0, at(5 * hour + 1))],
        [(1, 0, 5, "f", False, 9.0, at(5 * hour + 2)), (1, 1, 6, "f", False, 9.0, at(5 * hour + 2))],
    ]
    _, live = arrivals(spark, batches, "run_id long, thread long, seq long, fn string, is_start boolean, t_ms double, ts timestamp")
    out = append_run(S.paired_calls(live), *place(spark))
    # the call of thread 0 was dropped before its end came, that of thread 1 was still held
    assert sorted((x.thread, x.seq, x.end_seq) for x in out.collect()) == [(1, 2, 6), (1, 3, 4)]


@pytest.mark.parametrize("again", [False, True])
def test_outbox_is_idempotent(spark, again):
    good = [(i, 'ip - - "GET /a HTTP" 200 1') for i in range(10)]
    bad = [(i, 'ip - - "GET /a HTTP" 500 1') for i in range(10)]
    out = scratch_path(spark, "outbox")
    run = S.alert_batch(out)
    for batch, rows in enumerate([good, bad]):
        df = spark.createDataFrame(rows, "line_no long, value string")
        for _ in range(2 if again else 1):
            run(df, batch)
    assert [r.subject for r in spark.read.parquet(out).collect()] == ["Error rate 100.0% in last night's traffic"]


def test_late_rows_by_the_watermark(spark):
    """A row is late behind the latest time of the batches before, less the delay; nulls and repeated rows stay."""
    big = 2**60 + 1
    batches = [
        [(1, at(0)), (2, at(5000)), (None, at(100)), (big, None)],
        [(3, at(1399)), (4, at(1400)), (4, at(1400)), (None, at(9000)), (5, at(0))],
        [(6, at(5399)), (big, at(5400)), (7, None)],
    ]
    _, live = arrivals(spark, batches, "id long, ts timestamp")
    got = append_run(S.late_rows(live, "ts", "1 hour"), *place(spark))
    want, top = [], None
    for rows in batches:
        mark = None if top is None else top - dt.timedelta(hours=1)
        want += [(i, t, mark is not None and t is not None and t < mark) for i, t in rows]
        top = max(t for t in [top, *(t for _, t in rows)] if t is not None)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert got.filter("late").count() == 3
