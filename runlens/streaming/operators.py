"""Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, IntegralType, StringType, StructField, StructType

from ..functions.numbers import exact_mean, half_even
from ..functions.text import endpoint, is_log_line, log_fields, percent
from ..operators.access import ALERT_RATE, alert, endpoint_rates, parse
from ..operators.ordered import first_k

DETAIL = 3


def running_rates(lines: DataFrame) -> DataFrame:
    """Endpoint counters that grow with the stream (update mode)."""
    return endpoint_rates(parse(lines)).drop("first_line")


def daily_windows(readings: DataFrame, delay: str) -> DataFrame:
    """Daily summary per station as a one-day window, given out when the watermark has passed its end."""
    w = F.window("timestamp", "1 day")
    out = readings.withWatermark("timestamp", delay).groupBy("station_id", w).agg(
        F.min("temp").alias("min"), F.max("temp").alias("max"), half_even(exact_mean(F.col("temp")), 2).alias("mean"), F.count("temp").alias("count")
    )
    return out.select("station_id", F.to_date("window.start").alias("day"), "min", "max", "mean", "count")


def drop_repeats(readings: DataFrame, delay: str) -> DataFrame:
    """The first arrival of a reading stays; state is kept for the watermark only."""
    return readings.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["station_id", "timestamp"])


def match_calls(stack: list[tuple[int, str, float]], events) -> tuple[list[tuple], list[tuple]]:
    """Feed ordered ``(seq, fn, is_start, t_ms)`` to a stack of open calls: an end closes the latest open call of its
    function; calls above it are thrown away, and an end without a call is ignored."""
    done = []
    for seq, fn, is_start, t in events:
        if is_start:
            stack.append((seq, fn, t))
        elif any(f == fn for _, f, _ in stack):
            while stack[-1][1] != fn:
                stack.pop()
            begin, _, t0 = stack.pop()
            done.append((begin, seq, fn, len(stack), t - t0))
    return stack, done


CALLS = "run_id long, thread long, seq long, end_seq long, fn string, depth long, dur_ms double"


#: rows of state that the open calls of all threads are spread over
STACKS = 4096


def paired_calls(events: DataFrame, delay: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Starts and ends of calls per (run, thread) as finished calls with depth and inclusive time.

    ``events(run_id, thread, seq, fn, is_start, t_ms, ts)``. The open calls of a thread are dropped when the watermark (``delay`` behind
    the latest ``ts``) is ``idle_ms`` past its last event, so a thread that never ends its calls doesn't stay for ever. A micro-batch is
    bounded by the trigger, and so is what is sorted for a thread.

    A row of state holds the threads that share a hash, so a micro-batch costs by its rows and not by its threads, which may be as many.
    Whole numbers travel as texts, since beside nulls they would become doubles."""
    keyed_state(events.sparkSession)
    whole = ["run_id", "thread", "seq", "end_seq"]
    sent = StructType([StructField(f.name, StringType()) if f.name in whole else f for f in StructType.fromDDL(CALLS)])

    def keep(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs, threads, latest, *calls = state.get if state.exists else ([], [], [], [], [], [])
        held = {(r, t): (at, [*zip(*c)]) for r, t, at, *c in zip(runs, threads, latest, *calls)}
        arrived = {}
        for batch in batches:  # none for a row whose time is over
            for run, thread, *event, ms in zip(*(batch[c].tolist() for c in ("run_id", "thread", "seq", "fn", "is_start", "t_ms", "ms"))):
                new = arrived.setdefault((run, thread), ([], []))
                new[0].append(event)
                new[1].append(ms)
        finished = []
        for thread, (new, times) in arrived.items():
            at, stack = held.get(thread, (0, []))
            new.sort(key=lambda e: (e[0] is None, int(e[0] or 0)))
            stack, done = match_calls(stack, new)
            # an older event doesn't make a thread older
            held[thread] = (max([at, *(int(ms) for ms in times if ms == ms)]), stack)
            finished += [(*thread, *d) for d in done]
        mark = state.getCurrentWatermarkMs()
        held = {thread: x for thread, x in held.items() if x[0] + idle_ms >= mark}
        if held:
            open_calls = [[*map(list, zip(*stack))] or [[], [], []] for _, stack in held.values()]
            state.update((*map(list, zip(*held)), [at for at, _ in held.values()], *map(list, zip(*open_calls))))
            state.setTimeoutTimestamp(min(at for at, _ in held.values()) + idle_ms)
        elif state.exists:
            state.remove()
        if finished:
            yield pd.DataFrame(finished, columns=sent.names)

    texts = [F.col(c).cast("string").alias(c) for c in ("run_id", "thread", "seq")]
    wanted = events.select(*texts, "fn", "is_start", "t_ms", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).withWatermark("ts", delay)
    share = F.pmod(F.xxhash64("run_id", "thread"), F.lit(STACKS)).alias("share")
    found = wanted.withColumn("share", share).groupBy("share").applyInPandasWithState(
        keep, sent,
        "runs array<string>, threads array<string>, latest array<long>, seqs array<array<string>>, fns array<array<string>>, starts array<array<double>>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
    return found.withColumns({c: F.col(c).cast("long") for c in whole})


FIRST = "run_id long, parent long, fn string, nodes array<long>, seen long"


#: neighbouring parents whose calls share a row of state
PARENTS = 16


def first_calls(calls: DataFrame, delay: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """The first three calls per (run, parent, function), by arrival and then by node, and the number seen: the current
    row of each key that a micro-batch brings something for (update mode). ``calls(run_id, parent, fn, node, ts)``.

    A row of state holds a few numbers for each function called by ``PARENTS`` neighbouring calls, however often: it is as long
    as the program has functions. It is forgotten when the watermark is ``idle_ms`` past its last call."""
    keys, columns = ["parent", "fn"], ["parent", "fn", "nodes", "seen"]

    def keep(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *held, latest = state.get if state.exists else ([], [], [], [], 0)
        known = {(p, f): (n, s) for p, f, n, s in zip(*held)}
        parts = []
        for batch in batches:
            latest = max(latest, int(batch["ts"].max().value // 1_000_000))
            batch = batch.sort_values("node")
            per = batch.groupby(keys, sort=False)["node"]
            few = batch[per.cumcount() < DETAIL].groupby(keys, sort=False)["node"].agg(list)
            parts.append(pd.DataFrame({"nodes": few, "n": per.size()}).reset_index())
        changed = {}
        for parent, fn, nodes, n in pd.concat(parts).itertuples(index=False, name=None):
            now, more = changed.get((parent, fn), ([], 0))
            changed[(parent, fn)] = (sorted([*now, *nodes])[:DETAIL], more + n)
        for k, (nodes, n) in changed.items():
            before, seen = known.get(k, ([], 0))
            known[k] = changed[k] = ([*before, *nodes][:DETAIL], seen + n)
        rows = [(*k, *v) for k, v in known.items()]
        state.update((*map(list, zip(*rows)), latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        out = pd.DataFrame([(*k, *v) for k, v in changed.items()], columns=columns)
        out.insert(0, "run_id", key[0])
        yield out

    wanted = calls.select("run_id", "parent", "fn", "node", "ts").withWatermark("ts", delay)
    return wanted.withColumn("block", F.floor(F.col("parent") / PARENTS)).groupBy("run_id", "block").applyInPandasWithState(
        keep, FIRST, "parents array<long>, fns array<string>, nodes array<array<long>>, seen array<long>, latest long", "update",
        GroupStateTimeout.EventTimeTimeout,
    )


def keyed_state(spark: SparkSession) -> None:
    """State with timers needs the store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def window_rates(lines: DataFrame, every: str, delay: str) -> DataFrame:
    """Counters of each endpoint and event-time window, given out once, when the watermark has passed the end of the window.
    ``lines(ts, line_no, value)``."""
    asked = lines.withWatermark("ts", delay).filter(is_log_line(F.col("value")))
    fields = {n: c for n, c in log_fields(F.col("value")).items() if n in ("path", "status")}
    named = asked.select("ts", "line_no", *[c.alias(n) for n, c in fields.items()])
    out = named.groupBy(F.window("ts", every).alias("w"), endpoint(F.col("path")).alias("endpoint")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), F.min("line_no").alias("first_line")
    )
    return out.select(F.col("w.start").alias("start"), "endpoint", "requests", "errors", "first_line")


def window_alerts(rates: DataFrame, threshold: float = ALERT_RATE, k: int = 5) -> DataFrame:
    """One outbox row per window whose error rate is above the threshold: ``start, subject, body`` with its ``k`` worst endpoints."""
    total = rates.groupBy("start").agg(F.sum("requests").alias("r"), F.sum("errors").alias("e")).filter(F.col("e") / F.col("r") > threshold)
    bad = first_k(rates, ["start"], [F.desc("errors"), F.desc("requests"), "first_line"], k, "place")
    lines = bad.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("place", "endpoint", "errors"))).alias("w"))
    body = F.array_join(F.transform("w", lambda x: F.concat(x["endpoint"], F.lit(": "), x["errors"], F.lit(" errors"))), "\n")
    subject = F.concat(F.lit("Error rate "), percent(half_even(F.col("e") / F.col("r"), 3)), F.lit(" in the traffic"))
    return total.join(lines, "start").select("start", subject.alias("subject"), body.alias("body"))


def window_alert_batch(out: str, threshold: float = ALERT_RATE):
    """Batch function over closed windows: a window comes whole, in one batch, so it is judged once, however the lines arrived."""

    def run(df: DataFrame, batch: int) -> None:
        window_alerts(df, threshold).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return run


def alert_batch(out: str, threshold: float = ALERT_RATE):
    """Batch function: one outbox row when the error rate of the batch is too high. A batch that runs again overwrites
    its own row."""

    def run(df: DataFrame, batch: int) -> None:
        alert(endpoint_rates(parse(df)), threshold).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return run


#: rows are only spread by it, no state is kept
SPREAD = 64


def late_rows(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """Each row of a stream with ``late``: whether ``time`` is behind the stream's watermark, which is ``delay`` behind the latest
    time of the micro-batches before. Nothing is dropped, and a row without a time isn't late.

    The watermark is Spark's own, so it survives a restart with the checkpoint; the operator keeps no state. Whole numbers
    travel as texts, since beside nulls they would become doubles."""
    whole = [f.name for f in rows.schema if isinstance(f.dataType, IntegralType)]
    sent = rows.withColumns({c: F.col(c).cast("string") for c in whole}).withColumns(
        {"__time": F.col(time).cast("timestamp"), "__spread": F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD))}
    )
    sent = sent.withColumn("__micros", F.unix_micros("__time")).withWatermark("__time", delay)
    out = StructType([*(sent.schema[c] for c in rows.columns), StructField("late", BooleanType())])

    def flag(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        for batch in batches:
            yield batch[rows_columns].assign(late=(batch["__micros"] < mark).to_numpy())

    rows_columns = list(rows.columns)
    flagged = sent.groupBy("__spread").applyInPandasWithState(flag, out, "seen long", "append", GroupStateTimeout.NoTimeout)
    return flagged.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in rows.schema if f.name in whole})
