"""From line events to the ordered steps of a run.

Every function takes and returns tables keyed by ``run_id``. Order inside a run is the event number ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, is_written, written
from .ordered import SPAN, first_k, islands, scan, value_before_run

RUN = ["run_id"]
CALL = ["run_id", "node"]
DETAIL = 3


def map_lines(lines: DataFrame, stmts: DataFrame) -> DataFrame:
    """Line event -> statement that covers the line; the first one in file order wins on a shared line."""
    covered = stmts.select("run_id", "file", "stmt", "ord", F.explode(F.sequence("line", "last_line")).alias("line"))
    first = covered.groupBy("run_id", "file", "line").agg(F.min_by("stmt", "ord").alias("stmt"))
    return lines.join(first, ["run_id", "file", "line"])


def tag_islands(mapped: DataFrame, span: float = SPAN) -> DataFrame:
    return islands(mapped, RUN, "seq", ["node", "stmt"], "island", span)


def merge_events(tagged: DataFrame) -> DataFrame:
    """Neighbouring events of the same statement in the same call as one event."""
    at_raise = F.when(F.col("raised").isNotNull(), F.col("seq"))
    return tagged.groupBy("run_id", "island", "node", "stmt").agg(
        F.min("seq").alias("seq"),
        F.max("seq").alias("end_seq"),
        F.min_by("t_ms", "seq").alias("t_ms"),
        F.max_by("raised", at_raise).alias("raised"),
    )


def latest_changes(tagged: DataFrame) -> DataFrame:
    """Changes of a merged event: the latest value of each variable."""
    return tagged.groupBy("run_id", "island", "var").agg(F.max_by("value", "seq").alias("value"))


def with_occurrence(merged: DataFrame, span: float = SPAN) -> DataFrame:
    return scan(merged, ["run_id", "node", "stmt"], "seq", row_number="occurrence", span=span)


def _inside(df: DataFrame, closure: DataFrame, inner: str, outer: str, out: str) -> DataFrame:
    """Which block of ``outer`` holds ``inner``, null if none does."""
    c = closure.select(
        F.col("run_id").alias("__r"), F.col("stmt").alias("__s"), F.col("ancestor").alias("__a"), F.col("side").alias(out)
    )
    on = (F.col("run_id") == F.col("__r")) & (F.col(inner) == F.col("__s")) & (F.col(outer) == F.col("__a"))
    return df.join(c, on, "left").drop("__r", "__s", "__a")


def drop_tails(events: DataFrame, closure: DataFrame, span: float = SPAN) -> DataFrame:
    """Drop header events that only mark the end of a block.

    A loop header that is seen again and is not followed by a statement inside the loop; a ``with`` header whose
    last other statement in the call lies inside the block. ``events`` need ``kind`` and ``occurrence``."""
    cols = events.columns
    ahead = _inside(scan(events, CALL, "seq", lead={"__next": "stmt"}, span=span), closure, "__next", "stmt", "__into")
    tail = F.col("kind").isin("for", "while") & (F.col("occurrence") > 1) & F.col("__into").isNull()
    body = value_before_run(ahead.filter(~tail).select(cols), CALL, "seq", "stmt", "__before", span)
    body = _inside(body, closure, "__before", "stmt", "__from")
    return body.filter(~((F.col("kind") == "with") & F.col("__from").isNotNull())).select(cols)


def with_next_time(events: DataFrame, calls: DataFrame, span: float = SPAN) -> DataFrame:
    """End of the time in which an event was current: the next event of the call, or the end of the call."""
    ends = calls.select("run_id", "node", (F.col("t_ms") + F.coalesce("dur_ms", F.lit(0.0))).alias("__end"))
    timed = scan(events, CALL, "seq", lead={"__next_t": "t_ms"}, span=span).join(ends, CALL, "left")
    return timed.withColumn("t_end", F.coalesce("__next_t", "__end")).drop("__next_t", "__end")


def during(events: DataFrame, facts: DataFrame, span_ms: float = 256.0) -> DataFrame:
    """Facts (``fact``, ``t_ms``) of a call that happened while an event (``seq``, ``t_ms``, ``t_end``) was current; both
    ends belong to it, so a fact on a boundary is attached twice.

    Events of a call follow each other in time. A fact therefore belongs to the last event that began before it
    (one ordered scan) and to the events that began at the same instant (one equality join): no pair is tried that is
    not a result."""
    events, facts = written(events), written(facts)
    e = events.select("run_id", "node", "t_ms", F.lit(1).alias("__side"), F.col("seq").alias("__id"), F.struct("seq", "t_end").alias("__ev"))
    f = facts.select("run_id", "node", "t_ms", F.lit(0).alias("__side"), F.col("fact").alias("__id"), F.lit(None).cast(e.schema["__ev"].dataType).alias("__ev"))
    both = scan(e.unionByName(f), CALL, ["t_ms", "__side", "__id"], last={"__cur": "__ev"}, span=span_ms, settled=True)
    before = both.filter((F.col("__side") == 0) & (F.col("__cur.t_end") >= F.col("t_ms"))).select(
        "run_id", "node", F.col("__cur.seq").alias("seq"), F.col("__id").alias("fact")
    )
    lasting = events.filter(F.col("t_end") >= F.col("t_ms"))
    same = lasting.select("run_id", "node", "t_ms", "seq").join(facts.select("run_id", "node", "t_ms", "fact"), ["run_id", "node", "t_ms"])
    return before.unionByName(same.select("run_id", "node", "seq", "fact"))


def call_site(probes: DataFrame, events: DataFrame, ancestry: DataFrame, span: float = SPAN) -> DataFrame:
    """Last event before ``at_seq`` in the nearest ancestor call that has one.

    ``probes(run_id, node, at_seq)``, ``events(run_id, node, seq)``, ``ancestry(run_id, node, ancestor, distance)``."""
    p = probes.join(ancestry, CALL).select(
        "run_id", F.col("ancestor").alias("node"), F.col("at_seq").alias("__o"), F.lit(0).alias("__side"),
        F.col("node").alias("__call"), "distance", F.lit(None).cast("long").alias("__seq"),
    ).distinct()
    e = events.select(
        "run_id", "node", F.col("seq").alias("__o"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__call"),
        F.lit(0).cast("long").alias("distance"), F.col("seq").alias("__seq"),
    )
    found = scan(p.unionByName(e), CALL, ["__o", "__side", "__call"], last={"__site": "__seq"}, span=span)
    hit = found.filter((F.col("__side") == 0) & F.col("__site").isNotNull())
    return hit.groupBy("run_id", F.col("__call").alias("node"), F.col("__o").alias("at_seq")).agg(
        F.min_by("__site", F.col("distance")).alias("site")
    )


def call_rows(events: DataFrame, paths: DataFrame, focused: DataFrame | None = None, span: float = SPAN) -> DataFrame:
    """Rows for calls entered and left between neighbouring events of a run.

    The stacks of the two events are compared: calls beyond the common part are left deepest first, then entered
    outermost first, at the later event; open calls are left behind the last event (``at_seq`` null).
    ``paths(run_id, node, path)``; ``focused(run_id, node)`` limits the rows to these calls."""
    chains = paths.select("run_id", "node", F.transform("path", lambda x: x["node"]).alias("chain"))
    moved = scan(
        events.select("run_id", "seq", "node"), RUN, "seq", lag={"__prev": "node"}, lead={"__next": "seq"}, span=span, settled=is_written(events)
    )
    moved = written(moved)
    now = moved.filter(F.col("__prev").isNotNull() & (F.col("__prev") != F.col("node")))
    now = now.join(chains, CALL).join(
        chains.select("run_id", F.col("node").alias("__prev"), F.col("chain").alias("__was")), ["run_id", "__prev"]
    )
    differs = F.zip_with("__was", "chain", lambda a, b: ~a.eqNullSafe(b))
    common = (F.array_position(differs, True) - 1).cast("int")
    pops = F.reverse(F.slice("__was", common + 1, F.size("__was")))
    pushes = F.slice("chain", common + 1, F.size("chain"))
    first = moved.filter(F.col("__prev").isNull()).join(chains, CALL).filter(F.size("chain") > 1)
    final = moved.filter(F.col("__next").isNull()).join(chains, CALL)

    def rows(df: DataFrame, calls: Column, kind: str, at: Column) -> DataFrame:
        return df.select("run_id", at.alias("at_seq"), F.lit(kind).alias("type"), F.posexplode(calls).alias("ord", "node"))

    out = (
        rows(now, pops, "return", F.col("seq"))
        .unionByName(rows(now, pushes, "enter", F.col("seq")))
        .unionByName(rows(first, F.array("node"), "enter", F.col("seq")))
    )
    # behind the last event; the outermost call is the module itself and has no return row
    ends = rows(final, F.reverse(F.slice("chain", 2, F.size("chain"))), "return", F.lit(None).cast("long"))
    if focused is not None:
        shown = focused.select(*CALL).distinct()
        out = out.join(shown, CALL, "left_semi")
        # the last stack is left up to the first call that is not shown
        barrier = ends.join(shown, CALL, "left_anti").groupBy("run_id").agg(F.min("ord").alias("__barrier"))
        ends = ends.join(barrier, RUN, "left").filter(F.col("__barrier").isNull() | (F.col("ord") < F.col("__barrier"))).drop("__barrier")
    out = out.unionByName(ends)
    return out.select("run_id", "at_seq", "type", F.col("ord").cast("long").alias("ord"), "node")


def branch_taken(events: DataFrame, closure: DataFrame, span: float = SPAN) -> DataFrame:
    """For an if or match: the block of the next statement of the call that lies under it, else ``none``."""
    ahead = _inside(scan(events, CALL, "seq", lead={"__next": "stmt"}, span=span), closure, "__next", "stmt", "__side")
    return ahead.filter(F.col("kind").isin("if", "match")).select(
        "run_id", "node", "seq", "stmt", F.coalesce("__side", F.lit("none")).alias("taken")
    )


def loop_spans(events: DataFrame, closure: DataFrame, stmts: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per loop and call, at its first header: ``start``, ``second`` header, ``stop`` (first later event of the call
    outside the loop, null if none), ``iterations`` (runs of the first line of the body)."""
    heads = events.filter(F.col("kind").isin("for", "while") & (F.col("occurrence") == 1)).select(
        "run_id", "node", F.col("stmt").alias("loop"), F.col("seq").alias("start")
    )
    first_line = (
        stmts.filter("block = 'body'").groupBy("run_id", F.col("parent").alias("loop")).agg(F.min_by("line", "ord").alias("line"))
    )
    iters = first_line.join(counts, ["run_id", "line"]).select("run_id", "node", "loop", F.col("n").alias("iterations"))
    # where a loop is left: an event in it whose next event is not. One row per event and enclosing loop.
    events = written(events)
    nexts = scan(events.select("run_id", "node", "stmt", "seq"), CALL, "seq", lead={"__next": "stmt", "__at": "seq"}, settled=True)
    in_loop = closure.select("run_id", "stmt", F.col("ancestor").alias("loop"))
    loops = heads.select("run_id", "loop").distinct()
    in_loop = in_loop.join(loops, ["run_id", "loop"], "left_semi").unionByName(loops.withColumn("stmt", F.col("loop")))
    inside = nexts.join(in_loop, ["run_id", "stmt"])
    stays = in_loop.select("run_id", F.col("stmt").alias("__next"), "loop")
    left = inside.filter(F.col("__at").isNotNull()).join(stays, ["run_id", "__next", "loop"], "left_anti")
    marks = left.select("run_id", "node", "loop", F.col("__at").alias("out"), F.lit(None).cast("long").alias("head")).unionByName(
        inside.filter(F.col("stmt") == F.col("loop")).select("run_id", "node", "loop", F.lit(None).cast("long").alias("out"), F.col("seq").alias("head"))
    )
    stop = (
        marks.join(heads, ["run_id", "node", "loop"])
        .groupBy("run_id", "node", "loop", "start")
        .agg(
            F.min(F.when(F.col("out") > F.col("start"), F.col("out"))).alias("stop"),
            F.min(F.when(F.col("head") > F.col("start"), F.col("head"))).alias("__second"),
        )
    )
    out = heads.join(stop, ["run_id", "node", "loop", "start"], "left").join(iters, ["run_id", "node", "loop"], "left")
    second = F.when(F.col("stop").isNull() | (F.col("__second") < F.col("stop")), F.col("__second"))
    return out.withColumns({"second": second, "iterations": F.coalesce("iterations", F.lit(0).cast("long"))}).drop("__second")


def first_disjoint(spans: DataFrame, keys: list[str], start: str, stop: str, span: float = SPAN) -> DataFrame:
    """Spans taken from the left: the first one, then each next one that begins at or behind the end of the last taken.

    Each span points to the first span that begins at or behind its end; pointers are doubled, so log2(spans) rounds
    mark all that hang on the first one. A null ``stop`` reaches to the end."""
    spans = written(spans)
    mark = spans.select(*keys, F.col(start).alias("__o"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__id"))
    ask = spans.filter(F.col(stop).isNotNull()).select(*keys, F.col(stop).alias("__o"), F.lit(0).alias("__side"), F.col(start).alias("__id"))
    # next span start at or behind the end: scan from the right, so order by the negative position
    both = ask.unionByName(mark).withColumns({"__neg": -F.col("__o"), "__pos": F.when(F.col("__side") == 1, F.col("__o"))})
    both = both.withColumn("__rank", -F.col("__side"))
    nxt = scan(both, keys, ["__neg", "__rank", "__id"], last={"__to": "__pos"}, span=span, settled=True).filter("__side = 0")
    jump = cut(nxt.select(*keys, F.col("__id").alias("__from"), "__to").filter(F.col("__to").isNotNull()))
    taken = cut(spans.groupBy(*keys).agg(F.min(start).alias("__from")))
    n = taken.count()
    while True:
        more = taken.join(jump, [*keys, "__from"]).select(*keys, F.col("__to").alias("__from"))
        taken = cut(taken.unionByName(more).distinct())
        grown = taken.count()
        if grown == n:
            break
        n = grown
        two = jump.select(*keys, F.col("__from").alias("__to"), F.col("__to").alias("__to2"))
        jump = cut(jump.join(two, [*keys, "__to"]).select(*keys, "__from", F.col("__to2").alias("__to")))
    return spans.join(taken.withColumnRenamed("__from", start), [*keys, start], "left_semi")


def hidden_by_loops(events: DataFrame, spans: DataFrame, span: float = SPAN) -> DataFrame:
    """Events hidden by a collapsed loop: more than three iterations and a second header; the events from that
    header to the end of the loop, whatever call they belong to. Taken spans do not overlap, so one ordered scan
    finds the span an event lies in."""
    events = written(events)
    collapsed = first_disjoint(spans.filter((F.col("iterations") > DETAIL) & F.col("second").isNotNull()), RUN, "start", "stop", span)
    c = collapsed.select(
        "run_id", F.col("second").alias("__o"), F.lit(0).alias("__side"), F.lit(None).cast("long").alias("seq"),
        F.struct(F.col("start").alias("start"), F.col("stop").alias("stop")).alias("__loop"),
    )
    e = events.select(
        "run_id", F.col("seq").alias("__o"), F.lit(1).alias("__side"), "seq", F.lit(None).cast(c.schema["__loop"].dataType).alias("__loop")
    )
    both = scan(written(c).unionByName(e), RUN, ["__o", "__side"], last={"__cur": "__loop"}, span=span, settled=True)
    return both.filter(
        (F.col("__side") == 1) & F.col("__cur").isNotNull() & (F.col("__cur.stop").isNull() | (F.col("seq") < F.col("__cur.stop")))
    ).select("run_id", "seq", F.col("__cur.start").alias("hidden_by"))


def loop_effect(hidden: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest value of each variable over the hidden part of a loop; deleted variables are left out."""
    both = hidden.join(changes, ["run_id", "seq"])
    last = both.groupBy("run_id", "hidden_by", "var").agg(F.max_by(F.struct("value", "deleted"), F.col("seq")).alias("s"))
    return last.filter(~F.col("s.deleted")).select("run_id", "hidden_by", "var", F.col("s.value").alias("value"))


def loop_summaries(spans: DataFrame, hidden: DataFrame, events: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per collapsed loop, to stand behind its first iteration: ``iterations`` that ran, ``detailed`` ones among the steps,
    ``hidden`` steps, and ``changes``, the latest value of each variable that the hidden steps of the loop's own call changed
    and did not delete.

    ``spans`` from ``loop_spans``, ``hidden`` from ``hidden_by_loops``, ``events(run_id, seq, node, stmt)``, ``changes(run_id, seq, var, value,
    deleted)``. A loop has as many changes as its call has variables, so the map is bounded by the source code."""
    heads = spans.select("run_id", F.col("start").alias("hidden_by"), F.col("node").alias("__node"), F.col("loop").alias("__loop"), "second", "stop", "iterations")
    mine = written(hidden.join(events.select("run_id", "seq", "node", "stmt"), ["run_id", "seq"]).join(heads, ["run_id", "hidden_by"]))
    own = F.col("node") == F.col("__node")
    per = mine.groupBy("run_id", "hidden_by").agg(
        F.first("__node").alias("node"), F.first("__loop").alias("stmt"), F.first("iterations").alias("iterations"),
        (F.count_if(own & (F.col("stmt") == F.col("__loop"))) + 1).alias("detailed"), F.count(F.lit(1)).alias("hidden"),
    )
    latest = mine.filter(own).select("run_id", "hidden_by", "seq").join(changes, ["run_id", "seq"])
    latest = latest.groupBy("run_id", "hidden_by", "var").agg(F.max_by(F.struct("value", "deleted"), F.col("seq")).alias("s"))
    latest = latest.filter(~F.col("s.deleted")).groupBy("run_id", "hidden_by").agg(
        F.map_from_entries(F.collect_list(F.struct("var", "s.value"))).alias("changes")
    )
    return per.join(latest, ["run_id", "hidden_by"], "left").withColumnRenamed("hidden_by", "start")


def group_steps(steps: DataFrame, span: float = SPAN) -> DataFrame:
    """Neighbouring simple statements of one group, call and block as one step. A raising step begins a new one.

    The list holds neighbouring statements of one block: it is no longer than the block in the source."""
    alone = F.col("grp").isNull() | F.col("raised").isNotNull()
    tagged = islands(steps, RUN, "seq", ["node", "grp", "parent"], "g", span, breaks=alone)
    grouped = tagged.groupBy("run_id", "g", "node").agg(
        F.min("seq").alias("seq"),
        F.array_sort(F.collect_list(F.struct("seq", "stmt"))).alias("s"),
        F.min_by("line", "seq").alias("first_line"),
        F.max("last_line").alias("last_line"),
    )
    return grouped.select(
        "run_id", "node", "seq", F.when(F.size("s") > 1, "group").otherwise("statement").alias("type"),
        F.transform("s", lambda x: x["stmt"]).alias("stmts"), "first_line", "last_line",
    )


def step_score() -> Column:
    """Weight of a step: what kind of statement it is, whether it calls project code or does I/O, what it changed."""
    # The weights, and which kinds have them
    kind = F.col("kind")
    base = F.greatest(
        F.lit(1),
        F.when(kind.isin("if", "while", "match"), 4).otherwise(1),
        F.when(kind.isin("for", "while", "return"), 3).otherwise(1),
        F.when(F.coalesce(F.col("calls_project"), F.lit(False)), 4).otherwise(1),
        F.when(F.coalesce(F.col("does_io"), F.lit(False)), 4).otherwise(1),
        F.when(F.coalesce(F.col("changes_table"), F.lit(False)), 5)
        .when(F.coalesce(F.col("changes_any"), F.lit(False)), 2)
        .otherwise(1),
    )
    score = F.when(F.col("raised").isNotNull(), 6).otherwise(base)
    return F.when(kind.isin("import", "constant", "pass", "scope"), 1).otherwise(score).cast("long")


def importance(steps: DataFrame) -> DataFrame:
    """Highest score and first place of each statement."""
    return steps.groupBy("run_id", "stmt").agg(F.max(step_score()).alias("score"), F.min("seq").alias("first"))


def top_statements(ranked: DataFrame, n: int = 150) -> DataFrame:
    return first_k(ranked, RUN, [F.desc("score"), "first"], n, "place")


def snapshot_changes(snaps: DataFrame, keys: list[str]) -> DataFrame:
    """Differences between neighbouring snapshots of a call: ``new``, ``changed`` or ``deleted`` variables.

    ``snaps(keys, snap, var, fingerprint)``. One equality join on (call, variable, number of the snapshot)."""
    last = snaps.groupBy(*keys).agg(F.max("snap").alias("__last"))
    old = snaps.select(*keys, (F.col("snap") + 1).alias("snap"), "var", F.col("fingerprint").alias("was"))
    both = snaps.join(old, [*keys, "snap", "var"], "full").join(last, keys)
    kind = (
        F.when(F.col("fingerprint").isNull(), "deleted").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("fingerprint"), "changed")
    )
    return both.filter(F.col("snap") <= F.col("__last")).withColumn("change", kind).filter("change is not null").select(*keys, "snap", "var", "change")
