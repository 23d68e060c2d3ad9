"""The ten detectors. Each reads a TraceContext and returns finding rows for every trace at once.

`limit` is the number of rows per trace (None: all of them). Thresholds are milliseconds or counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import any_glob, as_key, from_key, glob, int_div, lng, ms_text, ns, tenths_text, to_ms
from ..functions.ordered import counted_values, top_k, values_at_ranks
from ..session import settle
from .context import TraceContext
from .intervals import intersect_intervals, islands

LIMIT = 20
RUNNABLE = ["R", "R+"]
BUSY_STATES = ["Running", "R", "R+", "D", "DK"]
UNNAMED_STALL = "uninstrumented work on the main thread"
_NUMBERS = ["self_ms", "total_ms", "max_ms", "covered_ms"]


def _finding(df: DataFrame, detector: str, rank_by: str, limit: int | None,
             ascending: bool = False,
             identity: Sequence[str] | None = None) -> DataFrame:
    """The finding contract: all columns, top rows per trace, ties by location and detail.

    `identity` maps the columns which tell one row of the detector from another to their values.
    """
    cols = [F.lit(detector).alias("detector")]
    for name in ["location", "count", *_NUMBERS, "detail", "extra"]:
        kind = {"location": "string", "detail": "string", "count": "long",
                "extra": "map<string,string>"}.get(name, "double")
        c = F.col(name) if name in df.columns else F.lit(None)
        cols.append(c.cast(kind).alias(name))
    names = identity or IDENTITY.get(detector, ("location",))
    named = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
    rank = F.col(rank_by).asc_nulls_last() if ascending else F.col(rank_by).desc_nulls_last()
    best = top_k(df, ["trace_id"], [rank, F.col("location"), F.col("detail")], limit)
    return best.select("trace_id", *cols, named.alias("identity"))


def _folds() -> list[Column]:
    return [F.sum("n").alias("count"), F.sum("dur_sum").alias("_sum"), F.max("dur_max").alias("_max")]


def _totals() -> dict[str, Column]:
    return {"total_ms": to_ms("_sum"), "max_ms": to_ms("_max")}


def main_thread_block(ctx: TraceContext, *, min_slice_ms: float = 16,
                      limit: int | None = LIMIT) -> DataFrame:
    """Self time on the main thread by name: own duration less that of the direct children.

    The child sum is over all spans of the trace, unclipped; an open child counts 0.
    """
    main = F.col("is_main_thread")
    parents = ctx.slice_win.where(main).select("trace_id", "slice_id", "name", "thread_name")
    # Only the sum per name is wanted, so children meet their parent's name and no sum per parent is made.
    children = (
        ctx.tables.slice.where(F.col("parent_id").isNotNull() & (F.col("dur") > 0))
        .select("trace_id", F.col("parent_id").alias("slice_id"), "dur")
        .join(parents, ["trace_id", "slice_id"])
        .groupBy("trace_id", as_key("name").alias("_name"), as_key("thread_name").alias("_thread"))
        .agg(F.sum("dur").alias("child_ns"))
    )
    own = (
        ctx.span_folds.where(main)
        .groupBy("trace_id", as_key("name").alias("_name"), as_key("thread_name").alias("_thread")).agg(*_folds())
        .join(children, ["trace_id", "_name", "_thread"], "left")
        .withColumn("_self", F.col("_sum") - F.coalesce("child_ns", lng(0)))
    )
    rows = (
        own.where(F.col("_self") >= lng(ns(min_slice_ms)))
        .withColumns({"location": from_key("_name"), "detail": from_key("_thread"),
                      "self_ms": to_ms("_self"), **_totals()})
    )
    return _finding(rows, "main_thread_block", "self_ms", limit)


def main_thread_outlier(ctx: TraceContext, *, factor: float = 4, min_abs_ms: float = 40,
                        min_occurrences: int = 5, limit: int | None = LIMIT) -> DataFrame:
    """Occurrences far above the lower median of their own name on the main thread."""
    seen = ctx.slice_win.where(F.col("is_main_thread") & (F.col("dur") > 0)).select(
        "trace_id", "name", "dur")
    # Equal durations are folded once; the baseline and the outliers both read that.
    folded = settle(counted_values(seen, ["trace_id", "name"], "dur"))
    median = values_at_ranks(folded, ["trace_id", "name"], "dur",
                             {"median_ns": int_div(F.col("n") + 1, lng(2))})
    median = median.where(F.col("n") >= min_occurrences)
    far = (
        folded.join(median, ["trace_id", "name"])
        .where((F.col("dur") >= F.col("median_ns") * F.lit(factor))
               & (F.col("dur") >= lng(ns(min_abs_ms))))
    )
    worst = int_div(F.col("_max") * 20 + F.col("median_ns"), F.col("median_ns") * 2)
    rows = (
        far.groupBy("trace_id", F.col("name").alias("location"), "n", "median_ns")
        .agg(F.sum("cnt").alias("count"), F.sum(F.col("dur") * F.col("cnt")).alias("_sum"),
             F.max("dur").alias("_max"))
        .withColumns({**_totals(), "detail": F.concat(
            F.lit("median "), ms_text("median_ns"), F.lit(" ms of "), F.col("n").cast("string"),
            F.lit(" · worst "), tenths_text(worst), F.lit("×"))})
    )
    return _finding(rows, "main_thread_outlier", "max_ms", limit)


def gc_pressure(ctx: TraceContext, *, max_events: int = 15, max_total_ms: float = 120,
                name_glob: str = "*GC", name_glob_alt: str = "waitWhileAllocating*",
                limit: int | None = LIMIT) -> DataFrame:
    """Collector cycles and allocation waits by name and thread."""
    rows = (
        ctx.span_folds.where(any_glob("name", [name_glob, name_glob_alt]))
        .groupBy("trace_id", F.col("name").alias("location"), F.col("thread_name").alias("detail"))
        .agg(*_folds())
        .where((F.col("count") >= max_events) | (F.col("_sum") >= lng(ns(max_total_ms))))
        .withColumns(_totals())
    )
    return _finding(rows, "gc_pressure", "total_ms", limit)


def monitor_contention(ctx: TraceContext, *, min_block_ms: float = 8, max_total_ms: float = 50,
                       name_glob: str = "Lock contention on a monitor lock*",
                       name_glob_alt: str = "monitor contention with owner*",
                       limit: int | None = LIMIT) -> DataFrame:
    """Monitor waits by the thread which waited; the longest one names the owner."""
    rows = (
        ctx.span_folds.where(any_glob("name", [name_glob, name_glob_alt]))
        .groupBy("trace_id", F.col("thread_name").alias("location"))
        .agg(*_folds(), F.max_by("name", "longest").alias("detail"))
        .where((F.col("_max") >= lng(ns(min_block_ms))) | (F.col("_sum") >= lng(ns(max_total_ms))))
        .withColumns(_totals())
    )
    return _finding(rows, "monitor_contention", "total_ms", limit)


def binder_txn(ctx: TraceContext, *, min_txn_ms: float = 10, max_total_ms: float = 50,
               name_glob: str = "binder transaction*", skip_glob: str = "*async*",
               limit: int | None = LIMIT) -> DataFrame:
    """Synchronous calls into other processes by thread."""
    rows = (
        ctx.span_folds.where(glob("name", name_glob) & ~glob("name", skip_glob))
        .groupBy("trace_id", F.col("thread_name").alias("location"), "is_main_thread")
        .agg(*_folds())
        .where((F.col("_max") >= lng(ns(min_txn_ms))) | (F.col("_sum") >= lng(ns(max_total_ms))))
        .withColumns({**_totals(), "detail": F.when(
            F.col("is_main_thread"), F.lit("main thread")).otherwise(F.lit("background"))})
    )
    return _finding(rows, "binder_txn", "total_ms", limit)


def runnable_starvation(ctx: TraceContext, *, min_runnable_ms: float = 20,
                        limit: int | None = LIMIT) -> DataFrame:
    """Time ready to run without a CPU, by thread and state, inside the window."""
    rows = (
        ctx.state_folds.where(F.col("state").isin(RUNNABLE))
        .groupBy("trace_id", F.col("thread_name").alias("location"), "state")
        .agg(*_folds())
        .where(F.col("_sum") >= lng(ns(min_runnable_ms)))
        .withColumns({**_totals(), "detail": F.concat(F.lit("state "), F.col("state"))})
    )
    return _finding(rows, "runnable_starvation", "total_ms", limit)


def cpu_in_spans(ctx: TraceContext) -> DataFrame:
    """Per thread, on-CPU time inside top-level spans: `trace_id, utid, shared_ns`."""
    running = ctx.tstate_win.where(F.col("state") == "Running").select(
        "trace_id", "utid", "ts", "dur")
    top = ctx.slice_win.where((F.col("depth") == 0) & (F.col("dur_win") > 0)).select(
        "trace_id", "utid", F.col("ts_win").alias("ts"), F.col("dur_win").alias("dur"))
    return intersect_intervals(running, top, ["trace_id", "utid"])


def uninstrumented_cpu(ctx: TraceContext, *, min_running_ms: float = 50,
                       max_covered_pct: float = 50, limit: int | None = LIMIT) -> DataFrame:
    """Threads which burn CPU mostly outside any span."""
    running = (
        ctx.state_folds.where(F.col("state") == "Running")
        .select("trace_id", "utid", "thread_name", F.col("dur_sum").alias("running_ns"))
        .where(F.col("running_ns") >= lng(ns(min_running_ms)))
    )
    counted = ctx.span_folds.groupBy("trace_id", "utid").agg(F.sum("n").alias("_slices"))
    covered = F.coalesce("shared_ns", lng(0))
    rows = (
        running.join(cpu_in_spans(ctx), ["trace_id", "utid"], "left")
        .join(counted, ["trace_id", "utid"], "left")
        .where(covered < F.col("running_ns") * F.lit(max_covered_pct) / F.lit(100.0))
        .withColumns({
            "location": F.col("thread_name"), "count": F.coalesce("_slices", lng(0)),
            "total_ms": to_ms("running_ns"), "covered_ms": to_ms(covered),
            "detail": F.concat(
                int_div((F.col("running_ns") - covered) * 200 + F.col("running_ns"),
                        F.col("running_ns") * 2).cast("string"),
                F.lit(".0% of CPU outside slices"))})
    )
    return _finding(rows, "uninstrumented_cpu", "total_ms", limit)


def frame_jank(ctx: TraceContext, *, min_frames: int = 3, min_overrun_ms: float = 4,
               limit: int | None = LIMIT) -> DataFrame:
    """Frames past their deadline by kind. total/max are overruns, not durations.

    The denominator counts all app frames of the window, also those without a deadline.
    """
    mine = (
        ctx.tables.actual_frame.where(F.col("surface_frame_token").isNotNull() & (F.col("dur") > 0))
        .join(ctx.chosen.select("trace_id", "upid", "ts_start", "ts_end"), ["trace_id", "upid"])
        .where((F.col("ts") < F.col("ts_end"))
               & (F.col("ts") + F.col("dur") > F.col("ts_start")))
        .select("trace_id", "upid", "surface_frame_token", "dur", "jank_type", "jank_tag")
    )
    due = ctx.tables.expected_frame.select(
        "trace_id", "upid", "surface_frame_token", F.col("dur").alias("due_ns"))
    frames = mine.join(due, ["trace_id", "upid", "surface_frame_token"], "left").withColumn(
        "over_ns", F.col("dur") - F.col("due_ns"))
    late = (F.col("jank_tag") != "No Jank") & (F.col("over_ns") >= lng(ns(min_overrun_ms)))
    # One pass: all frames of a kind and the late ones, then the denominator from the kinds.
    kinds = frames.groupBy("trace_id", "jank_type", "jank_tag").agg(
        F.count(F.lit(1)).alias("_frames"), F.count_if(late).alias("count"),
        F.sum(F.when(late, F.col("over_ns"))).alias("_sum"),
        F.max(F.when(late, F.col("over_ns"))).alias("_max"),
        F.max(F.when(late, F.col("dur"))).alias("_longest"))
    total = kinds.groupBy("trace_id").agg(F.sum("_frames").alias("_all"))
    rows = (
        kinds.where((F.col("count") > 0) & (F.col("count") >= min_frames))
        .join(total, "trace_id")
        .withColumns({
            **_totals(), "location": F.col("jank_type"),
            "detail": F.concat(
                F.col("jank_tag"), F.lit(" · "), F.col("count").cast("string"), F.lit(" of "),
                F.col("_all").cast("string"), F.lit(" frames · longest "), ms_text("_longest"),
                F.lit(" ms"))})
    )
    return _finding(rows, "frame_jank", "total_ms", limit)


def stalls(ctx: TraceContext, min_stall_ms: float, max_gap_ms: float) -> DataFrame:
    """Unbroken busy stretches of the main thread, each with its name and time split.

    Every busy interval lies inside exactly one stretch, so the stretch number found by the
    island pass replaces an overlap join.
    """
    if max_gap_ms < 0:
        raise ValueError("max_gap_ms must not be negative")
    spans = ctx.slice_win.where(F.col("is_main_thread") & (F.col("depth") >= 1)).select(
        "trace_id", F.col("ts_win").alias("ts"),
        F.when(F.col("dur_win") > 0, F.col("ts_win") + F.col("dur_win")).alias("te"),
        F.col("name").alias("span"), "slice_id", F.lit(None).cast("string").alias("state"))
    states = ctx.tstate_win.where(F.col("is_main_thread") & F.col("state").isin(BUSY_STATES)).select(
        "trace_id", "ts", (F.col("ts") + F.col("dur")).alias("te"),
        F.lit(None).cast("string").alias("span"), F.lit(None).cast("long").alias("slice_id"),
        "state")
    marked = islands(settle(spans.unionByName(states)), ["trace_id"], ns(max_gap_ms))
    length = F.col("te") - F.col("ts")
    longest = F.struct(length, -F.col("slice_id"))
    per = (
        marked.where(F.col("te").isNotNull()).groupBy("trace_id", "island").agg(
            F.min("ts").alias("ts_from"), F.max("te").alias("ts_to"),
            F.max_by("span", F.when(F.col("slice_id").isNotNull(), longest)).alias("_name"),
            F.count("slice_id").alias("_messages"),
            F.sum(F.when(F.col("state") == "Running", length).otherwise(lng(0))).alias("on_cpu_ns"),
            F.sum(F.when(F.col("state").isin(RUNNABLE), length).otherwise(lng(0)))
            .alias("runnable_ns"))
        .where(F.col("ts_to") - F.col("ts_from") >= lng(ns(min_stall_ms)))
    )
    # Spans without length inside the stretch are messages too.
    points = (
        marked.where(F.col("te").isNull() & F.col("state").isNull())   # only spans are without length
        .join(per.select("trace_id", "island", "ts_from", "ts_to"), ["trace_id", "island"])
        .where((F.col("ts") > F.col("ts_from")) & (F.col("ts") < F.col("ts_to")))
        .groupBy("trace_id", "island").agg(
            F.count(F.lit(1)).alias("_points"),
            F.min_by("span", "slice_id").alias("_point_name"))
    )
    return per.join(points, ["trace_id", "island"], "left").select(
        "trace_id", "ts_from", "ts_to", (F.col("ts_to") - F.col("ts_from")).alias("stall_ns"),
        F.coalesce("_name", "_point_name", F.lit(UNNAMED_STALL)).alias("what"),
        (F.col("_messages") + F.coalesce("_points", lng(0))).alias("messages"),
        "on_cpu_ns", "runnable_ns")


def anr_risk(ctx: TraceContext, *, min_stall_ms: float = 5000, max_gap_ms: float = 2,
             limit: int | None = LIMIT) -> DataFrame:
    """Stretches in which the main thread never got back to its queue."""
    text = F.concat(
        ms_text("on_cpu_ns"), F.lit(" ms on CPU · "), ms_text("runnable_ns"),
        F.lit(" ms waiting for one · "),
        ms_text(F.col("stall_ns") - F.col("on_cpu_ns") - F.col("runnable_ns")),
        F.lit(" ms neither · "), F.col("messages").cast("string"), F.lit(" messages"))
    rows = (
        stalls(ctx, min_stall_ms, max_gap_ms)
        .groupBy("trace_id", F.col("what").alias("location"))
        .agg(F.count(F.lit(1)).alias("count"), F.sum("stall_ns").alias("_sum"),
             F.max("stall_ns").alias("_max"),
             F.max_by(text, F.struct(F.col("stall_ns"), -F.col("ts_from"))).alias("detail"))
        .withColumns(_totals())
    )
    return _finding(rows, "anr_risk", "total_ms", limit)


def anr(ctx: TraceContext, *, limit: int | None = LIMIT) -> DataFrame:
    """Freezes the system recorded for this process, over the whole trace."""
    p = ctx.chosen.where(F.col("ts_start").isNotNull()).select(
        "trace_id", F.col("upid").alias("_upid"), F.col("pid").alias("_pid"), F.col("name").alias("_name"),
        "ts_start", "ts_end")
    same = ((F.col("upid") == F.col("_upid")) | (F.col("pid") == F.col("_pid"))
            | (F.col("process_name") == F.col("_name")))
    ours = ctx.tables.freeze_record.join(p, "trace_id").where(same)
    subject = F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.col("anr_type"), F.lit("ANR"))
    where = (
        F.when(F.col("ts") < F.col("ts_start"), F.concat(
            F.lit("before the window by "), ms_text(F.col("ts_start") - F.col("ts")), F.lit(" ms")))
        .when(F.col("ts") > F.col("ts_end"), F.concat(
            F.lit("after the window by "), ms_text(F.col("ts") - F.col("ts_end")), F.lit(" ms")))
        .otherwise(F.concat(
            F.lit("inside the window at +"), ms_text(F.col("ts") - F.col("ts_start")),
            F.lit(" ms")))
    )
    longest = F.round(F.max(F.coalesce("anr_dur_ms", F.lit(0.0))), 2)
    rows = (
        ours.withColumn("location", subject)
        .withColumn("detail", F.concat(where, F.lit(" · "), F.col("error_id")))
        .groupBy("trace_id", "location", "detail")
        .agg(F.count(F.lit(1)).alias("count"), longest.alias("total_ms"),
             longest.alias("max_ms"), F.min("ts").alias("_ts"))
    )
    return _finding(rows, "anr", "_ts", limit, ascending=True)


DETECTORS = {f.__name__: f for f in (
    main_thread_block, main_thread_outlier, gc_pressure, monitor_contention, binder_txn,
    runnable_starvation, uninstrumented_cpu, frame_jank, anr_risk, anr)}

# Which columns name one finding row.
IDENTITY: dict[str, tuple[str, ...]] = {
    "main_thread_block": ("location", "detail"),
    "main_thread_outlier": ("location",),
    "gc_pressure": ("location", "detail"),
    "monitor_contention": ("location",),
    "binder_txn": ("location", "detail"),
    "runnable_starvation": ("location", "detail"),
    "uninstrumented_cpu": ("location",),
    "frame_jank": ("location",),
    "anr_risk": ("location",),
    "anr": ("location", "detail"),
}


def identity_of(df: DataFrame) -> Column:
    """The identity of each row: as it is carried, NULL read as the location alone; rows which carry none at
    all are those of the detectors above."""
    location = F.create_map(F.lit("location"), F.col("location"))
    if "identity" in df.columns:
        return F.coalesce("identity", location)
    both = F.create_map(F.lit("location"), F.col("location"), F.lit("detail"), F.col("detail"))
    named = [d for d, cols in IDENTITY.items() if "detail" in cols]
    return F.when(F.col("detector").isin(named), both).otherwise(location)
