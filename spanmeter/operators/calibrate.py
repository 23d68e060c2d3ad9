"""Thresholds from healthy recordings: a statistic over an open measuring pass, times a margin."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import lng, to_ms
from ..functions.ordered import counted_values, top_k, values_at_ranks
from ..session import settle, together
from .context import TraceContext
from .detectors import DETECTORS
from .registry import check_params, defaults_of


@dataclass(frozen=True)
class Rule:
    """`param = statistic(column) * factor`; kind `top` takes the n-th largest, `p` a percentile."""

    detector: str
    param: str
    kind: str
    n: int
    column: str
    factor: float


# The rules of the shipped detectors.
RULES = [
    Rule("binder_txn", "min_txn_ms", "top", 10, "max_ms", 1.5),
    Rule("binder_txn", "max_total_ms", "top", 10, "total_ms", 1.5),
    Rule("frame_jank", "min_frames", "top", 10, "count", 1.5),
    Rule("gc_pressure", "max_events", "top", 10, "count", 1.5),
    Rule("gc_pressure", "max_total_ms", "top", 10, "total_ms", 1.5),
    Rule("main_thread_block", "min_slice_ms", "top", 10, "self_ms", 1.5),
    Rule("main_thread_outlier", "min_abs_ms", "top", 10, "max_ms", 1.5),
    Rule("monitor_contention", "min_block_ms", "top", 10, "max_ms", 1.5),
    Rule("monitor_contention", "max_total_ms", "top", 10, "total_ms", 1.5),
    Rule("runnable_starvation", "min_runnable_ms", "top", 10, "total_ms", 1.5),
    Rule("uninstrumented_cpu", "min_running_ms", "top", 10, "total_ms", 1.5),
]


def measure_open(ctx: TraceContext, detector: str, params: dict[str, Any] | None = None,
                 rules: Sequence[Rule] = RULES) -> DataFrame:
    """All rows of a detector over all traces: calibrated thresholds at 0, no limit."""
    fn = DETECTORS[detector]
    check_params(detector, defaults_of(fn), params or {})
    opened = {r.param: 0 for r in rules if r.detector == detector}
    return fn(ctx, **{**(params or {}), **opened}, limit=None)


def nth_largest(df: DataFrame, keys: Sequence[str], column: str, n: int) -> DataFrame:
    """The n-th largest value of a column per key, `value`; no row where there are fewer."""
    kept = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("value"))
    best = top_k(kept, keys, [F.col("value").desc()], n, rank="_place")
    return best.where(F.col("_place") == n).select(*keys, "value")


def interp_percentile(df: DataFrame, keys: Sequence[str], column: str, p: float) -> DataFrame:
    """The percentile at position (n-1)*p/100, linear between the two neighbours, per key."""
    counted = counted_values(df.select(*keys, F.col(column).cast("double").alias("_x")), keys, "_x")
    at = (F.col("n") - 1) * F.lit(p) / F.lit(100.0)
    low = F.floor(at) + 1
    found = values_at_ranks(counted, keys, "_x", {"_low": low, "_high": F.least(low + 1, F.col("n"))})
    return found.select(*keys, "n", (
        F.col("_low") + (F.col("_high") - F.col("_low")) * (at - F.floor(at))).alias("value"))


def propose_thresholds(ctx: TraceContext, rules: Sequence[Rule] = RULES, min_sample: int = 10,
                       params: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """One row per rule: statistic, proposed threshold, and whether the sample supports one.

    `status` is `derived`, `small_sample` (fewer than max(min_sample, n) values) or `degenerate`
    (the result is below 1); in the last two the default stays.
    """
    params = params or {}

    def measured(d: str) -> DataFrame:
        rows = measure_open(ctx, d, params.get(d), rules)
        wanted = sorted({r.column for r in rules if r.detector == d})
        return rows.select("detector", F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
            for c in wanted])).alias("_m")).select("detector", "_m.column", "_m.value")

    parts = together([lambda d=d: measured(d) for d in sorted({r.detector for r in rules})])
    pooled = parts[0]
    for part in parts[1:]:
        pooled = pooled.unionByName(part)
    pooled = settle(pooled.where(F.col("value").isNotNull()))
    keys = ["detector", "column"]
    sizes = pooled.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample"))
    stats = None
    for kind, n in sorted({(r.kind, r.n) for r in rules}):
        one = (nth_largest(pooled, keys, "value", n) if kind == "top" else
               interp_percentile(pooled, keys, "value", n).select(*keys, "value"))
        one = one.withColumns({"kind": F.lit(kind), "n": F.lit(n)})
        stats = one if stats is None else stats.unionByName(one)
    defaults = [float(params.get(r.detector, {}).get(
        r.param, defaults_of(DETECTORS[r.detector])[r.param])) for r in rules]
    table = ctx.spans.sparkSession.createDataFrame(
        [(r.detector, r.param, r.kind, r.n, r.column, float(r.factor), v)
         for r, v in zip(rules, defaults, strict=True)],
        "detector string, param string, kind string, n int, column string, factor double, "
        "default double")
    need = F.when(F.col("kind") == "top", F.greatest(F.lit(min_sample), F.col("n"))).otherwise(
        F.lit(max(min_sample, 1)))
    product = F.col("value") * F.col("factor")
    proposed = F.when(F.col("column") == "count", F.bround(product)).otherwise(F.round(product, 1))
    status = (F.when(F.coalesce("sample", lng(0)) < need, "small_sample")
              .when(F.coalesce(proposed, F.lit(0.0)) < 1, "degenerate").otherwise("derived"))
    return (
        table.join(sizes, keys, "left").join(stats, [*keys, "kind", "n"], "left")
        .withColumn("status", status)
        .select("detector", "param", F.coalesce("sample", lng(0)).alias("sample"),
                F.col("value").alias("statistic"), "status",
                F.when(F.col("status") == "derived", proposed).otherwise(F.col("default"))
                .alias("threshold"))
    )


def divergent_windows(win: DataFrame, keys: Sequence[str] = (), ratio: float = 2) -> DataFrame:
    """Shortest and longest window per key; `divergent` when they differ more than `ratio` times."""
    length = F.col("ts_end") - F.col("ts_start")
    return win.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("traces"), to_ms(F.min(length)).alias("min_ms"),
        to_ms(F.max(length)).alias("max_ms"),
        ((F.count(F.lit(1)) > 1) & (F.max(length) > F.min(length) * F.lit(ratio)))
        .alias("divergent"))
