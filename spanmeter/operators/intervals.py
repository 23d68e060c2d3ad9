"""Interval algebra: intersection by a boundary sweep, and unbroken stretches (islands)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import lng
from ..functions.ordered import TRACE_CELL_NS, carry, time_cell
from ..session import settle


def intersect_intervals(a: DataFrame, b: DataFrame, keys: Sequence[str],
                        cell_ns: int = TRACE_CELL_NS) -> DataFrame:
    """Per key, how long at least one interval of `a` and one of `b` were open at once.

    Both sides carry `ts, dur`. Every interval becomes a +1 and a -1 at its bounds; equal
    instants are summed before the shuffle, and one ordered pass adds up the segments where
    both counts are positive. Linear in the bounds, and right when intervals of one side overlap.
    """
    def bounds(df: DataFrame, side: str) -> DataFrame:
        step = F.explode(F.array(
            F.struct(F.col("ts").alias("t"), lng(1).alias("d")),
            F.struct((F.col("ts") + F.col("dur")).alias("t"), lng(-1).alias("d"))))
        d = df.where(F.col("dur") > 0).select(*keys, step.alias("_e"))
        mine, zero = F.col("_e.d"), lng(0)
        return d.select(*keys, F.col("_e.t").alias("t"),
                        (mine if side == "a" else zero).alias("da"),
                        (mine if side == "b" else zero).alias("db"))

    # Read twice by the pass, once for the cells and once for the rows.
    events = settle(
        bounds(a, "a").unionByName(bounds(b, "b"))
        .groupBy(*keys, "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    )
    swept = carry(events, keys, ["t"], time_cell("t", cell_ns),
                  sums_before={"open_a": F.col("da"), "open_b": F.col("db")},
                  lags={"since": F.col("t")})
    both = (F.col("open_a") > 0) & (F.col("open_b") > 0)
    return swept.where(both).groupBy(*keys).agg(
        F.sum(F.col("t") - F.col("since")).alias("shared_ns"))


def islands(intervals: DataFrame, keys: Sequence[str], max_gap_ns: int,
            cell_ns: int = TRACE_CELL_NS) -> DataFrame:
    """Adds `island`, the time at which it opens, to intervals `ts, te`: a new one opens where the largest end so
    far is left behind by more than the gap. Rows with a NULL `te` are points: they join the island
    around them and never open or prolong one; before the first island they have none.

    Rows are sorted inside cells only. A row which would open an island in its cell does so if the ends of
    earlier cells are left behind too, and if the last one of a cell doesn't, none of that cell does: so a cell's
    largest end and last opening are all that is carried on, and the rows are met once.
    """
    cell_keys, gap = [*keys, "_cell"], lng(max_gap_ns)
    inside = Window.partitionBy(*cell_keys).orderBy("ts", "te")
    before = F.max("te").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("te").isNotNull() & (before.isNull() | (F.col("ts") - before > gap))
    rows = (
        intervals.withColumn("_cell", time_cell("ts", cell_ns))
        .withColumn("_opens", F.when(opens, F.col("ts")))
    )
    per_cell = rows.groupBy(*cell_keys).agg(F.max("te").alias("_end"), F.max("_opens").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)

    def valid(c: str) -> Column:
        return F.when(F.col("_reached").isNull() | (F.col(c) - F.col("_reached") > gap), F.col(c))

    carried = (
        per_cell.withColumn("_reached", F.max("_end").over(earlier))
        .withColumn("_island", F.max(valid("_last")).over(earlier))
        .select(*cell_keys, "_reached", "_island")
    )
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    island = F.greatest(F.max(valid("_opens")).over(upto), F.col("_island"))
    return rows.join(carried, cell_keys).select(*intervals.columns, island.alias("island"))
