"""Ordered computations per key which never put a whole key into one task.

A plain `Window.partitionBy(key).orderBy(ts)` gathers all rows of a key. When one key holds a
third of the data, that task does not finish. Here every key is cut into cells along its order
(a stretch of time, a block of lines, a band of values); a window partition is one cell of one
key, and a small per-cell summary is carried forward (running sum, running maximum, previous row,
next row). The answer is exactly the one of the single window. The summary has one row per
non-empty cell: its size follows the length of the recording, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import int_div, lng

# Small enough that a burst stays a task's worth of rows, large enough that a key's summary does:
# a day of recording has 864 000 cells, a year of log 525 600.
TRACE_CELL_NS = 100_000_000          # a tenth of a second of recording
LOG_CELL_US = 60_000_000             # one minute of a log
LINE_CELL = 50_000                   # lines of one text
BANDS_PER_OCTAVE = 256               # bands of a value range, for order statistics


def time_cell(c: str, width: int = TRACE_CELL_NS) -> Column:
    return int_div(F.col(c), lng(width))


def line_cell(c: str = "line_no", width: int = LINE_CELL) -> Column:
    return int_div(F.col(c).cast("long"), lng(width))


def value_band(c: str) -> Column:
    """A band index which never decreases with the value, even under a heavy tail."""
    v = F.col(c).cast("double")
    return F.floor(F.signum(v) * F.log2(F.lit(1.0) + F.abs(v)) * F.lit(BANDS_PER_OCTAVE))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None,
          rank: str | None = None) -> DataFrame:
    """The first k rows per key. Spark cuts each map task to k rows before the shuffle."""
    if k is None:
        return df
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def carry(df: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Column, *,
          sums: dict[str, Column] | None = None,
          sums_before: dict[str, Column] | None = None,
          maxes: dict[str, Column] | None = None,
          maxes_before: dict[str, Column] | None = None,
          lags: dict[str, Column] | None = None,
          leads: dict[str, Column] | None = None) -> DataFrame:
    """Adds running columns over `order` inside `keys`.

    sums / maxes                 up to and including the row
    sums_before / maxes_before   strictly before the row (0 / NULL for the first one)
    lags / leads                 the neighbouring row's value
    Keys must not be NULL. `cell` must not decrease along `order`. `order` must be unique inside a key for lags and
    leads to be well defined.
    """
    kinds = {"sums": sums, "sums_before": sums_before, "maxes": maxes,
             "maxes_before": maxes_before, "lags": lags, "leads": leads}
    specs = [(kind, name, value) for kind, d in kinds.items() for name, value in (d or {}).items()]
    cell_keys = [*keys, "_cell"]
    work = df.select(*df.columns, cell.alias("_cell"),
                     *[value.alias(f"_v{i}") for i, (_, _, value) in enumerate(specs)])
    place = F.struct(*[F.col(c) for c in order])
    per_cell = work.groupBy(*cell_keys).agg(*[
        (F.sum(f"_v{i}") if kind.startswith("sums") else
         F.max(f"_v{i}") if kind.startswith("maxes") else
         F.max_by(F.struct(f"_v{i}"), place) if kind == "lags" else
         F.min_by(F.struct(f"_v{i}"), place)).alias(f"_s{i}")
        for i, (kind, _, _) in enumerate(specs)])
    over = Window.partitionBy(*keys).orderBy("_cell")
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = per_cell.select(*cell_keys, *[
        (F.sum(f"_s{i}").over(past) if kind.startswith("sums") else
         F.max(f"_s{i}").over(past) if kind.startswith("maxes") else
         F.lag(f"_s{i}").over(over)[f"_v{i}"] if kind == "lags" else
         F.lead(f"_s{i}").over(over)[f"_v{i}"]).alias(f"_c{i}")
        for i, (kind, _, _) in enumerate(specs)])

    work = work.join(carried, cell_keys, "left")
    inside = Window.partitionBy(*cell_keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for i, (kind, name, _) in enumerate(specs):
        v, c = F.col(f"_v{i}"), F.col(f"_c{i}")
        if kind.startswith("sums"):
            part = F.sum(v).over(upto if kind == "sums" else before)
            out[name] = F.coalesce(part, lng(0)) + F.coalesce(c, lng(0))
        elif kind.startswith("maxes"):
            out[name] = F.greatest(F.max(v).over(upto if kind == "maxes" else before), c)
        elif kind == "lags":
            out[name] = F.when(F.row_number().over(inside) == 1, c).otherwise(F.lag(v).over(inside))
        else:
            last = F.lead(F.lit(1)).over(inside).isNull()
            out[name] = F.when(last, c).otherwise(F.lead(v).over(inside))
    return work.select(*df.columns, *[e.alias(n) for n, e in out.items()])


def counted_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """`keys, value, cnt`: equal values folded, so that only distinct ones travel."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("cnt"))


def values_at_ranks(counted: DataFrame, keys: Sequence[str], value: str,
                    ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics: one row per key with `n` and the values at the given 1-based ranks.

    Takes the output of `counted_values`. `ranks` are expressions over the column `n`. A running
    count over bands of the value range finds each rank; no key is sorted in one task.
    """
    run = carry(counted, keys, [value], value_band(value), sums={"_upto": F.col("cnt")})
    total = counted.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    joined = run.join(total, list(keys))
    hit = {
        name: F.when((r > F.col("_upto") - F.col("cnt")) & (r <= F.col("_upto")), F.col(value))
        for name, r in ranks.items()
    }
    return joined.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(e).alias(name) for name, e in hit.items()])
