"""The history of reports per investigation: numbering, choosing two to compare, looking one up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import lng
from ..functions.ordered import carry, top_k


def number_reports(reports: DataFrame, investigation: str, order: Sequence[str],
                   cell: Column) -> DataFrame:
    """Adds `seq` from 1 in the given order. `cell` cuts the order, see `functions.ordered`."""
    return carry(reports, [investigation], order, cell, sums={"seq": lng(1)})


def pick_pair(reports: DataFrame, mode: str, investigation: str = "investigation") -> DataFrame:
    """Which two reports of an investigation are compared: `before_id, after_id`.

    `first_last`: its first report against its last. `latest_two`: the previous one against the
    latest. An investigation with fewer than two reports gives no row.
    """
    if mode not in ("first_last", "latest_two"):
        raise ValueError(f"unknown mode {mode!r}")
    wanted = [F.col("seq").desc()] if mode == "latest_two" else None
    if wanted:
        two = top_k(reports, [investigation], wanted, 2)
        ends = two.groupBy(investigation)
    else:
        ends = reports.groupBy(investigation)
    return (
        ends.agg(F.count(F.lit(1)).alias("_n"), F.min_by("report_id", "seq").alias("before_id"),
                 F.max_by("report_id", "seq").alias("after_id"))
        .where(F.col("_n") >= 2)
        .select(investigation, F.lit(mode).alias("mode"), "before_id", "after_id")
    )


def named_pair(before_id: str, after_id: str | None, latest_id: str | None) -> tuple[str, str]:
    """Two named reports, or one named report against the latest."""
    other = after_id or latest_id
    if other is None:
        raise ValueError("nothing to compare: name two reports, or one and a latest")
    return before_id, other


def newest_first(history: DataFrame) -> DataFrame:
    opened = "opened_at" if "opened_at" in history.columns else "opened_us"
    return history.orderBy(F.col("n").desc(), F.col(opened).desc())


def find_investigation(history: DataFrame, ident: str) -> DataFrame:
    """By number, else the newest whose question contains the text, ignoring case."""
    if ident.isdigit():
        return history.where(F.col("n") == int(ident))
    hit = history.where(F.lower("question").contains(ident.lower()))
    return newest_first(hit).limit(1)


def is_fresh(touched_at, now=None, minutes: int = 30):
    """Worked on within the last half hour."""
    now = F.current_timestamp() if now is None else now
    return touched_at.isNotNull() & (
        F.unix_timestamp(now) - F.unix_timestamp(touched_at) < minutes * 60)


def is_stale(touched_at, now=None, days: int = 7):
    """Left alone for a week or more."""
    now = F.current_timestamp() if now is None else now
    return F.unix_timestamp(now) - F.unix_timestamp(touched_at) >= days * 86400
