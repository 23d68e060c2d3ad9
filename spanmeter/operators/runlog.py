"""The run log of a tool: sittings, their facts, last runs, and matching runs to session calls.

`runs(project, us, cmd, ms, exit, version)`; `us` is the start in epoch microseconds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.exprs import epoch_us, iso_text, lng
from ..functions.ordered import LOG_CELL_US, carry, time_cell, top_k
from ..session import settle

GAP_S = 30 * 60
SLACK_S = 15


def from_log(log: DataFrame) -> DataFrame:
    """Run-log entries as `load_runs` reads them, with `us`; a run without a project has ''."""
    return log.withColumns({"us": epoch_us("ts"), "project": F.coalesce("project", F.lit(""))})


def sittings(runs: DataFrame, gap_s: int = GAP_S, keys: Sequence[str] = ("project",)) -> DataFrame:
    """Adds `sitting` (1, 2, …): a new one when more than the gap lies between the END of the
    previous run and this start."""
    keys = list(keys)
    end = F.col("us") + F.coalesce("ms", lng(0)) * lng(1000)
    order = ["us", "cmd"]
    before = settle(carry(runs, keys, order, time_cell("us", LOG_CELL_US), lags={"_end": end}))
    cut = F.col("_end").isNull() | (F.col("us") - F.col("_end") > lng(gap_s * 1_000_000))
    return carry(before, keys, order, time_cell("us", LOG_CELL_US),
                 sums={"sitting": F.when(cut, lng(1)).otherwise(lng(0))}).drop("_end")


def sitting_facts(sat: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """Per sitting: stable id, start, end of the last run, number of runs, last known version."""
    keys = list(keys)
    end = F.col("us") + F.coalesce("ms", lng(0)) * lng(1000)
    known = F.when(F.col("version").isNotNull(), F.struct("us", "cmd"))
    return sat.groupBy(*keys, "sitting").agg(
        F.min("us").alias("started_us"), F.max_by(end, F.struct("us", "cmd")).alias("ended_us"),
        F.count(F.lit(1)).alias("runs"), F.max_by("version", known).alias("version"),
        F.max(F.col("cmd") != "reflect").alias("worth_reporting")
    ).withColumn("sitting_id", sitting_id(keys))


def sitting_id(keys: Sequence[str]):
    """Twelve hex digits of the keys and the first start: it stays when the log grows."""
    first = iso_text(F.timestamp_micros("started_us"))
    return F.substring(F.sha2(F.concat_ws(
        "\n", *[F.col(k).cast("string") for k in keys], first), 256), 1, 12)


def last_runs(runs: DataFrame, keys: Sequence[str] = ("project",),
              commands: Sequence[str] | None = None) -> DataFrame:
    """The last run of each command: start, exit code, duration."""
    d = runs if commands is None else runs.where(F.col("cmd").isin(list(commands)))
    last = F.max_by(F.struct("us", "exit", "ms"), F.struct(F.col("us"), F.col("ms")))
    return d.groupBy(*keys, "cmd").agg(last.alias("_l")).select(
        *keys, "cmd", F.col("_l.us").alias("us"), F.col("_l.exit").alias("exit"),
        F.col("_l.ms").alias("ms"))


def match_runs(calls: DataFrame, runs: DataFrame, keys: Sequence[str] = ("session_id", "cmd"),
               slack_s: float = SLACK_S) -> DataFrame:
    """One-to-one pairs of calls and logged runs of the same command: each call in order of time takes
    the nearest run within the slack that no earlier call took (ties: the earlier run).

    Takes `call_id, us` and `run_id, us` beside the keys; events without a time match nothing. No pair reaches over
    a pause longer than the slack, so the pauses cut a key into chains. Chains are dealt out on their
    own and walked once, as sorted streams: a walk holds the events of one slack, never a chain.
    """
    keys = list(keys)
    slack = round(slack_s * 1_000_000)
    ids = {"call_id": calls.schema["call_id"].dataType, "run_id": runs.schema["run_id"].dataType}
    def side(df: DataFrame, own: str) -> DataFrame:
        return df.where(F.col("us").isNotNull()).select(
            *keys, "us", *[(F.col(i) if i == own else F.lit(None)).cast(t).alias(i) for i, t in ids.items()])

    events = side(calls, "call_id").unionByName(side(runs, "run_id"))
    cell = time_cell("us", LOG_CELL_US)
    near = carry(events, keys, ["us"], cell, lags={"_before": F.col("us")})
    # Of events at one time the one that opens a chain goes first.
    goes_on = near.withColumn("_goes_on", F.when(F.col("us") - F.col("_before") <= lng(slack), lng(1)).otherwise(lng(0)))
    chains = carry(goes_on, keys, ["us", "_goes_on"], cell, sums={"_chain": 1 - F.col("_goes_on")})
    place = [*keys, "_chain"]
    dealt = (chains.select(*place, "us", *ids).repartition(*place)
             .sortWithinPartitions(*place, "us", "call_id", "run_id"))
    schema = StructType([*[events.schema[k] for k in keys], *[StructField(i, t) for i, t in ids.items()],
                         StructField("gap_us", LongType())])
    return dealt.mapInArrow(_walk(len(place), slack), schema)


def _walk(n_place: int, slack: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The walk over sorted events (place, us, call_id, run_id). A call is decided when the stream has
    passed the last run it could take."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, free, pairs = None, deque(), deque(), []

        def decide() -> None:
            us, call = waiting.popleft()
            while free and free[0][0] < us - slack:
                free.popleft()
            near = [k for k, (t, _) in enumerate(free) if abs(t - us) <= slack]
            if near:
                k = min(near, key=lambda k: abs(free[k][0] - us))
                pairs.append((*at[:-1], call, free[k][1], abs(free[k][0] - us)))
                del free[k]

        def emit(kinds: list) -> pa.RecordBatch:
            columns = zip(*pairs, strict=True) if pairs else [[]] * len(kinds)
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)
            pairs.clear()
            return out

        kinds = names = None
        for b in batches:
            fields = [f for k, f in enumerate(b.schema) if k not in (n_place - 1, n_place)]
            names, kinds = [*[f.name for f in fields], "gap_us"], [*[f.type for f in fields], pa.int64()]
            for *place, us, call, run in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if place != at:
                    while waiting:
                        decide()
                    free.clear()
                    at = place
                while waiting and waiting[0][0] < us - slack:
                    decide()
                if call is not None:
                    waiting.append((us, call))
                else:
                    if not waiting:   # no call before this one can reach further back
                        while free and free[0][0] < us - slack:
                            free.popleft()
                    free.append((us, run))
            yield emit(kinds)
        while waiting:
            decide()
        if kinds is not None:
            yield emit(kinds)

    return walk


def newest_sittings(facts: DataFrame, keys: Sequence[str] = ("project",), n: int | None = 1
                    ) -> DataFrame:
    """The newest sittings worth reporting."""
    return top_k(facts.where("worth_reporting"), list(keys), [F.col("ended_us").desc()], n)
