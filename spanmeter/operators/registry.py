"""Running a set of detectors with checked parameters, and detectors given as SQL."""

from __future__ import annotations

import inspect
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle, together
from .context import TraceContext
from .detectors import DETECTORS, IDENTITY, LIMIT, _finding


def defaults_of(detector: Callable[..., DataFrame]) -> dict[str, Any]:
    return {n: p.default for n, p in inspect.signature(detector).parameters.items()
            if p.kind is inspect.Parameter.KEYWORD_ONLY and n != "limit"}


def check_params(name: str, defaults: Mapping[str, Any], given: Mapping[str, Any]) -> None:
    """Refuses unknown names and values of another kind than the default. No job runs."""
    for key, value in given.items():
        if key not in defaults:
            raise ValueError(f"{name} has no parameter {key!r}; known: {sorted(defaults)}")
        number = isinstance(defaults[key], (int, float))
        is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if number and not is_number:
            raise ValueError(f"{name}.{key} must be a number, not {value!r}")
        if not number and not isinstance(value, str):
            raise ValueError(f"{name}.{key} must be text, not {value!r}")


@dataclass(frozen=True)
class Planned:
    name: str
    params: dict[str, Any]
    source: str


def plan_detectors(names: list[str] | None = None,
                   config: Mapping[str, Mapping[str, Any]] | None = None,
                   overrides: Mapping[str, Mapping[str, Any]] | None = None) -> list[Planned]:
    """Default < config < call. A detector named in `overrides` runs even when not in `names`."""
    config, overrides = config or {}, overrides or {}
    for d in [*(names or []), *config, *overrides]:
        if d not in DETECTORS:
            raise ValueError(f"no detector {d!r}; known: {sorted(DETECTORS)}")
    wanted = list(DETECTORS) if names is None else [
        d for d in DETECTORS if d in names or d in overrides]
    if not wanted:
        raise ValueError("no detectors selected")
    out = []
    for d in wanted:
        base = defaults_of(DETECTORS[d])
        for given in (config.get(d, {}), overrides.get(d, {})):
            check_params(d, base, given)
        source = "+".join(s for s, on in (("config", config.get(d)), ("call", overrides.get(d)))
                          if on) or "default"
        out.append(Planned(d, {**base, **config.get(d, {}), **overrides.get(d, {})}, source))
    return out


@dataclass
class DetectorResults:
    """Lazy rows of all detectors, one entry per detector run, and the ones left out."""

    findings: DataFrame
    runs: list[dict[str, Any]]
    absent: list[str]
    per_detector: dict[str, DataFrame] = field(default_factory=dict)


def run_detectors(ctx: TraceContext, names: list[str] | None = None,
                  overrides: Mapping[str, Mapping[str, Any]] | None = None,
                  config: Mapping[str, Mapping[str, Any]] | None = None,
                  limit: int | None = LIMIT,
                  extra: Mapping[str, Callable[[TraceContext], DataFrame]] | None = None
                  ) -> DetectorResults:
    """All or some detectors as one union. One which cannot be planned yields an error entry; nothing runs
    yet, so one that fails on its rows is only seen by `guarded`. `extra` are detectors of one's own."""
    plan = plan_detectors(names, config, overrides)
    jobs: list[tuple[str, dict, str, Callable[[], DataFrame]]] = [
        (p.name, p.params, p.source,
         lambda p=p: DETECTORS[p.name](ctx, **p.params, limit=limit)) for p in plan]
    jobs += [(n, {}, "call", lambda f=f: f(ctx)) for n, f in (extra or {}).items()]

    def attempt(build: Callable[[], DataFrame]) -> tuple[DataFrame | None, str | None]:
        try:
            df = build()
            df.schema  # analysis happens here; a bad plan must not take the others down
            return df, None
        except (PySparkException, ValueError) as e:
            return None, str(e).splitlines()[0]

    runs, done = [], {}
    # Some detectors write what they sort; those jobs run side by side.
    for (name, params, source, _), (df, error) in zip(jobs, together([
            lambda b=build: attempt(b) for *_, build in jobs]), strict=True):
        if df is not None:
            done[name] = df
        runs.append({"detector": name, "params": {k: str(v) for k, v in params.items()},
                     "params_source": source, "identity": list(IDENTITY.get(name, ())), "error": error})
    union = None
    for df in done.values():
        union = df if union is None else union.unionByName(df)
    if union is None:
        raise ValueError("every detector failed: " + "; ".join(r["error"] for r in runs))
    planned = {p.name for p in plan}
    return DetectorResults(union, runs, [d for d in DETECTORS if d not in planned], done)


def guarded(done: DetectorResults) -> DetectorResults:
    """The rows of all detectors, written. One that fails while it runs keeps the others' rows: its error
    is noted in `runs` and it has none.

    All are written in one job; only if that fails is each written on its own to see which one it is.
    """
    try:
        rows = settle(done.findings)
        return replace(done, findings=rows, per_detector={
            n: rows.where(F.col("detector") == n) for n in done.per_detector})
    except (PySparkException, Py4JJavaError):
        pass
    written, errors = {}, {}
    for name, df in done.per_detector.items():
        try:
            written[name] = settle(df)
        except (PySparkException, Py4JJavaError) as e:
            errors[name] = str(getattr(e, "java_exception", None) or e).splitlines()[0]
    rows = done.findings.where(F.lit(False))
    for df in written.values():
        rows = rows.unionByName(df)
    runs = [{**r, "error": r["error"] or errors.get(r["detector"])} for r in done.runs]
    return replace(done, findings=rows, runs=runs, per_detector=written)


def custom_detector(ctx: TraceContext, sql: str, args: Mapping[str, Any] | None = None,
                    name: str = "custom", rank_by: str = "total_ms",
                    limit: int | None = LIMIT, identity: Sequence[str] = ("location",)) -> DataFrame:
    """A detector written in SQL over the context views, with bound parameters.

    `identity` names the columns which tell one of its rows from another, for merging and comparing.

    The text may read `slice_win`, `tstate_win`, `scenario_window`, `spans` and `proc`, must return
    `trace_id` and `location`, and takes parameters as `:name` markers (values are bound, never
    spliced into the text). Columns outside the finding contract go to `extra`.
    """
    spark = ctx.spans.sparkSession
    views = {"slice_win": ctx.slice_win, "tstate_win": ctx.tstate_win, "spans": ctx.spans,
             "scenario_window": ctx.window, "proc": ctx.proc}
    tag = uuid.uuid4().hex[:12]
    header = []
    for view, df in views.items():
        df.createOrReplaceTempView(f"_{view}_{tag}")
        header.append(f"{view} AS (SELECT * FROM _{view}_{tag})")
    try:
        body = sql.strip()
        glue = ", " + body[4:].lstrip() if body[:5].lower() == "with " else " " + body
        df = spark.sql("WITH " + ", ".join(header) + glue, args=dict(args or {}))
    finally:
        for view in views:
            spark.catalog.dropTempView(f"_{view}_{tag}")
    for need in ("trace_id", "location", *identity):
        if need not in df.columns:
            raise ValueError(f"a detector must return {need}")
    known = {"trace_id", "location", "count", "self_ms", "total_ms", "max_ms", "covered_ms",
             "detail"}
    more = [c for c in df.columns if c not in known]
    if more:
        df = df.withColumn("extra", F.create_map(
            *[x for c in more for x in (F.lit(c), F.col(c).cast("string"))]))
    for c in ("detail", rank_by):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string" if c == "detail" else "double"))
    return _finding(df, name, rank_by, limit, identity=identity)
