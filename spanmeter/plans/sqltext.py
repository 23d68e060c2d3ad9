"""Building blocks of the check SQL: integer rounding, text of tenths, context CTEs."""

from __future__ import annotations

from .bridge import TRACE_SQL


def scaled(x: str, unit: int) -> str:
    half = unit // 2
    return (f"(CASE WHEN {x} >= 0 THEN ({x} + {half}) // {unit} "
            f"ELSE -((-({x}) + {half}) // {unit}) END)")


def ms(x: str) -> str:
    return f"(CAST({scaled(x, 10_000)} AS DOUBLE) / 100.0)"


def tenths(x: str) -> str:
    return (f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST(abs({x}) // 10 AS VARCHAR) "
            f"|| '.' || CAST(abs({x}) % 10 AS VARCHAR))")


def ms_text(x: str) -> str:
    return tenths(scaled(x, 100_000))


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def family(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, '0x[0-9a-fA-F]+', '0x#', 'g'), "
            f"'[0-9]+', '#', 'g')")


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip().strip(",") for c in ctes) + "\n" + body.strip()


def context(process: str = "app.p*", start: str | None = "view*", end: str | None = None) -> str:
    """proc, spans, win, slice_win and tstate_win over the bridge tables."""
    s = f"name GLOB '{start}'" if start else "FALSE"
    e = f"s.name GLOB '{end}'" if end else "FALSE"
    return f"""
per_process AS (
  SELECT p.trace_id, p.upid, p.pid, p.name, count(s.id) AS slices
  FROM process p
  LEFT JOIN thread t ON t.trace_id = p.trace_id AND t.upid = p.upid
  LEFT JOIN thread_track k ON k.trace_id = t.trace_id AND k.utid = t.utid
  LEFT JOIN slice s ON s.trace_id = k.trace_id AND s.track_id = k.id
  WHERE p.name GLOB '{process}'
  GROUP BY p.trace_id, p.upid, p.pid, p.name),
ranked_process AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY slices DESC, upid) AS rk,
         count(*) OVER (PARTITION BY trace_id) AS n_found
  FROM per_process),
proc AS (SELECT trace_id, upid, pid, name FROM ranked_process WHERE rk = 1),
spans AS (
  SELECT s.trace_id, s.id AS slice_id, s.ts, s.dur, s.name, s.depth, t.utid, t.tid,
         t.name AS thread_name, t.tid = p.pid AS is_main_thread
  FROM slice s
  JOIN thread_track k ON k.trace_id = s.trace_id AND k.id = s.track_id
  JOIN thread t ON t.trace_id = k.trace_id AND t.utid = k.utid
  JOIN proc p ON p.trace_id = t.trace_id AND p.upid = t.upid),
win_start AS (
  SELECT trace_id, coalesce(min(CASE WHEN {s} THEN ts END), min(ts)) AS ts_start
  FROM spans GROUP BY trace_id),
win_end AS (
  SELECT trace_id, ts_end FROM (
    SELECT s.trace_id, s.ts + greatest(s.dur, 0) AS ts_end,
           row_number() OVER (PARTITION BY s.trace_id ORDER BY s.ts, s.slice_id) AS rk
    FROM spans s JOIN win_start w ON w.trace_id = s.trace_id
    WHERE {e} AND s.ts >= w.ts_start) WHERE rk = 1),
win AS (
  SELECT w.trace_id, w.ts_start, coalesce(e.ts_end, a.ts_end) AS ts_end
  FROM win_start w
  JOIN (SELECT trace_id, max(ts + greatest(dur, 0)) AS ts_end FROM spans GROUP BY trace_id) a
    ON a.trace_id = w.trace_id
  LEFT JOIN win_end e ON e.trace_id = w.trace_id),
slice_real AS (
  SELECT s.trace_id, s.slice_id, s.ts, s.name, s.depth, s.utid, s.tid, s.thread_name,
         s.is_main_thread, s.dur < 0 AS unfinished, w.ts_start, w.ts_end,
         CASE WHEN s.dur < 0 THEN w.ts_end - s.ts ELSE s.dur END AS dur
  FROM spans s JOIN win w ON w.trace_id = s.trace_id),
slice_win AS (
  SELECT trace_id, slice_id, ts, dur, name, depth, utid, tid, thread_name, is_main_thread,
         unfinished, greatest(ts, ts_start) AS ts_win,
         least(ts + dur, ts_end) - greatest(ts, ts_start) AS dur_win
  FROM slice_real WHERE ts < ts_end AND ts + dur > ts_start),
tstate_win AS (
  SELECT x.trace_id, x.utid, t.tid, t.name AS thread_name, t.tid = p.pid AS is_main_thread,
         x.state, greatest(x.ts, w.ts_start) AS ts,
         least(x.ts + x.dur, w.ts_end) - greatest(x.ts, w.ts_start) AS dur
  FROM thread_state x
  JOIN thread t ON t.trace_id = x.trace_id AND t.utid = x.utid
  JOIN proc p ON p.trace_id = t.trace_id AND p.upid = t.upid
  JOIN win w ON w.trace_id = x.trace_id
  WHERE x.dur > 0 AND x.ts < w.ts_end AND x.ts + x.dur > w.ts_start)"""


def bridge(process: str = "app.p*", start: str | None = "view*", end: str | None = None) -> str:
    return TRACE_SQL + "," + context(process, start, end)


def finding(detector: str, rows: str, *, self_ms: str = "NULL", total_ms: str = "total_ms",
            max_ms: str = "max_ms", covered_ms: str = "NULL", rank: str = "total_ms",
            order: str = "DESC", limit: int | None = 20) -> str:
    """The finding columns of `rows`, top `limit` per trace."""
    cut = f"WHERE rk <= {limit}" if limit else ""
    return f"""
SELECT trace_id, '{detector}' AS detector, location, {big('"count"')} AS "count",
       CAST({self_ms} AS DOUBLE) AS self_ms, CAST({total_ms} AS DOUBLE) AS total_ms,
       CAST({max_ms} AS DOUBLE) AS max_ms, CAST({covered_ms} AS DOUBLE) AS covered_ms, detail
FROM (SELECT *, row_number() OVER (PARTITION BY trace_id
                                   ORDER BY {rank} {order}, location, detail) AS rk
      FROM ({rows})) {cut}"""
