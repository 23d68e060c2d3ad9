"""Name and process inventories over the bridge traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as cx
from ..operators import inventory as inv
from ..session import settle
from .bridge import trace_tables
from .sqltext import big, bridge, family, ms, with_
from .traces import PROCESS

MASKS = [("gc_pressure", "name", "signup 3"), ("gc_pressure", "name", "signup 1"),
         ("binder_txn", "name", "purchase*"), ("binder_txn", "skip", "*2*"),
         ("monitor_contention", "thread", "worker-19")]
BUCKETS = [("Signups", ["signup", "sign"]), ("Money", ["purchase", "error"]), ("Looks", ["view"])]


def _spans(spark, sf):
    t = trace_tables(spark, sf)
    return settle(inv.named_spans(t, cx.resolve_process(t, PROCESS)))


def _text(df):
    """Lists as comma-joined text, so that the result is flat."""
    return df.select(*[F.concat_ws(",", c).alias(c) if t.startswith("array") else F.col(c)
                       for c, t in df.dtypes])


def _families(spark, sf):
    spans = _spans(spark, sf)
    return inv.bucket_families(inv.family_inventory(spans, inv.mask_coverage(spans, MASKS)), BUCKETS)


_SPANS_SQL = """
named AS (SELECT trace_id, name, thread_name AS thread, count(*) AS n,
                 sum(greatest(dur, 0)) AS ns, max(dur) AS longest FROM spans
          GROUP BY trace_id, name, thread_name)"""

_COVER_SQL = """
hits AS (
  SELECT trace_id, name, bool_or(name IN ('signup 3', 'signup 1')) AS gc,
         bool_or(name GLOB 'purchase*') AS bi, bool_or(name GLOB '*2*') AS bs,
         bool_or(thread GLOB 'worker-19') AS mo
  FROM named GROUP BY trace_id, name),
cover AS (
  SELECT trace_id, name,
         concat_ws(',', CASE WHEN gc THEN 'gc_pressure' END,
                   CASE WHEN bi AND NOT bs THEN 'binder_txn' END,
                   CASE WHEN mo THEN 'monitor_contention' END) AS covered_by,
         concat_ws(',', CASE WHEN bi AND bs THEN 'binder_txn' END) AS skipped_by
  FROM hits)"""

_FAM_SQL = f"""
fams AS (
  SELECT n.trace_id, {family('n.name')} AS family, sum(n.n) AS n, sum(n.ns) AS ns,
         string_agg(DISTINCT n.thread, ',' ORDER BY n.thread) AS threads,
         concat_ws(',', CASE WHEN bool_or(bi AND NOT bs) THEN 'binder_txn' END,
                   CASE WHEN bool_or(gc) THEN 'gc_pressure' END,
                   CASE WHEN bool_or(mo) THEN 'monitor_contention' END) AS covered_by,
         concat_ws(',', CASE WHEN bool_or(bi AND bs) THEN 'binder_txn' END) AS skipped_by
  FROM named n JOIN hits h ON h.trace_id = n.trace_id AND h.name = n.name
  GROUP BY n.trace_id, {family('n.name')}),
sections AS (
  SELECT *, CASE WHEN regexp_matches(lower(family), 'signup|sign') THEN 'Signups'
                 WHEN regexp_matches(lower(family), 'purchase|error') THEN 'Money'
                 WHEN regexp_matches(lower(family), 'view') THEN 'Looks'
                 ELSE 'Everything else' END AS section FROM fams)"""


def _q(body, *ctes):
    return with_(bridge(), _SPANS_SQL, *ctes, body=body)


_FAM_COLS = (f"trace_id, family, {big('n')} AS n, {big('ns')} AS ns, threads, covered_by, "
             f"skipped_by, section")

QUERIES = {
    "probe_processes": (
        lambda s, d: inv.process_inventory(trace_tables(s, d), 3).drop("pid"),
        with_(bridge(), body=f"""
          SELECT trace_id, upid, name, {big('slices')} AS slices FROM ranked_process
          WHERE rk <= 3""")),
    "probe_threads": (
        lambda s, d: inv.thread_inventory(trace_tables(s, d), "app.p[12]", 8),
        with_(bridge(), body=f"""
          SELECT trace_id, utid, thread, tid, slices, sliced_ms, running_ms FROM (
            SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY running_ms DESC,
                                         slices DESC, utid) AS rk FROM (
              SELECT t.trace_id, t.utid, t.name AS thread, t.tid,
                     {big('coalesce(s.n, 0)')} AS slices,
                     CAST((coalesce(s.ns, 0) + 50000) // 100000 AS DOUBLE) / 10.0 AS sliced_ms,
                     CAST((coalesce(x.ns, 0) + 50000) // 100000 AS DOUBLE) / 10.0 AS running_ms
              FROM thread t JOIN process p ON p.trace_id = t.trace_id AND p.upid = t.upid
              LEFT JOIN (SELECT k.trace_id, k.utid, count(*) AS n, sum(greatest(dur, 0)) AS ns
                         FROM slice s JOIN thread_track k ON k.trace_id = s.trace_id
                          AND k.id = s.track_id GROUP BY k.trace_id, k.utid) s
                ON s.trace_id = t.trace_id AND s.utid = t.utid
              LEFT JOIN (SELECT trace_id, utid, sum(dur) AS ns FROM thread_state
                         WHERE state = 'Running' AND dur > 0 GROUP BY trace_id, utid) x
                ON x.trace_id = t.trace_id AND x.utid = t.utid
              WHERE p.name GLOB 'app.p[12]'))
          WHERE rk <= 8""")),
    "probe_longest": (
        lambda s, d: inv.longest_spans(trace_tables(s, d), "app.p1", 10),
        with_(bridge(), body=f"""
          SELECT trace_id, name, thread, n, max_ms FROM (
            SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY max_ms DESC, name) AS rk
            FROM (SELECT trace_id, name, max(CASE WHEN top = 1 THEN thread END) AS thread,
                         {big('count(*)')} AS n, {ms('max(dur)')} AS max_ms
                  FROM (SELECT s.trace_id, s.name, t.name AS thread, s.dur,
                               row_number() OVER (PARTITION BY s.trace_id, s.name
                                                  ORDER BY s.dur DESC, t.name DESC) AS top
                        FROM slice s
                        JOIN thread_track k ON k.trace_id = s.trace_id AND k.id = s.track_id
                        JOIN thread t ON t.trace_id = k.trace_id AND t.utid = k.utid
                        JOIN process p ON p.trace_id = t.trace_id AND p.upid = t.upid
                        WHERE p.name = 'app.p1')
                  GROUP BY trace_id, name))
          WHERE rk <= 10""")),
    "name_families": (
        lambda s, d: _text(inv.family_inventory(_spans(s, d))),
        _q(f"""SELECT trace_id, {family('name')} AS family, {big('sum(n)')} AS n,
                      {big('sum(ns)')} AS ns,
                      string_agg(DISTINCT thread, ',' ORDER BY thread) AS threads
               FROM named GROUP BY trace_id, {family('name')}""")),
    "mask_coverage": (
        lambda s, d: _text(inv.mask_coverage(_spans(s, d), MASKS)),
        _q("SELECT * FROM cover", _COVER_SQL)),
    "name_buckets": (
        lambda s, d: _text(inv.top_families(_families(s, d), 1, 2)),
        _q(f"""SELECT {_FAM_COLS}, CAST(rk AS INTEGER) AS place, {big('total')} AS shown_of FROM (
                 SELECT *, row_number() OVER (PARTITION BY trace_id, section
                                              ORDER BY ns DESC, family) AS rk,
                        count(*) OVER (PARTITION BY trace_id, section) AS total
                 FROM sections WHERE ns >= 1000000) WHERE rk <= 2""", _COVER_SQL, _FAM_SQL)),
    "missed_names": (
        lambda s, d: _text(inv.missed_families(_families(s, d), 1, 2)),
        _q(f"""SELECT {_FAM_COLS}, CAST(rk AS INTEGER) AS place, {big('total')} AS shown_of FROM (
                 SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ns DESC, family) AS rk,
                        count(*) OVER (PARTITION BY trace_id) AS total
                 FROM sections WHERE ns >= 1000000 AND section <> 'Everything else'
                   AND covered_by = '' AND skipped_by = '') WHERE rk <= 2""",
           _COVER_SQL, _FAM_SQL)),
}
