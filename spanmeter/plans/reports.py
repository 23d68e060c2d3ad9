"""Calibration, merged repeats and comparisons over the bridge traces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import LOG_CELL_US, time_cell
from ..operators import calibrate as cal
from ..operators import compare as cmp
from ..operators import repeats as rep
from ..operators.detectors import DETECTORS
from ..operators.registry import custom_detector, defaults_of, guarded, run_detectors
from ..session import settle
from ..sources import history as hist
from .sqltext import big, bridge, family, ms, scaled, with_
from .traces import (CHILD_SQL, COLUMNS, FRAMES_SQL, OUTLIER_SQL, PARAMS, SHARED_SQL, STALL_SQL, anr_sql, binder_sql,
                     block_sql, blind_sql, ctx, gc_sql, jank_sql, monitor_sql, outlier_sql, stall_sql,
                     starvation_sql)


@dataclass
class Sample:
    """Findings of every day; a day is one repeat of the scenario pair/side."""

    findings: DataFrame
    traces: DataFrame
    window: DataFrame


def _traces(window: DataFrame) -> DataFrame:
    day = F.substring("trace_id", 9, 2).cast("int")
    return window.select(
        "trace_id", day.alias("repeat_no"),
        F.concat(F.lit("p"), (day % 3).cast("string")).alias("pair_id"),
        F.when(day <= 15, "before").otherwise("after").alias("side"),
        F.concat(F.lit("p"), (day % 3).cast("string"), F.lit("/"),
                 F.when(day <= 15, "before").otherwise("after")).alias("scenario_id"))


def sample(spark: SparkSession, sf: str) -> Sample:
    c = ctx(spark, sf).settled()
    # All rows: a row which one repeat shows 21st must not count as missing there.
    found = run_detectors(c, overrides=PARAMS, limit=None).findings
    return Sample(settle(found), _traces(c.window), c.window)


def merged(spark: SparkSession, sf: str, with_spread: bool = False) -> DataFrame:
    s = sample(spark, sf)
    return rep.merge_repeats(s.findings, s.traces, with_spread=with_spread)


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).withColumn("identity", F.to_json("identity"))


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = rows.withColumns({"pair_id": F.substring("scenario_id", 1, 2),
                          "side": F.substring("scenario_id", 4, 6)}).drop("scenario_id")
    return (d.where(F.col("side") == "before").drop("side"),
            d.where(F.col("side") == "after").drop("side"))


def changes(spark: SparkSession, sf: str, with_spread: bool = False) -> DataFrame:
    before, after = _sides(settle(merged(spark, sf, with_spread)))
    return cmp.classify_changes(cmp.pair_rows(before, after))


# ---- SQL side -------------------------------------------------------------------------------

FINDINGS_SQL = f"""
findings AS ({' UNION ALL '.join(f'SELECT * FROM ({q})' for q in (
    block_sql(limit=None), outlier_sql(None), gc_sql(limit=None), monitor_sql(None), binder_sql(limit=None),
    starvation_sql(None), blind_sql(None), jank_sql(limit=None), stall_sql(None), anr_sql(None)))}),
traces AS (
  SELECT trace_id, CAST(substr(trace_id, 9, 2) AS INTEGER) AS repeat_no,
         'p' || CAST(substr(trace_id, 9, 2) AS INTEGER) % 3 || '/' ||
         CASE WHEN CAST(substr(trace_id, 9, 2) AS INTEGER) <= 15 THEN 'before' ELSE 'after' END
           AS scenario_id FROM win),
keyed AS (
  SELECT f.*, t.scenario_id, t.repeat_no,
         CASE WHEN f.detector IN ('main_thread_block', 'gc_pressure', 'binder_txn', 'runnable_starvation', 'anr')
              THEN f.detail ELSE '' END AS identity_detail
  FROM findings f JOIN traces t ON t.trace_id = f.trace_id),
longf AS (
  {' UNION ALL '.join(f'''SELECT scenario_id, detector, location, identity_detail, repeat_no,
  '{m}' AS metric, CAST(round("{m}" * 100.0) AS BIGINT) AS v FROM keyed WHERE "{m}" IS NOT NULL'''
                      for m in rep.METRICS)}),
places AS (
  SELECT *, row_number() OVER w AS rk, count(*) OVER (PARTITION BY scenario_id, detector, location,
         identity_detail, metric) AS n
  FROM longf WINDOW w AS (PARTITION BY scenario_id, detector, location, identity_detail, metric
                          ORDER BY v)),
mids AS (
  SELECT scenario_id, detector, location, identity_detail, metric,
         CAST({scaled("(sum(CASE WHEN rk = (n + 1) // 2 THEN v ELSE 0 END) + "
                      "sum(CASE WHEN rk = n // 2 + 1 THEN v ELSE 0 END))", 2)} AS DOUBLE) / 100.0 AS v
  FROM places GROUP BY scenario_id, detector, location, identity_detail, metric),
med AS (
  SELECT scenario_id, detector, location, identity_detail,
         {', '.join(f"max(CASE WHEN metric = '{m}' THEN v END) AS {chr(34)}{m}{chr(34)}"
                    for m in rep.METRICS)}
  FROM mids GROUP BY scenario_id, detector, location, identity_detail),
sizes AS (SELECT scenario_id, count(DISTINCT trace_id) AS runs_total FROM traces
          GROUP BY scenario_id),
seen AS (SELECT scenario_id, detector, location, identity_detail,
                count(DISTINCT trace_id) AS runs,
                first(detail ORDER BY coalesce(self_ms, total_ms, 0) DESC, repeat_no) AS worst FROM keyed
         GROUP BY scenario_id, detector, location, identity_detail),
merged AS (
  SELECT m.scenario_id, m.detector, m.location, m.identity_detail, s.worst AS detail,
         {big('s.runs')} AS runs, {big('z.runs_total')} AS runs_total, m."count", m.self_ms,
         m.total_ms, m.max_ms, m.covered_ms
  FROM med m JOIN seen s USING (scenario_id, detector, location, identity_detail)
  JOIN sizes z USING (scenario_id))"""

PAIRS_SQL = f"""
b AS (SELECT * REPLACE (identity_detail AS detail), substr(scenario_id, 1, 2) AS pair_id FROM merged WHERE scenario_id LIKE '%before'),
a AS (SELECT * REPLACE (identity_detail AS detail), substr(scenario_id, 1, 2) AS pair_id FROM merged WHERE scenario_id LIKE '%after'),
exact AS (
  SELECT b.pair_id, b.detector, b.location, b.detail, 'exact' AS matched_by,
         b.self_ms AS bs, b.total_ms AS bt, a.self_ms AS asf, a.total_ms AS att, TRUE AS hb,
         TRUE AS ha
  FROM b JOIN a USING (pair_id, detector, location, detail)),
lb AS (SELECT *, {family('location')} AS fl, {family('detail')} AS fd FROM b
       WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.pair_id = b.pair_id AND a.detector = b.detector
                         AND a.location = b.location AND a.detail = b.detail)),
la AS (SELECT *, {family('location')} AS fl, {family('detail')} AS fd FROM a
       WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.pair_id = b.pair_id AND a.detector = b.detector
                         AND a.location = b.location AND a.detail = b.detail)),
nb AS (SELECT pair_id, detector, fl, fd FROM lb GROUP BY ALL HAVING count(*) = 1),
na AS (SELECT pair_id, detector, fl, fd FROM la GROUP BY ALL HAVING count(*) = 1),
fam AS (SELECT * FROM nb INTERSECT SELECT * FROM na),
by_family AS (
  SELECT f.pair_id, f.detector, f.fl AS location, f.fd AS detail, 'family' AS matched_by,
         lb.self_ms AS bs, lb.total_ms AS bt, la.self_ms AS asf, la.total_ms AS att, TRUE AS hb,
         TRUE AS ha
  FROM fam f JOIN lb USING (pair_id, detector, fl, fd) JOIN la USING (pair_id, detector, fl, fd)),
alone AS (
  SELECT pair_id, detector, location, detail, 'exact' AS matched_by, self_ms AS bs,
         total_ms AS bt, NULL::DOUBLE AS asf, NULL::DOUBLE AS att, TRUE AS hb, FALSE AS ha
  FROM lb WHERE (pair_id, detector, fl, fd) NOT IN (SELECT (pair_id, detector, fl, fd) FROM fam)
  UNION ALL
  SELECT pair_id, detector, location, detail, 'exact', NULL, NULL, self_ms, total_ms, FALSE, TRUE
  FROM la WHERE (pair_id, detector, fl, fd) NOT IN (SELECT (pair_id, detector, fl, fd) FROM fam)),
pairs AS (SELECT * FROM exact UNION ALL SELECT * FROM by_family UNION ALL SELECT * FROM alone),
judged AS (
  SELECT *, CASE WHEN metric = 'self_ms' THEN bs ELSE bt END AS before_ms,
         CASE WHEN metric = 'self_ms' THEN asf ELSE att END AS after_ms
  FROM (SELECT *, CASE WHEN asf IS NOT NULL OR (NOT ha AND bs IS NOT NULL) THEN 'self_ms'
                       ELSE 'total_ms' END AS metric FROM pairs)),
moved AS (
  SELECT *, CAST(CAST(round(coalesce(after_ms, 0) * 100.0) AS BIGINT)
                 - CAST(round(coalesce(before_ms, 0) * 100.0) AS BIGINT) AS DOUBLE) / 100.0
           AS delta_ms FROM judged),
changes AS (
  SELECT pair_id, detector, location, nullif(detail, '') AS detail, metric,
         CASE WHEN NOT hb THEN 'appeared' WHEN NOT ha THEN 'vanished'
              WHEN abs(delta_ms) < greatest(5.0, 0.1 * coalesce(before_ms, 0)) THEN 'steady'
              WHEN delta_ms > 0 THEN 'grew' ELSE 'shrank' END AS change,
         matched_by, before_ms, after_ms, delta_ms,
         CASE WHEN hb AND ha AND before_ms <> 0
              THEN round(coalesce(after_ms, 0) / before_ms, 2) END AS ratio, hb, ha
  FROM moved)"""

BANDS_SQL = """
bands AS (
  SELECT scenario_id, detector, location, identity_detail, metric, min(v) AS lo, max(v) AS hi
  FROM longf GROUP BY scenario_id, detector, location, identity_detail, metric)"""


def _q(body: str, *ctes: str) -> str:
    return with_(bridge(), CHILD_SQL, OUTLIER_SQL, SHARED_SQL, FRAMES_SQL, STALL_SQL, FINDINGS_SQL, *ctes, body=body)


def _compare_exact(spark, sf):
    before, after = _sides(settle(merged(spark, sf)))
    pairs = cmp.pair_rows(before, after)
    return pairs.groupBy("pair_id", "detector", "matched_by").agg(
        F.count(F.lit(1)).alias("pairs"), F.count("b").alias("with_before"),
        F.count("a").alias("with_after"))


def _spread_flat(spark, sf):
    s = sample(spark, sf)
    return rep.spread(s.findings, s.traces).select(
        "scenario_id", "detector", "location", "identity_detail", "metric", "min", "max",
        F.concat_ws(",", F.transform("values", lambda x: F.round(x * 100).cast("long")
                                     .cast("string"))).alias("values_text"))


def _evidence(spark, sf):
    """Evidence of all detectors, from the worst repeat."""
    return merged(spark, sf).select("scenario_id", "detector", "location", "detail", "runs", "max_ms")


def _overlap(spark, sf):
    return cmp.range_overlap(changes(spark, sf, True)).select(
        "pair_id", "detector", "location", "detail", "change", "matched_by", "overlap")


def _worst_only(spark, sf):
    """Only the worst row of each detector and side, so that most names differ between the sides."""
    rows = rep.ranked(merged(spark, sf), limit=1).drop("place")
    before, after = _sides(settle(rows))
    return cmp.classify_changes(cmp.pair_rows(before, after)).drop("a", "b")


def _flat_changes(spark, sf):
    return changes(spark, sf).drop("a", "b")


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All detectors run on both sides, but for one which the after side of p1 lacks. The bar of one
    follows what it found, as a calibrated one would."""
    m = merged(spark, sf).withColumns({"pair_id": F.substring("scenario_id", 1, 2),
                                       "side": F.substring("scenario_id", 4, 6)})
    tops = settle(m.groupBy("pair_id", "side").agg(
        F.max(F.when(F.col("detector") == "gc_pressure", F.col("total_ms"))).alias("top")))
    bar = F.when(F.col("detector") == "gc_pressure", F.col("top").cast("long").cast("string")).otherwise("16")
    ran = tops.select("pair_id", "side", "top", F.explode(F.array(*[F.lit(n) for n in DETECTORS])).alias("detector")).where(
        ~((F.col("detector") == "anr") & (F.col("pair_id") == "p1") & (F.col("side") == "after")))
    ran = ran.select("pair_id", "side", "detector", F.create_map(
        F.lit("bar"), bar, F.lit("floor"), F.lit("5")).alias("params"))
    return ran.where("side = 'before'").drop("side"), ran.where("side = 'after'").drop("side")


def _heads(spark, sf):
    s = sample(spark, sf)
    win = rep.merge_windows(s.window, s.traces)
    d = win.withColumns({"pair_id": F.substring("scenario_id", 1, 2),
                         "side": F.substring("scenario_id", 4, 6)})
    d = settle(d.select("pair_id", "side", "duration_ms", F.col("repeats").cast("int").alias("runs")))
    return d.where("side = 'before'"), d.where("side = 'after'")


def _window_delta(spark, sf):
    return cmp.window_delta(*_heads(spark, sf))


def _warnings(spark, sf):
    b, a = _heads(spark, sf)
    rb, ra = _runs(spark, sf)

    def head(d, sha, side):
        return d.select(
            "pair_id", F.concat(F.lit("app."), F.when(F.col("pair_id") == "p1", F.lit(sha))
                                .otherwise(F.lit("x"))).alias("process"),
            F.when((F.col("pair_id") == "p2") & F.lit(side == "after"), 1).otherwise(F.col("runs")).alias("runs"),
            F.lit(sha).alias("config_sha"),
            ((F.col("pair_id") == "p0") & F.lit(side == "after")).alias("defaults"),
            F.when(F.col("pair_id") == "p2", 0).otherwise(1).cast("long").alias("start_matches"))
    planted = cmp.planted_rows(changes(spark, sf), "purchase")
    return cmp.compare_warnings(head(b, "s1", "before"), head(a, "s2", "after"), rb, ra, planted)


def _param_diff(spark, sf):
    return cmp.param_diff(*_runs(spark, sf))


def _state(spark, sf):
    """One side measured with a bar nothing passes, so that detectors fall silent."""
    s = sample(spark, sf)
    d = s.findings.join(s.traces, "trace_id").where(
        (F.col("side") == "before") | (F.col("detector") != "gc_pressure"))
    d = settle(d.select("pair_id", "side", "detector", "location"))
    ran = s.findings.join(s.traces, "trace_id").select("pair_id", "detector").distinct()
    return cmp.state_changes(d.where("side = 'before'"), d.where("side = 'after'"), ran, ran)


def _summary(spark, sf):
    s = sample(spark, sf)
    f = s.findings.withColumnRenamed("trace_id", "report_id")
    ran = s.window.select(F.col("trace_id").alias("report_id"), F.explode(F.array(
        *[F.lit(n) for n in DETECTORS])).alias("detector"))
    return rep.report_summary(f, ran, [*DETECTORS, "not_installed"])


def _calibrate_ctx(spark, sf):
    return ctx(spark, sf)


def _calibrate_topn(spark, sf):
    rows = cal.measure_open(_calibrate_ctx(spark, sf), "main_thread_block")
    return cal.nth_largest(rows, ["detector"], "self_ms", 10)


def _calibrate_percentile(spark, sf):
    rows = cal.measure_open(_calibrate_ctx(spark, sf), "binder_txn", {
        k: PARAMS["binder_txn"][k] for k in ("name_glob", "skip_glob")})
    return cal.interp_percentile(rows, ["detector"], "max_ms", 90).select(
        "detector", "n", F.round("value", 6).alias("value"))


_GLOBS = {d: {k: v for k, v in PARAMS[d].items()
              if "glob" in k or k in ("factor", "min_occurrences", "max_covered_pct",
                                      "min_overrun_ms")} for d in PARAMS}


def _thresholds(spark, sf):
    return cal.propose_thresholds(_calibrate_ctx(spark, sf).settled(), params=_GLOBS)


def _measured_sql() -> str:
    opened = {
        "main_thread_block": block_sql(0, None),
        "binder_txn": binder_sql(0, 0, None),
        "gc_pressure": gc_sql(0, 0, None),
        "monitor_contention": monitor_sql(None).replace("8000000", "0").replace("50000000", "0"),
        "runnable_starvation": starvation_sql(None).replace("20000000", "0"),
        "main_thread_outlier": outlier_sql(None),
        "uninstrumented_cpu": blind_sql(None).replace("50000000", "0"),
        "frame_jank": jank_sql(0, None),
    }
    union = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in opened.values())
    cols = sorted({r.column for r in cal.RULES})
    longm = " UNION ALL ".join(
        f"SELECT detector, '{c}' AS metric, CAST(\"{c}\" AS DOUBLE) AS v FROM measured "
        f"WHERE \"{c}\" IS NOT NULL" for c in cols)
    return f"measured AS ({union}), longm AS ({longm})"


def _threshold_sql() -> str:
    rows = ", ".join(
        f"('{r.detector}', '{r.param}', '{r.column}', {float(r.factor)}, "
        f"{float(defaults_of(DETECTORS[r.detector])[r.param])})" for r in cal.RULES)
    return f"""
SELECT detector, param, {big('coalesce(n, 0)')} AS sample, stat AS statistic, status,
       CASE WHEN status = 'derived' THEN proposed ELSE dflt END AS threshold
FROM (SELECT *, CASE WHEN coalesce(n, 0) < 10 THEN 'small_sample'
                     WHEN coalesce(proposed, 0) < 1 THEN 'degenerate' ELSE 'derived' END AS status
      FROM (SELECT r.*, s.n, s.stat,
                   CASE WHEN r.metric = 'count' THEN round_even(s.stat * r.factor, 0)
                        ELSE round(s.stat * r.factor, 1) END AS proposed
            FROM (VALUES {rows}) r(detector, param, metric, factor, dflt)
            LEFT JOIN (SELECT detector, metric, count(*) AS n,
                              max(CASE WHEN rk = 10 THEN v END) AS stat
                       FROM (SELECT *, row_number() OVER (PARTITION BY detector, metric
                                                          ORDER BY v DESC) AS rk FROM longm)
                       GROUP BY detector, metric) s
              ON s.detector = r.detector AND s.metric = r.metric))"""


_OUT0 = OUTLIER_SQL.replace("d >= 40000000000 AND ", "")
_CAL_CTES = (CHILD_SQL, _OUT0, SHARED_SQL, FRAMES_SQL)


def _cq(body: str) -> str:
    return with_(bridge(), *_CAL_CTES, _measured_sql(), body=body)


# ---- report history -------------------------------------------------------------------------

def investigations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as reports of investigations: one investigation per customer, opened by the first."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.col("o_custkey").alias("investigation"), F.col("o_orderkey").alias("report_id"),
                    F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
                    F.col("o_orderpriority").alias("question"))


def _pick_pair(spark, sf):
    reports = hist.number_reports(investigations(spark, sf), "investigation", ["us", "report_id"],
                                  time_cell("us", 30 * 24 * LOG_CELL_US))
    return hist.pick_pair(reports, "first_last").unionByName(hist.pick_pair(reports, "latest_two"))


def _identity(spark, sf):
    """A detector of one's own whose rows are told apart by location and depth. The before side was written
    by an older version which knew the location alone."""
    c = ctx(spark, sf)
    found = custom_detector(c, OWN, name="by_depth", identity=("location", "depth"), limit=None)
    m = settle(rep.merge_repeats(found, _traces(c.window), with_spread=False))
    before, after = _sides(m)
    old = before.where("identity['depth'] = '0'").withColumn("identity", F.create_map(F.lit("location"), F.col("location")))
    new = cmp.pair_rows(before, after).withColumn("written", F.lit("both new"))
    upgraded = cmp.pair_rows(old, after).withColumn("written", F.lit("before old"))
    return new.unionByName(upgraded).select(
        "written", "pair_id", "key_location", F.concat_ws(",", "key_more").alias("depth"), "matched_by",
        "ordinal", F.col("b.total_ms").alias("before_ms"), F.col("a.total_ms").alias("after_ms"))


OWN = """
SELECT trace_id, name AS location, CAST(depth AS STRING) AS depth, count(*) AS count,
       CAST(sum(dur_win) DIV 1000000 AS DOUBLE) AS total_ms
FROM (SELECT trace_id, split(name, ' ')[0] AS name, slice_id % 3 AS depth, dur_win FROM slice_win)
GROUP BY trace_id, name, depth"""

BROKEN = """
SELECT trace_id, name AS location, count(*) AS count, CAST(CAST(max(name) AS INT) AS DOUBLE) AS total_ms
FROM slice_win GROUP BY trace_id, name"""


def _guarded(spark, sf):
    """One detector fails on its rows and one on its parameters; the others are not taken down."""
    c = ctx(spark, sf).settled()
    return guarded(run_detectors(c, overrides=PARAMS | {"anr_risk": {"min_stall_ms": 600_000, "max_gap_ms": -1}},
                                 extra={"broken": lambda c: custom_detector(c, BROKEN, name="broken")}))


def _guarded_runs(spark, sf):
    done = _guarded(spark, sf)
    rows = done.findings.groupBy("detector").agg(F.count(F.lit(1)).alias("rows"))
    ran = spark.createDataFrame([(r["detector"], r["params_source"], r["error"] is not None) for r in done.runs],
                                "detector string, params_source string, failed boolean")
    return ran.join(rows, "detector", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))


def _faces(spark, sf):
    d = cmp.faces(cmp.range_overlap(changes(spark, sf, True))).where("matched_by = 'exact'")
    return d.select("pair_id", "detector", "location", "detail", *[
        F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("before", "after") for c in ("value", "min", "max", "runs")])


def _ordered(spark, sf):
    """The order as a column: changes of one pair carry their place."""
    d = cmp.ordered_changes(changes(spark, sf).drop("a", "b"))
    return d.select("pair_id", "detector", "location", "detail", "delta_ms", F.row_number().over(
        Window.partitionBy("pair_id").orderBy(*cmp.largest_move())).alias("place"))


def _merged_runs(spark, sf):
    """Detector runs of every day, some of which failed."""
    w = _traces(ctx(spark, sf).window)
    runs = w.select("scenario_id", "repeat_no", F.explode(F.array(*[F.lit(n) for n in DETECTORS])).alias("detector"))
    bad = (F.length("detector") + F.col("repeat_no")) % 4 != 0
    return rep.merged_detector_runs(runs.select(
        "scenario_id", "repeat_no", "detector",
        F.create_map(F.lit("day"), F.col("repeat_no").cast("string")).alias("params"),
        F.when(F.col("repeat_no") % 2 == 0, "call").otherwise("default").alias("params_source"),
        F.array(F.lit("location")).alias("identity"),
        F.when(bad, F.concat(F.lit("failed on day "), F.col("repeat_no").cast("string"))).alias("error"))).select(
        "scenario_id", "detector", F.col("params")["day"].alias("day"), "params_source", "error")


def _silent(spark, sf):
    s = sample(spark, sf)
    f = s.findings.join(s.traces, "trace_id").withColumnRenamed("scenario_id", "report_id")
    f = f.where("not (detector = 'frame_jank' and pair_id = 'p0')")
    ran = s.traces.select(F.col("scenario_id").alias("report_id"), F.explode(F.array(
        *[F.lit(n) for n in DETECTORS])).alias("detector"))
    summary = rep.report_summary(f, ran, list(DETECTORS)).withColumns({
        "pair_id": F.substring("report_id", 1, 2), "side": F.substring("report_id", 4, 6)})
    return cmp.silent_in_both(summary)


def _find(spark, sf):
    h = investigations(spark, sf).groupBy("investigation").agg(
        F.max_by("question", F.struct("us", "report_id")).alias("question"),
        F.min("us").alias("opened_us")).withColumnRenamed("investigation", "n")
    return hist.find_investigation(h, "urgent").unionByName(hist.find_investigation(h, "7"))


_HIST_SQL = """
reports AS (
  SELECT o_custkey AS investigation, o_orderkey AS report_id, epoch_us(o_orderdate) AS us,
         o_orderpriority AS question,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back,
         count(*) OVER (PARTITION BY o_custkey) AS n
  FROM orders)"""

MERGED_BODY = """
SELECT * EXCLUDE (identity_detail), CASE WHEN identity_detail <> ''
       THEN CAST(to_json({'location': location, 'detail': identity_detail}) AS VARCHAR)
       ELSE CAST(to_json({'location': location}) AS VARCHAR) END AS identity FROM merged"""


def merged_sql(body: str) -> str:
    return _q(body)


_OWN_SQL = f"""
found AS (
  SELECT trace_id, split_part(name, ' ', 1) AS location, CAST(slice_id % 3 AS VARCHAR) AS depth,
         CAST(sum(dur_win) // 1000000 AS BIGINT) AS total
  FROM slice_win GROUP BY ALL),
sided AS (
  SELECT f.*, 'p' || CAST(substr(trace_id, 9, 2) AS INTEGER) % 3 AS pair_id,
         CAST(substr(trace_id, 9, 2) AS INTEGER) <= 15 AS early FROM found f),
mid AS (
  SELECT pair_id, early, location, depth, CAST({scaled("(list_sort(list(total * 100))[(count(*) + 1) // 2] + list_sort(list(total * 100))[count(*) // 2 + 1])", 2)} AS DOUBLE) / 100.0 AS ms
  FROM sided GROUP BY ALL),
olds AS (SELECT * FROM mid WHERE early AND depth = '0'),
news AS (SELECT *, row_number() OVER (PARTITION BY pair_id, location ORDER BY ms DESC) AS k FROM mid WHERE NOT early)"""

QUERIES = {
    "compare_identity": (_identity, with_(bridge(), _OWN_SQL, body="""
        SELECT 'both new' AS written, coalesce(b.pair_id, a.pair_id) AS pair_id,
               coalesce(b.location, a.location) AS key_location, coalesce(b.depth, a.depth) AS depth,
               'exact' AS matched_by, 1 AS ordinal, b.ms AS before_ms, a.ms AS after_ms
        FROM (SELECT * FROM mid WHERE early) b FULL JOIN (SELECT * FROM mid WHERE NOT early) a
          USING (pair_id, location, depth)
        UNION ALL
        SELECT 'before old', coalesce(b.pair_id, a.pair_id), coalesce(b.location, a.location), '', 'exact',
               CAST(coalesce(a.k, 1) AS INTEGER), b.ms, a.ms
        FROM olds b FULL JOIN news a ON a.pair_id = b.pair_id AND a.location = b.location AND a.k = 1""")),
    "guarded_detectors": (
        lambda s, d: _guarded(s, d).findings.select(*COLUMNS),
        with_(bridge(), CHILD_SQL, OUTLIER_SQL, SHARED_SQL, FRAMES_SQL, body=" UNION ALL ".join(
            f"SELECT * FROM ({q})" for q in (block_sql(), outlier_sql(), gc_sql(), monitor_sql(), binder_sql(),
                                             starvation_sql(), blind_sql(), jank_sql(), anr_sql())))),
    "guarded_runs": (_guarded_runs, with_(bridge(), CHILD_SQL, OUTLIER_SQL, SHARED_SQL, FRAMES_SQL, body=f"""
        SELECT detector, CASE WHEN detector IN ({", ".join(f"'{d}'" for d in [*PARAMS, "broken"] if d == "broken" or PARAMS[d])})
                         THEN 'call' ELSE 'default' END AS params_source,
               detector IN ('anr_risk', 'broken') AS failed, {big("coalesce(n, 0)")} AS "rows"
        FROM (VALUES {", ".join(f"('{d}')" for d in [*DETECTORS, "broken"])}) d(detector)
        LEFT JOIN (SELECT detector, count(*) AS n FROM ({" UNION ALL ".join(
            f"SELECT * FROM ({q})" for q in (block_sql(), outlier_sql(), gc_sql(), monitor_sql(), binder_sql(),
                                             starvation_sql(), blind_sql(), jank_sql(), anr_sql()))})
                   GROUP BY detector) USING (detector)""")),
    "faces": (_faces, _q("""
        SELECT c.pair_id, c.detector, c.location, c.detail, c.before_ms AS before_value, c.after_ms AS after_value,
               b.lo / 100.0 AS before_min, b.hi / 100.0 AS before_max, a.lo / 100.0 AS after_min, a.hi / 100.0 AS after_max,
               mb.runs AS before_runs, ma.runs AS after_runs
        FROM (SELECT *, coalesce(detail, '') AS dk FROM changes WHERE matched_by = 'exact') c
        LEFT JOIN (SELECT *, substr(scenario_id, 1, 2) AS pair_id FROM bands WHERE scenario_id LIKE '%before') b
          ON b.pair_id = c.pair_id AND b.detector = c.detector AND b.metric = c.metric AND b.location = c.location AND b.identity_detail = c.dk
        LEFT JOIN (SELECT *, substr(scenario_id, 1, 2) AS pair_id FROM bands WHERE scenario_id LIKE '%after') a
          ON a.pair_id = c.pair_id AND a.detector = c.detector AND a.metric = c.metric AND a.location = c.location AND a.identity_detail = c.dk
        LEFT JOIN b mb ON mb.pair_id = c.pair_id AND mb.detector = c.detector AND mb.location = c.location AND mb.detail = c.dk
        LEFT JOIN a ma ON ma.pair_id = c.pair_id AND ma.detector = c.detector AND ma.location = c.location AND ma.detail = c.dk""",
        PAIRS_SQL, BANDS_SQL)),
    "ordered_changes": (_ordered, _q("""
        SELECT pair_id, detector, location, detail, delta_ms, CAST(rank() OVER (
                 PARTITION BY pair_id ORDER BY abs(delta_ms) DESC, detector, location, coalesce(detail, '')) AS INTEGER) AS place
        FROM changes""", PAIRS_SQL)),
    "merged_detector_runs": (_merged_runs, _q(f"""
        SELECT scenario_id, detector,
               CAST(first(repeat_no ORDER BY bad, repeat_no) AS VARCHAR) AS day,
               first(CASE WHEN repeat_no % 2 = 0 THEN 'call' ELSE 'default' END ORDER BY bad, repeat_no) AS params_source,
               'failed on day ' || min(repeat_no) FILTER (bad) AS error
        FROM (SELECT *, (length(detector) + repeat_no) % 4 <> 0 AS bad
              FROM traces, (VALUES {', '.join(f"('{n}')" for n in DETECTORS)}) d(detector))
        GROUP BY scenario_id, detector""")),
    "silent_in_both": (_silent, _q(f"""
        SELECT p.pair_id, d.detector
        FROM (SELECT substr(scenario_id, 1, 2) AS pair_id FROM traces GROUP BY 1
              HAVING count(DISTINCT scenario_id) = 2) p, (VALUES {', '.join(f"('{n}')" for n in DETECTORS)}) d(detector)
        WHERE (p.pair_id = 'p0' AND d.detector = 'frame_jank')
           OR (p.pair_id, d.detector) NOT IN (SELECT (substr(scenario_id, 1, 2), detector) FROM keyed)""")),
    "calibrate_topn": (_calibrate_topn, _cq(
        "SELECT detector, v AS value FROM (SELECT *, row_number() OVER (ORDER BY v DESC) AS rk "
        "FROM longm WHERE detector = 'main_thread_block' AND metric = 'self_ms') WHERE rk = 10")),
    "calibrate_percentile": (_calibrate_percentile, _cq(
        f"SELECT detector, {big('count(*)')} AS n, round(quantile_cont(v, 0.9), 6) AS value FROM "
        f"longm WHERE detector = 'binder_txn' AND metric = 'max_ms' GROUP BY detector")),
    "calibrate_thresholds": (_thresholds, _cq(_threshold_sql())),
    "divergent_windows": (
        lambda s, d: cal.divergent_windows(ctx(s, d).window.withColumn(
            "scenario_id", F.substring("trace_id", 1, 7)), ["scenario_id"]),
        with_(bridge(), body=f"""
          SELECT substr(trace_id, 1, 7) AS scenario_id, {big('count(*)')} AS traces,
                 {ms('min(ts_end - ts_start)')} AS min_ms, {ms('max(ts_end - ts_start)')} AS max_ms,
                 count(*) > 1 AND max(ts_end - ts_start) > 2 * min(ts_end - ts_start) AS divergent
          FROM win GROUP BY 1""")),
    "merge_repeats": (_merged, _q(MERGED_BODY)),
    "merge_spread": (_spread_flat, _q("""
        SELECT scenario_id, detector, location, identity_detail, metric,
               CAST(min(v) AS DOUBLE) / 100.0 AS "min", CAST(max(v) AS DOUBLE) / 100.0 AS "max",
               string_agg(CAST(v AS VARCHAR), ',' ORDER BY repeat_no, v) AS values_text
        FROM longf WHERE metric IN ('self_ms', 'total_ms', 'max_ms')
        GROUP BY scenario_id, detector, location, identity_detail, metric""")),
    "merge_worst_evidence": (_evidence, _q(
        "SELECT scenario_id, detector, location, detail, runs, max_ms FROM merged")),
    "merge_window": (
        lambda s, d: _merge_window(s, d),
        _q(f"""
        SELECT scenario_id, {big('count(*)')} AS repeats,
               CAST({scaled("(sum(CASE WHEN rk = (n + 1) // 2 THEN v ELSE 0 END) + sum(CASE WHEN rk = n // 2 + 1 THEN v ELSE 0 END))", 2)} AS DOUBLE) / 100.0 AS duration_ms,
               CAST(min(v) AS DOUBLE) / 100.0 AS duration_ms_min,
               CAST(max(v) AS DOUBLE) / 100.0 AS duration_ms_max, max(v) > 2 * min(v) AS divergent
        FROM (SELECT scenario_id, v, row_number() OVER (PARTITION BY scenario_id ORDER BY v) AS rk,
                     count(*) OVER (PARTITION BY scenario_id) AS n
              FROM (SELECT t.scenario_id, CAST(round((w.ts_end - w.ts_start) / 1e6 * 100) AS BIGINT) AS v
                    FROM win w JOIN traces t ON t.trace_id = w.trace_id))
        GROUP BY scenario_id""")),
    "report_summary": (_summary, _q(f"""
        SELECT w.trace_id AS report_id, d.detector, {big('coalesce(f.n, 0)')} AS "rows",
               CASE WHEN d.detector = 'not_installed' THEN 'absent' WHEN f.n > 0 THEN 'fired' ELSE 'silent' END AS state
        FROM win w CROSS JOIN (VALUES {', '.join(f"('{n}')" for n in [*DETECTORS, 'not_installed'])}) d(detector)
        LEFT JOIN (SELECT trace_id, detector, count(*) AS n FROM findings
                   GROUP BY trace_id, detector) f
          ON f.trace_id = w.trace_id AND f.detector = d.detector""")),
    "compare_exact": (_compare_exact, _q(f"""
        SELECT pair_id, detector, matched_by, {big('count(*)')} AS pairs,
               {big('count(*) FILTER (hb)')} AS with_before, {big('count(*) FILTER (ha)')} AS with_after
        FROM changes GROUP BY pair_id, detector, matched_by""", PAIRS_SQL)),
    "compare_family": (_worst_only, _q(
        "SELECT * EXCLUDE (hb, ha) FROM changes", """
        worst AS (SELECT * FROM (SELECT *, row_number() OVER (
                    PARTITION BY scenario_id, detector
                    ORDER BY coalesce(self_ms, total_ms, 0) DESC, location, detail) AS rk
                  FROM merged) WHERE rk = 1)""", PAIRS_SQL.replace("FROM merged", "FROM worst"))),
    "compare_changes": (_flat_changes, _q("SELECT * EXCLUDE (hb, ha) FROM changes", PAIRS_SQL)),
    "compare_overlap": (_overlap, _q("""
        SELECT c.pair_id, c.detector, c.location, c.detail, c.change, c.matched_by,
               CASE WHEN c.hb AND c.ha THEN NOT (a.hi IS NOT NULL AND b.hi IS NOT NULL
                    AND (a.hi < b.lo OR b.hi < a.lo)) END AS overlap
        FROM changes c
        LEFT JOIN (SELECT *, substr(scenario_id, 1, 2) AS pair_id
                   FROM bands WHERE scenario_id LIKE '%before') b
          ON b.pair_id = c.pair_id AND b.detector = c.detector AND b.metric = c.metric
         AND b.location = c.bl AND b.identity_detail = c.bd
        LEFT JOIN (SELECT *, substr(scenario_id, 1, 2) AS pair_id
                   FROM bands WHERE scenario_id LIKE '%after') a
          ON a.pair_id = c.pair_id AND a.detector = c.detector AND a.metric = c.metric
         AND a.location = c.al AND a.identity_detail = c.ad""",
        PAIRS_SQL.replace("SELECT b.pair_id,", "SELECT b.location AS bl, b.detail AS bd, a.location AS al, a.detail AS ad, b.pair_id,")
        .replace("SELECT f.pair_id,", "SELECT lb.location AS bl, lb.detail AS bd, la.location AS al, la.detail AS ad, f.pair_id,")
        .replace("SELECT pair_id, detector, location, detail, 'exact' AS", "SELECT location AS bl, detail AS bd, NULL AS al, NULL AS ad, pair_id, detector, location, detail, 'exact' AS")
        .replace("SELECT pair_id, detector, location, detail, 'exact', NULL", "SELECT NULL, NULL, location, detail, pair_id, detector, location, detail, 'exact', NULL")
        .replace("SELECT pair_id, detector, location, nullif", "SELECT bl, bd, al, ad, pair_id, detector, location, nullif"), BANDS_SQL)),
    "compare_summary": (
        lambda s, d: cmp.compare_summary(changes(s, d)),
        _q(f"""
        SELECT pair_id, {big("count(*) FILTER (change IN ('grew', 'shrank'))")} AS moved,
               {big("count(*) FILTER (change = 'appeared')")} AS appeared,
               {big("count(*) FILTER (change = 'vanished')")} AS vanished,
               {big("count(*) FILTER (change = 'steady')")} AS steady,
               string_agg(DISTINCT CASE WHEN hb THEN detector END, ',' ORDER BY CASE WHEN hb THEN detector END) AS fired_before,
               string_agg(DISTINCT CASE WHEN ha THEN detector END, ',' ORDER BY CASE WHEN ha THEN detector END) AS fired_after
        FROM changes GROUP BY pair_id""", PAIRS_SQL)),
    "compare_planted": (
        lambda s, d: cmp.planted_rows(changes(s, d), "purchase").drop("a", "b"),
        _q("""SELECT * EXCLUDE (hb, ha) FROM changes
              WHERE change = 'appeared' AND location LIKE 'purchase%'""", PAIRS_SQL)),
    "compare_state": (_state, _q(f"""
        SELECT pair_id, detector, {big("count(*) FILTER (side = 'before')")} AS rows_before,
               {big("count(*) FILTER (side = 'after' AND detector <> 'gc_pressure')")} AS rows_after
        FROM (SELECT f.detector, substr(t.scenario_id, 1, 2) AS pair_id,
                     substr(t.scenario_id, 4) AS side
              FROM findings f JOIN traces t ON t.trace_id = f.trace_id)
        GROUP BY pair_id, detector
        HAVING (count(*) FILTER (side = 'before') > 0)
            <> (count(*) FILTER (side = 'after' AND detector <> 'gc_pressure') > 0)""")),
    "compare_params": (_param_diff, _q("""
        SELECT b.pair_id, b.detector, 'bar' AS param, b.was, a.was AS "now"
        FROM (SELECT substr(scenario_id, 1, 2) AS pair_id, detector, CASE WHEN detector = 'gc_pressure'
                THEN CAST(CAST(trunc(max(total_ms)) AS BIGINT) AS VARCHAR) ELSE '16' END AS was
              FROM merged WHERE scenario_id LIKE '%before' GROUP BY 1, 2) b
        JOIN (SELECT substr(scenario_id, 1, 2) AS pair_id, detector, CASE WHEN detector = 'gc_pressure'
                THEN CAST(CAST(trunc(max(total_ms)) AS BIGINT) AS VARCHAR) ELSE '16' END AS was
              FROM merged WHERE scenario_id LIKE '%after' GROUP BY 1, 2) a
          USING (pair_id, detector)
        WHERE b.was <> a.was""")),
    "compare_warnings": (_warnings, _q("""
        SELECT pair_id, id, id <> 'process' AS comparable FROM (
          SELECT DISTINCT pair_id, unnest(CASE pair_id WHEN 'p0' THEN ['config', 'defaults']
                 WHEN 'p1' THEN ['process', 'config', 'detectors']
                 WHEN 'p2' THEN ['anchor-before', 'anchor-after', 'config', 'single'] END) AS id
          FROM (SELECT DISTINCT substr(scenario_id, 1, 2) AS pair_id FROM traces)
          UNION ALL
          SELECT DISTINCT b.pair_id, 'thresholds' FROM
            (SELECT substr(scenario_id, 1, 2) AS pair_id, trunc(max(total_ms)) AS x FROM merged
             WHERE detector = 'gc_pressure' AND scenario_id LIKE '%before' GROUP BY 1) b
            JOIN (SELECT substr(scenario_id, 1, 2) AS pair_id, trunc(max(total_ms)) AS x FROM merged
             WHERE detector = 'gc_pressure' AND scenario_id LIKE '%after' GROUP BY 1) a
            USING (pair_id) WHERE a.x <> b.x
          UNION ALL
          SELECT DISTINCT pair_id, 'instrumentation' FROM changes WHERE change = 'appeared' AND location LIKE 'purchase%'
          UNION ALL
          SELECT b.pair_id, 'runs' FROM
            (SELECT substr(scenario_id, 1, 2) AS pair_id, count(*) AS n FROM traces
             WHERE scenario_id LIKE '%before' GROUP BY 1) b
            JOIN (SELECT substr(scenario_id, 1, 2) AS pair_id, count(*) AS n FROM traces
             WHERE scenario_id LIKE '%after' GROUP BY 1) a USING (pair_id) WHERE a.n <> b.n OR b.pair_id = 'p2')""", PAIRS_SQL)),
    "compare_window": (_window_delta, _q(f"""
        SELECT b.pair_id, b.d AS before_ms, a.d AS after_ms,
               CAST(CAST(round(a.d * 100) AS BIGINT) - CAST(round(b.d * 100) AS BIGINT) AS DOUBLE) / 100.0 AS delta_ms,
               CASE WHEN b.d <> 0 THEN round(a.d / b.d, 2) END AS ratio
        FROM mw b JOIN mw a ON a.pair_id = b.pair_id AND b.side = 'before' AND a.side = 'after'""",
        f"""mw AS (SELECT substr(scenario_id, 1, 2) AS pair_id, substr(scenario_id, 4) AS side,
               CAST({scaled("(sum(CASE WHEN rk = (n + 1) // 2 THEN v ELSE 0 END) + sum(CASE WHEN rk = n // 2 + 1 THEN v ELSE 0 END))", 2)} AS DOUBLE) / 100.0 AS d
        FROM (SELECT scenario_id, v, row_number() OVER (PARTITION BY scenario_id ORDER BY v) AS rk,
                     count(*) OVER (PARTITION BY scenario_id) AS n
              FROM (SELECT t.scenario_id, CAST(round((w.ts_end - w.ts_start) / 1e6 * 100) AS BIGINT) AS v
                    FROM win w JOIN traces t ON t.trace_id = w.trace_id))
        GROUP BY scenario_id)""")),
    "pick_pair": (_pick_pair, with_(_HIST_SQL, body=f"""
        SELECT investigation, 'first_last' AS mode, max(CASE WHEN seq = 1 THEN report_id END) AS before_id,
               max(CASE WHEN back = 1 THEN report_id END) AS after_id
        FROM reports WHERE n >= 2 GROUP BY investigation
        UNION ALL
        SELECT investigation, 'latest_two', max(CASE WHEN back = 2 THEN report_id END),
               max(CASE WHEN back = 1 THEN report_id END)
        FROM reports WHERE n >= 2 GROUP BY investigation""")),
    "find_investigation": (_find, with_(_HIST_SQL, """
        inv AS (SELECT investigation AS n, max(CASE WHEN back = 1 THEN question END) AS question,
                       min(us) AS opened_us FROM reports GROUP BY investigation)""", body="""
        SELECT * FROM (SELECT n, question, opened_us FROM inv
                       WHERE contains(lower(question), 'urgent')
                       ORDER BY n DESC, opened_us DESC LIMIT 1)
        UNION ALL SELECT n, question, opened_us FROM inv WHERE n = 7""")),
}


def _merge_window(spark, sf):
    c = ctx(spark, sf)
    return rep.merge_windows(c.window, _traces(c.window))
