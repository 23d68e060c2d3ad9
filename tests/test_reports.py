import pytest

from spanmeter.operators import compare as cmp
from spanmeter.operators import repeats as rep
from spanmeter.operators.analyze import analyze
from spanmeter.operators.detectors import IDENTITY
from spanmeter.sources import history as hist
from spanmeter.sources.readers import TraceTables, load_report, load_traces
from spanmeter.sources.schemas import FINDING, REPORT_FINDING
from spanmeter.sources.writers import append_report, nested, write_report
from spanmeter.functions.ordered import time_cell

from planted import rows as planted_rows
from spanmeter.sources.schemas import TRACE_TABLES


def findings(spark, rows):
    """(trace, detector, location, self, total, max, detail)"""
    return spark.createDataFrame(
        [(t, d, loc, 1, s, tot, m, None, det, None) for t, d, loc, s, tot, m, det in rows], FINDING)


def repeats(spark, n, scenario="s"):
    return spark.createDataFrame([(f"t{i}", scenario, i) for i in range(1, n + 1)],
                                 "trace_id string, scenario_id string, repeat_no int")


def test_median_spread_and_runs(spark):
    f = findings(spark, [
        ("t1", "main_thread_outlier", "a", None, 20.0, 20.0, "small"),
        ("t2", "main_thread_outlier", "a", None, 890.0, 890.0, "worst"),
        ("t3", "main_thread_outlier", "a", None, 21.0, 21.0, "mid"),
        ("t2", "main_thread_outlier", "once", None, 77.0, 77.0, "x")])
    got = {r.location: r for r in rep.merge_repeats(f, repeats(spark, 3)).collect()}
    a = got["a"]
    assert (a.max_ms, a.runs, a.runs_total, a.detail) == (21.0, 3, 3, "worst")
    assert a.spread["max_ms"]["values"] == [20.0, 890.0, 21.0]
    assert (a.spread["max_ms"]["min"], a.spread["max_ms"]["max"]) == (20.0, 890.0)
    assert (got["once"].runs, got["once"].total_ms) == (1, 77.0)


def test_identity_keeps_details_apart_and_even_medians(spark):
    f = findings(spark, [
        ("t1", "binder_txn", "w", None, 120.0, 1.0, "main thread"),
        ("t2", "binder_txn", "w", None, 240.0, 1.0, "main thread"),
        ("t2", "binder_txn", "w", None, 5.01, 1.0, "background")])
    got = {r.detail: r for r in rep.merge_repeats(f, repeats(spark, 2)).collect()}
    assert got["main thread"].total_ms == 180.0 and got["background"].runs == 1


def test_rows_without_a_name_are_kept(spark):
    f = findings(spark, [("t1", "frame_jank", None, None, 10.0, 1.0, "d"),
                         ("t2", "frame_jank", None, None, 20.0, 1.0, "d")])
    (r,) = rep.merge_repeats(f, repeats(spark, 2)).collect()
    assert (r.location, r.total_ms, r.runs) == (None, 15.0, 2)
    assert r.spread["total_ms"]["values"] == [10.0, 20.0]
    assert rep.spread(f, repeats(spark, 2)).first().location is None
    (c,) = changed(spark, [("frame_jank", None, "", 10.0)], [("frame_jank", None, "", 90.0)]).values()
    assert (c.location, c.change, c.matched_by) == (None, "grew", "exact")


def test_a_single_repeat_stays_as_it_is(spark):
    f = findings(spark, [("t1", "anr", "w", None, 3.5, 3.5, "d")])
    (r,) = rep.merge_repeats(f, repeats(spark, 1)).collect()
    assert (r.total_ms, r.runs, r.spread) == (3.5, None, None)


def test_merged_run_takes_the_first_which_worked(spark):
    runs = spark.createDataFrame(
        [("s", "anr", 1, {"a": "default"}, "default", "boom"), ("s", "anr", 2, {"a": "7"}, "config", None)],
        "scenario_id string, detector string, repeat_no int, params map<string,string>, "
        "params_source string, error string")
    (r,) = rep.merged_detector_runs(runs).collect()
    assert (r.params, r.params_source, r.error) == ({"a": "7"}, "config", "boom")


def side(spark, rows, spread=None):
    """(detector, location, detail, total)"""
    return spark.createDataFrame(
        [("p", d, loc, det, {c: v for c, v in (("location", loc), ("detail", det)) if c in IDENTITY[d]}, 3, 3, 1.0, None, tot, tot, None,
          {"total_ms": (b[0], b[1], list(b))} if (b := (spread or {}).get(loc)) else None)
         for d, loc, det, tot in rows], REPORT_FINDING.replace("report_id", "pair_id"))


def changed(spark, before, after, **kw):
    return {(r.location, r.detail): r for r in cmp.classify_changes(
        cmp.pair_rows(side(spark, before), side(spark, after)), **kw).collect()}


def test_changes_and_noise_floors(spark):
    d = "frame_jank"
    got = changed(spark, [(d, "a", "", 100.0), (d, "b", "", 100.0), (d, "c", "", 100.0),
                          (d, "e", "", 900.0), (d, "f", "", 20.0), (d, "gone", "", 9.0)],
                  [(d, "a", "", 200.0), (d, "b", "", 50.0), (d, "c", "", 104.0),
                   (d, "e", "", 940.0), (d, "f", "", 26.0), (d, "new", "", 8.0)])
    kinds = {k[0]: r.change for k, r in got.items()}
    assert kinds == {"a": "grew", "b": "shrank", "c": "steady", "e": "steady", "f": "grew",
                     "gone": "vanished", "new": "appeared"}
    assert (got["a", None].delta_ms, got["a", None].ratio, got["new", None].ratio) == (100.0, 2.0, None)


def test_family_pairs_only_without_doubt(spark):
    d = "frame_jank"
    (r,) = changed(spark, [(d, "worker-2", "", 300.0)], [(d, "worker-5", "", 340.0)]).values()
    assert (r.change, r.matched_by, r.location) == ("grew", "family", "worker-#")
    got = changed(spark, [(d, "worker-2", "", 1.0), (d, "worker-3", "", 2.0)],
                  [(d, "worker-5", "", 3.0)])
    assert sorted(r.change for r in got.values()) == ["appeared", "vanished", "vanished"]


def test_identity_pairs_states_of_one_thread(spark):
    d = "runnable_starvation"
    got = changed(spark, [(d, "m", "state R", 100.0), (d, "m", "state R+", 30.0)],
                  [(d, "m", "state R", 105.0), (d, "m", "state R+", 400.0)])
    assert got["m", "state R"].change == "steady" and got["m", "state R+"].change == "grew"


def own(spark, rows):
    """(identity or None, total) of a detector nobody here knows"""
    return spark.createDataFrame([("p", "own", (i or {}).get("location", "A"), "evidence", i, 1, 1, 1.0, None, t, t, None, None)
                                  for i, t in rows], REPORT_FINDING.replace("report_id", "pair_id"))


def test_rows_are_named_by_what_both_reports_declare(spark):
    def kinds(before, after):
        return sorted((r.location, r.detail, r.change, r.matched_by) for r in cmp.classify_changes(
            cmp.pair_rows(own(spark, before), own(spark, after))).collect())
    x, y = {"location": "A", "state": "x"}, {"location": "A", "state": "y"}
    assert kinds([(x, 100.0), (y, 30.0)], [(y, 31.0), (x, 400.0)]) == [("A", None, "grew", "exact"), ("A", None, "steady", "exact")]
    # One side has no identity, or another column: the name alone is matched.
    assert kinds([(None, 100.0)], [(x, 300.0)]) == [("A", None, "grew", "exact")]
    assert kinds([({"location": "A", "other": "1"}, 100.0)], [(x, 300.0)]) == [("A", None, "grew", "exact")]
    assert kinds([(x, 100.0)], []) == [("A", None, "vanished", "exact")]
    # A family is told apart by the further columns too.
    w = [({"location": f"w-{k}", "state": s}, 50.0) for k, s in ((1, "x"), (2, "y"))]
    v = [({"location": f"w-{k}", "state": s}, 90.0) for k, s in ((7, "x"), (8, "y"))]
    assert kinds(w, v) == [("w-#", None, "grew", "family")] * 2


def test_duplicates_pair_in_order(spark):
    got = cmp.classify_changes(cmp.pair_rows(
        side(spark, [("frame_jank", "a", "", 1.0), ("frame_jank", "a", "", 50.0)]),
        side(spark, [("frame_jank", "a", "", 51.0)]))).collect()
    assert sorted(r.change for r in got) == ["steady", "vanished"]


def test_overlap_and_faces(spark):
    b = side(spark, [("anr", "a", "", 10.0), ("anr", "b", "", 10.0)], {"a": (8.0, 20.0), "b": (8.0, 12.0)})
    a = side(spark, [("anr", "a", "", 30.0), ("anr", "b", "", 30.0)], {"a": (19.0, 40.0), "b": (25.0, 40.0)})
    got = cmp.faces(cmp.range_overlap(cmp.classify_changes(cmp.pair_rows(b, a)))).collect()
    assert {r.location: r.overlap for r in got} == {"a": True, "b": False}
    assert {r.location: r.after["max"] for r in got} == {"a": 40.0, "b": 40.0}


def test_warnings_params_and_state(spark):
    head = "pair_id string, process string, runs int, config_sha string, defaults boolean, " \
           "start_matches long, duration_ms double"
    b = spark.createDataFrame([("p", "x", 1, "s1", False, 0, 100.0), ("q", "x", 3, "s", None, 1, 0.0)], head)
    a = spark.createDataFrame([("p", "y", 3, "s2", True, 1, 150.0), ("q", "x", 3, "s", False, 1, 5.0)], head)
    run = "pair_id string, detector string, params map<string,string>"
    rb = spark.createDataFrame([("p", "anr", {"k": "1", "z": "5"}), ("p", "old", {}), ("q", "anr", {})], run)
    ra = spark.createDataFrame([("p", "anr", {"k": "2", "z": "5"}), ("q", "anr", {})], run)
    got = {(r.pair_id, r.id): r.comparable for r in cmp.compare_warnings(b, a, rb, ra).collect()}
    assert set(got) == {("p", i) for i in ("process", "anchor-before", "config", "defaults", "runs",
                                           "single", "thresholds", "detectors")}
    assert [i for (_, i), ok in got.items() if not ok] == ["process"]
    (d,) = cmp.param_diff(rb, ra).collect()
    assert (d.param, d.was, d.now) == ("k", "1", "2")
    w = {r.pair_id: r for r in cmp.window_delta(b, a).collect()}
    assert (w["p"].delta_ms, w["p"].ratio, w["q"].ratio) == (50.0, 1.5, None)
    (s,) = cmp.state_changes(side(spark, [("anr", "a", "", 1.0)]), side(spark, []), rb, ra).collect()
    assert (s.detector, s.rows_before, s.rows_after) == ("anr", 1, 0)


def test_investigations(spark):
    h = spark.createDataFrame([(1, "Slow cold start", 5), (2, "slow scroll", 6), (3, "leak", 7)],
                              "n long, question string, opened_us long")
    assert hist.find_investigation(h, "SLOW").first().n == 2
    assert hist.find_investigation(h, "1").first().question == "Slow cold start"
    assert [r.n for r in hist.newest_first(h).collect()] == [3, 2, 1]
    reports = spark.createDataFrame([(1, "b", 20), (1, "a", 10), (1, "c", 30), (2, "z", 5)],
                                    "investigation long, report_id string, us long")
    numbered = hist.number_reports(reports, "investigation", ["us"], time_cell("us", 7))
    first = hist.pick_pair(numbered, "first_last").collect()
    last = hist.pick_pair(numbered, "latest_two").collect()
    assert [(r.before_id, r.after_id) for r in first + last] == [("a", "c"), ("b", "c")]
    with pytest.raises(ValueError):
        hist.named_pair("a", None, None)


def test_analyze_store_and_read_back(spark, tmp_path):
    src, out, hist_dir = (str(tmp_path / n) for n in ("traces", "report", "history"))
    for name in ("process", "thread", "thread_track", "slice", "thread_state"):
        data = [r for t in ("t1", "t2") for r in planted_rows(t)[name]]
        spark.createDataFrame(data, TRACE_TABLES[name]).write.partitionBy("trace_id").parquet(
            f"{src}/{name}")
    t = load_traces(spark, src)  # frames and freezes are absent: silence
    scenarios = spark.createDataFrame([("t1", "cold", 1), ("t2", "cold", 2)],
                                      "trace_id string, scenario_id string, repeat_no int")
    report = analyze(t, "com.example.app*", "AppStart", "Screen.firstFrame", scenarios=scenarios)
    write_report(report, out)
    back = load_report(spark, out)
    head = back.report.first()
    assert (head.report_id, head.runs, head.duration_ms) == ("cold", 2, 1005.0)
    row = back.finding.where("location = 'collection_mapping'").first()
    assert (row.runs, row.runs_total, row.self_ms) == (2, 2, 120.0)
    doc = nested(back).first()
    assert {d.detector for d in doc.detectors} >= {"anr", "main_thread_block"}
    assert append_report(back, hist_dir, "i1") == 1
    assert append_report(back, hist_dir, "i1") == 2
    assert append_report(back, hist_dir, "i2") == 1
    with pytest.raises(ValueError):
        load_report(spark, src)


def test_a_finding_ranked_low_in_one_repeat_is_merged(spark):
    """W00 is the 25th of its detector in t1 and the first in t2; a shown document has 20 rows."""
    data = {n: [] for n in TRACE_TABLES}
    for trace in ("t1", "t2"):
        for name, r in planted_rows(trace).items():
            data[name] += r
        root = next(s[1] for s in data["slice"] if s[0] == trace and s[6] == "AppStart")
        data["slice"] += [(trace, 900 + k, 4100, root, 10_000_000_000 + (200 + k) * 1_000_000,
                           (200 if trace == "t2" and k == 0 else 130 + k) * 1_000_000, f"W{k:02}", 1) for k in range(25)]
    t = TraceTables(**{n: spark.createDataFrame(data[n], s) for n, s in TRACE_TABLES.items()})
    scenarios = spark.createDataFrame([("t1", "cold", 1), ("t2", "cold", 2)],
                                      "trace_id string, scenario_id string, repeat_no int")
    report = analyze(t, "com.example.app*", "AppStart", "Screen.firstFrame", scenarios=scenarios, names=["main_thread_block"])
    row = report.finding.where("location = 'W00'").first()
    assert (row.runs, row.runs_total, row.self_ms) == (2, 2, 165.0)
    shown = [r.location for r in nested(report).first().detectors[0].rows]
    assert len(shown) == 20 and shown[:3] == ["waitWhileAllocatingLocked", "W00", "W24"] and report.finding.count() > 25
