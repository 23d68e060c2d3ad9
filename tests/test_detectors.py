import pytest
from pyspark.sql import functions as F

from spanmeter.operators import calibrate as cal
from spanmeter.operators import context as cx
from spanmeter.operators import detectors as det
from spanmeter.operators import inventory as inv
from spanmeter.operators.registry import custom_detector, plan_detectors, run_detectors
from spanmeter.sources.readers import empty_tables

from planted import ns, tables

TRACES = ("t1", "t2", "t3")


@pytest.fixture(scope="module")
def ctx(spark):
    return cx.build_context(tables(spark, TRACES), "com.example.app*", "AppStart",
                            "Screen.firstFrame").settled()


@pytest.fixture(scope="module")
def found(ctx):
    done = run_detectors(ctx)
    assert all(r["error"] is None for r in done.runs)
    out = {}
    for r in done.findings.collect():
        out.setdefault((r.trace_id, r.detector), []).append(r)
    return out


def one(rows, location):
    hits = [r for r in rows if r.location == location]
    assert len(hits) == 1, (location, rows)
    return hits[0]


def test_window_and_anchors(ctx):
    for r in cx.window_info(ctx).collect():
        assert (r.ts_start, r.ts_end, r.duration_ms) == (ns(100), ns(1105), 1005.0)
        assert (r.process, r.pid, r.start_matches, r.end_matches) == ("com.example.app", 4100, 1, 1)
        assert r.process_alternatives == 0


def test_every_trace_gives_the_same_answer(found):
    def plain(t):
        return {d: [r[2:] for r in rows] for (x, d), rows in found.items() if x == t}
    assert plain("t1") == plain("t2") == plain("t3")


def test_main_thread_block(found):
    rows = found["t1", "main_thread_block"]
    assert (one(rows, "AppStart").total_ms, one(rows, "AppStart").self_ms) == (1006.0, 275.0)
    r = one(rows, "collection_mapping")
    assert (r.self_ms, r.total_ms) == (120.0, 120.0)
    names = {r.location for r in rows}
    assert not names & {"quick_thing", "Bootstrap_OUTSIDE", "After_OUTSIDE", "other_app_huge_OUTSIDE"}
    assert sum(r.self_ms for r in rows) <= 1006.0
    assert [r.self_ms for r in rows] == sorted((r.self_ms for r in rows), reverse=True)


def test_outlier(found):
    (r,) = found["t1", "main_thread_outlier"]
    assert (r.location, r["count"], r.max_ms) == ("inflate", 1, 44.0)
    assert r.detail == "median 4.0 ms of 6 · worst 11.0×"


def test_gc(found):
    rows = found["t1", "gc_pressure"]
    r = one(rows, "Background young concurrent copying GC")
    assert (r["count"], r.total_ms, r.detail) == (20, 80.0, "HeapTaskDaemon")
    assert one(rows, "waitWhileAllocatingLocked").total_ms == 180.0
    assert len(rows) == 2


def test_contention_and_the_open_span(found):
    rows = found["t1", "monitor_contention"]
    r = one(rows, "m.example.app")
    assert (r["count"], r.total_ms, r.max_ms) == (2, 42.0, 30.0) and "4201" in r.detail
    r = one(rows, "StuckForever")
    assert (r["count"], r.max_ms) == (1, 60.0)


def test_binder(found):
    (r,) = found["t1", "binder_txn"]
    assert (r["count"], r.total_ms, r.max_ms, r.detail) == (2, 28.0, 25.0, "main thread")


def test_starvation(found):
    (r,) = found["t1", "runnable_starvation"]
    assert (r.location, r.total_ms, r.detail) == ("OkHttp Dispatcher", 50.0, "state R")


def test_uninstrumented(found):
    rows = found["t1", "uninstrumented_cpu"]
    r = one(rows, "DefaultDispatcher-worker-1")
    assert (r.total_ms, r.covered_ms, r["count"], r.max_ms) == (300.0, 0.0, 0, None)
    assert r.detail == "100.0% of CPU outside slices"
    r = one(rows, "BlockingIO-1")
    assert (r.total_ms, r.covered_ms) == (160.0, 60.0)
    assert len(rows) == 2


def test_frames(found):
    rows = found["t1", "frame_jank"]
    r = one(rows, "App Deadline Missed")
    assert (r["count"], r.total_ms, r.max_ms) == (5, 220.0, 44.0) and "5 of 24 frames" in r.detail
    r = one(rows, "SurfaceFlinger CPU Deadline Missed")
    assert (r["count"], r.total_ms) == (4, 56.0)
    assert len(rows) == 2


def test_anr(found):
    (r,) = found["t1", "anr"]
    assert r.detail == "after the window by 195.0 ms · 0123abcd"


def test_stalls(ctx, found):
    assert ("t1", "anr_risk") not in found
    got = det.stalls(ctx, 100, 2).where("trace_id = 't1'").orderBy("ts_from").collect()
    assert [(r.ts_from, r.ts_to) for r in got] == [(ns(100), ns(845)), (ns(850), ns(1105))]
    for r in got:
        neither = r.stall_ns - r.on_cpu_ns - r.runnable_ns
        assert 0 <= neither <= r.stall_ns and r.messages > 0
    rows = det.anr_risk(ctx, min_stall_ms=100).where("trace_id = 't1'").collect()
    assert {r.location for r in rows} == {"collection_mapping", "waitWhileAllocatingLocked"}


def test_limit_and_open_pass(ctx):
    assert det.main_thread_block(ctx, min_slice_ms=0, limit=2).count() == 2 * len(TRACES)
    top = cal.nth_largest(cal.measure_open(ctx, "main_thread_block"), ["detector"], "self_ms", 1)
    assert top.first().value == 275.0


def test_proposed_thresholds(ctx):
    got = {(r.detector, r.param): r for r in cal.propose_thresholds(ctx).collect()}
    assert len(got) == 11
    r = got["main_thread_block", "min_slice_ms"]
    assert r.status == "derived" and r.threshold == round(r.statistic * 1.5, 1)
    assert got["binder_txn", "min_txn_ms"].status == "small_sample"
    assert got["binder_txn", "min_txn_ms"].threshold == 10.0


def test_parameters_are_checked():
    for bad in ({"gc_pressure": {"nope": 1}}, {"gc_pressure": {"max_events": True}},
                {"gc_pressure": {"name_glob": 3}}, {"nobody": {}}):
        with pytest.raises(ValueError):
            plan_detectors(overrides=bad)
    (p,) = plan_detectors(["anr"])
    assert p.source == "default"
    both = plan_detectors(["gc_pressure"], {"gc_pressure": {"max_events": 3}},
                          {"gc_pressure": {"max_events": 4}})
    assert (both[0].params["max_events"], both[0].source) == (4, "config+call")


def test_a_failing_detector_leaves_the_others(ctx):
    done = run_detectors(ctx, ["binder_txn"], extra={
        "broken": lambda c: custom_detector(c, "SELECT nothing FROM slice_win")})
    assert [bool(r["error"]) for r in done.runs] == [False, True]
    assert done.findings.count() == len(TRACES) and len(done.absent) == 9


def test_custom_detector(ctx):
    df = custom_detector(ctx, """
        SELECT trace_id, name AS location, count(*) AS count, max(depth) AS deepest
        FROM slice_win WHERE name = :n GROUP BY trace_id, name""", {"n": "x' OR '1'='1"})
    assert df.count() == 0
    df = custom_detector(ctx, """
        WITH d AS (SELECT trace_id, name, depth FROM slice_win WHERE name LIKE :n)
        SELECT trace_id, name AS location, count(*) AS count, max(depth) AS deepest
        FROM d GROUP BY trace_id, name""", {"n": "inflate"})
    r = df.where("trace_id = 't1'").first()
    assert (r["count"], r.extra) == (6, {"deepest": "1"})


def test_no_frames_and_no_match(spark, ctx):
    empty = empty_tables(spark)
    t = tables(spark).replace(actual_frame=empty.actual_frame, expected_frame=empty.expected_frame)
    c = cx.build_context(t, "com.example.app", None, None)
    assert det.frame_jank(c).count() == 0
    with pytest.raises(ValueError):
        cx.require_process(t, "com.nobody*")
    w = c.window.first()
    assert (w.ts_start, w.ts_end) == (ns(0), ns(1400))


def test_alternatives_and_inventories(spark):
    t = tables(spark)
    rows = cx.process_alternatives(t, "com*").collect()
    assert [(r.name, r.slices, r.alternatives_total) for r in rows] == [("com.other.app", 1, 1)]
    assert inv.process_inventory(t).first().name == "com.example.app"
    top = inv.thread_inventory(t, "com.example.app").first()
    assert (top.thread, top.running_ms) == ("m.example.app", 1180.0)
    assert inv.longest_spans(t, "com.example.app").first().name == "AppStart"
    spans = inv.named_spans(t, cx.resolve_process(t, "com.example.app"))
    fams = inv.bucket_families(inv.family_inventory(spans, inv.mask_coverage(spans, inv.masks_of())))
    got = {r.family: r for r in fams.collect()}
    lock = got["Lock contention on a monitor lock (owner tid: #)"]
    assert (lock.n, lock.covered_by, lock.section) == (3, ["monitor_contention"], "Locks and waiting")
    assert got["binder transaction async"].skipped_by == ["binder_txn"]
    missed = {r.family for r in inv.missed_families(fams).collect()}
    assert "binder reply" in missed and "binder transaction async" not in missed


def test_globs(spark):
    from spanmeter.functions.exprs import family, glob
    df = spark.createDataFrame([("a.b[1]",), ("A.b",), ("aXb",), ("a\nb",)], "s string")
    def hits(p):
        return [r.s for r in df.where(glob("s", p)).collect()]
    assert hits("a*b") == ["aXb", "a\nb"]
    assert hits("a.b*") == ["a.b[1]"]
    assert hits("a?b") == ["aXb", "a\nb"]
    assert hits("[A-Z]*") == ["A.b"]
    assert hits("*") == ["a.b[1]", "A.b", "aXb", "a\nb"]
    fam = spark.createDataFrame([("w-12 0xAf3 9",)], "s string").select(family("s")).first()[0]
    assert fam == "w-# #x# #"
