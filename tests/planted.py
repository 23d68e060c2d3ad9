"""One recording with a planted problem per detector and negative controls, as plain rows."""

from spanmeter.sources.readers import TraceTables
from spanmeter.sources.schemas import TRACE_TABLES

BASE = 10_000_000_000


def ns(ms):
    return BASE + int(ms * 1_000_000)


APP, OTHER = 4100, 5000
THREADS = {4100: "m.example.app", 4201: "DefaultDispatcher-worker-1", 4202: "HeapTaskDaemon",
           4203: "OkHttp Dispatcher", 4204: "WellInstrumented", 4205: "BlockingIO-1",
           4206: "StuckForever"}
LOCK = "Lock contention on a monitor lock (owner tid: %d)"

# name, start, length, children
CHILDREN = [
    ("collection_mapping", 200, 120), ("quick_thing", 400, 5), ("binder transaction", 450, 25),
    ("binder transaction", 480, 3), ("binder transaction async", 600, 40), (LOCK % 4201, 500, 30),
    ("waitWhileAllocatingLocked", 700, 60), ("waitWhileAllocatingLocked", 900, 60),
    ("waitWhileAllocatingLocked", 980, 60), ("Lock contention on GC lock (owner tid: 4202)", 800, 20),
    ("binder reply", 850, 15), (LOCK % 4202, 880, 12),
    *[("inflate", 322 + i * 6, 4) for i in range(5)], ("inflate", 352, 44),
    *[("measure", 530 + i * 8, 6) for i in range(6)],
    ("Rare_work", 641, 1), ("Rare_work", 643, 1), ("Rare_work", 645, 45),
    *[("Tiny_tick", 762 + i * 2, 1) for i in range(5)], ("Tiny_tick", 775, 20),
    *[("Steady_heavy", 405 + i * 13, 12) for i in range(3)], ("Steady_heavy", 820, 12),
    ("Steady_heavy", 833, 12), ("Steady_heavy", 1040, 44), ("Screen.firstFrame", 1100, 5)]
RUNNING = [(4100, 50, 600), (4100, 610, 800), (4100, 860, 1300), (4206, 1040, 1050),
           (4201, 200, 350), (4201, 400, 550), (4202, 700, 800), (4203, 600, 620), (4203, 670, 680),
           (4204, 200, 400), (4205, 200, 260), (4205, 600, 700), (OTHER, 200, 700)]
MISSED, SF = "App Deadline Missed", "SurfaceFlinger CPU Deadline Missed"
FRAMES = [
    *[(1 + i, 200 + i * 50, 16, 60, MISSED, "Self Jank") for i in range(5)],
    *[(10 + i, 450 + i * 20, 16, 18, MISSED, "Self Jank") for i in range(3)],
    *[(20 + i, 550 + i * 30, 16, 30, SF, "Other Jank") for i in range(4)],
    *[(30 + i, 700 + i * 5, 16, 14, "None", "No Jank") for i in range(10)],
    *[(50 + i, 800 + i * 20, 16, 50, "Buffer Stuffing", "Self Jank") for i in range(2)],
    (60, 1200, 16, 200, MISSED, "Self Jank")]


def rows(trace):
    """Rows of all tables for one trace id."""
    spans, sid = [], [0]

    def add(tid, name, at, length, depth=0, parent=None):
        sid[0] += 1
        spans.append((trace, sid[0], tid, parent, ns(at), -1 if length is None
                      else length * 1_000_000, name, depth))
        return sid[0]

    add(4206, LOCK % 4444, 1045, None)
    add(4100, "Bootstrap_OUTSIDE", 0, 50)
    root = add(4100, "AppStart", 100, 1006)
    for name, at, length in CHILDREN:
        add(4100, name, at, length, 1, root)
    add(4100, "After_OUTSIDE", 1200, 200)
    for i in range(20):
        cycle = add(4202, "Background young concurrent copying GC", 700 + i * 5, 4)
        add(4202, "CopyingPhase", 700 + i * 5, 3, 1, cycle)
    add(4204, "work_a", 200, 90)
    add(4204, "work_b", 300, 90)
    add(4205, "blocking_io_wait", 200, 300)
    add(OTHER, "other_app_huge_OUTSIDE", 200, 500)
    threads = [(trace, t, t, n, 1) for t, n in THREADS.items()] + [(trace, OTHER, OTHER, "other", 2)]
    actual = [(trace, tok, 1, ns(at), act * 1_000_000, kind, tag)
              for tok, at, _, act, kind, tag in FRAMES]
    actual += [(trace, 100 + i, 2, ns(300 + i * 40), 90_000_000, MISSED, "Self Jank")
               for i in range(4)]
    actual += [(trace, None, 3, ns(250 + i * 40), 70_000_000, SF, "Other Jank") for i in range(4)]
    return {
        "process": [(trace, 1, APP, "com.example.app"), (trace, 2, OTHER, "com.other.app"),
                    (trace, 3, 600, "/system/bin/surfaceflinger"),
                    (trace, 4, 1200, "system_server")],
        "thread": threads,
        "thread_track": [(trace, t, t) for _, t, *_ in threads],
        "slice": spans,
        "thread_state": [(trace, t, ns(a), (b - a) * 1_000_000, "Running") for t, a, b in RUNNING]
        + [(trace, 4203, ns(620), 50_000_000, "R")],
        "actual_frame": actual,
        "expected_frame": [(trace, tok, 1, ns(at), 16_000_000) for tok, at, *_ in FRAMES],
        "freeze_record": [
            (trace, "0123abcd", ns(1300), "Input dispatching timed out (fixture)", None, None, None,
             None, "com.example.app"),
            (trace, "9999ffff", ns(1340), "Input dispatching timed out (other app)", None, None,
             None, OTHER, "com.other.app")],
    }


def tables(spark, traces=("t1",)):
    data = {n: [] for n in TRACE_TABLES}
    for t in traces:
        for n, r in rows(t).items():
            data[n] += r
    return TraceTables(**{n: spark.createDataFrame(data[n], s) for n, s in TRACE_TABLES.items()})
