from pyspark.sql import functions as F

from spanmeter.operators import dumps as dm
from spanmeter.operators import locks as lk
from spanmeter.session import settle
from spanmeter.sources.readers import load_dumps, numbered_lines, text_lines

# Two monitors with a holder each, four threads with nothing to do, one line no rule reads.
EXPORT = """\
# Application: org.fernwood.ledger
# Version: 7.4 (3310)
# Device: tablet

SyncEngine-3 (runnable):tid=41 systid=9041
       at org.fernwood.ledger.sync.Journal.fold(Journal.kt:210)
       at org.fernwood.ledger.sync.Engine.tick(Engine.kt:77)

main (blocked):tid=1 systid=9000 | waiting to lock <0x5fe2> (org.fernwood.ledger.sync.b) held by thread 41
       at org.fernwood.ledger.sync.Journal.size(Journal.kt:64)
       at org.fernwood.ledger.ui.BalanceCard.bind(BalanceCard.kt:19)

Importer (blocked):tid=33 systid=9033 | waiting to lock <0x77aa> (org.fernwood.ledger.io.k) held by thread 34
       at org.fernwood.ledger.io.CsvReader.next(CsvReader.kt:140)

Exporter (waiting):tid=34 systid=9034
#00 pc 0x4ab10 libc.so (pwrite64 + 8)
       at libcore.io.Linux.pwrite(Native method)
       at okio.FileHandle.write(FileHandle.kt:12)
       at org.fernwood.ledger.io.PdfSink.put(PdfSink.kt:301)
       ~ pages flushed: 12

timer-0 (timed waiting):tid=50 systid=9050
       at java.util.TimerThread.mainLoop(Timer.java:563)

reader-2 (native):tid=51 systid=9051
#02 pc 0x1c0de libc.so (__epoll_pwait + 20)

RxComputation (waiting):tid=52 systid=9052
       at java.util.concurrent.ArrayBlockingQueue.take(ArrayBlockingQueue.java:11)

RefQueue (waiting):tid=53 systid=9053
       at java.lang.Daemons$ReferenceQueueDaemon.run(Daemons.java:5)
"""

# The process which hung is the second of its entry; a later entry does not count.
RECORD = """\
note from the collector
==============================
Package: net.halyard.tide v12
Reason: Broadcast of Intent timed out
Load over the last minute:
  12.5% 777/surfaceflinger: 4% user + 8.5% kernel
  61% 31/kworker/u8:3: 61% kernel
  3% 12/net.halyard.tide: 3% user
---- pid 310 at 2031-02-03 04:05:06 ----
Cmd line: net.halyard.tide:push
"main" prio=5 tid=1 Native
  at net.halyard.push.Socket.read(Socket.java:7)
---- end 310 ----
---- pid 305 at 2031-02-03 04:05:07 ----
Cmd line: net.halyard.tide
"main" prio=5 tid=1 Waiting
  | sysTid=305 nice=0
  at java.lang.Object.wait(Native method)
  - waiting on <0x9c1> (a java.lang.Object)
  at net.halyard.tide.Tiller.turn(Tiller.java:18)
"mapper" prio=5 tid=14 Blocked
  | sysTid=318 nice=4
  at net.halyard.tide.chart.Tiles.put(Tiles.java:90)
  - waiting to lock <0xe44> (a net.halyard.tide.chart.Cache) held by thread 61
"fetch" daemon prio=5 tid=15 Runnable
  | sysTid=319 nice=4
  at net.halyard.tide.chart.Tiles.get(Tiles.java:44)
  - locked <0xe44>
"late" prio=5 (not attached)
  (no managed stack frames)
  unexpected words here
trailer without a thread
---- end 305 ----
==============================
Package: other.later.one
"main" prio=5 tid=1 Blocked
  at other.later.Main.run(Main.java:1)
"""

CONSOLE = """\
"pump" tid=9 Blocked
  at io.quarry.Silo.push (Silo.kt:70)
"gate" tid=10 Blocked
  at io.quarry.Silo.pull (Silo.kt:75)
"lamp" tid=11 Blocked
  at io.quarry.Lamp.on (Lamp.kt:3)
"main" tid=1 Blocked
  at io.quarry.Desk.open (Desk.kt:8)
"spare" tid=12 Timed Waiting
  at java.lang.Thread.sleep (Native method)
"""

# A ring of three, a thread which waits for it, and a pair outside.
RING = """\
north (blocked):tid=70 systid=700 | waiting to lock <0xaa> (z.North) held by thread 71
east (blocked):tid=71 systid=701 | waiting to lock <0xbb> (z.East) held by thread 72
south (blocked):tid=72 systid=702 | waiting to lock <0xcc> (z.South) held by thread 70
tail (blocked):tid=73 systid=703 | waiting to lock <0xbb> (z.East) held by thread 72
calm (blocked):tid=74 systid=704 | waiting to lock <0xdd> (z.Calm) held by thread 75
free (runnable):tid=75 systid=705
"""


def parse(spark, **texts):
    lines = text_lines(spark.createDataFrame(list(texts.items()), "dump_id string, text string"),
                       "dump_id", "text")
    seg = dm.segment_threads(lines)
    threads, frames, locks = (settle(f(seg)) for f in (dm.dump_threads, dm.dump_frames, dm.dump_locks))
    return seg, threads, frames, locks


def test_export(spark):
    seg, threads, frames, locks = parse(spark, e=EXPORT)
    fields = dm.dump_header_fields(seg)
    assert dm.dump_package(fields).first().package == "org.fernwood.ledger"
    assert dm.dump_headers(fields, ["Device"]).first().head == {"Device": "tablet"}
    idle = settle(dm.idle_reason(threads, frames))
    assert {r.name: r.idle for r in idle.collect()} == {
        "SyncEngine-3": None, "main": None, "Importer": None, "Exporter": None,
        "timer-0": "library idle loop", "reader-2": "waiting on a descriptor",
        "RxComputation": "pool waiting for work", "RefQueue": "runtime daemon"}
    groups = settle(lk.lock_groups(locks, threads))
    assert {r.addr: (r.waiters, r.blocks_main, r.holder, r.holder_tid) for r in groups.collect()} == {
        "0x5fe2": (1, True, "SyncEngine-3", "41"), "0x77aa": (1, False, "Exporter", "34")}
    assert {r.monitor: r.named for r in lk.monitor_names(locks, threads, frames).collect()} == {
        "org.fernwood.ledger.sync.b": "org.fernwood.ledger.sync.Journal",
        "org.fernwood.ledger.io.k": "org.fernwood.ledger.io.CsvReader"}
    assert {(r.root_tid, r.holders, r.deadlock) for r in lk.chain_roots(locks, threads).collect()} == {
        ("41", 1, False), ("34", 1, False)}
    assert dm.unread_lines(seg).first().unread == 1
    s = dm.dump_summary(threads, idle, groups).first()
    assert (s.threads, s.working, s.idle, s.chains, s.blocking_main) == (8, 4, 4, 2, 1)
    shown = {}
    for r in dm.shown_frames(frames, dm.own_frames(frames, dm.dump_package(fields))).orderBy("place").collect():
        shown.setdefault(r.thread_no, []).append(r.frame)
    assert shown[4] == ["libcore.io.Linux.pwrite(Native method)", "okio.FileHandle.write(FileHandle.kt:12)",
                        "org.fernwood.ledger.io.PdfSink.put(PdfSink.kt:301)"]
    assert shown[1] == ["org.fernwood.ledger.sync.Journal.fold(Journal.kt:210)",
                        "org.fernwood.ledger.sync.Engine.tick(Engine.kt:77)"]
    names = {r.name for r in lk.threads_of_interest(threads, locks, groups, idle).collect()}
    assert names == {"SyncEngine-3", "main", "Importer", "Exporter"}


def test_device_record(spark):
    seg, threads, frames, locks = parse(spark, r=RECORD)
    head = dm.dump_package(dm.dump_header_fields(seg))
    assert tuple(head.first()[1:]) == ("net.halyard.tide", "Broadcast of Intent timed out")
    kept = dm.scope_process(threads, head).collect()
    assert sorted((r.name, r.state, r.systid, r.elsewhere) for r in kept) == [
        ("fetch", "runnable", "319", 1), ("late", "not attached", "", 1),
        ("main", "waiting", "305", 1), ("mapper", "blocked", "318", 1)]
    load = [(r.share, r.process) for r in dm.dump_load(seg).orderBy("place").collect()]
    assert load == [(61.0, "kworker/u8:3"), (12.5, "surfaceflinger"), (3.0, "net.halyard.tide")]
    # No thread has the owner's tid; the one which says it holds the address is found.
    (g,) = lk.lock_groups(locks, threads).collect()
    assert (g.owner_tid, g.holder, g.monitor) == ("61", "fetch", "net.halyard.tide.chart.Cache")
    u = dm.unread_lines(seg).first()
    assert (u.unread, u.skipped) == (2, 1)


def test_console_form_infers_the_queue(spark):
    _, threads, frames, locks = parse(spark, c=CONSOLE)
    assert locks.count() == 0
    found = lk.inferred_queues(threads, frames, locks).collect()
    assert {(r.monitor, r.waiters, r.blocks_main) for r in found} == {
        ("io.quarry.Silo", 2, False), ("io.quarry.Desk", 1, True)}
    assert {r.state for r in threads.collect()} == {"blocked", "timed waiting"}


def test_ring(spark):
    _, threads, _, locks = parse(spark, d=RING)
    got = {r.addr: (r.waiters, r.deadlock) for r in lk.chain_roots(locks, threads).collect()}
    assert got == {"0xaa": (1, True), "0xbb": (2, True), "0xcc": (1, True), "0xdd": (1, False)}


def graph(spark, wants, n):
    """wants: tid -> owner tid"""
    threads = spark.createDataFrame([("d", i, f"t{i}", str(i)) for i in range(1, n + 1)],
                                    "dump_id string, thread_no long, name string, tid string")
    locks = spark.createDataFrame([("d", t, "wants", f"0x{o}", "c", str(o)) for t, o in wants.items()],
                                  "dump_id string, thread_no long, role string, addr string, "
                                  "cls string, owner_tid string")
    return threads, locks


def walk(wants, n, start):
    seen, cur = [], start
    while cur is not None and cur <= n and cur not in seen:
        seen.append(cur)
        cur = wants.get(cur)
    return seen, cur in seen if cur is not None else False


def test_roots_match_a_walk(spark):
    import random
    rnd = random.Random(5)
    n = 40
    wants = {t: rnd.randint(1, n + 4) for t in rnd.sample(range(1, n + 1), 30)}
    wants.update({1: 2, 2: 3, 3: 1, 4: 1, 5: 4})  # a loop of three with a tail of two
    threads, locks = graph(spark, wants, n)
    for r in lk.chain_roots(locks, threads).collect():
        owner = int(r.owner_tid)
        if owner > n:
            assert (r.holder_tid, r.holders, r.deadlock) == (None, 0, False)
            continue
        seen, loop = walk(wants, n, owner)
        assert (int(r.root_tid), r.deadlock) == (seen[-1], loop), r
        if not loop:
            assert r.holders == len(seen)


def test_frames_are_placed(spark):
    frames = spark.createDataFrame([(f,) for f in (
        "com.a.ui.Mapper$1.run(Mapper.kt:58)", "com.a.ui.Mapper$1.run(Mapper.kt:58)",
        "com.zzz.Mapper.run(Mapper.kt:7)", "com.zzz.Only.run(Only.kt)", "x.Gone.f(Gone.kt:1)",
        "x.N.f(Native method)", "x.N.f(com.google.x:artifact@@1.2.3:2)")], "frame string")
    files = spark.createDataFrame([("m1/src/com/a/data/Mapper.kt",), ("m2/src/com/a/ui/Mapper.kt",),
                                   ("m2/src/Only.kt",)], "path string")
    got = {r.frame: (r.path, r.exact, r.line) for r in
           dm.place_frames(frames, dm.source_index(files)).collect()}
    assert got == {
        "com.a.ui.Mapper$1.run(Mapper.kt:58)": ("m2/src/com/a/ui/Mapper.kt", True, 58),
        "com.zzz.Mapper.run(Mapper.kt:7)": ("m1/src/com/a/data/Mapper.kt", False, 7),
        "com.zzz.Only.run(Only.kt)": ("m2/src/Only.kt", True, None),
        "x.Gone.f(Gone.kt:1)": (None, False, 1)}


def test_dump_files_are_read_as_numbered_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo\n\nfour\n")
    rows = load_dumps(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in rows] == [(1, "one"), (2, "two"), (3, ""), (4, "four")]


def test_deep_stacks_show_both_ends(spark):
    own = "".join(f"       at com.acme.Own.f{i}(Own.kt:{i})\n" for i in range(12))
    text = ("deep (runnable):tid=1 systid=1\n       at java.lang.Object.wait(Native method)\n"
            "       at okhttp3.Call.run(Call.kt:1)\n" + own + "\n"
            "bare (native):tid=2 systid=2\n#00 pc 0x1 a.so\n#01 pc 0x2 b.so\n#02 pc 0x3 c.so\n#03 pc 0x4 d.so\n")
    _, _, frames, _ = parse(spark, x=text)
    got = {}
    for r in dm.shown_frames(frames, dm.own_frames(frames)).orderBy("place").collect():
        got.setdefault(r.thread_no, []).append(r.frame)
    assert got[1] == ["java.lang.Object.wait(Native method)", "okhttp3.Call.run(Call.kt:1)",
                      "com.acme.Own.f0(Own.kt:0)", "com.acme.Own.f1(Own.kt:1)",
                      "com.acme.Own.f2(Own.kt:2)", "…", "com.acme.Own.f10(Own.kt:10)",
                      "com.acme.Own.f11(Own.kt:11)"]
    assert got[2] == ["#00 pc 0x1 a.so", "#01 pc 0x2 b.so", "#02 pc 0x3 c.so"]


def test_ranking(spark):
    seg, threads, frames, locks = parse(spark, e=EXPORT)
    idle = dm.idle_reason(threads, frames)
    wants = locks.where("role = 'wants'").select("dump_id", "thread_no", F.lit(True).alias("wants"))
    work = dm.working_threads(idle).join(wants, ["dump_id", "thread_no"], "left").fillna(False, ["wants"])
    rows = dm.rank_working(work, dm.own_frames(frames)).orderBy("place").collect()
    assert [(r.name, r.place) for r in rows] == [("SyncEngine-3", 1), ("Exporter", 2)]


def test_lines_are_numbered_over_the_blocks_of_a_file(spark, tmp_path):
    texts = {"a.txt": "".join(f"line {k} of a\n" for k in range(5000)), "b.txt": "one\r\ntwo\r\n\r\nfour", "c.txt": "", "d/e.txt": "\n\nx\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        rows = numbered_lines(spark, str(tmp_path))
        got = {}
        for r in rows.collect():
            got.setdefault(r.file.split(str(tmp_path) + "/")[1], []).append((r.line_no, r.line))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {n: list(enumerate(t.replace("\r\n", "\n").removesuffix("\n").split("\n"), 1)) for n, t in texts.items() if t}
    assert {n: sorted(v) for n, v in got.items()} == want


def test_one_holder_per_lock_and_the_last_note_of_a_thread(spark):
    threads = spark.createDataFrame(
        [("d", 1, "main", "1"), ("d", 2, "owner", "7"), ("d", 3, "same tid", "7"), ("d", 4, "w", "9"), ("d", 5, "x", "8")],
        "dump_id string, thread_no int, name string, tid string")
    locks = spark.createDataFrame(
        [("d", 1, "wants", "0xa", "A", "7", 10), ("d", 4, "wants", "0xb", "B", "8", 20), ("d", 4, "wants", "0xa", "A", "7", 21)],
        "dump_id string, thread_no int, role string, addr string, cls string, owner_tid string, line_no int")
    got = {(r.addr, r.owner_tid): (r.holder, r.waiters) for r in lk.lock_groups(locks, threads).collect()}
    assert got == {("0xa", "7"): ("owner", 2), ("0xb", "8"): ("x", 1)}
    assert {(r.tid, r.next) for r in lk.wait_edges(locks, threads).collect()} == {("1", "7"), ("9", "7")}


def test_long_chains_and_loops_have_their_roots(spark):
    chain = [("c", str(k), str(k + 1)) for k in range(300)]
    loop = [("l", str(k), str((k + 1) % 5)) for k in range(5)] + [("l", "10", "3"), ("l", "11", "10")]
    edges = spark.createDataFrame(chain + loop, "dump_id string, tid string, next string")
    got = {(r.dump_id, r.tid): (r.root, r.steps, r.in_cycle) for r in lk.wait_roots(edges).collect()}
    assert all(got["c", str(k)] == ("300", 300 - k, False) for k in range(300))
    assert got["l", "11"] == ("2", 2, True) and got["l", "10"] == ("2", 1, True)
    assert all(got["l", str(k)][2] for k in range(5)) and got["l", "0"][0] == "4"
    assert lk.wait_roots(edges.where("false")).collect() == []
