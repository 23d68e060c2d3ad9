"""Thread-dump queries. Forty customers in a row make one dump, written out as text lines in two
producers' formats; the operators read the lines back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dumps as dm
from ..operators import locks as lk
from ..session import settle
from .bridge import table
from .sqltext import big, with_


def _concat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def customers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    rank = key % 40
    state = (F.when(F.col("c_acctbal") < 3000, 0).when(F.col("c_acctbal") < 6000, 1).otherwise(2))
    return table(spark, sf, "customer").select(
        F.expr("c_custkey div 40").alias("dump"), key.alias("tid"), rank.alias("rank"),
        F.when(rank == 0, "main").otherwise(F.col("c_name")).alias("name"), state.alias("st"),
        (key - rank + (rank * 3 + 1) % 40).alias("owner"),
        F.concat(F.lit("src.b"), (key % 25).cast("string"), F.lit("."),
                 F.initcap("c_mktsegment")).alias("cls"))


def dump_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    top = F.get(F.array(
        F.lit("android.os.MessageQueue.nativePollOnce(Native method)"),
        F.lit("java.lang.Object.wait(Native method)"),
        F.lit("java.lang.Daemons$ReferenceQueueDaemon.run(Daemons.java:1)"),
        _concat(F.col("cls"), ".load(F", F.col("tid") % 60, ".kt:", F.col("tid") % 90 + 1, ")"),
        F.lit("kotlin.io.Reader.read(Reader.kt:9)")), (F.col("tid") % 5).cast("int"))
    own = _concat("src.b", F.col("tid") % 25, ".tSMALL.Cls.run(F", F.col("tid") % 60, ".kt:",
                  F.col("tid") % 90 + 1, ")")
    blocked = F.col("st") == 0
    addr = F.concat(F.lit("0x"), F.lower(F.hex("owner")))
    words = [("blocked", "Blocked"), ("timed waiting", "TimedWaiting"), ("runnable", "Runnable")]

    def word(i):
        return F.get(F.array(*[F.lit(w[i]) for w in words]), F.col("st"))
    crash = F.array(
        F.when(F.col("rank") == 0, _concat("# Application: com.app", F.col("dump") % 3)),
        F.when(F.col("rank") == 0, F.lit("# Reason: input timed out")),
        _concat(F.col("name"), " (", word(0), "):tid=", F.col("tid"), " systid=",
                F.col("tid") + 1000, F.when(blocked, _concat(
                    " | waiting to lock <", addr, "> (", F.col("cls"), ") held by thread ",
                    F.col("owner"))).otherwise(F.lit(""))),
        _concat("    at ", top), _concat("    at ", own),
        F.lit("    native: #00 pc 0x1f libc.so"))
    sysd = F.array(
        F.when(F.col("rank") == 0, _concat("Process: com.app", F.col("dump") % 3)),
        F.when(F.col("rank") == 0, F.lit("  12.5% 34/system_server: 5% user + 7% kernel")),
        _concat('"', F.col("name"), '" prio=5 tid=', F.col("tid"), " ", word(1)),
        _concat("  | sysTid=", F.col("tid") + 1000), _concat("  at ", top),
        F.when(blocked, _concat("  - waiting to lock <", addr, "> (a ", F.col("cls"),
                                ") held by thread ", F.col("owner"))),
        _concat("  at ", own), _concat("  - locked <0x", F.lower(F.hex("tid")), ">"))
    lines = F.posexplode(F.when(F.col("dump") % 2 == 0, crash).otherwise(sysd)).alias("i", "line")
    return c.select("dump", "rank", lines).where(F.col("line").isNotNull()).select(
        _concat("d", F.col("dump")).alias("dump_id"),
        (F.col("rank") * 10 + F.col("i") + 1).cast("int").alias("line_no"), "line")


class Parsed:
    """The parsed dumps of the sample, each table settled on first use."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        self.seg = dm.segment_threads(dump_lines(spark, sf))
        self.threads = settle(dm.dump_threads(self.seg))
        self.frames = settle(dm.dump_frames(self.seg))
        self.locks = settle(dm.dump_locks(self.seg))

    def packages(self):
        return dm.dump_package(dm.dump_header_fields(self.seg))


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of a source tree, one per distinct brand, type and size of `part`."""
    p = table(spark, sf, "part")
    return p.select(F.concat(
        F.lit("app/src/b"), F.substring_index("p_brand", "#", -1), F.lit("/t"), F.col("p_type"),
        F.lit("/F"), F.col("p_size").cast("string"), F.lit(".kt")).alias("path")).distinct()


def _threads(s, d):
    return dm.dump_threads(dm.segment_threads(dump_lines(s, d)))


def _idle(s, d):
    p = Parsed(s, d)
    return dm.idle_reason(p.threads, p.frames).select("dump_id", "thread_no", "name", "idle")


def _groups(s, d):
    seg = dm.segment_threads(dump_lines(s, d))
    groups = lk.lock_groups(settle(dm.dump_locks(seg)), settle(dm.dump_threads(seg)))
    return lk.ordered_groups(groups)


def graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Threads and wanted monitors without the detour over text."""
    c = customers(s, d)
    threads = c.select(
        "dump", F.concat(F.lit("d"), F.col("dump").cast("string")).alias("dump_id"),
        (F.col("rank") + 1).alias("thread_no"), "name", F.col("tid").cast("string").alias("tid"), "st")
    locks = c.where("st = 0").select(
        F.concat(F.lit("d"), F.col("dump").cast("string")).alias("dump_id"),
        (F.col("rank") + 1).alias("thread_no"), F.lit("wants").alias("role"),
        F.concat(F.lit("0x"), F.lower(F.hex("owner"))).alias("addr"), "cls",
        F.col("owner").cast("string").alias("owner_tid"))
    return threads, locks


def _roots(s, d):
    threads, locks = graph(s, d)
    return lk.chain_roots(locks, threads).select(
        "dump_id", "addr", "holder_tid", "root_tid", "holders", "deadlock", "waiters",
        "blocks_main")


def _summary(s, d):
    p = Parsed(s, d)
    threads, frames, locks = dm.scope_dump(p.threads, p.frames, p.locks, p.packages())
    return dm.dump_summary(threads, settle(dm.idle_reason(threads, frames)), lk.lock_groups(locks, threads),
                           dm.unread_lines(p.seg))


def _two_processes(s, d):
    """The same dumps, every third thread of the even ones in another process; every fourth dump names that one."""
    p = Parsed(s, d)
    number = F.substring("dump_id", 2, 9).cast("int")
    threads = p.threads.withColumn("process", F.when((number % 2 == 0) & (F.col("thread_no") % 3 == 0), "other.app").otherwise("an.app"))
    packages = p.threads.select("dump_id").distinct().withColumn(
        "package", F.when(number % 4 == 0, "other.app").otherwise("no.such.app"))
    return threads, p.frames, p.locks, packages


def _scope(s, d):
    return dm.scope_process(*(x for k, x in enumerate(_two_processes(s, d)) if k in (0, 3))).select(
        "dump_id", "thread_no", "process", "elsewhere")


def _scoped_groups(s, d):
    threads, _, locks = dm.scope_dump(*_two_processes(s, d))
    return lk.lock_groups(locks, threads).select("dump_id", "addr", "waiters", "blocks_main", "holder_tid")


def _ranked(s, d):
    p = Parsed(s, d)
    idle = dm.idle_reason(p.threads, p.frames)
    wants = p.locks.where("role = 'wants'").select("dump_id", "thread_no").distinct().withColumn(
        "wants", F.lit(True))
    work = dm.working_threads(idle).join(wants, ["dump_id", "thread_no"], "left").fillna(
        False, ["wants"])
    return dm.rank_working(work, dm.own_frames(p.frames, p.packages())).select(
        "dump_id", "thread_no", "name", "own_frame", "place")


def _interest(s, d):
    p = Parsed(s, d)
    idle = dm.idle_reason(p.threads, p.frames)
    return lk.threads_of_interest(p.threads, p.locks, lk.lock_groups(p.locks, p.threads),
                                  idle).select("dump_id", "thread_no", "tid")


def _names(s, d):
    p = Parsed(s, d)
    return lk.monitor_names(p.locks, p.threads, p.frames)


def _queues(s, d):
    """The same dumps with their lock notes left out, as one console prints them."""
    p = Parsed(s, d)
    return lk.inferred_queues(p.threads, p.frames, p.locks.where("role = 'none'"))


def _own(s, d):
    p = Parsed(s, d)
    return dm.own_frames(p.frames, p.packages()).select("dump_id", "thread_no", "pos", "frame")


def _place(s, d):
    seg = dm.segment_threads(dump_lines(s, d))
    return dm.place_frames(dm.own_frames(dm.dump_frames(seg)), dm.source_index(source_files(s, d)))


def _shown(s, d):
    p = Parsed(s, d)
    return dm.shown_frames(p.frames, dm.own_frames(p.frames, p.packages()))


def _head(s, d):
    return dm.dump_package(dm.dump_header_fields(dm.segment_threads(dump_lines(s, d))))


BASE_SQL = """
c AS (
  SELECT c_custkey // 40 AS dump, c_custkey AS tid, c_custkey % 40 AS rank,
         CASE WHEN c_custkey % 40 = 0 THEN 'main' ELSE c_name END AS name,
         CASE WHEN c_acctbal < 3000 THEN 'blocked' WHEN c_acctbal < 6000 THEN 'timed waiting'
              ELSE 'runnable' END AS state,
         c_custkey - c_custkey % 40 + ((c_custkey % 40) * 3 + 1) % 40 AS owner,
         'src.b' || c_custkey % 25 || '.' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:])
           AS cls,
         'd' || c_custkey // 40 AS dump_id, c_custkey % 40 + 1 AS thread_no
  FROM customer),
fr AS (
  SELECT *, CASE tid % 5 WHEN 0 THEN 'android.os.MessageQueue.nativePollOnce(Native method)'
              WHEN 1 THEN 'java.lang.Object.wait(Native method)'
              WHEN 2 THEN 'java.lang.Daemons$ReferenceQueueDaemon.run(Daemons.java:1)'
              WHEN 3 THEN cls || '.load(F' || tid % 60 || '.kt:' || tid % 90 + 1 || ')'
              ELSE 'kotlin.io.Reader.read(Reader.kt:9)' END AS top,
         'src.b' || tid % 25 || '.tSMALL.Cls.run(F' || tid % 60 || '.kt:' || tid % 90 + 1 || ')'
           AS own,
         CASE WHEN state = 'blocked' THEN NULL WHEN tid % 5 = 0 THEN 'looper idle'
              WHEN tid % 5 = 2 THEN 'runtime daemon' END AS idle FROM c),
g AS (
  SELECT w.dump_id, lower(to_hex(w.owner)) AS hex, '0x' || lower(to_hex(w.owner)) AS addr,
         w.owner, count(*) AS waiters, bool_or(w.name = 'main') AS blocks_main,
         arg_min(w.cls, w.thread_no) AS monitor
  FROM c w WHERE w.state = 'blocked' GROUP BY w.dump_id, w.owner),
gh AS (SELECT g.*, h.name AS holder, h.tid AS holder_tid FROM g
       LEFT JOIN c h ON h.dump_id = g.dump_id AND h.tid = g.owner)"""

SCOPE_SQL = """
two AS (SELECT *, CASE WHEN dump % 2 = 0 AND thread_no % 3 = 0 THEN 'other.app' ELSE 'an.app' END AS process FROM c),
hung AS (
  SELECT dump_id, CASE WHEN count(DISTINCT process) > 1 THEN
           CASE WHEN any_value(dump) % 4 = 0 THEN 'other.app' ELSE arg_min(process, thread_no) END END AS target
  FROM two GROUP BY dump_id),
scoped AS (
  SELECT *, target IS NULL OR process = target AS mine,
         count(*) FILTER (process <> target) OVER (PARTITION BY dump_id) AS away
  FROM two JOIN hung USING (dump_id))"""

WALK_SQL = """
e AS (SELECT w.dump_id, w.tid, w.owner AS nxt FROM c w JOIN c o ON o.tid = w.owner
      WHERE w.state = 'blocked'),
walk AS (
  SELECT dump_id, holder_tid AS start, holder_tid AS cur, 1 AS steps, [holder_tid] AS seen
  FROM gh WHERE holder_tid IS NOT NULL
  UNION ALL
  SELECT w.dump_id, w.start, e.nxt, w.steps + 1, list_append(w.seen, e.nxt)
  FROM walk w JOIN e ON e.tid = w.cur WHERE NOT list_contains(w.seen, e.nxt)),
ends AS (
  SELECT dump_id, start, max(steps) AS steps, arg_max(cur, steps) AS root,
         arg_max(seen, steps) AS seen FROM walk GROUP BY dump_id, start),
closed AS (
  SELECT x.*, e.nxt IS NOT NULL AS loops FROM ends x
  LEFT JOIN e ON e.tid = x.root AND list_contains(x.seen, e.nxt)),
chains AS (
  SELECT gh.dump_id, gh.addr, CAST(gh.holder_tid AS VARCHAR) AS holder_tid,
         CAST(k.root AS VARCHAR) AS root_tid,
         CASE WHEN gh.holder_tid IS NULL THEN 0 WHEN NOT k.loops THEN k.steps END AS holders,
         coalesce(k.loops, FALSE) AS deadlock, gh.waiters, gh.blocks_main
  FROM gh LEFT JOIN closed k ON k.dump_id = gh.dump_id AND k.start = gh.holder_tid)"""


def _q(body: str, *ctes: str) -> str:
    return with_(BASE_SQL, *ctes, body=body)


def _rq(body: str) -> str:
    return "WITH RECURSIVE " + _q(body, WALK_SQL)[5:]


_CHAIN_COLS = (f"dump_id, addr, holder_tid, root_tid, {big('holders')} AS holders, deadlock, "
               f"{big('waiters')} AS waiters, blocks_main")

QUERIES = {
    "dump_producers": (
        lambda s, d: dm.detect_producer(dump_lines(s, d)),
        _q(f"""SELECT dump_id, {big('count(*)')} AS signatures, CASE WHEN any_value(dump) % 2 = 0
               THEN 'crashlytics' ELSE 'dumpsys' END AS producer FROM c GROUP BY dump_id""")),
    "dump_headers": (_head, _q("""
        SELECT dump_id, 'com.app' || dump % 3 AS package,
               CASE WHEN dump % 2 = 0 THEN 'input timed out' END AS reason
        FROM c WHERE rank = 0""")),
    "dump_load": (
        lambda s, d: dm.dump_load(dm.segment_threads(dump_lines(s, d))),
        _q("""SELECT dump_id, 12.5::DOUBLE AS share, 'system_server' AS process,
                     CAST(1 AS INTEGER) AS place FROM c WHERE rank = 0 AND dump % 2 = 1""")),
    "dump_threads": (_threads, _q("""
        SELECT dump_id, thread_no, name, CAST(tid AS VARCHAR) AS tid,
               CAST(tid + 1000 AS VARCHAR) AS systid, state, '' AS process FROM c""")),
    "dump_frames": (
        lambda s, d: dm.dump_frames(dm.segment_threads(dump_lines(s, d))),
        _q("""SELECT dump_id, thread_no, 'java' AS kind, CAST(1 AS INTEGER) AS pos, top AS frame FROM fr
              UNION ALL SELECT dump_id, thread_no, 'java', 2, own FROM fr
              UNION ALL SELECT dump_id, thread_no, 'native', 1, 'native: #00 pc 0x1f libc.so'
              FROM fr WHERE dump % 2 = 0""")),
    "dump_locks": (
        lambda s, d: dm.dump_locks(dm.segment_threads(dump_lines(s, d))).drop("line_no"),
        _q("""SELECT dump_id, thread_no, 'wants' AS role, '0x' || lower(to_hex(owner)) AS addr,
                     cls, CAST(owner AS VARCHAR) AS owner_tid FROM c WHERE state = 'blocked'
              UNION ALL SELECT dump_id, thread_no, 'holds', '0x' || lower(to_hex(tid)), NULL, NULL
              FROM c WHERE dump % 2 = 1""")),
    "idle_threads": (_idle, _q("SELECT dump_id, thread_no, name, idle FROM fr")),
    "scope_process": (_scope, _q(f"""
        SELECT dump_id, thread_no, process, {big('away')} AS elsewhere FROM scoped WHERE mine""", SCOPE_SQL)),
    "scoped_lock_groups": (_scoped_groups, _q(f"""
        SELECT w.dump_id, '0x' || lower(to_hex(w.owner)) AS addr, {big('count(*)')} AS waiters,
               bool_or(w.name = 'main') AS blocks_main, CAST(any_value(h.tid) AS VARCHAR) AS holder_tid
        FROM scoped w LEFT JOIN scoped h ON h.dump_id = w.dump_id AND h.tid = w.owner AND h.mine
        WHERE w.mine AND w.state = 'blocked' GROUP BY w.dump_id, w.owner""", SCOPE_SQL)),
    "lock_groups": (_groups, _q(f"""
        SELECT dump_id, addr, CAST(owner AS VARCHAR) AS owner_tid, monitor, {big('waiters')} AS waiters,
               blocks_main, holder, CAST(holder_tid AS VARCHAR) AS holder_tid,
               CAST(row_number() OVER (PARTITION BY dump_id ORDER BY blocks_main DESC, waiters DESC,
                    addr, CAST(owner AS VARCHAR)) AS INTEGER) AS place
        FROM gh""")),
    "lock_roots": (_roots, _rq(f"SELECT {_CHAIN_COLS} FROM chains")),
    "deadlocks": (lambda s, d: lk.deadlocks(_roots(s, d)),
                  _rq(f"SELECT {_CHAIN_COLS} FROM chains WHERE deadlock")),
    "monitor_names": (_names, _q("""
        SELECT dump_id, addr, CAST(owner AS VARCHAR) AS owner_tid, arg_min(cls, thread_no) AS monitor,
               arg_min(CASE WHEN tid % 5 = 3 THEN cls END,
                       CASE WHEN tid % 5 = 3 THEN thread_no END) AS named
        FROM (SELECT *, '0x' || lower(to_hex(owner)) AS addr FROM c WHERE state = 'blocked')
        GROUP BY dump_id, addr, owner""")),
    "inferred_queues": (_queues, _q(f"""
        SELECT dump_id, regexp_replace(split_part(top, '(', 1), '\\.[^.]*$', '') AS monitor,
               {big('count(*)')} AS waiters, bool_or(name = 'main') AS blocks_main
        FROM fr WHERE state = 'blocked' GROUP BY 1, 2
        HAVING count(*) > 1 OR bool_or(name = 'main')""")),
    "own_frames": (_own, _q("""
        SELECT dump_id, thread_no, CAST(1 AS INTEGER) AS pos, top AS frame FROM fr WHERE tid % 5 = 3
        UNION ALL SELECT dump_id, thread_no, 2, own FROM fr""")),
    "shown_frames": (_shown, _q("""
        SELECT dump_id, thread_no, CAST(1 AS INTEGER) AS place, top AS frame FROM fr
        UNION ALL SELECT dump_id, thread_no, 2, own FROM fr""")),
    "frame_placement": (_place, _q("""
        SELECT f.frame, f.symbol, f.file, f.line,
               coalesce(a.path, n.path) AS path, a.path IS NOT NULL OR coalesce(n.n = 1, FALSE) AS exact
        FROM (SELECT DISTINCT own AS frame, split_part(own, '(', 1) AS symbol,
                     'F' || tid % 60 || '.kt' AS file, CAST(tid % 90 + 1 AS INTEGER) AS line,
                     'src/b' || tid % 25 || '/tSMALL' AS run FROM fr
              UNION SELECT DISTINCT top, split_part(top, '(', 1), 'F' || tid % 60 || '.kt',
                     CAST(tid % 90 + 1 AS INTEGER), 'src/b' || tid % 25 FROM fr WHERE tid % 5 = 3) f
        LEFT JOIN (SELECT split_part(path, '/', -1) AS file, min(path) AS path, count(*) AS n
                   FROM files GROUP BY 1) n ON n.file = f.file
        LEFT JOIN (SELECT file, run, min(path) AS path FROM (
                     SELECT split_part(path, '/', -1) AS file, path,
                            unnest([regexp_extract(path, '(src/b[0-9]+/t[A-Z]+)/', 1),
                                    regexp_extract(path, '(src/b[0-9]+)/', 1)]) AS run FROM files)
                   GROUP BY file, run) a ON a.file = f.file AND a.run = f.run""", """
        files AS (SELECT DISTINCT 'app/src/b' || split_part(p_brand, '#', 2) || '/t' || p_type
                         || '/F' || p_size || '.kt' AS path FROM part)""")),
    "unplaced_frames": (lambda s, d: dm.unplaced_frames(_place(s, d)), _q("""
        SELECT f.* FROM (
          SELECT DISTINCT own AS frame, split_part(own, '(', 1) AS symbol,
                 'F' || tid % 60 || '.kt' AS file, CAST(tid % 90 + 1 AS INTEGER) AS line FROM fr
          UNION SELECT DISTINCT top, split_part(top, '(', 1), 'F' || tid % 60 || '.kt',
                 CAST(tid % 90 + 1 AS INTEGER) FROM fr WHERE tid % 5 = 3) f
        WHERE NOT EXISTS (SELECT 1 FROM part WHERE 'F' || p_size || '.kt' = f.file)""")),
    "dump_summary": (_summary, _q(f"""
        SELECT f.dump_id, {big('count(*)')} AS threads, CAST(0 AS BIGINT) AS elsewhere,
               {big('count(*) FILTER (idle IS NULL)')} AS working,
               {big('count(idle)')} AS idle,
               {big('coalesce(any_value(k.chains), 0)')} AS chains,
               {big('coalesce(any_value(k.bm), 0)')} AS blocking_main,
               CAST(0 AS BIGINT) AS unread, CAST(0 AS BIGINT) AS skipped
        FROM fr f LEFT JOIN (SELECT dump_id, count(*) AS chains, count(*) FILTER (blocks_main) AS bm
                             FROM g GROUP BY dump_id) k ON k.dump_id = f.dump_id
        GROUP BY f.dump_id""")),
    "rank_working": (_ranked, _q("""
        SELECT dump_id, thread_no, name, own_frame, CAST(rk AS INTEGER) AS place FROM (
          SELECT *, row_number() OVER (PARTITION BY dump_id
                    ORDER BY state LIKE '%waiting', thread_no) AS rk
          FROM (SELECT *, CASE WHEN tid % 5 = 3 THEN top ELSE own END AS own_frame FROM fr
                WHERE idle IS NULL AND state <> 'blocked' AND name <> 'main'))
        WHERE rk <= 12""")),
    "threads_of_interest": (_interest, _q("""
        SELECT dump_id, thread_no, CAST(tid AS VARCHAR) AS tid FROM fr
        WHERE idle IS NULL OR name = 'main' OR tid IN (SELECT holder_tid FROM gh
              WHERE holder_tid IS NOT NULL)""")),
}
