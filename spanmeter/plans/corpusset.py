"""Corpus queries: the pages as source files, their markup as the code which is searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as cp
from ..session import settle
from .bridge import table
from .sqltext import big, with_

# Markup in the place of code: a link is a qualified call, a paragraph a declaration.
PATTERNS = cp.SitePatterns(
    qualified=r'<a href="([^"]*)"', bare=r"<li>([a-zA-Z]+)", bare_import=r"<script",
    dynamic=r"<img ", method=r"<h[1-6]>([a-zA-Z]+)", symbol=r"<(p|div)>([a-zA-Z]+)")
# A rare link as the only tracing call, so that some modules have none.
RARE = cp.SitePatterns(
    qualified=r'<a href="(/In[^"]*)"', bare=r"<rare>(x)", bare_import=r"<script",
    dynamic=r"<img ", method=PATTERNS.method, symbol=PATTERNS.symbol)
INVENTORY = [("links", r"<a "), ("lists", r"<li>"), ("images", r"<img "), ("scripts", r"<script")]


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        F.concat(F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", ""),
                 F.lit("/"), F.col("page_id").cast("string"), F.lit(".kt")).alias("path"),
        F.regexp_replace("html", "><", ">\n<").alias("text"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return cp.site_lines(files(spark, sf), PATTERNS)


def dirs(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts are modules; so are the language folders of hosts with an even length."""
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", "")
    host = F.substring_index(path, "/", 1)
    second = F.when(F.length(host) % 2 == 0, F.substring_index(path, "/", 2))
    script = F.lit("/build.gradle")
    built = F.explode(F.array_compact(F.array(
        F.when(F.length(host) % 3 > 0, F.concat(host, script)), F.concat(second, script))))
    return cp.build_dirs(table(spark, sf, "pages").select(built.alias("path")))


def _stats(s, d, patterns=PATTERNS):
    return cp.module_stats(cp.site_lines(files(s, d), patterns),
                           cp.file_modules(files(s, d), dirs(s, d)))


def _map(s, d):
    m = cp.name_map(cp.trace_sites(settle(lines(s, d))))
    return m.withColumn("others", F.concat_ws(",", "others"))


BASE_SQL = r"""
files AS (
  SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS url,
         regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || '/' || page_id
           || '.kt' AS path, replace(html, '><', '>' || chr(10) || '<') AS text FROM pages),
cut AS (SELECT path, contains(text, '<script') AS bare,
               unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM files),
lines AS (
  SELECT path, CAST(line_no AS INTEGER) AS line_no, line,
         regexp_extract_all(line, '<a href="([^"]*)"', 1)
           || CASE WHEN bare THEN regexp_extract_all(line, '<li>([a-zA-Z]+)', 1) ELSE [] END AS names,
         contains(line, '<img ') AS dynamic,
         CASE WHEN regexp_matches(line, '<h[1-6]>[a-zA-Z]+')
              THEN 'method ' || regexp_extract(line, '<h[1-6]>([a-zA-Z]+)', 1)
              WHEN regexp_matches(line, '<(p|div)>[a-zA-Z]+')
              THEN regexp_extract(line, '<(p|div)>([a-zA-Z]+)', 1) || ' '
                   || regexp_extract(line, '<(p|div)>([a-zA-Z]+)', 2) END AS symbol
  FROM cut),
sites AS (SELECT path, line_no, unnest(names) AS name,
                 CAST(generate_subscripts(names, 1) - 1 AS INTEGER) AS pos FROM lines),
host AS (SELECT DISTINCT url, split_part(url, '/', 1) AS h FROM files),
dirs AS (SELECT h AS dir FROM host WHERE length(h) % 3 > 0
         UNION SELECT h || CASE WHEN contains(url, '/') THEN '/' || split_part(url, '/', 2) ELSE '' END
         FROM host WHERE length(h) % 2 = 0),
modules AS (
  SELECT f.path, ':' || replace(coalesce(arg_max(d.dir, length(d.dir)), ''), '/', ':') AS module
  FROM files f LEFT JOIN dirs d ON starts_with(f.path, d.dir || '/') GROUP BY f.path)"""

_NEAR_SQL = """
near AS (
  SELECT *, max(CASE WHEN symbol IS NOT NULL THEN line_no END) OVER (
            PARTITION BY path ORDER BY line_no ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS at
  FROM lines)"""


def _q(body: str, *ctes: str) -> str:
    return with_(BASE_SQL, *ctes, body=body)


_STATS_SQL = f"""
stats AS (
  SELECT m.module, {big('count(*)')} AS files, {big('sum(n)')} AS lines, {big('sum(s)')} AS sites,
         {big('sum(y)')} AS dynamic
  FROM modules m JOIN (SELECT path, count(*) AS n, sum(len(names)) AS s,
                              count(*) FILTER (dynamic) AS y FROM lines GROUP BY path) l
    ON l.path = m.path GROUP BY m.module)"""

QUERIES = {
    "trace_sites": (lambda s, d: cp.trace_sites(lines(s, d)),
                    _q("SELECT path, line_no, pos, name FROM sites")),
    "file_modules": (lambda s, d: cp.file_modules(files(s, d), dirs(s, d)),
                     _q("SELECT path, module FROM modules")),
    "module_stats": (_stats, _q("SELECT * FROM stats", _STATS_SQL)),
    "nearest_symbol": (
        lambda s, d: cp.nearest_symbol(settle(lines(s, d))),
        _q("""SELECT s.path, s.line_no, s.pos, s.name, l.symbol FROM sites s
              JOIN near n ON n.path = s.path AND n.line_no = s.line_no
              LEFT JOIN lines l ON l.path = n.path AND l.line_no = n.at""", _NEAR_SQL)),
    "name_map": (_map, _q(f"""
        SELECT name, max(CASE WHEN rk = 1 THEN path END) AS path,
               max(CASE WHEN rk = 1 THEN line_no END) AS line_no, {big('count(*)')} AS sites,
               coalesce(string_agg(CASE WHEN rk BETWEEN 2 AND 4 THEN path || ':' || line_no END, ','
                                   ORDER BY rk), '') AS others
        FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, line_no, pos) AS rk
              FROM sites) GROUP BY name""")),
    "uninstrumented_modules": (
        lambda s, d: cp.bare_modules(_stats(s, d, RARE)),
        _q("SELECT * FROM stats WHERE sites = 0 ORDER BY lines DESC, module LIMIT 12",
           _STATS_SQL.replace("len(names)", """len(regexp_extract_all(line, '<a href="(/In[^"]*)"', 1))"""))),
    "leftover_markers": (
        lambda s, d: cp.leftover_markers(files(s, d), "<p", "</p>"),
        _q(f"""SELECT path, {big('count(*)')} AS markers,
                      {big("count(*) FILTER (contains(line, '</p>'))")} AS removable
               FROM lines WHERE contains(line, '<p') GROUP BY path""")),
    "pattern_inventory": (
        lambda s, d: cp.pattern_inventory(files(s, d), INVENTORY),
        _q(f"""SELECT kind, {big('count(DISTINCT path)')} AS files, {big('count(*)')} AS lines FROM (
                 SELECT path, 'links' AS kind FROM lines WHERE contains(line, '<a ')
                 UNION ALL SELECT path, 'lists' FROM lines WHERE contains(line, '<li>')
                 UNION ALL SELECT path, 'images' FROM lines WHERE contains(line, '<img ')
                 UNION ALL SELECT path, 'scripts' FROM lines WHERE contains(line, '<script')
                 ) GROUP BY kind""")),
    "source_lines": (
        lambda s, d: lines(s, d).groupBy("path").agg(
            F.max("line_no").alias("lines"), F.count("symbol").alias("symbols")),
        _q(f"SELECT path, max(line_no) AS lines, {big('count(symbol)')} AS symbols FROM lines "
           f"GROUP BY path")),
}
