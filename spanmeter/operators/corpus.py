"""A source corpus scanned for instrumentation: sites, modules, declarations, markers.

`files(path, text)`; lines are split inside Spark and only the lines a rule needs travel on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import lng
from ..functions.ordered import carry, line_cell, top_k
from ..sources.readers import text_lines

# How a tracing call and a declaration look in Kotlin and Java.
_LITERAL = r'"((?:[^"\\]|\\.)*)"'


@dataclass(frozen=True)
class SitePatterns:
    """`qualified` counts everywhere, `bare` only in a file which holds `bare_import`."""

    qualified: str = (r"\b(?:Trace|TraceCompat)\s*\.\s*(?:beginSection|beginAsyncSection)\s*\(\s*"
                      + _LITERAL)
    bare: str = r"\btrace\s*\(\s*" + _LITERAL
    bare_import: str = r"(?m)^\s*import\s+androidx\.tracing"
    dynamic: str = (r"\b(?:trace|Trace\s*\.\s*beginSection|TraceCompat\s*\.\s*beginSection)\s*\(\s*"
                    r"(?!\")[A-Za-z_$]")
    method: str = (r"^\s*(?:@\w+\s+)*(?:(?:public|private|protected|static|final|synchronized|"
                   r"abstract|native)\s+)+[\w<>\[\],.\s]+?\s+(\w+)\s*\([^;{]*\)\s*"
                   r"(?:throws [\w,.\s]+)?\{")
    symbol: str = (r"^\s*(?:@\w+\s+)*(?:(?:public|private|internal|protected|suspend|inline|"
                   r"override|open|final|static|abstract)\s+)*(fun|class|object|interface|val|var)"
                   r"\s+([A-Za-z_]\w*)")


# Entry points a first marker would go to.
ENTRY_POINTS: list[tuple[str, str]] = [
    ("room_open", r"\bRoom\s*\.\s*(?:databaseBuilder|inMemoryDatabaseBuilder)\s*\("),
    ("di_koin", r"\bstartKoin\s*\{"),
    ("di_hilt", r"@HiltAndroidApp\b"),
    ("set_content", r"\bsetContent\s*(?:\([^)]*\)\s*)?\{"),
    ("set_content_view", r"\bsetContentView\s*\("),
]
BUILD_FILE = r"(^|/)build\.gradle(\.kts)?$"


def site_lines(files: DataFrame, p: SitePatterns = SitePatterns()) -> DataFrame:
    """Lines of the corpus with the names of their tracing calls: `path, line_no, names, dynamic,
    symbol`."""
    flagged = files.select("path", "text", F.col("text").rlike(p.bare_import).alias("_bare"))
    lines = text_lines(flagged.select(F.struct("path", "_bare").alias("_k"), "text"), "_k", "text")
    line = F.col("line")
    names = F.regexp_extract_all(line, F.lit(p.qualified), 1)
    bare = F.regexp_extract_all(line, F.lit(p.bare), 1)
    method = F.regexp_extract(line, p.method, 1)
    kind = F.regexp_extract(line, p.symbol, 1)
    symbol = (F.when(method != "", F.concat(F.lit("method "), method)).when(
        kind != "", F.concat(kind, F.lit(" "), F.regexp_extract(line, p.symbol, 2))))
    return lines.select(
        F.col("_k.path").alias("path"), "line_no",
        F.when(F.col("_k._bare"), F.concat(names, bare)).otherwise(names).alias("names"),
        line.rlike(p.dynamic).alias("dynamic"), symbol.alias("symbol"))


def trace_sites(lines: DataFrame) -> DataFrame:
    """One row per tracing call with a literal name: `path, line_no, pos, name`."""
    return lines.where(F.size("names") > 0).select(
        "path", "line_no", F.posexplode("names").alias("pos", "name"))


def build_dirs(paths: DataFrame) -> DataFrame:
    """Directories which hold a build script, from a listing of paths; the root is ''."""
    return paths.where(F.col("path").rlike(BUILD_FILE)).select(
        F.regexp_replace("path", r"/?[^/]+$", "").alias("dir")).distinct()


def file_modules(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """`path, module`: the nearest ancestor directory with a build script, `:` when there is none."""
    parts = F.split(F.regexp_replace("path", r"/?[^/]+$", ""), "/")
    above = files.select("path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
        .alias("dir"))
    hit = above.join(dirs.select("dir"), "dir").groupBy("path").agg(
        F.max_by("dir", F.length("dir")).alias("dir"))
    return files.select("path").join(hit, "path", "left").select(
        "path", F.concat(F.lit(":"), F.translate(F.coalesce("dir", F.lit("")), "/", ":"))
        .alias("module"))


def module_stats(lines: DataFrame, modules: DataFrame) -> DataFrame:
    """Per module: files, lines, sites and sites whose name is built at runtime."""
    per_file = lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.size("names")).alias("sites"),
        F.count_if("dynamic").alias("dynamic"))
    d = modules.join(per_file, "path", "left")
    return d.groupBy("module").agg(F.count(F.lit(1)).alias("files"), *[
        F.sum(F.coalesce(c, lng(0))).alias(c) for c in ("lines", "sites", "dynamic")])


def nearest_symbol(lines: DataFrame, back: int = 60) -> DataFrame:
    """Sites with the nearest declaration among the `back` lines up to their own, else NULL."""
    at = F.col("line_no").cast("long")
    d = lines.where((F.size("names") > 0) | F.col("symbol").isNotNull())
    d = carry(d, ["path"], ["line_no"], line_cell(), maxes={
        "_near": F.when(F.col("symbol").isNotNull(), F.struct(at.alias("at"), "symbol"))})
    near = F.when(F.col("_near.at") > at - back, F.col("_near.symbol"))
    return d.where(F.size("names") > 0).select(
        "path", "line_no", near.alias("symbol"), F.posexplode("names").alias("pos", "name"))


def name_map(sites: DataFrame, others: int = 3) -> DataFrame:
    """One row per name: its first site by path and line, how many there are, a few more places."""
    total = sites.groupBy("name").agg(F.count(F.lit(1)).alias("sites"))
    best = top_k(sites, ["name"], [F.col("path"), F.col("line_no"), F.col("pos")], others + 1,
                 rank="_p")
    place = F.concat("path", F.lit(":"), F.col("line_no").cast("string"))
    # At most `others` + 1 rows of a name are left.
    firsts = best.groupBy("name").agg(
        F.min_by(F.struct("path", "line_no"), "_p").alias("_f"),
        F.array_sort(F.collect_list(F.when(F.col("_p") > 1, F.struct("_p", place.alias("x")))))
        .alias("_o"))
    return firsts.join(total, "name").select(
        "name", F.col("_f.path").alias("path"), F.col("_f.line_no").alias("line_no"), "sites",
        F.transform("_o", lambda o: o["x"]).alias("others"))


def bare_modules(stats: DataFrame, n: int = 12) -> DataFrame:
    """The largest modules without a single site."""
    return stats.where(F.col("sites") == 0).orderBy(F.col("lines").desc(), "module").limit(n)


def leftover_markers(files: DataFrame, prefix: str, tag: str) -> DataFrame:
    """Per file: lines which hold the marker prefix, and those of them a removal would delete."""
    kept = files.where(F.col("text").contains(prefix))
    lines = text_lines(kept, "path", "text").where(F.col("line").contains(prefix))
    return lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("markers"), F.count_if(F.col("line").rlike(tag)).alias("removable"))


def pattern_inventory(files: DataFrame, patterns: Sequence[tuple[str, str]] = ENTRY_POINTS
                      ) -> DataFrame:
    """Per pattern: files and lines which match. The patterns are a parameter of fixed size."""
    lines = text_lines(files, "path", "text")
    hits = F.array_compact(F.array(*[
        F.when(F.col("line").rlike(rx), F.lit(kind)) for kind, rx in patterns]))
    per_file = lines.select("path", F.explode(hits).alias("kind")).groupBy("kind", "path").agg(
        F.count(F.lit(1)).alias("_n"))
    return per_file.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("_n").alias("lines"))


