"""Pure Column helpers: name globs, name families, unit conversion, stable text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_MS = 1_000_000
# Stands in for a NULL name inside join keys, where NULL would match nothing.
NO_NAME = "\u0000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def glob(c: Column | str, pattern: str) -> Column:
    """Case-sensitive whole-string GLOB (`*`, `?`, `[..]`, `[^..]`).

    The three shapes with only outer stars become startswith / endswith / contains,
    which the Parquet scan can push down or evaluate without a regex.
    """
    c = col(c)
    body = pattern.strip("*")
    if not re.search(r"[*?\[]", body):
        lead, trail = pattern.startswith("*"), pattern.endswith("*")
        if not body:
            return c.isNotNull() if pattern else c == F.lit("")
        if lead and trail:
            return c.contains(body)
        if trail:
            return c.startswith(body)
        if lead:
            return c.endswith(body)
        return c == F.lit(pattern)
    return c.rlike(glob_regex(pattern))


def glob_regex(pattern: str) -> str:
    """The anchored regular expression which accepts the same strings as the glob."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1:end].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[{inner}]")
            i = end
        else:
            out.append(re.escape(ch))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def any_glob(c: Column | str, patterns: list[str | None]) -> Column:
    """True where any of the given globs matches; a missing pattern matches nothing."""
    out = F.lit(False)
    for p in patterns:
        if p is not None:
            out = out | glob(c, p)
    return out


def family(c: Column | str) -> Column:
    """Names which differ only in numbers become one: hex first, then digits."""
    return F.regexp_replace(F.regexp_replace(col(c), r"0x[0-9a-fA-F]+", "0x#"), r"\d+", "#")


def as_key(c: Column | str) -> Column:
    """A name which can be joined on; `from_key` gives the NULL back."""
    return F.coalesce(col(c), F.lit(NO_NAME))


def from_key(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(NO_NAME))


def nonneg(c: Column | str) -> Column:
    """SQL two-argument MAX(x, 0): NULL stays NULL."""
    c = col(c)
    return F.when(c < 0, F.lit(0).cast("long")).otherwise(c)


def ns(ms: float) -> int:
    """A millisecond threshold as LONG nanoseconds, so that no INT product can overflow."""
    return round(ms * NS_PER_MS)


def lng(value: int) -> Column:
    return F.lit(int(value)).cast("long")


def _scaled(value: Column, unit: int) -> Column:
    """Integer division by `unit`, half away from zero."""
    half = lng(unit // 2)
    return F.when(
        value >= 0, F.call_function("div", value + half, lng(unit))
    ).otherwise(-F.call_function("div", -value + half, lng(unit)))


def to_ms(value: Column | str) -> Column:
    """Nanoseconds as milliseconds with two digits, rounded on integers."""
    return _scaled(col(value).cast("long"), 10_000).cast("double") / F.lit(100.0)


def ms_text(value: Column | str) -> Column:
    """Nanoseconds as `12.3`, one digit, never in exponent form."""
    return tenths_text(_scaled(col(value).cast("long"), 100_000))


def tenths_text(tenths: Column) -> Column:
    size = F.abs(tenths)
    return F.concat(
        F.when(tenths < 0, F.lit("-")).otherwise(F.lit("")),
        F.call_function("div", size, lng(10)).cast("string"), F.lit("."),
        (size % lng(10)).cast("string"),
    )


def hundredths(value: Column | str) -> Column:
    """A two-digit double as an exact integer count of hundredths."""
    return F.round(col(value) * F.lit(100.0)).cast("long")


def half_up_mean(a: Column, b: Column) -> Column:
    """Mean of two integers, half away from zero."""
    return _scaled(a + b, 2)


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def epoch_us(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def iso_text(ts: Column | str) -> Column:
    """A timestamp as ISO-8601 UTC text with microseconds."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def clip_text(c: Column | str, limit: int) -> Column:
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


# The first line of a here-document stays, its body goes.
HEREDOC = (r"(?s)(<<-?[ \t\r\f]*(['\"]?)([A-Za-z_][A-Za-z0-9_]*)\2[^\n]*\n)"
           r"(?:.*?\n)?\s*\3[ \t]*(?=\n|$)")


def strip_heredocs(c: Column | str) -> Column:
    """A shell command without the here-document bodies it carries."""
    return F.regexp_replace(col(c), HEREDOC, "$1")


def age_text(seconds: Column) -> Column:
    """How long ago, in the coarsest unit which still says something."""
    s = seconds.cast("double")
    return (
        F.when(s.isNull(), F.lit("never"))
        .when(s < 90, F.concat(F.floor(s).cast("string"), F.lit("s ago")))
        .when(s < 5400, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
        .when(s < 172800, F.concat(F.bround(s / 3600).cast("long").cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.bround(s / 86400).cast("long").cast("string"), F.lit("d ago")))
    )
