"""Line-first cleaning: rules per line, then a verdict on what a document has lost. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LOST_PERCENT = 40     # of the characters in words
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

# What a line that is not prose looks like.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
SENTENCE_END = r"[.!?…。！？:;](['\")\]»”’]*)[\x20\x09-\x0D]*$"
NAVIGATION = (r"(?i)^[\x20\x09-\x0D>|*-]*(home|menu|next|previous|prev|back|back to top|skip to (main )?content|"
              r"login|log in|sign in|sign up|register|subscribe|share|print|search|read more|contact us|sitemap)"
              r"([\x20\x09-\x0D>|*-]|$)")
BOILERPLATE = (r"(?i)(all rights reserved|is licensed under|^licensed under|^released under|terms of (use|service)|"
               r"privacy policy|cookie policy|we use cookies|enable javascript|copyright (\(c\)|©)|lorem ipsum)")
SHOUTED = r"^[^a-z]*[A-Z][^a-z]*[A-Z]{3}[^a-z]*$"
SHOUTED_END = r"!!+[\x20\x09-\x0D]*$"
NAVIGATION_WORDS = 8      # a longer line is a sentence which happens to begin so
BOILERPLATE_WORDS = 30
UNENDED_WORDS = 4         # a shorter line may be a heading
SYMBOL_PERCENT = 10


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda x: x != "")


def _chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def _failing(words: Column, line: Column) -> Column:
    """Whether a line with a word fails one of the rules."""
    n = F.size(words)
    symbols = F.length(F.regexp_replace(line, NOT_SYMBOLS, ""))
    return ((symbols * 100 > F.length(F.array_join(words, "")) * SYMBOL_PERCENT)
            | ((n >= UNENDED_WORDS) & ~line.rlike(SENTENCE_END))
            | ((n <= NAVIGATION_WORDS) & line.rlike(NAVIGATION))
            | ((n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
            | ((n >= UNENDED_WORDS) & line.rlike(SHOUTED))
            | line.rlike(SHOUTED_END))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """One row per document: its counts, the verdicts and the text without the failing lines.

    Columns: a struct `kept_columns` of the columns named in `keep`, doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word), n_failed_lines,
    lost_chars, base_failed, kept, clean_text (lines that fail are left out, all others and the
    blank ones stay), and barrier: a filter which also names it (`barrier >= 0`, always true) is not
    pushed below the measures, where it would write their nested expressions out many times over.
    A null or empty text has no words and fails the base rules. Columns of `docs`
    that are not named are not read, so no name can clash.
    """
    keep = keep or []
    d = docs.select(F.struct(*[F.col(c) for c in keep] or [F.lit(None).alias("none")]).alias("kept_columns"),
                    F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("w", _words(F.col("t")))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    # Three-word windows by hash; only a text with an equal pair sorts them.
    d = d.withColumn("h", F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("w") - 3),
        lambda i: F.xxhash64(F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2]))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    d = d.withColumn("starts", F.sort_array(F.transform(F.filter(
        F.transform("s", lambda e, k: F.struct(e["i"].alias("i"), (
            ((k > 0) & (F.try_element_at("s", k)["x"] == e["x"]))
            | ((k + 1 < F.size("s")) & (F.try_element_at("s", k + 2)["x"] == e["x"]))).alias("again"))),
        lambda e: e["again"]), lambda e: e["i"])))
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).cast("long").alias("c"), F.lit(-3).alias("at")),
        lambda a, x: F.struct((a["c"] + F.least(F.lit(3), x - a["at"])).alias("c"), x.alias("at")))["c"]
    d = d.withColumn("lines", F.transform(
        F.split("t", "\n"), lambda x: F.struct(x.alias("line"), _words(x).alias("w"))))
    d = d.withColumn("judged", F.transform("lines", lambda x: F.struct(
        x["line"].alias("line"), F.size(x["w"]).alias("n"),
        ((F.size(x["w"]) > 0) & _failing(x["w"], x["line"])).alias("failed"), _chars(x["w"]).alias("chars"))))
    worded = F.filter("judged", lambda x: x["n"] > 0)
    d = d.withColumn("worded", F.transform(worded, lambda x: x["line"]))
    d = d.select(
        "kept_columns", "doc_id", "n_words", _chars(F.col("w")).alias("word_chars"),
        F.length(F.regexp_replace("t", NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("worded").cast("long").alias("n_lines"),
        F.size(F.filter("judged", lambda x: x["failed"])).cast("long").alias("n_failed_lines"),
        F.aggregate(F.filter("judged", lambda x: x["failed"]), F.lit(0).cast("long"),
                    lambda a, x: a + x["chars"]).alias("lost_chars"),
        F.array_join(F.transform(F.filter("judged", lambda x: ~x["failed"]), lambda x: x["line"]), "\n")
        .alias("clean_text"), F.rand().alias("barrier"))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                     | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT))
    return d.withColumn("kept", ~F.col("base_failed")
                        & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST_PERCENT))


def line_quality(docs: DataFrame) -> DataFrame:
    """The counts and verdicts of `measured` for each document."""
    return measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                 "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars")
