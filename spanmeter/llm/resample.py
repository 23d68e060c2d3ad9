"""Importance resampling towards a target distribution, by hashed word runs.

Bytes are translated by one table of 256 entries, which lower-cases A-Z and blanks separators, and split;
separators are ASCII, so cutting UTF-8 gives the same words as cutting code points. The crc32 of a run of
words is continued from that of the run before it, so a run of n words is hashed n bytes-objects long and
never joined. Tasks count buckets in a Counter; the sums of all tasks meet in one grouping by bucket.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

RUNS = 1            # longest run of words
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024

# Words are runs of digits, letters and bytes from 0x80; everything else is blanked.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))
WORDS_AT_ONCE = 1 << 16


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def hashes(found: list[bytes], runs: int) -> Iterator[list[int]]:
    """The crc32 of each run of 1 to `runs` words, joined by single spaces, in parts of bounded size."""
    for at in range(0, len(found), WORDS_AT_ONCE):
        part = found[at:at + WORDS_AT_ONCE + runs - 1]   # with the words the last runs go on to
        seeds = list(map(crc32, part))
        yield seeds[:WORDS_AT_ONCE]
        for n in range(1, runs):
            seeds = [crc32(w, crc32(b" ", s)) for w, s in zip(part[n:], seeds, strict=False)]
            yield seeds[:WORDS_AT_ONCE]


def bucket_counts(texts: DataFrame, text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket occurs in all texts, repeats counted. Null texts hold none."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for b in batches:
            for text in b.column(0):
                for part in hashes(words(text.as_py()), runs):
                    total.update([h % buckets for h in part])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(total), pa.int32()),
                                          "n": pa.array(list(total.values()), pa.int64())})

    return (texts.select(F.col(text_col).alias("t")).mapInArrow(count, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln) of how much likelier each bucket is in the target, both counts smoothed by one."""
    s_all, t_all = sum(raw.values()) + buckets, sum(target.values()) + buckets
    return [math.floor(1000 * math.log(float((target.get(k, 0) + 1) * s_all) / float((raw.get(k, 0) + 1) * t_all)))
            for k in range(buckets)]


def weights(docs: DataFrame, gains: list[int], id_col: str = "doc_id", text_col: str = "text",
            runs: int = RUNS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a document's runs; 0 without any."""
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_features, means = [], [], []
            for text in b.column(1):
                found = words(text.as_py())
                n = total = 0
                for part in hashes(found, runs):
                    n += len(part)
                    total += sum([gains[h % buckets] for h in part])
                n_words.append(len(found))
                n_features.append(n)
                means.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0)] + [pa.array(x, pa.int64()) for x in (n_words, n_features, means)],
                ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the document's id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """`rows` (doc_id, n_words, score, others) with rank: 1, 2, 3 ... for the `percent` % drawn, else null.

    Scores are whole thousandths of logarithms, so their distinct values are bounded by the logarithm of the
    counts: the lowest score drawn is read off their histogram. Rows from there on are sorted by range
    over all tasks; a row's rank is its place in its range plus the sizes of the ranges before it.
    """
    able = F.col("n_words") >= min_words
    bins = rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).collect()
    want = sum(b["n"] for b in bins) * percent // 100
    lowest, seen = None, 0
    for b in bins:
        if seen >= want:
            break
        lowest, seen = b["score"], seen + b["n"]
    if lowest is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    near = able & (F.col("score") >= lowest)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = settle(rows.where(near).repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("place", F.monotonically_increasing_id()))
    # One row per range: as many as there are shuffle partitions.
    sizes = placed.groupBy(F.shiftright("place", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    before, at = {}, 0
    for s in sizes:
        before[s["p"]], at = at, at + s["n"]
    starts = F.create_map(*[F.lit(x) for p in before.items() for x in p])
    rank = (F.element_at(starts, F.shiftright("place", 33)) + F.col("place").bitwiseAND((1 << 33) - 1) + 1).cast("long")
    drawn = placed.withColumn("rank", rank).drop("place").withColumn("rank", F.when(F.col("rank") <= want, F.col("rank")))
    return drawn.unionByName(rows.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              target_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS, percent: int = PERCENT,
              min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of `docs`.

    The `percent` % with the highest scores of the documents with `min_words` words are drawn; equal scores go to
    the smaller id, a row without an id comes last. A null or empty text has no feature and weight 0; texts of
    any length count whole. Rows with the same id get the same noise and a rank each. An empty target, or no
    documents at all, leave all gains at what smoothing gives; an empty `docs` gives no rows. Other columns are
    not read. The counts of the `buckets` buckets are all that the driver sees of the texts.
    """
    raw, wanted = ({r["bucket"]: r["n"] for r in bucket_counts(x, c, runs, buckets).collect()}
                   for x, c in ((docs, text_col), (target, target_col)))
    gains = bucket_gains(raw, wanted, buckets)
    scored = settle(weights(docs, gains, id_col, text_col, runs)
                    .withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return ranked(scored, percent, min_words).select("doc_id", "n_features", "weight", "score", "rank")
