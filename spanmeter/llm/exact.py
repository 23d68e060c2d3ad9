"""Exact duplicates by skew-safe combining, with DataFrame functions only.

Three steps, each comparing whole texts and not their digests alone:

1. local: the map side of the first grouping folds the copies a task reads into one row per salt;
2. salted: rows with the same (digest, salt, text) meet, so that a text which a third of all rows share
   is spread over SALTS keys;
3. global: at most SALTS winners of a text meet and give its largest id and its number of rows.

A group remembers as a bit mask which salts its rows have, so rows find their group again on (digest,
salt), where the hottest text is spread as in step 2. Texts themselves are not needed for that unless two
texts share a digest, which step 3 sees: such digests are then matched on their texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

SALTS = 64   # bits of the mask


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("i"), text.alias("t")).withColumns({
        "d": digest(F.col("t")), "salt": F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int")})


def _texts(rows: DataFrame) -> DataFrame:
    """(d, t, keep, n, salts): one row per distinct text."""
    salted = rows.groupBy("d", "salt", "t").agg(F.max("i").alias("keep"), F.count(F.lit(1)).alias("n"))
    # Partitioned by digest alone, so that the texts of a digest lie together for the next grouping too.
    return (salted.repartition("d").groupBy("d", "t")
            .agg(F.max("keep").alias("keep"), F.sum("n").alias("n"),
                 F.expr("bit_or(shiftleft(1L, salt))").alias("salts")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of `docs`.

    Texts are equal when their bytes are; a null counts as empty, texts of any length are compared whole.
    Of equal texts the largest id stays. Rows without an id count in group_size and are never kept (nor has
    a group of such rows a keep_id); rows with the same id and text count each and are kept together. An empty
    table gives no rows; other columns are not read. `digest` only deals the texts out: a digest with few
    values gives the same result, more slowly.
    """
    rows = _rows(docs, id_col, text_col, digest)
    by_digest = (_texts(rows).groupBy("d").agg(
        F.max("keep").alias("keep"), F.max("n").alias("n"), F.max("salts").alias("salts"),
        F.count(F.lit(1)).alias("texts")).where("n > 1 or texts > 1"))
    found = settle(by_digest)
    groups = (found.where("texts = 1")
              .select("d", "keep", "n", F.explode(F.filter(
                  F.sequence(F.lit(0), F.lit(SALTS - 1)),
                  lambda s: F.expr("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s)) != 0))
                  .alias("salt")))
    shared = found.where("texts > 1").select("d")
    alone = rows
    if not shared.isEmpty():
        alone = rows.join(shared, "d", "left_anti")
    slim = alone.select("i", "d", "salt", F.sha2("t", 256).alias("text_sha256"))
    out = slim.join(groups, ["d", "salt"], "left")
    if alone is not rows:
        met = rows.join(shared, "d", "left_semi")
        out = out.select("i", "keep", "n", "text_sha256").union(
            met.join(_texts(met).select("d", "t", "keep", "n"), ["d", "t"])
            .select("i", "keep", "n", F.sha2("t", 256)))
    keep = F.when(F.col("n").isNull(), F.col("i")).otherwise(F.col("keep"))
    return (out.select(F.col("i").alias("doc_id"), keep.alias("keep_id"),
                       F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
            .select("doc_id", "keep_id", "group_size",
                    F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one text once, under its largest id."""
    stay = settle(exact_duplicates(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct())
    same = (docs[id_col].cast("long") == stay["_id"]) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == stay["_sha"])
    return docs.join(stay, same, "left_semi")
