"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame which is written as Parquet and read again as the next one's docs. All but the last return
the columns of documents, further ones included, whatever they are called. No documents give no rows
at any stage, and texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmeter.llm import cleaning, minhash, packing, passages, toxicity
from spanmeter.llm.shipping import ship
from spanmeter.session import configure, settle


def _ready(spark: SparkSession) -> SparkSession:
    return ship(configure(spark))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the lines that fail a rule; documents which fail the base rules or lose too much text go.

    A null or empty text fails the base rules. Repeated rows, and rows without an id, are judged one by one.
    """
    _ready(spark)
    clean = cleaning.measured(docs, keep=docs.columns).where("kept and barrier >= 0")
    def column(c: str):
        if c == "text":
            return F.col("clean_text").alias(c)
        return F.length("clean_text").cast("long").alias(c) if c == "n_chars" else F.col(f"kept_columns.`{c}`").alias(c)
    return clean.select(*[column(c) for c in docs.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go.

    Null and empty texts have a score too, that of a text without any vote. Rows are scored by their text alone, so
    repeated ones go or stay together.
    """
    model = toxicity.fitted(docs, _ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"), F.struct(*docs.columns).alias("k"))
    return toxicity.score(rows, model, ["k"]).where(F.col("score") < toxicity.THRESHOLD).select("k.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-identical documents the one with the smallest id stays; one without an id stays.

    Null and empty texts are like nothing and stay. Rows with the same id are one document and stay or go together.
    """
    _ready(spark)
    gone = settle(minhash.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages which an earlier document or place keeps; a document that loses all its words goes.

    Earlier means the smaller id. Null and empty texts, and rows without an id, lose nothing. Rows with the same id
    are one document and lose the same words.
    """
    _ready(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"))
    found = settle(passages.removals(rows.where("i is not null")).select(F.col("i").alias("doc_id"), "spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = passages.without(b.column("text"), b.column("spans").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(texts, pa.string())], ["k", "t"])

    joined = docs.select("doc_id", "text", F.struct(*docs.columns).alias("k")).join(found, "doc_id", "left")
    kind = dict(joined.dtypes)["k"]
    left = joined.select("k", "text", "spans").mapInArrow(cut, f"k {kind}, t string")
    emptied = F.col("k.text").rlike(r"[^\x20\x09-\x0D]") & ~F.coalesce(F.col("t"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    def column(c: str):
        if c == "text":
            return F.col("t").alias(c)
        if c == "n_chars":
            return F.when(F.col("t") == F.col("k.text"), F.col("k.n_chars")).otherwise(F.length("t")).cast("long").alias(c)
        return F.col(f"k.`{c}`").alias(c)
    return left.where(~F.coalesce(emptied, F.lit(False))).select(*[column(c) for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each token of each document lies in the training sequences.

    A null or empty text is the end id alone. Repeated rows are packed one by one.
    """
    _ready(spark)
    return packing.packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", without_toxic),
    ("MinHash near-dedup", one_of_each_group),
    ("substring dedup", without_repeats),
    ("packing", sequences),
]
# Neither the toxicity model nor the tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
