"""One query per operator, over the whole table it is meant for, and the SQL of those which have one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import sqltext
from .shipping import ship

# name of the query, module and function which make it from the table, the table, its SQL
OPERATORS = [
    ("op1_vector_packing", "packing", "packed_documents", "documents", None),
    ("op2_language", "language", "document_languages", "documents", None),
    ("op3_line_quality", "cleaning", "line_quality", "documents", sqltext.LINE_QUALITY),
    ("op4_passages", "passages", "document_passages", "documents", None),
    ("op6_huffman_files", "huffman", "coded_documents", "documents", None),
    ("op7_katz_backoff", "katz", "document_scores", "documents", None),
    ("op8_near_vectors", "multi_index", "near_vectors", "embeddings", sqltext.NEAR_VECTORS),
    ("op9_minhash_near_dedup", "minhash", "near_duplicates", "documents", sqltext.NEAR_DUPLICATES),
    ("op10_byte_bpe", "byte_bpe", "round_trip", "documents", None),
    ("op11_bit_planes", "bit_planes", "clusters", "embeddings", sqltext.CLUSTERS),
    ("op13_exact_dedup", "exact", "exact_duplicates", "documents", sqltext.EXACT_DUPLICATES),
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _bound(module: str, function: str, table: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        make = getattr(import_module(f"{__package__}.{module}"), function)
        return make(read(ship(configure(spark)), sf_dir, table))
    return query


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import document_toxicity
    return document_toxicity(ship(configure(spark)), read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resampled
    return resampled(read(ship(configure(spark)), sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _bound(module, function, table) for name, module, function, table, _ in OPERATORS}
    return found | {"op5_toxicity": _toxicity, "op12_resampling": _resampled}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, *_, sql in OPERATORS if sql is not None} | {"op12_resampling": sqltext.RESAMPLED}
