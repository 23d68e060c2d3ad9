"""All ready queries by name, and the SQL of those which have one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

MODULES = ["traces", "reports", "inventories", "dumpset", "logset", "corpusset", "loading"]


def _entries() -> dict:
    out: dict = {}
    for m in MODULES:
        for name, pair in import_module(f"{__package__}.{m}").QUERIES.items():
            if name in out:
                raise ValueError(f"two queries named {name}")
            out[name] = pair
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(fn):
        return lambda spark, sf_dir: fn(configure(spark), sf_dir)
    return {name: bound(fn) for name, (fn, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql is not None}
