"""Session settings the plans rely on, and intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import ContextVar
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

RUNTIME = {
    # Trace times are integers; log times compare as UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot trace in a join even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: the one the cluster names, else (local runs) a fresh one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spanmeter-"))
    return sc.getCheckpointDir().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Writes an intermediate result once and reads it back.

    For a table several later steps read: it is computed a single time, its lineage ends, its
    true size is known to the optimizer, and it outlives any executor.
    """
    spark = df.sparkSession
    path = f"{_FOLDER.get() or shared_dir(spark)}/spanmeter-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FOLDER: ContextVar[str | None] = ContextVar("folder of the tables which `settle` writes", default=None)


def settle_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """Settles what `make` gives, and gives up the tables that were settled on the way to it.

    Nothing else may read those tables. They lie in one folder, which an empty table then overwrites.
    """
    folder = f"{_FOLDER.get() or shared_dir(spark)}/spanmeter-{uuid.uuid4().hex}"
    outside = _FOLDER.set(folder)
    try:
        made = make()
    finally:
        _FOLDER.reset(outside)
    made = settle(made)
    spark.range(0).write.mode("overwrite").parquet(folder)
    return made


T = TypeVar("T")


def together(makers: Sequence[Callable[[], T]], at_once: int = 8) -> list[T]:
    """Results of functions which start jobs of their own, in order, the jobs running side by side."""
    with ThreadPoolExecutor(max(1, min(at_once, len(makers)))) as pool:
        return list(pool.map(lambda make: make(), makers))
