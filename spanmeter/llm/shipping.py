"""Makes this library importable in Python workers that don't share the driver's path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the library's source to the workers, once per application; workers that have it use their own."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        handle, name = tempfile.mkstemp(prefix="spanmeter-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(name, "w") as z:
            for folder, _, files in os.walk(top):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(top)))
        sc.addPyFile(name)
        _SHIPPED.add(sc.applicationId)
    return spark
