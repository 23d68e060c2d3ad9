"""MinHash near-duplicates of documents by an inverted join over signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .near import links
from .words import shingle_sets, signatures, slices, words

COORDINATES = 96
# Two sets of similarity 0.75 agree in 72 of 96 coordinates on average, with a deviation of 4.2;
# fewer than 54 happen about once in 200 000 pairs just at the threshold, and more rarely above it.
MATCHES = 54
SHINGLE = 5
CROWD = 64                # buckets of more classes, not yet known to be one, are compared in blocks


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(*words(texts), SHINGLE)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, rows=2000):
        values, bounds = _sets(b.column("t"))
        n = np.diff(bounds)
        s = signatures(values, bounds, COORDINATES)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        twice = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * values)])
        yield pa.RecordBatch.from_arrays(
            [b.column("i"), pa.array(n, pa.int64()),
             pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)),
             pa.array((twice[bounds[1:]] - twice[bounds[:-1]]).view(np.int64)),
             _lists(s.reshape(-1), np.concatenate([[0], np.cumsum(np.where(n > 0, COORDINATES, 0))]))],
            ["i", "n", "h", "g", "keys"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, rows=2000):
        yield pa.RecordBatch.from_arrays([b.column("i"), _lists(*_sets(b.column("t")))], ["id", "items"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`.

    Sets of five-word shingles (A-Z lower-cased) are linked when 100 * common >= 75 * united. Texts
    with equal sets are one class and compared once; a class is posted under its signature's
    coordinate-value pairs, and classes with enough equal pairs are confirmed on their full sets.
    Null and empty texts have no shingle and link with nothing. A row without an id links with nothing,
    has no component and is not kept; rows with the same id are one document, returned once per row.
    Other columns of `docs` are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    signed = settle(rows.mapInArrow(_sign, "i long, n long, h long, g long, keys array<long>"))
    classes = settle(signed.where("n > 0 and i is not null").groupBy("n", "h", "g")
                     .agg(F.min("i").alias("id"), F.min_by("keys", "i").alias("keys")))

    def contents(ids: DataFrame) -> DataFrame:
        wanted = rows.join(ids.withColumnRenamed("id", "i"), "i", "left_semi")
        return (wanted.mapInArrow(_contents, "id long, items array<long>")
                .groupBy("id").agg(F.first("items").alias("items")))

    found = links(classes.select("id", "n", "keys"), MATCHES, contents, crowd=CROWD)
    named = classes.select("n", "h", "g", "id").join(found, "id", "left").select(
        "n", "h", "g", F.coalesce("component", "id").alias("c"))
    out = (signed.select("i", "n", "h", "g").join(named, ["n", "h", "g"], "left")
           .select("i", "n", F.when(F.col("i").isNotNull(), F.coalesce("c", "i")).alias("c")))
    return out.select(F.col("i").alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.col("c").alias("component_id"),
                      F.coalesce(F.col("i") == F.col("c"), F.lit(False)).alias("kept"))
