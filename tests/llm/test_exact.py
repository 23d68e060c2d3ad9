"""Exact duplicates against dictionaries: nulls, empty and very long texts, repeated rows, digests that collide."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from spanmeter.llm import exact

LONG = "lorem ipsum " * 300_000
ROWS = [(1, "a"), (5, "a"), (3, "a "), (2, None), (9, ""), (4, LONG), (7, LONG), (6, LONG + "."), (8, "B"), (10, "b"),
        (11, "twice"), (11, "twice"), (12, "twice, another text"), (12, "b"), (None, "a"), (None, "only here"), (None, "only here"),
        (-3, "é"), (-4, "é"), (13, "\x00"), (14, "\x00")] + [(k, "hot") for k in range(100, 400)]


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i is not None and i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2, "k", "s") for i, t in ROWS],
                                 "doc_id long, text string, t string, i long, n long, d string, salt string").repartition(5)


def rows(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def test_groups_of_equal_texts(docs):
    assert rows(exact.exact_duplicates(docs)) == brute(ROWS)


@pytest.mark.parametrize("digest", [lambda t: F.substring(F.sha2(t, 256), 1, 1), lambda t: F.lit("same")])
def test_texts_are_compared_and_not_digests(docs, digest):
    assert rows(exact.exact_duplicates(docs, digest=digest)) == brute(ROWS)


def test_empty_table_and_other_columns(docs):
    assert rows(exact.exact_duplicates(docs.where("false"))) == []
    left = exact.without_copies(docs)
    assert left.columns == docs.columns
    kept = [(i, sha) for i, _, _, stays, sha in brute(ROWS) if stays]
    assert sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in left.collect()) == sorted(kept)


def test_no_python_in_the_plan(docs):
    plan = exact.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
