"""Importance resampling against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from spanmeter.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "The quick-brown fox; jumps over 12 lazy dogs and élan vital " * 20_000
TEXTS = [(k, f"word{k % 7} common Common, text {'again ' * (k % 5)}number {k} of many rows that hold at least twenty words in a row "
             f"so that they may be drawn by score") for k in range(60)]
TEXTS += [(100, None), (101, ""), (102, " \n\t--"), (103, LONG), (104, "few words"), (105, TEXTS[3][1]), (106, "日本語 text with\x85odd spaces"),
          (7, TEXTS[8][1]), (7, TEXTS[8][1]), (None, TEXTS[9][1]), (None, "none")]
TARGET = ["common text of the target", "quick brown fox", None, "Number of many"]


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def features(text, runs):
    w = WORD.findall(lowered(text))
    return w, [" ".join(w[k:k + n]) for n in range(1, runs + 1) for k in range(len(w) - n + 1)]


def brute(runs, buckets, percent, min_words, rows=TEXTS, target=TARGET):
    def counted(texts):
        c = collections.Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, runs)[1])
        return c, sum(c.values()) + buckets
    (s, s_all), (t, t_all) = counted(x for _, x in rows), counted(target)
    out = []
    for i, text in rows:
        w, found = features(text, runs)
        gains = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
                 for b in (zlib.crc32(f.encode()) % buckets for f in found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[:percent * len(able) // 100]
    ranks = collections.defaultdict(list)
    for k, r in enumerate(drawn, 1):
        ranks[r].append(k)
    return sorted([(*r[:4], (ranks[r].pop(0) if ranks[r] else None)) for r in out], key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in TEXTS],
                                 "doc_id long, text string, t string, n long, score long, bucket int, rank long").repartition(4)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "doc_id long, text string")


@pytest.mark.parametrize("runs,buckets,percent,min_words", [(1, 10_000, 10, 20), (1, 50, 60, 1), (3, 1000, 100, 2), (2, 7, 35, 0)])
def test_against_plain_python(docs, target, runs, buckets, percent, min_words):
    got = resample.resampled(docs, target, runs=runs, buckets=buckets, percent=percent, min_words=min_words)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(runs, buckets, percent, min_words)


def test_slices_of_a_long_text_are_its_runs(monkeypatch):
    w = resample.words(LONG[:9000])
    whole = collections.Counter(zlib.crc32(f.encode()) for f in features(LONG[:9000], 3)[1])
    monkeypatch.setattr(resample, "WORDS_AT_ONCE", 10)
    assert collections.Counter(h for part in resample.hashes(w, 3) for h in part) == whole


def test_empty_tables(docs, target):
    assert resample.resampled(docs.where("false"), target).collect() == []
    got = resample.resampled(docs, target.where("false"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(1, 10_000, 10, 20, target=[])


def test_ranks_run_over_all_ranges(spark):
    rows = [(k, 30, 30, 0, k // 40) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(6)
    got = {r.doc_id: r["rank"] for r in resample.ranked(df, percent=33).collect()}
    expected = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[4], r[0])), 1) if k <= 660}
    assert got == {r[0]: expected.get(r[0]) for r in rows}
