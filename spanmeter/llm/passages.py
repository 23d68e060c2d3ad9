"""Repeated passages inside and across documents.

A paragraph is a line of at least MIN_WORDS words, or a run of shorter lines which have as many words
together and no blank or longer line between them. Equal paragraphs are found by their hash. Different
ones are posted under the bands of a MinHash signature; those which meet in a band are confirmed by the
exact Jaccard similarity of their sets of five-word shingles, and components of links form clusters. Of
the members of a cluster, the first by (document, position) stays and the others are removed.

A passage can also stand inside paragraphs or run over several. So the words of the whole document, its
line breaks ignored, are winnowed: in each MIN_WORDS words in a row, the SEED words in a row with the
smallest hash are posted. Any MIN_WORDS words which stand in two places have such a seed in common, and
the seeds of a passage touch. Each seed is found again at its first place; seeds in a row are extended
there word by word on both sides, as long as the words are equal, and removed where together they have at
least MIN_WORDS words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle, settle_alone
from .near import links
from .words import _LOWER, _powers, hash_spans, mix, shingle_sets, signatures, slices, utf8, word_spans, words

MIN_WORDS = 20
SEED = 11                # words; more than half of MIN_WORDS, so that the seeds of a passage touch
# Two paragraphs of similarity 0.75 share none of 20 bands of 3 with a chance of (1 - 0.75 ** 3) ** 20,
# about 2 in 100 000; of similarity 0.85, 2 in 100 million.
BANDS, ROWS = 20, 3
STEP = 16                # words compared at first beside a run; eight times as many each further time
CROWD = 64               # more paragraphs in one band are compared in blocks


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, the bounds of all lines, and the text of each line."""
    data, offsets = utf8(texts)
    cut = np.flatnonzero(data == 10)
    n = np.diff(np.searchsorted(cut, offsets))
    row = np.repeat(np.arange(len(offsets) - 1), n + 1)
    starts = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    # A line ends at its break or at the end of its text.
    ends = np.sort(np.concatenate([cut, offsets[1:]]), kind="stable")
    return _LOWER[data], np.stack([starts, ends]), row


class _Cut:
    """Lines, paragraphs and seeds of a batch of texts, as ranges of word numbers."""

    def __init__(self, texts: pa.Array):
        self.data, lines, self.text = _lines(texts)
        self.line_starts, self.line_ends = lines
        self.starts, self.ends, _ = word_spans(self.data, np.array([0, len(self.data)]))
        # A word can't span two texts: their bytes may touch, so cut there as well.
        self.starts, self.ends = _split_at(self.starts, self.ends, utf8(texts)[1][1:-1])
        self.hash = hash_spans(self.data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.line_starts)
        self.last = np.searchsorted(self.starts, self.line_ends)

    def sequence(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of each range of words, as words."""
        out = np.zeros(len(first), np.uint64)
        at = 0
        while at < len(first):
            lo = int(first[at])
            upto = max(int(np.searchsorted(last, lo + (1 << 18), "right")), at + 1)
            hi = int(last[upto - 1])
            n = hi - lo
            p = _powers(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(self.hash[lo:hi]) * p[:n], out=total[1:])
            f, t = first[at:upto] - lo, last[at:upto] - lo
            out[at:upto] = (total[t] - total[f]) * p[n - f] * np.uint64(pow(int(p[n]), -1, 1 << 64))
            at = upto
        return mix(out + (last - first).astype(np.uint64))

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last word of each paragraph, and its text."""
        n = self.last - self.first
        short = np.flatnonzero((n > 0) & (n < MIN_WORDS))
        new = np.ones(len(short), bool)
        new[1:] = (np.diff(short) > 1) | (np.diff(self.text[short]) > 0)
        begins = np.flatnonzero(new)
        run_first, run_last = short[begins], short[np.append(begins[1:], len(short)) - 1] if len(short) else short
        long = np.flatnonzero(n >= MIN_WORDS)
        begin, end = np.concatenate([long, run_first]), np.concatenate([long, run_last])
        enough = self.last[end] - self.first[begin] >= MIN_WORDS
        begin, end = begin[enough], end[enough]
        order = np.argsort(begin)
        return self.first[begin][order], self.last[end][order], self.text[begin][order]

    def seeds(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each seed; bounds: the n + 1 bounds of the texts' words."""
        n, wide = len(self.hash), MIN_WORDS - SEED + 1
        if n < MIN_WORDS:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        rolled = np.zeros(n, np.uint64)
        for k in range(SEED):
            rolled[:n - k] += self.hash[k:] * _powers(SEED + 1)[k + 1]
        rolled = mix(rolled)
        # The least hash of each window, and for each place the largest of those of its windows.
        least = np.zeros(n + wide - 1, np.uint64)
        least[wide - 1:n] = _sliding(np.minimum, rolled, wide)
        ends = np.repeat(bounds[1:], np.diff(bounds))
        least[wide - 1:][np.arange(n) + MIN_WORDS > ends] = 0          # not in one text
        most = _sliding(np.maximum, least, wide)
        at = np.flatnonzero((most == rolled) & (most > 0))
        return at, rolled[at]


def _sliding(of: np.ufunc, x: np.ndarray, wide: int) -> np.ndarray:
    """`of` over each `wide` values in a row."""
    have = 1
    while have < wide:
        by = min(have, wide - have)
        x = of(x[:-by], x[by:])
        have += by
    return x


def _split_at(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.searchsorted(starts, cuts, "right") - 1
    inside = cuts[(k >= 0) & (starts[k] < cuts) & (ends[k] > cuts)] if len(starts) else cuts[:0]
    inside = np.unique(inside)
    return np.sort(np.concatenate([starts, inside])), np.sort(np.concatenate([ends, inside]))


# kind 0: a paragraph; kind 1: a seed. at: the first word of its document; n: its words.
UNITS = "i long, kind int, at int, n int, h long"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        c = _Cut(b.column("t"))
        ids = b.column("i").to_numpy(zero_copy_only=False)
        bounds = np.append(np.searchsorted(c.starts, utf8(b.column("t"))[1][:-1]), len(c.starts))
        first, last, text = c.paragraphs()
        at, h = c.seeds(bounds)
        text = np.concatenate([text, np.searchsorted(bounds, at, "right") - 1])
        kind = np.repeat(np.array([0, 1], np.int32), [len(first), len(at)])
        h = np.concatenate([c.sequence(first, last), h])
        n = np.concatenate([last - first, np.full(len(at), SEED)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[text]), pa.array(kind), pa.array((np.concatenate([first, at]) - bounds[text]).astype(np.int32)),
             pa.array(n.astype(np.int32)), pa.array(h.view(np.int64))], ["i", "kind", "at", "n", "h"])


def _paragraph_sets(c: _Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the paragraphs, and the bounds and values of their shingle sets."""
    first, last, _ = c.paragraphs()
    n = last - first
    bounds = np.concatenate([[0], np.cumsum(n)])
    hashes = c.hash[np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], n)]
    values, at = shingle_sets(hashes, bounds)
    return c.sequence(first, last), values, at


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n, keys) of each paragraph: its hash, the size of its set, and the keys of its bands."""
    for b in slices(batches):
        c = _Cut(b.column("t"))
        hashes, values, at = _paragraph_sets(c)
        s = signatures(values, at, BANDS * ROWS, seed=11).reshape(-1, BANDS, ROWS)
        key = np.zeros(s.shape[:2], np.uint64)
        for r in range(ROWS):
            key = mix(key + s[:, :, r])
        key ^= mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None]
        h, once = np.unique(hashes, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * BANDS), pa.array(key[once].reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.diff(at)[once].astype(np.int64)), lists], ["id", "n", "keys"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        c = _Cut(b.column("t"))
        hashes, values, at = _paragraph_sets(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))], ["id", "items"])


def repeats(rows: DataFrame) -> DataFrame:
    """rows: (i, t), ids unique and not null. (i, kind, at, n, cluster, first_i, first_at) of every
    unit to be removed: the members of a cluster of which another document, or an earlier place of the
    same one, keeps the first."""
    units = settle(rows.mapInArrow(_units, UNITS))
    place = F.struct("i", "at")
    groups = units.where("kind = 0").groupBy("h").agg(F.count("*").alias("f"), F.min(place).alias("first"))

    def contents(ids: DataFrame) -> DataFrame:
        # Only the documents which have one of the paragraphs are cut again.
        having = units.where("kind = 0").join(ids.withColumnRenamed("id", "h"), "h").select("i").distinct()
        wanted = settle(having)
        return (rows.join(wanted, "i", "left_semi").mapInArrow(_contents, "id long, items array<long>")
                .join(ids, "id", "left_semi").groupBy("id").agg(F.first("items").alias("items")))

    def linked() -> DataFrame:
        paragraphs = settle(rows.mapInArrow(_banded, "id long, n long, keys array<long>").groupBy("id")
                            .agg(F.max("n").alias("n"), F.first("keys").alias("keys")))
        return links(paragraphs, 1, contents, crowd=CROWD)

    near = settle_alone(rows.sparkSession, linked)
    named = (groups.join(near.withColumnRenamed("id", "h"), "h", "left")
             .select("h", "f", "first", F.coalesce("component", "h").alias("cluster")))
    several = named.groupBy("cluster").agg(F.sum("f").alias("members"), F.min("first").alias("kept")).where("members > 1")
    seeds = (units.where("kind = 1").groupBy("h").agg(F.count("*").alias("f"), F.min(place).alias("kept")).where("f > 1")
             .select(F.lit(1).alias("kind"), "h", F.col("h").alias("cluster"), "kept"))
    first = settle(named.join(several, "cluster").select(F.lit(0).alias("kind"), "h", "cluster", "kept").union(seeds))
    return (units.join(first, ["kind", "h"])
            .where((F.col("i") != F.col("kept.i")) | (F.col("at") != F.col("kept.at")))
            .select("i", "kind", "at", "n", "cluster", F.col("kept.i").alias("first_i"), F.col("kept.at").alias("first_at")))


def _by_document(rows: DataFrame, make: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """make of tables in which every document has all its rows, side by side."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = []
        for b in batches:
            i = b.column("i").to_numpy()
            at = int(np.searchsorted(i, i[-1])) if len(i) else 0
            if at or (rest and len(i) and rest[-1].column("i")[-1].as_py() != i[0]):
                yield make(pa.Table.from_batches([*rest, b.slice(0, at)]))
                rest = []
            if len(i):
                rest.append(b.slice(at))
        if rest:
            yield make(pa.Table.from_batches(rest))
    return rows.repartition("i").sortWithinPartitions("i").mapInArrow(whole, schema)


RUNS = "i long, kind int, at int, n int, clusters array<long>, first_i long, first_at int"


def _runs(t: pa.Table) -> pa.RecordBatch:
    """Seeds in a row which are in a row at their first places too become one; paragraphs stay."""
    i, kind, at, n, cluster, first_i, first_at = (t.column(c).to_numpy() for c in ("i", "kind", "at", "n", "cluster", "first_i", "first_at"))
    apart = at.astype(np.int64) - first_at
    order = np.lexsort((at, apart, first_i, kind, i))
    i, kind, at, n, cluster, first_i, first_at, apart = (x[order] for x in (i, kind, at, n, cluster, first_i, first_at, apart))
    new = np.ones(len(i), bool)
    new[1:] = ((kind[1:] == 0) | (kind[:-1] == 0) | (i[1:] != i[:-1]) | (first_i[1:] != first_i[:-1]) | (apart[1:] != apart[:-1])
               | (at[1:] > at[:-1] + n[:-1]))
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(i)) - 1
    clusters = pa.ListArray.from_arrays(pa.array(np.append(s, len(i)).astype(np.int32)), pa.array(cluster))
    return pa.RecordBatch.from_arrays(
        [pa.array(i[s]), pa.array(kind[s]), pa.array(at[s]), pa.array(at[e] + n[e] - at[s]), clusters, pa.array(first_i[s]),
         pa.array(first_at[s])], ["i", "kind", "at", "n", "clusters", "first_i", "first_at"])


def _beside(step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(i, p, d, w) of texts and their places (p, d): the `step` words before (d = -1) or from (1) word p, nearest first."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, bounds = words(b.column("t"))
            asked = b.column("asked")
            places = asked.flatten()
            p, d = (places.field(c).to_numpy().astype(np.int64) for c in ("p", "d"))
            row = np.repeat(np.arange(b.num_rows), np.diff(asked.offsets.to_numpy()))
            at = bounds[row] + p
            n = np.clip(np.where(d > 0, bounds[row + 1] - at, p), 0, step)
            upto = np.cumsum(n)
            k = np.arange(upto[-1] if len(n) else 0) - np.repeat(upto - n, n)
            near = np.repeat(np.where(d > 0, at, at - 1), n) + np.repeat(d, n) * k
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, upto).astype(np.int32)), pa.array(h[near].view(np.int64)))
            ids = b.column("i").to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(p.astype(np.int32)), pa.array(d.astype(np.int32)), lists], ["i", "p", "d", "w"])
    return cut


def _extended(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """As rows of RUNS, the words beside each run of seeds which equal those beside its first place."""
    def side(d: int, n: str) -> DataFrame:
        return runs.where("kind = 1").selectExpr("i", "first_i", f"{d} d", f"at + {n} p", f"first_at + {n} q")
    left, step, found = side(-1, "0").union(side(1, "n")), STEP, None
    while True:
        asked = (left.select("i", "p", "d").union(left.selectExpr("first_i", "q", "d")).distinct()
                 .groupBy("i").agg(F.collect_list(F.struct("p", "d")).alias("asked")))

        def equal_words() -> DataFrame:
            # Rows with the same id are one document: one of them is compared.
            near = settle(rows.join(asked, "i").select("i", "t", "asked").mapInArrow(_beside(step), "i long, p int, d int, w array<long>")
                          .groupBy("i", "p", "d").agg(F.min("w").alias("w")))
            there = near.selectExpr("i first_i", "p q", "d", "w v")
            unlike = F.array_position(F.zip_with("w", "v", lambda a, b: a == b), F.lit(False))
            equal = F.when(unlike > 0, unlike - 1).otherwise(F.least(F.size("w"), F.size("v"))).cast("int")
            return (left.join(near, ["i", "p", "d"]).join(there, ["first_i", "q", "d"])
                    .select("i", "first_i", "d", "p", "q", equal.alias("k")).where("k > 0"))
        part = settle_alone(rows.sparkSession, equal_words)
        back = F.when(F.col("d") < 0, F.col("k")).otherwise(0)
        more = part.select("i", F.lit(1).alias("kind"), (F.col("p") - back).alias("at"), F.col("k").alias("n"),
                           F.array().cast("array<long>").alias("clusters"), "first_i", (F.col("q") - back).alias("first_at"))
        found = more if found is None else found.union(more)
        left = part.where(F.col("k") == step).selectExpr("i", "first_i", "d", f"p + d * {step} p", f"q + d * {step} q")
        if left.isEmpty():
            return found
        step *= 8


def _joined(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges which overlap or touch become one."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order]) if len(s) else e
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    k = np.flatnonzero(new)
    return s[k], e[np.append(k[1:], len(s)) - 1] if len(k) else e


def _lists(row: np.ndarray, value: np.ndarray, n: int) -> pa.ListArray:
    """The distinct values of each of n rows, ascending."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[keep], value[keep]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(value))


def _outer(s: np.ndarray, e: np.ndarray, doc: np.ndarray, first_i: np.ndarray, first_at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs joined with what extends them, without those that lie inside another one: start, end, first_i."""
    apart = (s & 0xFFFFFFFF) - first_at
    order = np.lexsort((s, apart, first_i, doc))
    s, e, doc, first_i, apart = (x[order] for x in (s, e, doc, first_i, apart))
    new = np.ones(len(s), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first_i[1:] != first_i[:-1]) | (apart[1:] != apart[:-1])
    group = np.cumsum(new) << 32
    upto = np.maximum.accumulate((e & 0xFFFFFFFF) + group) if len(s) else e
    new[1:] |= (s[1:] & 0xFFFFFFFF) + group[1:] > upto[:-1]
    k = np.flatnonzero(new)
    last = np.append(k[1:], len(s)) - 1 if len(k) else k
    s, e, first_i, apart = s[k], (upto[last] - group[last]) + (s[k] >> 32 << 32), first_i[k], apart[k]
    order = np.lexsort((-apart, first_i, -e, s))
    s, e, first_i = s[order], e[order], first_i[order]
    outer = np.ones(len(s), bool)
    if len(s):
        outer[1:] = e[1:] > np.maximum.accumulate(e)[:-1]
    return s[outer], e[outer], first_i[outer]


def _spans(t: pa.Table) -> pa.RecordBatch:
    i, kind, at, n, first_i, first_at = (t.column(c).to_numpy() for c in ("i", "kind", "at", "n", "first_i", "first_at"))
    ids, doc = np.unique(i, return_inverse=True)
    s = (doc.astype(np.int64) << 32) + at           # the ranges of all documents on one line
    e = s + n
    run = kind == 1
    os, oe, of_i = _outer(s[run], e[run], doc[run], first_i[run], first_at[run])
    # A run has one first place: short ones that only touch are no passage together.
    enough = oe - os >= MIN_WORDS
    os, oe, of_i = os[enough], oe[enough], of_i[enough]
    rs, re = _joined(np.concatenate([os, s[~run]]), np.concatenate([oe, e[~run]]))
    def within(x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(rs, x, "right") - 1
        return np.flatnonzero((k >= 0) & (x < re[np.maximum(k, 0)])) if len(rs) else np.zeros(0, np.int64)
    inside = within(s)
    kept_s, kept_i = np.concatenate([os, s[~run]]), np.concatenate([of_i, first_i[~run]])
    kept = within(kept_s)
    some, of = np.unique(rs >> 32, return_inverse=True)
    ends = np.stack([rs & 0xFFFFFFFF, re & 0xFFFFFFFF], 1).astype(np.int32).reshape(-1)
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(len(rs) + 1, dtype=np.int32) * 2), pa.array(ends))
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(some) + 1)).astype(np.int32)), pairs)
    row, kept_row = np.searchsorted(some, doc[inside]), np.searchsorted(some, kept_s[kept] >> 32)
    lists = t.column("clusters").combine_chunks().take(pa.array(inside))
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    clusters = lists.flatten().to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[some]), spans, _lists(np.repeat(row, sizes), clusters, len(some)), _lists(kept_row, kept_i[kept], len(some))],
        ["i", "spans", "clusters", "firsts"])


def removals(rows: DataFrame) -> DataFrame:
    """(i, spans, clusters, firsts) of the documents that lose words: disjoint ascending spans of words
    [from, upto), the clusters of what is removed and the documents which keep them."""
    runs = settle_alone(rows.sparkSession, lambda: _by_document(repeats(rows), _runs, RUNS))
    return _by_document(runs.union(_extended(rows, runs)), _spans, "i long, spans array<array<int>>, clusters array<long>, firsts array<long>")


def without(texts: pa.Array, spans: list[list[list[int]] | None]) -> list[str]:
    """The texts without the words of the spans; a line that loses all its words goes as a whole."""
    out = []
    for t, gone in zip(texts.to_pylist(), spans, strict=True):
        if not gone:
            out.append(t)
            continue
        data = (t or "").encode()
        starts, ends, _ = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        keep, at = [], 0
        for s, e in gone:
            keep.append(data[at:starts[s]])
            at = int(starts[e]) if e < len(starts) else len(data)
            if b"\n" in data[ends[e - 1]:at] and not keep[-1].endswith(b"\n") and keep[-1]:
                at = int(ends[e - 1])            # words stay before it on its line, so its line break stays too
        keep.append(data[at:])
        out.append(b"".join(keep).decode())
    return out


def document_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_spans, removed_words, spans, clusters, kept_in) for each row of `docs`.

    spans: the word ranges [from, upto) which repeat what an earlier document or place keeps; clusters:
    their clusters; kept_in: the documents which keep them. A null, empty or short text has no
    passage and loses nothing. A row without an id loses nothing. Rows with the same id are one
    document: each of them gets what is found for the id. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    found = removals(rows.where("i is not null"))
    none = F.array().cast("array<long>")
    return rows.select("i").join(found, "i", "left").select(
        F.col("i").alias("doc_id"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0]), F.lit(0).cast("long")).alias("removed_words"),
        F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"),
        F.coalesce("clusters", none).alias("clusters"), F.coalesce("firsts", none).alias("kept_in"))
