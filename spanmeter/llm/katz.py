"""A Katz bigram model of words: Good-Turing discounts, exactly normalised backoff weights.

Tokens are words and one end per text. The word table has every token's count, and every pair of words
is counted and scored on its own. One more count stands in each history's total for what has not
followed it, so a backoff weight is never zero, and a small part of the mass of unknown words is set
aside as an event that no text has, so there is always something to back off to. With it, the
probabilities after every history add up to one.

Words with at least 2 occurrences and a share of SHARE of all tokens have a number that every task
knows (a share, so there are at most 1 / SHARE of them at any size of the corpus); the rarer ones go by
their hash. A text's tokens are not joined with the tables row by row. Blocks of texts post their pairs,
packed, to groups; there all posts of a pair meet, so the group counts the pair and scores its posts at
once, and gives sums per text back to the blocks:

* Pairs of numbered words meet by history, a frequent history being dealt to several groups by the next
  word. Those which a sample shows to be very frequent are counted and scored in the blocks instead, from
  totals of bounded number.
* Pairs with a rare word meet by that word, by the second one if both are rare, so its count and
  probability are known there without a table.
* What a rare history's total and backoff weight decide meets once more, by the history, with the
  discounts and probabilities of its followers.

Discounts and the weights of numbered histories are global, so a group gives back how often a text used
counts of 1 to TURING, and which unseen pairs; the blocks finish.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle, shared_dir
from .language import remainder
from .words import mix, words

SHARE = 2.0 ** -20
TURING = 5               # counts up to this are discounted
BLOCK_DOCS = 2000
BLOCK_WORDS = 1_000_000
SAMPLE_DOCS = 2000       # texts in which very frequent pairs are looked for, on average
SILENT = 1e-3            # of the mass of unknown words
END = np.uint64(0x454E44)

SECOND, BOTH, FIRST = 0, 1, 2    # which word of a pair is rare
POSTS = "g int, block long, body binary"
SCORED = "kind int, block long, h long, body binary"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's tokens and the n + 1 bounds of the texts."""
    h, bounds = words(texts)
    out = np.insert(h, bounds[1:], END)
    return out, bounds + np.arange(len(bounds))


def discounts(of: np.ndarray) -> np.ndarray:
    """Katz's discounts of the counts 1 to TURING, from how many events have the counts 1 to TURING + 1.

    Where Good-Turing gives no proper discount, since counts of counts are few or uneven, a constant
    is taken off each count instead.
    """
    of = np.asarray(of, float)
    k = np.arange(1, TURING + 1)
    with np.errstate(all="ignore"):
        common = (TURING + 1) * of[TURING] / of[0]
        d = ((k + 1) * of[1:] / (k * of[:-1]) - common) / (1 - common)
    if np.isfinite(d).all() and (d > 0).all() and (d < 1).all():
        return d
    off = of[0] / (of[0] + 2 * of[1]) if of[0] > 0 and of[1] > 0 else 0.5
    return (k - off) / k


class Words:
    """What the word table says about all tokens, and the numbers of the frequent ones."""

    def __init__(self, total: int, distinct: int, of: np.ndarray, hashes: np.ndarray, counts: np.ndarray, texts: int):
        self.total, self.distinct = total, distinct
        self.discount = discounts(of)
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.n = len(hashes)                       # numbers: 0 .. n - 1, n: none, n + 1: before a text
        d = np.concatenate([[0], self.discount])
        kept = (np.minimum(d[1:] * np.arange(1, TURING + 1), np.arange(1, TURING + 1)) * of[:TURING]).sum() + (
            total - (np.arange(1, TURING + 1) * of[:TURING]).sum())
        self.unknown = 1 - kept / total if total else 1.0
        if self.unknown <= 0:                      # every count is above TURING: one count in all for the unknown
            self.unknown = 1 / (total + 1)
        self.scale = (1 - self.unknown) / (kept / total) if total and kept else 1.0
        own = self.counts * self.of(self.counts) * self.scale / max(total, 1)
        self.p = np.append(own, [1.0, 1.0])        # no factor where a rare word's own is already in
        self.before = np.append(self.counts, [0, texts])   # as histories

    def of(self, c: np.ndarray) -> np.ndarray:
        """Discounts of counts above 0."""
        return np.where(c <= TURING, self.discount[np.clip(c, 1, TURING) - 1], 1.0)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.n - 1)
        return np.where(self.hashes[at] == hashes, at, self.n)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def by_count(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of words with these counts, unknown ones included."""
        known = np.maximum(c, 1) * self.of(np.maximum(c, 1)) * self.scale / max(self.total, 1)
        return np.where(c > 0, known, self.unknown * (1 - SILENT))


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays]], "<u4").tobytes()
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 1)


def _unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(body)
    sizes = np.frombuffer(raw, "<u4", len(kinds), 4)
    out, at = [], 4 + 4 * len(kinds)
    for n, k in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by the keys, the first one first, and where in it a new key begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


def _counted(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys, sorted, and how often each occurs."""
    order, new = _distinct(*keys)
    at = np.flatnonzero(new)
    return [k[order][at] for k in keys], np.diff(np.append(at, len(order)))


def _followers(h: np.ndarray, count: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of seen pairs, per history: how many have the counts 1 to TURING, and the mass of their words."""
    h, inv = np.unique(h, return_inverse=True)
    few = np.bincount(inv * (TURING + 1) + np.where(count <= TURING, count, 0), minlength=len(h) * (TURING + 1))
    return h, few.reshape(-1, TURING + 1)[:, 1:], np.bincount(inv, weights=p, minlength=len(h))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK_DOCS):
            yield whole.slice(at, BLOCK_DOCS)


def word_table(rows: DataFrame) -> DataFrame:
    """(h, c): how often the learning rows of (t, learn) have each token."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            h, c = np.unique(tokens(b.column("t"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])
    return rows.where("learn").select("t").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _pairs(known: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, numbers, histories and row of every token, and the bounds of the rows."""
    h, bounds = tokens(texts)
    w = known.numbers(h)
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[bounds[:-1]] = known.n + 1
    return h, w, before, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), bounds


def fit_words(rows: DataFrame) -> tuple[Words, DataFrame]:
    table = settle(word_table(rows))
    total, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    of = np.zeros(TURING + 1)
    for r in table.where(F.col("c") <= TURING + 1).groupBy("c").count().collect():
        of[r.c - 1] = r["count"]
    often = table.where(F.col("c") >= max(2.0, total * SHARE)).toArrow()      # 1 / SHARE rows at most
    texts = table.where(F.col("h") == int(END.view(np.int64))).select("c").first()
    return Words(total, distinct, of, often.column("h").to_numpy().view(np.uint64), often.column("c").to_numpy(),
                 texts[0] if texts else 0), table


def _very_frequent(rows: DataFrame, n_rows: int, known: Words, most: int) -> np.ndarray:
    """Pairs of numbered words (history * (n + 2) + word) with more than 1 / most of a sample's tokens: at most `most`."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            _, w, before, _, _ = _pairs(known, b.column("t"))
            both = (w != known.n) & (before != known.n)
            key, c = np.unique(before[both] * (known.n + 2) + w[both], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c)], ["k", "c"])
    share = min(1.0, SAMPLE_DOCS / max(n_rows, 1))
    part = rows.where(F.pmod(F.xxhash64("i", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20))).select("t")
    seen = settle(part.mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")))
    total = seen.agg(F.sum("c")).first()[0] or 0
    return np.sort(np.array([r.k for r in seen.where(F.col("c") * most > total).select("k").collect()], np.int64))


def score(rows: DataFrame) -> DataFrame:
    """rows: (i, t, learn) -> (i, n_tokens, n_known, train_tokens, base_score, score); nulls in t are empty texts."""
    spark = rows.sparkSession
    known, table = fit_words(rows)
    groups = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    often = _very_frequent(rows, rows.count(), known, 16 * groups)
    width = known.n + 2
    # A history with many tokens is dealt to as many groups as keep each near an even share.
    deal = np.maximum(1, np.ceil(known.before * (8.0 * groups / max(known.total, 1)))).astype(np.int64)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32     # the same when a lost task runs again
        for whole in _slices(batches):
            sizes = np.array([len(x) if x else 0 for x in whole.column("t").to_pylist()])
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // (6 * BLOCK_WORDS))) + 1
            for s, e in zip([0, *cuts], [*cuts, whole.num_rows]):
                yield block(whole.slice(s, e - s), name)
                name += 1

    def block(b: pa.RecordBatch, name: int) -> pa.RecordBatch:
        h, w, before, row, bounds = _pairs(known, b.column("t"))
        learn = b.column("learn").to_numpy(zero_copy_only=False)
        n = b.num_rows
        rare = w == known.n
        plain = np.flatnonzero(~rare)
        base = np.bincount(row[plain], weights=known.base(known.counts[w[plain]]), minlength=n)
        out = [(-1, name, _pack(b.column("i").fill_null(0).to_numpy().astype("<i8"), b.column("i").is_null().to_numpy(zero_copy_only=False).astype("u1"),
                                np.diff(bounds).astype("<i8"), np.bincount(row[plain], minlength=n).astype("<i8"), base))]
        key = before * width + w
        at = np.minimum(np.searchsorted(often, key), max(len(often) - 1, 0))
        hot = often[at] == key if len(often) else np.zeros(len(key), bool)
        mark = row * 2 + learn[row]
        both, c = np.unique(np.stack([at[hot], mark[hot]]), axis=1, return_counts=True)
        out.append((-2, name, _pack(both[0].astype("<u4"), both[1].astype("<u4"), c.astype("<u4"))))
        rest = ~(hot | rare | (before == known.n))
        # Pairs of numbered words go to groups 0 .. groups - 1, those with a rare word to the next as many.
        g1 = mix((before[rest] * 1048583 + mix(w[rest]).astype(np.int64) % deal[before[rest]]).astype(np.uint64)) % np.uint64(groups)
        out += [(g, name, _pack(np.diff(key, prepend=np.int64(0)), mark, c)) for g, key, mark, c in sorted_posts(g1, key[rest], mark[rest])]
        some = np.flatnonzero(rare | (before == known.n))
        h = h.view(np.int64)
        behind = before[some] == known.n
        role = np.where(rare[some], np.where(behind, BOTH, SECOND), FIRST)
        x = np.where(rare[some], h[some], h[some - 1])          # a text's first token comes after no word
        other = np.where(role == BOTH, h[some - 1], np.where(role == SECOND, before[some], w[some]))
        g2 = mix(x.view(np.uint64)) % np.uint64(groups)
        out += [(g + groups, name, _pack(role.astype("u1"), np.diff(x, prepend=np.int64(0)), other, mark, c))
                for g, role, x, other, mark, c in sorted_posts(g2, role, x, other, mark[some])]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()),
                                           pa.array([x[2] for x in out], pa.binary())], ["g", "block", "body"])

    def sorted_posts(g: np.ndarray, *keys: np.ndarray) -> Iterator[tuple]:
        """(group, keys, ..., mark, c): the sorted distinct posts of each group and how often each stands."""
        (g, *keys), c = _counted(g, *keys)
        mark, c = keys[-1].astype("<u4"), c.astype("<u4")
        edges = np.append(np.flatnonzero(np.diff(g.astype(np.int64), prepend=-1)), len(g))
        for s, e in zip(edges[:-1], edges[1:]):
            yield int(g[s]), *[k[s:e] for k in keys[:-1]], mark[s:e], c[s:e]

    posts = rows.select("i", "t", "learn").mapInArrow(post, POSTS)

    def used(doc: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Per text: how often it used counts of 1 to TURING."""
        n = int(doc.max()) + 1
        return np.bincount(doc * (TURING + 1) + np.where((y > 0) & (y <= TURING), y, 0), weights=m,
                           minlength=n * (TURING + 1)).reshape(n, TURING + 1)[:, 1:]

    def counts_of(count: np.ndarray) -> bytes:
        return _pack(np.bincount(np.minimum(count, TURING + 2), minlength=TURING + 3)[1:TURING + 2].astype("<i8"))

    def meet_numbered(g: int, posted: list[tuple[int, bytes]], give: Callable) -> None:
        parts = [_unpack(x, "<i8", "<u4", "<u4") for _, x in posted]
        key = np.concatenate([np.cumsum(p[0]) for p in parts])
        mark, c = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]).astype(np.int64)
        at = np.cumsum([0, *[len(p[0]) for p in parts]])
        distinct, inverse = np.unique(key, return_inverse=True)
        count = np.bincount(inverse, weights=c * (mark & 1), minlength=len(distinct)).astype(np.int64)
        seen, doc = count[inverse], (mark >> 1).astype(np.int64)
        for s, e, (b, _) in zip(at[:-1], at[1:], posted):
            y, m, some = seen[s:e], c[s:e], doc[s:e]
            gain = np.where(y > 0, np.log10(np.maximum(y, 1)) - np.log10(known.before[key[s:e] // width] + 1), 0) * m
            un = np.flatnonzero(y == 0)
            there = np.unique(some)
            give(4, b, 0, _pack(there.astype("<u4"), np.bincount(some, weights=gain)[there], used(some, y, m)[there].reshape(-1).astype("<u4"),
                                some[un].astype("<u4"), key[s:e][un].astype("<i8"), m[un].astype("<u4")))
        own = count > 0
        give(6, 0, 0, counts_of(count))
        give(7, 0, g, _pack(np.diff(distinct[own], prepend=np.int64(0)).astype("<i8"), count[own].astype("<i8")))
        h, few, mass = _followers(distinct[own] // width, count[own], known.p[distinct[own] % width])
        give(8, 0, 0, _pack(h.astype("<i8"), few.reshape(-1).astype("<i8"), mass))

    def meet_rare(g: int, posted: list[tuple[int, bytes]], give: Callable) -> None:
        parts = [_unpack(x, "u1", "<i8", "<i8", "<u4", "<u4") for _, x in posted]
        role, other, mark, c = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3, 4))
        x, c = np.concatenate([np.cumsum(p[1]) for p in parts]), c.astype(np.int64)
        at = np.cumsum([0, *[len(p[1]) for p in parts]])
        learnt, doc = c * (mark & 1), (mark >> 1).astype(np.int64)
        xs, xi = np.unique(x, return_inverse=True)
        second = role != FIRST
        cx = np.bincount(xi[second], weights=learnt[second], minlength=len(xs)).astype(np.int64)   # of a word, so of a history too
        p, base = known.by_count(cx), known.base(cx)
        order, new = _distinct(role, xi, other)
        pair = np.empty(len(x), np.int64)
        pair[order] = np.cumsum(new) - 1
        count = np.bincount(pair, weights=learnt, minlength=int(new.sum())).astype(np.int64)
        seen = count[pair]
        # Numbered histories have known totals; a rare one's is known here if the next word has a number.
        total = np.where(role == SECOND, known.before[np.where(role == SECOND, other, 0)], np.where(role == FIRST, cx[xi], 0))
        word = np.where(second, p[xi], known.p[np.where(second, 0, other)])
        gain = np.where(seen > 0, np.log10(np.maximum(seen, 1)) - np.log10(total + 1), np.log10(word)) * c
        for s, e, (b, _) in zip(at[:-1], at[1:], posted):
            y, m, some = seen[s:e], c[s:e], doc[s:e]
            un = np.flatnonzero((y == 0) & (role[s:e] == SECOND))
            there = np.unique(some)
            give(4, b, 0, _pack(there.astype("<u4"), np.bincount(some, weights=gain[s:e])[there], used(some, y, m)[there].reshape(-1).astype("<u4"),
                                some[un].astype("<u4"), other[s:e][un] * width + known.n, m[un].astype("<u4")))
            as_second = np.flatnonzero(second[s:e])
            if len(as_second):
                some, m, i = some[as_second], m[as_second], xi[s:e][as_second]
                there = np.unique(some)
                give(5, b, 0, _pack(there.astype("<u4"), np.bincount(some, weights=base[i] * m)[there],
                                    np.bincount(some, weights=m * (cx[i] > 0))[there].astype("<u4")))
        one = order[new]                                     # a post of each pair
        own = one[seen[one] > 0]
        give(6, 0, 0, counts_of(count))
        k = own[role[own] == SECOND]
        h, few, mass = _followers(other[k], seen[k], word[k])
        give(8, 0, 0, _pack(h, few.reshape(-1).astype("<i8"), mass))
        # To the groups of rare histories: their totals and followers, and which posts wait for them.
        k = own[role[own] == FIRST]
        few, mass = np.zeros((len(xs), TURING), np.int64), np.zeros(len(xs))
        h, f, m = _followers(xi[k], seen[k], word[k])
        few[h], mass[h] = f, m
        k = own[role[own] == BOTH]
        h, f, m = _followers(other[k], seen[k], word[k])
        there = cx > 0
        h, n = np.append(xs[there], h), np.append(cx[there], np.zeros(len(h), np.int64))
        few, mass = np.concatenate([few[there], f]), np.append(mass[there], m)
        waits = np.flatnonzero((role == BOTH) | ((role == FIRST) & (seen == 0) & (cx[xi] > 0)))
        blocks = np.repeat(np.array([b for b, _ in posted], np.int64), np.diff(at))[waits]
        rows = np.where(role[waits] == BOTH, other[waits], x[waits]), blocks, doc[waits], seen[waits] > 0, c[waits]
        to, wait_to = ((mix(v.view(np.uint64)) % np.uint64(groups)).astype(np.int64) for v in (h, rows[0]))
        by, wait_by = np.lexsort((h, to)), np.lexsort((rows[2], blocks, rows[0], wait_to))
        edges, wait_edges = (np.searchsorted(v, np.arange(groups + 1)) for v in (to[by], wait_to[wait_by]))
        for k in np.union1d(to, wait_to).tolist():
            i, j = by[edges[k]:edges[k + 1]], wait_by[wait_edges[k]:wait_edges[k + 1]]
            give(9, k, 0, _pack(np.diff(h[i], prepend=np.int64(0)), n[i], few[i].astype("<u4").reshape(-1), mass[i],
                                np.diff(rows[0][j], prepend=np.int64(0)), np.diff(rows[1][j], prepend=np.int64(0)), rows[2][j].astype("<u4"),
                                rows[3][j].astype("u1"), rows[4][j].astype("<u4")))

    def meet(t: pa.Table) -> pa.Table:
        g = t.column("g")[0].as_py()
        kind, block, hist, body = [], [], [], []
        def give(k: int, b: int, h: int, x: bytes) -> None:
            kind.append(k), block.append(b), hist.append(h), body.append(x)
        posted = list(zip(t.column("block").to_pylist(), t.column("body").to_pylist(), strict=True))
        if g == -1:
            for b, x in posted:
                give(1, b, 0, x)
        elif g == -2:
            for b, x in posted:
                at, mark, c = _unpack(x, "<u4", "<u4", "<u4")
                total = np.bincount(at, weights=c * (mark & 1), minlength=len(often)).astype("<i8")
                give(2, b, 0, x)
                give(3, 0, 0, _pack(total))
        else:
            (meet_numbered if g < groups else meet_rare)(g, posted, give)
        return pa.table({"kind": pa.array(kind, pa.int32()), "block": pa.array(block, pa.int64()), "h": pa.array(hist, pa.int64()),
                         "body": pa.array(body, pa.binary())})

    # What needs no meeting is dealt by its block, so that it is spread evenly.
    dealt = posts.withColumn("s", F.when(F.col("g") < 0, F.pmod(F.xxhash64("block"), F.lit(groups))).otherwise(F.lit(0)).cast("int"))
    path = f"{shared_dir(spark)}/spanmeter-{uuid.uuid4().hex}"
    dealt.groupBy("g", "s").applyInArrow(meet, SCORED).write.partitionBy("kind").parquet(path)
    stored = spark.read.schema("block long, h long, body binary, kind int").parquet(path)

    # Sums over groups and blocks of arrays whose size the vocabulary and the number of groups bound.
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {3: np.zeros(len(often), np.int64), 6: np.zeros(TURING + 1, np.int64)}
        few, mass = np.zeros((width, TURING), np.int64), np.zeros(width)
        for b in batches:
            for k, x in zip(b.column("kind").to_pylist(), b.column("body").to_pylist(), strict=True):
                if k == 8:
                    h, f, m = _unpack(x, "<i8", "<i8", "<f8")
                    few[h] += f.reshape(-1, TURING)
                    mass[h] += m
                else:
                    total[k] += _unpack(x, "<i8")[0]
        some = np.flatnonzero(mass)
        rows = [(3, int(i), [int(total[3][i])], 0.0) for i in np.flatnonzero(total[3])]
        rows += [(6, i, [int(c)], 0.0) for i, c in enumerate(total[6]) if c]
        rows += [(8, int(i), few[i].tolist(), float(mass[i])) for i in some]
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "at", "c", "m"), r)) for r in rows], pa.schema(
            [("kind", pa.int32()), ("at", pa.int64()), ("c", pa.list_(pa.int64())), ("m", pa.float64())]))

    sums = (stored.where("kind in (3, 6, 8)").select("kind", "body").mapInArrow(summed, "kind int, at long, c array<long>, m double")
            .groupBy("kind", "at").agg(*[F.sum(F.try_element_at("c", F.lit(k + 1))).alias(f"c{k}") for k in range(TURING)], F.sum("m").alias("m"))).toArrow()
    kind, at = sums.column("kind").to_numpy(), sums.column("at").to_numpy()
    c = np.stack([sums.column(f"c{k}").fill_null(0).to_numpy() for k in range(TURING)], 1) if len(at) else np.zeros((0, TURING), np.int64)
    hot, of = np.zeros(len(often), np.int64), np.zeros(TURING + 1)
    few, mass = np.zeros((width, TURING)), np.zeros(width)
    hot[at[kind == 3]] = c[kind == 3, 0]
    of[at[kind == 6]] = c[kind == 6, 0]
    few[at[kind == 8]], mass[at[kind == 8]] = c[kind == 8], sums.column("m").to_numpy()[kind == 8]
    there = hot > 0
    np.add.at(mass, often[there] // width, known.p[often[there] % width])
    low = there & (hot <= TURING)
    np.add.at(few, (often[low] // width, hot[low] - 1), 1)
    of += np.bincount(np.minimum(hot, TURING + 2), minlength=TURING + 3)[1:TURING + 2]
    d = discounts(of)
    log_d, back = np.log10(d), _backoff(known, known.before, d, few, mass)
    log_p = np.log10(known.p)

    def settle_rare(t: pa.Table) -> pa.Table:
        """What rare histories add to the texts of each block, from all that is known of a history."""
        parts = [_unpack(x, "<i8", "<i8", "<u4", "<f8", "<i8", "<i8", "<u4", "u1", "<u4") for x in t.column("body").to_pylist()]
        h, to, blocks = (np.concatenate([np.cumsum(p[k]) for p in parts]) for k in (0, 4, 5))
        n, few, mass, doc, seen, m = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 6, 7, 8))
        few = few.reshape(-1, TURING).astype(np.int64)
        hs, inv = np.unique(np.append(h, to), return_inverse=True)
        of_h, inv = inv[:len(h)], inv[len(h):]
        total, all_mass = (np.bincount(of_h, weights=v, minlength=len(hs)) for v in (n, mass))
        all_few = np.stack([np.bincount(of_h, weights=few[:, k], minlength=len(hs)) for k in range(TURING)], 1)
        gain = np.where(seen > 0, -np.log10(total + 1)[inv], _backoff(known, total, d, all_few, all_mass)[inv]) * m
        order, new = _distinct(blocks, doc)
        at = np.flatnonzero(new)
        sums = np.add.reduceat(gain[order], at) if len(at) else gain
        blocks, doc = blocks[order][at], doc[order][at]
        edges = np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(blocks))
        return pa.table({"block": blocks[edges[:-1]], "kind": np.full(len(edges) - 1, 9, np.int32),
                         "body": pa.array([_pack(doc[s:e], sums[s:e]) for s, e in zip(edges[:-1], edges[1:])], pa.binary())})

    def finish(t: pa.Table) -> pa.Table:
        by = sorted(zip(t.column("kind").to_pylist(), t.column("body").to_pylist(), strict=True), key=lambda x: (x[0], x[1]))
        ids, null, size, met, base = [x.copy() for x in _unpack(by[0][1], "<i8", "u1", "<i8", "<i8", "<f8")]
        total = np.zeros(len(ids))
        for k, body in by[1:]:
            if k == 2:
                pair, mark, m = _unpack(body, "<u4", "<u4", "<u4")
                h, w, y = often[pair] // width, often[pair] % width, hot[pair]
                gain = np.where(y > 0, np.log10(np.maximum(y, 1)) + np.where(y <= TURING, log_d[np.clip(y, 1, TURING) - 1], 0)
                                - np.log10(known.before[h] + 1), back[h] + log_p[w])
                np.add.at(total, mark >> 1, gain * m)
            elif k == 4:
                doc, gain, used, un, pair, m = _unpack(body, "<u4", "<f8", "<u4", "<u4", "<i8", "<u4")
                total[doc] += gain + used.reshape(-1, TURING) @ log_d
                np.add.at(total, un, (back[pair // width] + log_p[pair % width]) * m)
            elif k == 9:
                doc, gain = _unpack(body, "<u4", "<f8")
                total[doc] += gain
            else:
                doc, own, m = _unpack(body, "<u4", "<f8", "<u4")
                base[doc] += own
                met[doc] += m
        return pa.table({"i": pa.array(ids, mask=null.astype(bool)), "n_tokens": size, "n_known": met,
                         "train_tokens": np.full(len(ids), known.total), "base_score": base, "score": total})

    late = stored.where("kind = 9").select("block", "body").groupBy("block").applyInArrow(settle_rare, "block long, kind int, body binary")
    return (stored.where("kind in (1, 2, 4, 5)").select("block", "kind", "body").unionByName(late).groupBy("block")
            .applyInArrow(finish, "i long, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def _backoff(known: Words, total: np.ndarray, d: np.ndarray, few: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """log10 of the backoff weights of histories with these totals and followers."""
    k = np.arange(1, TURING + 1)
    kept = few @ (k * d) + (total - few @ k)
    return np.log10((1 - kept / (total + 1)) / np.maximum(1 - mass, known.unknown * SILENT))


def document_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`.

    Learned from the rows whose remainder by 5 is not 1; a null or empty text is its end alone. Rows
    with the same id or none are kept as they are. Without learning rows every token is unknown. Other
    columns are not read.
    """
    i = F.col(id_col).cast("long")
    found = score(docs.select(i.alias("i"), F.col(text_col).alias("t"), (remainder(i, 5) != 1).alias("learn")))
    return found.select(F.col("i").alias("doc_id"), (remainder(F.col("i"), 5) == 1).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")
