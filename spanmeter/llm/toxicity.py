"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters mark a text or abstain. Some are given (word lists, patterns of address and shouting); others
are word beginnings which the learning labels show in toxic texts and hardly elsewhere, dealt into
lists. The votes of all documents are counted by pattern; on the counts, expectation maximisation
estimates each voter's hit rate in toxic and in other texts, with labelled rows held to their label.
Voters that still go together once the posterior is known are correlated, and their evidence is
weighed down accordingly. A logistic regression on the hits learns the posteriors of a bounded
sample, and a last scale learns from the labels where toxic texts begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .language import remainder
from .linear import logistic, sigmoid
from .words import hash_spans, utf8, word_spans

LABELLED = 20_000        # labelled rows learned from, on average
SAMPLE = 8_000           # rows whose posteriors the classifier is fitted on, on average
LISTED = 2_000           # learned word beginnings
LISTS = 8                # voters which they are dealt to
CHANCE = 0.3             # learned word beginnings that may be there by chance
STEMS = (4, 5, 6, 8)     # bytes of a word's beginning, besides the whole word
THRESHOLD = 0.7

# Words that insult, by kind.
LEXICONS = {
    "insult": ["idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "dumb", "imbecile", "clown", "clowns", "fool"],
    "contempt": ["worthless", "pathetic", "disgusting", "trash", "scum", "garbage", "vermin", "filth", "filthy", "pig", "pigs"],
    "threat": ["kill", "murder", "die", "hang", "shoot", "burn", "strangle"],
    "hate": ["hate", "hates", "despise", "loathe", "subhuman", "subhumans"],
    "deutsch": ["idiotin", "dumm", "dummkopf", "abschaum", "arschloch", "wertlos", "ekelhaft", "müll", "trottel"],
    "francais": ["imbécile", "crétin", "salaud", "connard", "ordure", "débile", "pathétique", "minable"],
    "espanol": ["idiota", "imbécil", "estúpido", "estúpida", "basura", "escoria", "asqueroso", "patético", "inútil"],
}
ADDRESS = {"you", "your", "you're", "youre", "u"}

# Letters and what is not ASCII make words here; A-Z lower-cased, everything else a separator.
_TEXT = np.full(256, 0x20, np.uint8)
_TEXT[128:] = np.arange(128, 256)
_TEXT[97:123] = np.arange(97, 123)
_TEXT[65:91] = np.arange(97, 123)
N_DENSE = 4


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]))[0].view(np.int64))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = utf8(texts)
    data = _TEXT[raw]
    starts, ends, bounds = word_spans(data, offsets)
    return raw, data, starts, ends, bounds


def _stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The whole words, then their beginnings: (index of the word, hash)."""
    every = np.arange(len(starts))
    yield every, hash_spans(data, starts, ends).view(np.int64)
    for size in STEMS:
        some = every[ends - starts > size]
        # The size is part of the hash, so a beginning is never taken for a whole word.
        yield some, hash_spans(data, starts[some], starts[some] + size).view(np.int64) ^ np.int64(size * 0x1234567)


class Voters:
    def __init__(self, learned: list[int]):
        self.names = [*LEXICONS, "aimed", "shouted", "repeated", *[f"learned {k}" for k in range(min(LISTS, len(learned)))]]
        entries = [(_hash(w), k) for k, words in enumerate(LEXICONS.values()) for w in words]
        first = len(LEXICONS) + 3
        entries += [(h, first + k % LISTS) for k, h in enumerate(learned)]
        table = dict(reversed(entries))
        self.hashes = np.array(sorted(table), np.int64)
        self.voter = np.array([table[h] for h in self.hashes.tolist()], np.int64)
        self.address = np.sort(np.array([_hash(w) for w in ADDRESS], np.int64))
        self.width = len(self.hashes) + len(self.names) + N_DENSE + 1

    def apply(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Votes (texts by voters) and features (texts by width: hits by entry, votes, shares, one)."""
        raw, data, starts, ends, bounds = _words(texts)
        begin = utf8(texts)[1]
        n = len(bounds) - 1
        row = np.repeat(np.arange(n), np.diff(bounds))
        entry = np.zeros((n, len(self.hashes)), np.float32)
        hit = np.zeros(len(starts), bool)
        for k, (index, h) in enumerate(_stems(data, starts, ends)):
            if k == 0:
                spoken = np.isin(h, self.address)
            at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
            found = np.flatnonzero(self.hashes[at] == h) if len(self.hashes) else np.zeros(0, int)
            np.add.at(entry, (row[index[found]], at[found]), 1)
            hit[index[found]] = True
        votes = np.zeros((n, len(self.names)), bool)
        for v in range(len(self.names)):
            if (own := self.voter == v).any():
                votes[:, v] = entry[:, own].any(1)
        base = len(LEXICONS)
        near = np.zeros(len(starts), bool)          # a word of address among the three words before
        for d in (1, 2, 3):
            near[d:] |= spoken[:-d] & (row[d:] == row[:-d])
        words = np.maximum(np.diff(bounds), 1)
        hits = np.bincount(row[hit], minlength=n)
        upper = np.diff(np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])[begin])
        votes[:, base] = np.bincount(row[hit & near], minlength=n) > 0
        votes[:, base + 1] = (upper > words) & (hits > 0)
        votes[:, base + 2] = hits >= 2
        dense = np.stack([np.minimum(1, hits / words * 20), np.log1p(hits), np.minimum(1, upper / (words * 6)), hits > 0], 1)
        return votes, np.hstack([np.minimum(entry, 3), votes, dense, np.ones((n, 1))]).astype(np.float32)


def learn_stems(labelled: DataFrame) -> list[int]:
    """Hashes of words and word beginnings that mark toxic texts, from (t, toxic); at most LISTED."""
    totals = labelled.groupBy("toxic").count().collect()
    n = {int(r.toxic): r["count"] for r in totals}
    if not n.get(1) or not n.get(0):
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                _, data, starts, ends, bounds = _words(b.column("t"))
                toxic = b.column("toxic").to_numpy().astype(np.int64)
                row = np.repeat(np.arange(b.num_rows), np.diff(bounds))
                seen = [np.unique(np.stack([h, row[i]], 1), axis=0) for i, h in _stems(data, starts, ends) if len(h)]
                if not seen:
                    continue
                seen = np.concatenate(seen)
                h, inverse = np.unique(seen[:, 0], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), *[pa.array(np.bincount(inverse, weights=w, minlength=len(h)).astype(np.int64))
                                    for w in (toxic[seen[:, 1]], 1 - toxic[seen[:, 1]])]], ["h", "bad", "good"])

    seen = settle(labelled.mapInArrow(count, "h long, bad long, good long").groupBy("h")
                  .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad + good >= 3"))
    # So many texts that hardly any of all candidates would have only toxic ones by chance.
    sizes = seen.groupBy((F.col("bad") + F.col("good")).alias("d")).count().where("d <= 200").orderBy(F.desc("d")).collect()
    rate, least, above = n[1] / (n[0] + n[1]), 200, 0
    for r in sizes:
        above += r["count"]
        if above * rate ** r.d > CHANCE:
            break
        least = r.d
    # Nearly all texts with it are toxic, though toxic texts are few.
    found = (seen.where((F.col("bad") >= least) & (F.col("good") * 20 <= F.col("bad")))
             .orderBy(F.desc("bad"), "good", "h").limit(LISTED).collect())
    return [r.h for r in found]


def label_model(votes: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 50) -> dict:
    """Expectation maximisation over vote patterns.

    votes: patterns by voters; counts: documents of each pattern; known: (patterns, 2) of them with
    label 0 and 1. Gives the prior, the hit rates of voters in both classes, their correlations
    given the posterior, and each voter's weight.
    """
    v = votes.astype(float)
    free = np.maximum(counts - known.sum(1), 0)
    some = known.sum(0)
    prior = (some[1] + 1) / (some.sum() + 8) if some.sum() else 0.05
    bad = np.clip((known[:, 1] @ v + 0.6) / (some[1] + 1), 0.02, 0.98)
    good = np.clip((known[:, 0] @ v + 0.01) / (some[0] + 1), 1e-4, 0.5)
    weight = np.ones(v.shape[1])
    correlation = np.eye(v.shape[1])
    for k in range(rounds):
        p = _posterior(v, prior, bad, good, weight)
        one, zero = free * p + known[:, 1], free * (1 - p) + known[:, 0]
        prior = np.clip((one.sum() + 1) / (one.sum() + zero.sum() + 8), 1e-4, 0.9)
        bad = np.clip((one @ v + 0.1) / (one.sum() + 1), 1e-3, 0.999)
        good = np.clip((zero @ v + 0.001) / (zero.sum() + 1), 1e-6, 0.9)
        if k % 10 == 9:
            spread = v - np.where(p[:, None] > 0.5, bad, good)
            c = (spread * (one + zero)[:, None]).T @ spread / max((one + zero).sum(), 1)
            scale = np.sqrt(np.maximum(np.diag(c), 1e-9))
            correlation = np.clip(c / np.outer(scale, scale), -1, 1)
            weight = 1 / (1 + (np.maximum(correlation, 0) - np.diag(np.maximum(np.diag(correlation), 0))).sum(1))
    return {"prior": prior, "bad": bad, "good": good, "weight": weight, "correlation": correlation}


def _posterior(v: np.ndarray, prior: float, bad: np.ndarray, good: np.ndarray, weight: np.ndarray) -> np.ndarray:
    gain = v * np.log(bad / good) + (1 - v) * np.log((1 - bad) / (1 - good))
    return sigmoid(np.log(prior / (1 - prior)) + gain @ weight)


class Model:
    def __init__(self, voters: Voters, weights: np.ndarray, scale: tuple[float, float]):
        self.voters, self.weights, self.scale = voters, weights, scale

    def score(self, texts: pa.Array) -> np.ndarray:
        _, x = self.voters.apply(texts)
        return sigmoid(self.scale[0] * (x @ self.weights) + self.scale[1])


def fit(rows: DataFrame, labelled: DataFrame) -> Model:
    """rows: (i, t) of all documents; labelled: (i, t, toxic 0/1), the learning rows."""
    voters = Voters(learn_stems(labelled))
    width = len(voters.names)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                code = voters.apply(b.column("t"))[0] @ (1 << np.arange(width))
                toxic = b.column("toxic").fill_null(-1).to_numpy()
                for key, n in zip(*np.unique(np.stack([code, toxic], 1), axis=0, return_counts=True), strict=True):
                    total[tuple(key.tolist())] = total.get(tuple(key.tolist()), 0) + int(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.int64()), pa.array([k[1] for k in total], pa.int64()),
             pa.array(list(total.values()), pa.int64())], ["code", "toxic", "n"])

    shape = "code long, toxic long, n long"
    # At most 2 ** voters patterns, however many documents; very few occur.
    every = rows.select("t", F.lit(None).cast("int").alias("toxic")).mapInArrow(patterns, shape)
    told = labelled.select("t", F.col("toxic").cast("int").alias("toxic")).mapInArrow(patterns, shape)
    seen = every.union(told).groupBy("code", "toxic").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    codes = np.unique(np.array(seen["code"], np.int64))
    counts, known = np.zeros(len(codes)), np.zeros((len(codes), 2))
    for c, y, n in zip(seen["code"], seen["toxic"], seen["n"], strict=True):
        at = np.searchsorted(codes, c)
        if y < 0:
            counts[at] += n
        else:
            known[at, int(y)] += n
    model = label_model((codes[:, None] >> np.arange(width)) & 1, counts, known)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                votes, x = voters.apply(b.column("t"))
                p = _posterior(votes.astype(float), *[model[k] for k in ("prior", "bad", "good", "weight")])
                # A text without a hit has only the last feature; such rows are counted, not listed.
                some = votes.any(1)
                r, c = np.nonzero(x[some])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(r, np.arange(int(some.sum()) + 1)).astype(np.int32)), pa.array(c.astype(np.int32)))
                values = pa.ListArray.from_arrays(lists.offsets, pa.array(x[some][r, c]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p[some]), b.column("toxic").filter(pa.array(some)), lists, values], ["p", "toxic", "at", "x"])

    shape = "p double, toxic int, at array<int>, x array<float>"
    n = int(counts.sum())
    part = rows.where(F.pmod(F.xxhash64("i", F.lit(5)), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20)))
    listed = part.select("t", F.lit(None).cast("int").alias("toxic")).union(
        labelled.select("t", F.col("toxic").cast("int").alias("toxic"))).mapInArrow(features, shape).orderBy("p", "toxic", "at").toArrow()
    x = np.zeros((listed.num_rows + 1, voters.width), np.float32)
    for k, (at, values) in enumerate(zip(listed.column("at"), listed.column("x"), strict=True)):
        x[k, at.values.to_numpy()] = values.values.to_numpy()
    x[-1, -1] = 1
    none = _posterior(np.zeros((1, width)), *[model[k] for k in ("prior", "bad", "good", "weight")])[0]
    target = np.append(listed.column("p").to_numpy(), none)
    repeat = np.append(np.ones(listed.num_rows), max(1, listed.num_rows))     # the hitless texts, as one row of weight
    weights = logistic(np.concatenate([x, np.repeat(x[-1:], int(repeat[-1]) - 1, 0)]).astype(np.float64),
                       np.concatenate([target, np.repeat(none, int(repeat[-1]) - 1)]))
    margin = x @ weights
    toxic = listed.column("toxic").fill_null(-1).to_numpy()
    # Where toxic texts begin: the cut with the fewest errors on the labels, put at THRESHOLD.
    bad, good = np.sort(margin[:-1][toxic == 1]), np.sort(margin[:-1][toxic == 0])
    cuts = np.unique(np.concatenate([bad, good, [margin[-1]]]))
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts + 0.5
    wrong = np.searchsorted(bad, cuts) + len(good) - np.searchsorted(good, cuts)
    best = cuts[wrong == wrong.min()]
    cut = float(best[len(best) // 2]) if len(bad) else float(margin[-1]) + 1
    steep = 4 / max(abs(cut - float(margin[-1])), 0.25)
    return Model(voters, weights, (steep, np.log(THRESHOLD / (1 - THRESHOLD)) - steep * cut))


def score(rows: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Adds `score` to (i, t, and the columns in keep)."""
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in ("i", *keep)], pa.array(model.score(b.column("t")))], ["i", *keep, "score"])
    kinds = dict(rows.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in ("i", *keep))
    return rows.select("i", "t", *keep).mapInArrow(run, f"{fields}, score double")


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the toxic labels of `labels` (doc_id, toxic) whose remainder by 3 is not 1.

    A bounded share of the labelled rows is learned from; nulls are left out. Without labels of both
    kinds only the given voters count.
    """
    told = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    told = told.groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = max(told.count(), 1)
    share = int(min(1.0, LABELLED / n) * (1 << 20))
    told = settle(told.where(F.pmod(F.xxhash64("i", F.lit(3)), F.lit(1 << 20)) < share))
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"))
    return fit(rows, settle(rows.join(told, "i")))


def document_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`.

    An empty or null text gets the score of a text without a hit. Rows with the same id or none are
    kept as they are. Of `docs` only doc_id and text are read, of `labels` only doc_id and toxic.
    """
    model = fitted(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"))
    return score(rows, model).select(
        F.col("i").alias("doc_id"), (remainder(F.col("i"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
