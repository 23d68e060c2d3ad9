"""Language of whole texts: the family first, then one-versus-one linear support vector machines inside it.

Features are shares of byte trigrams of the lower-cased text, hashed to a fixed width; all bytes of the
text count. Each machine separates two families or two languages of one family and is fitted in a
task of its own, on at most about PER_LANGUAGE rows of each language; every row is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import sigmoid, svm
from .words import utf8

WIDTH = 1 << 13
PER_LANGUAGE = 400       # rows per language that machines are fitted on, on average
# Families of languages. A language that is not named is a family of its own.
FAMILIES = {
    "germanic": ["de", "en", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "hu", "et"],
}
UNKNOWN = "und"

_FAMILY = {lang: f for f, langs in FAMILIES.items() for lang in langs}
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"only {lang}")


def features(texts: pa.Array) -> np.ndarray:
    """Shares of the hashed byte trigrams of each text."""
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, WIDTH), np.float32)
    b = _LETTERS[data].astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    row = np.repeat(np.arange(n), np.diff(offsets))[:-2]
    # Runs of separators say nothing, nor does what reaches into the next text.
    keep = (np.arange(len(code)) + 2 < offsets[1:][row]) & (code != 0x202020) & ((code & 0xFFFF) != 0x2020)
    code, row = code[keep], row[keep]
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - 13)
    x = np.bincount(row * WIDTH + slot.astype(np.int64), minlength=n * WIDTH).reshape(n, WIDTH).astype(np.float32)
    return x / np.maximum(x.sum(1, keepdims=True), 1)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _machines(langs: list[str]) -> list[tuple[str, dict[str, int]]]:
    """Name of each machine, and the side of each language in it."""
    found = []
    families = sorted({family(x) for x in langs})
    for a, b in combinations(families, 2):
        found.append((f"family\t{a}\t{b}", {x: 1 if family(x) == a else -1 for x in langs if family(x) in (a, b)}))
    for a, b in combinations(sorted(langs), 2):
        if family(a) == family(b):
            found.append((f"language\t{a}\t{b}", {a: 1, b: -1}))
    return found


def fit(rows: DataFrame, langs: dict[str, int]) -> list[tuple[str, np.ndarray]]:
    """rows: (i, t, lang), the learning rows; langs: their number by language. (name, weights and bias) per machine."""
    machines = _machines(list(langs))
    if not machines:
        return []
    share = F.create_map(*[F.lit(v) for lang, n in langs.items() for v in (lang, int(min(1.0, PER_LANGUAGE / n) * (1 << 20)))])
    sides = F.create_map(*[v for lang in langs for v in (F.lit(lang), F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(s[lang]).alias("side")) for m, (_, s) in enumerate(machines) if lang in s]))])
    picked = (rows.where(F.col("lang").isin(list(langs)))
              .where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")))
              .select("t", F.element_at(sides, F.col("lang")).alias("sides")))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                x = features(b.column("t"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("sides"), pa.array([v.tobytes() for v in x], pa.binary())], ["sides", "x"])

    spread = (picked.mapInArrow(vectors, "sides array<struct<m: int, side: int>>, x binary")
              .select(F.explode("sides").alias("s"), "x").select("s.m", "s.side", "x"))

    def machine(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)
        side = t.column("side").to_numpy().astype(float)
        order = np.lexsort((x @ np.arange(WIDTH), side))      # the same sum whatever the order of arrival
        x, side = x[order], side[order]
        scale = 1 / np.sqrt(x.mean(0) + 1e-6)
        w = svm(np.hstack([x * scale, np.ones((len(x), 1))]), side)
        w[:-1] *= scale
        return pa.table({"m": pa.array([t.column("m")[0].as_py()], pa.int32()), "w": pa.array([w.tobytes()], pa.binary())})

    found = spread.groupBy("m").applyInArrow(machine, "m int, w binary").collect()   # one row per machine
    return [(machines[r.m][0], np.frombuffer(r.w)) for r in sorted(found, key=lambda r: r.m)]


def _winner(names: list[str], margins: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The index of the name with the largest sum of margins, and how sure its closest duel is."""
    total = np.zeros((n, len(names)))
    for (a, b), m in margins.items():
        total[:, names.index(a)] += np.clip(m, -1, 1)
        total[:, names.index(b)] -= np.clip(m, -1, 1)
    best = total.argmax(1)
    sure = np.ones(n)
    for (a, b), m in margins.items():
        for name, way in ((a, m), (b, -m)):
            sure = np.where(best == names.index(name), np.minimum(sure, sigmoid(4 * way)), sure)
    return best, sure


def predict(rows: DataFrame, langs: list[str], machines: list[tuple[str, np.ndarray]]) -> DataFrame:
    """(i, lang_pred, score) for each row of (i, t)."""
    families = sorted({family(x) for x in langs})
    by_name = {name: k for k, (name, _) in enumerate(machines)}
    weights = np.array([w for _, w in machines]).reshape(len(machines), WIDTH + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                n = b.num_rows
                margin = features(b.column("t")) @ weights[:, :-1].T + weights[:, -1] if len(weights) else np.zeros((n, 0))
                def duels(kind: str, names: list[str]) -> dict:
                    return {(x, y): margin[:, by_name[k]] for x, y in combinations(names, 2)
                            if (k := f"{kind}\t{x}\t{y}") in by_name}
                pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
                own, sure = _winner(families, duels("family", families), n) if families else (np.zeros(n, int), score)
                for f, name in enumerate(families):
                    inside = sorted(x for x in langs if family(x) == name)
                    best, closer = _winner(inside, duels("language", inside), n)
                    pred = np.where(own == f, np.array(inside, object)[best], pred)
                    score = np.where(own == f, sure * closer, score)
                lettered = np.array([has_letter(t) for t in b.column("t").to_pylist()], bool)
                pred, score = np.where(lettered, pred, UNKNOWN), np.where(lettered, score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [b.column("i"), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["i", "lang_pred", "score"])

    return rows.select("i", "t").mapInArrow(run, "i long, lang_pred string, score double")


def remainder(i: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(i.cast("string"), F.lit("")).cast("binary")) % by


def document_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of `docs`.

    Learned from the rows with text and lang whose remainder by 4 is not 2. A text that is null or has
    no letter is `und` with score 0, as is every text where nothing could be learned; with one language
    every lettered text has it. All languages are learned; the driver sees their names and counts. Rows with
    the same or no id are kept as they are. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang"))
    learn = rows.where(F.col("t").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("i"), 4) != 2))
    counts = learn.groupBy("lang").count().collect()
    langs = {r.lang: r["count"] for r in counts}
    found = predict(rows, sorted(langs), fit(learn, langs))
    return found.select(F.col("i").alias("doc_id"), (remainder(F.col("i"), 4) == 2).alias("held_out"), "lang_pred", "score")
