"""Packing of examples into training sequences by vector bin packing.

An example is a row of ids. Sequences have three limits: tokens, segments and loss-bearing tokens.
The full sequences of a long example go out as they are; what remains of each example waits in a
pool of bounded size. A sequence is opened and takes, again and again, the waiting piece that fits
under all limits and has the largest dot product of its demands with what the sequence has left, each
in shares of its limit. When none fits, the longest piece is cut to fill the sequence exactly and the
rest of it goes on waiting. A sequence that can't be filled is cut into powers of two, which need no
padding. Every task packs its own part of the input, so nothing is shuffled, and the same part gives
the same sequences when a lost task runs again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder

MAX_TOKENS = 1024
MAX_SEGMENTS = 64
MAX_LOSS = 1024
POOL = 512
END_ID = 0

PIECES = ("doc_id long, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, "
          "offset long, ids binary")


class Packer:
    """Takes (id, ids, loss_from) one after another and gives finished sequences: lists of pieces.

    A piece is (example, start, length); an example is (id, ids, loss_from). Ids before loss_from (a
    prompt) bear no loss.
    """

    def __init__(self, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS, pool: int = POOL):
        if min(tokens, segments, loss) < 1:
            raise ValueError("the limits must be positive")
        self.limits = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss, self.pool = tokens, segments, loss, pool
        self.waiting: list[tuple] = []          # (example, start)
        self.demands = np.zeros((2 * pool + 2, 3))

    @staticmethod
    def _loss(example: tuple, start: int, length: int) -> int:
        return max(0, start + length - max(start, example[2]))

    def _fit(self, example: tuple, start: int, tokens: int, loss: int) -> int:
        """How many ids from `start` fit under the given limits."""
        free = max(0, example[2] - start)       # without loss
        return min(tokens, len(example[1]) - start, free + loss)

    def add(self, example: tuple) -> Iterator[list]:
        start = 0
        while (n := len(example[1]) - start) >= self.tokens and self._fit(example, start, self.tokens, self.loss) == self.tokens:
            yield [(example, start, self.tokens)]
            start += self.tokens
        if n:
            self._wait(example, start)
        if len(self.waiting) > 2 * self.pool:
            while len(self.waiting) > self.pool:
                yield from self._close(self._fill())

    def finish(self) -> Iterator[list]:
        while self.waiting:
            yield from self._close(self._fill())

    def _wait(self, example: tuple, start: int) -> None:
        n = len(example[1]) - start
        self.demands[len(self.waiting)] = n, 1, self._loss(example, start, n)
        self.waiting.append((example, start))

    def _take(self, k: int) -> tuple:
        found = self.waiting[k]
        last = len(self.waiting) - 1
        self.waiting[k], self.demands[k] = self.waiting[last], self.demands[last]
        self.waiting.pop()
        return found

    def _fill(self) -> list:
        left, pieces = self.limits.copy(), []
        while self.waiting and left[0] >= 1 and left[1] >= 1:
            d = self.demands[:len(self.waiting)]
            score = np.where((d <= left).all(1), d @ (left / self.limits ** 2), -1.0)
            k = int(score.argmax())
            if score[k] >= 0:
                example, start = self._take(k)
                n = len(example[1]) - start
            else:
                k = int(d[:, 0].argmax())
                example, start = self._take(k)
                n = self._fit(example, start, int(left[0]), int(left[2]))
                self._wait(example, start + n)
                if n == 0:
                    break
            pieces.append((example, start, n))
            left -= (n, 1, self._loss(example, start, n))
        return pieces

    def _close(self, pieces: list) -> Iterator[list]:
        total = sum(n for _, _, n in pieces)
        if total == self.tokens:
            yield pieces
            return
        while total:
            size = min(1 << (total.bit_length() - 1), self.tokens)
            part, rest = [], size
            while rest:
                example, start, n = pieces.pop(0)
                part.append((example, start, min(n, rest)))
                if n > rest:
                    pieces.insert(0, (example, start + rest, n - rest))
                rest -= min(n, rest)
            total -= size
            yield part


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           prompt_col: str | None = None, end_id: int = END_ID, tokens: int = MAX_TOKENS,
           segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS) -> DataFrame:
    """Packs the rows of `docs` into sequences; one row per piece (columns: PIECES).

    An example is the ids of the prompt (if a column is named; without loss), those of the text and
    `end_id`. A null text or prompt is empty, so its row is the end id alone. Equal rows are
    examples of their own; a null id is carried along. Other columns are not read. A sequence has
    `tokens` ids or a power of two of them; its pieces lie at offsets from 0 without a gap. ids:
    little-endian unsigned 32-bit.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, True)
        packer = Packer(tokens, segments, loss)
        first = TaskContext.get().partitionId() << 36
        made = 0

        def rows(sequences: Iterator[list]) -> Iterator[tuple]:
            nonlocal made
            for pieces in sequences:
                offset = 0
                for example, start, n in pieces:
                    yield (example[0], start, n, len(example[1]), packer._loss(example, start, n), first + made,
                           offset, example[1][start:start + n].astype("<u4").tobytes())
                    offset += n
                made += 1

        def table(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()]
            columns = zip(*found, strict=True) if found else [[]] * 8
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "start", "length", "doc_tokens", "loss_tokens", "sequence_id", "offset", "ids"])

        end = np.array([end_id], encoder.dtype).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = encoder.encode(b.column("t").to_pylist())
                before = encoder.encode(b.column("p").to_pylist()) if prompt_col else [b""] * len(texts)
                found = []
                for i, p, t in zip(b.column("i").to_pylist(), before, texts, strict=True):
                    example = (i, np.frombuffer(p + t + end, encoder.dtype), len(p) // encoder.dtype.itemsize)
                    found.extend(rows(packer.add(example)))
                yield table(found)
        yield table(list(rows(packer.finish())))

    prompt = F.col(prompt_col) if prompt_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), prompt.alias("p")).mapInArrow(pack, PIECES)


def packed_documents(docs: DataFrame) -> DataFrame:
    """Where each id of each document lies: pieces with the crc32 of their ids."""
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "loss_tokens")
