"""Byte-level BPE over a global shuffle of distinct words.

Texts are cut into pre-tokens in blocks of a few megabytes. A block posts each of its distinct words
once, dealt by the word's hash, and keeps the sequence of word numbers that says where each stands
(the exploded positions, packed). Where all blocks' words of one hash group meet, each distinct word
is encoded once and its ids go back to every block that has it; there the texts' ids are put together
by position. A word which every text has still is one row entry per block, so no group is hot.

Decoding joins ids with the token-byte table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WHITE

BLOCK_CHARS = 4_000_000
_DOUBTFUL = re.compile(f" (?<=[{WHITE}] )")     # begins with a fixed character, so that the search skips to it
_SURE = re.compile(f"(?<=[^{WHITE}]) ")
# Latin letters in every Unicode version.
_LETTERS = re.compile("[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f]+")
_LOADED: dict[str, tuple] = {}

STREAM = "block long, doc_ids array<long>, sizes array<long>, groups binary, low binary, high binary"
WORDS = "block long, g int, words binary"
CODED = "block long, g int, n binary, ids binary"


def vocabulary(path: str) -> tuple[tiktoken.Encoding, np.ndarray, np.ndarray]:
    """An encoder of single pre-tokens; the bytes of all tokens in one array, and their bounds."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        whole = tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        by_id = {v: k for k, v in ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        _LOADED[path] = (whole, np.frombuffer(b"".join(tokens), np.uint8),
                         np.concatenate([[0], np.cumsum([len(t) for t in tokens])]))
    return _LOADED[path]


class _Block:
    """The pre-tokens of consecutive texts, numbered by first appearance."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        # Whether a space and letters after it are one pre-token; a pattern of another kind cuts all pieces.
        self.spaced = pattern == public_tokenizers.PATTERN
        self.number: dict[str, int] = {}
        self.known: dict[str, bytes] = {}
        self.mark = hashlib.blake2b(digest_size=8)
        self.ids, self.sizes, self.parts, self.chars = [], [], [], 0

    def _numbers(self, piece: str) -> bytes:
        n = self.number
        return array("I", [n.setdefault(w, len(n)) for w in self.pattern.findall(piece)]).tobytes()

    def add(self, i: int | None, text: str) -> None:
        # A pre-token never reaches over a space that follows a character which is no space.
        parts = _SURE.split(text) if _DOUBTFUL.search(text) else text.split(" ")
        known, number = self.known, self.number
        out = [self._numbers(parts[0]), *map(known.get, parts[1:])]
        if None in out:
            letters = _LETTERS.fullmatch
            for k, p in enumerate(parts[1:], 1):
                if out[k] is None:
                    found = known.get(p)               # the same text may have it twice
                    if found is None:
                        if self.spaced and letters(p):
                            found = number.setdefault(" " + p, len(number)).to_bytes(4, sys.byteorder)
                        else:
                            found = self._numbers(" " + p)
                        known[p] = found
                    out[k] = found
        body = b"".join(out)
        self.mark.update(f"{i} {len(body)} {zlib.crc32(body)}|".encode())
        self.ids.append(i)
        self.sizes.append(len(body) // 4)
        self.parts.append(body)
        self.chars += len(text)

    def words(self, groups: int) -> tuple[list[bytes], np.ndarray]:
        found = [w.encode() for w in self.number]
        return found, np.array([zlib.crc32(w) % groups for w in found], np.int64)

    def name(self, found: list[bytes]) -> int:
        """From the content alone, so that a second reading of the same texts names the same block."""
        self.mark.update(b"".join(found))
        return int.from_bytes(self.mark.digest(), "little", signed=True)


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[_Block]:
    block = _Block(pattern)
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            b = whole.slice(at, 200)
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist(), strict=True):
                block.add(i, t or "")
                if block.chars >= BLOCK_CHARS:
                    yield block
                    block = _Block(pattern)
    if block.ids:
        yield block


def _joined(parts: list[bytes]) -> bytes:
    """Byte strings with their lengths before them, compressed."""
    sizes = np.array([len(p) for p in parts], "<u4").tobytes()
    return zstandard.compress(np.array([len(parts)], "<u4").tobytes() + sizes + b"".join(parts), 3)


def _parted(body: bytes) -> list[bytes]:
    raw = zstandard.decompress(body)
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    at = 4 + 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw[4:4 + 4 * n], "<u4").astype(np.int64))])
    return [raw[s:e] for s, e in zip(at[:-1], at[1:])]


def encoded(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids binary: little-endian unsigned 32-bit) for each row of `docs`.

    A null or empty text has no ids; equal rows give equal rows; a null id is carried along. Other
    columns are not read. `docs` is read twice, once for the words and once for their places; blocks
    are named by their content, and a block whose words are missing is an error, so `docs` should be
    a stored table or otherwise give the same rows in the same order again.
    """
    spark = docs.sparkSession
    groups = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, pattern):
            found, g = block.words(groups)
            numbers = np.frombuffer(b"".join(block.parts), np.uint32)
            low, high = (numbers & 0xFFFF).astype("<u2"), (numbers >> 16).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.name(found)], pa.int64()), pa.array([block.ids], pa.list_(pa.int64())),
                 pa.array([block.sizes], pa.list_(pa.int64())),
                 *[pa.array([zstandard.compress(x.tobytes(), 3)], pa.binary()) for x in (g.astype("<u4"), low, high)]],
                ["block", "doc_ids", "sizes", "groups", "low", "high"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, pattern):
            found, g = block.words(groups)
            name, order = block.name(found), np.argsort(g, kind="stable")
            at = np.flatnonzero(np.diff(g[order], prepend=-1))
            bodies = [_joined([found[k] for k in part]) for part in np.split(order, at[1:])] if len(order) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(bodies), pa.int64()), pa.array(g[order][at].astype(np.int32)), pa.array(bodies, pa.binary())],
                ["block", "g", "words"])

    def encode(posted: pa.Table) -> pa.Table:
        encoding = vocabulary(ranks)[0]
        ids: dict[bytes, bytes] = {}
        n, out = [], []
        for body in posted.column("words"):
            parts = _parted(body.as_py())
            for w in parts:
                if w not in ids:
                    ids[w] = np.array(encoding.encode_ordinary(w.decode()), "<u2" if encoding.max_token_value < 1 << 16 else "<u4").tobytes()
            found = [ids[w] for w in parts]
            n.append(zstandard.compress(np.array([len(x) for x in found], "<u4").tobytes(), 3))
            out.append(zstandard.compress(b"".join(found), 3))
        return pa.table({"block": posted.column("block"), "g": posted.column("g"),
                         "n": pa.array(n, pa.binary()), "ids": pa.array(out, pa.binary())})

    def assemble(stream: pa.Table, coded: pa.Table) -> pa.Table:
        kind = np.dtype("<u2" if vocabulary(ranks)[0].max_token_value < 1 << 16 else "<u4")
        by_group = {}
        for g, n, body in zip(*[coded.column(c).to_pylist() for c in ("g", "n", "ids")], strict=True):
            by_group[g] = (np.frombuffer(zstandard.decompress(n), "<u4"), zstandard.decompress(body))
        docs_out, counts, bodies = [], [], []
        for doc_ids, sizes, g, low, high in zip(*[stream.column(c).to_pylist() for c in ("doc_ids", "sizes", "groups", "low", "high")], strict=True):
            g = np.frombuffer(zstandard.decompress(g), "<u4")
            order = np.argsort(g, kind="stable")       # words in the order of the posted groups
            there = np.unique(g)
            if set(there.tolist()) - set(by_group):
                raise RuntimeError("the texts differ between two readings; store the table first")
            n = np.empty(len(g), np.int64)
            n[order] = np.concatenate([np.zeros(0, np.int64), *[by_group[k][0] for k in there.tolist()]]) // kind.itemsize
            first = np.empty(len(g), np.int64)
            first[order] = np.cumsum(n[order]) - n[order]
            ids = np.frombuffer(b"".join(by_group[k][1] for k in there.tolist()), kind)
            numbers = (np.frombuffer(zstandard.decompress(low), "<u2").astype(np.int64)
                       | np.frombuffer(zstandard.decompress(high), "<u2").astype(np.int64) << 16)
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            for i, s, e in zip(doc_ids, at[:-1], at[1:]):
                own = numbers[s:e]
                body = ids[_ranges(first[own], n[own])].astype("<u4").tobytes()
                docs_out.append(i)
                counts.append(len(body) // 4)
                bodies.append(body)
        return pa.table({"doc_id": pa.array(docs_out, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                         "ids": pa.array(bodies, pa.large_binary()).cast(pa.binary())})

    coded = rows.mapInArrow(words, WORDS).groupBy("g").applyInArrow(encode, CODED)
    return (rows.mapInArrow(streams, STREAM).groupBy("block").cogroup(coded.groupBy("block"))
            .applyInArrow(assemble, "doc_id long, n_tokens long, ids binary"))


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + n[0] - 1, first[1], ..."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - n), n)


def decoded(tokens: DataFrame, ranks: str) -> DataFrame:
    """Adds `bytes`, the text's bytes, to (…, ids); null ids stay null, an id outside the table is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, bounds = vocabulary(ranks)
        n = np.diff(bounds)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = []
                for x in b.column("ids"):
                    if x.is_valid:
                        ids = np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)
                        texts.append(table[_ranges(bounds[ids], n[ids])].tobytes())
                    else:
                        texts.append(None)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*b.schema.names, "bytes"])
    kept = tokens.drop("bytes")
    fields = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
    return kept.mapInArrow(run, f"{fields}, bytes binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """Digests of the ids of each document and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return decoded(encoded(docs, ranks, public_tokenizers.PATTERN), ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
