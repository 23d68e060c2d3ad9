"""Token ids as files: canonical length-limited Huffman codes from global counts.

The files are two Parquet tables in the shared folder. `codes` has the length of each id's code; the
codes themselves follow from the lengths (canonical: by length, then by id). `blocks` has, in
ascending order of (part, block), independent blocks of whole documents: ids and sizes of the
documents, the bits (each document starts at a byte), and checkpoints, the bit offsets of every
STRIDE-th id of each document. A reader can start at any checkpoint, so all checkpoints of a block are
decoded side by side with one table look-up an id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .tokens import Encoder

MAX_BITS = 18            # of a code; 32 - 7 at most, so that any code lies in four bytes
STRIDE = 512             # ids between checkpoints
BLOCK_IDS = 1 << 16
READ_IDS = 1 << 19       # ids decoded at once, one block at least
END_ID = 2

BLOCKS = ("part int, block int, before long, n long, doc_ids array<long>, sizes array<long>, marks array<long>, "
          "bits binary")


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `most` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids can't have codes of {most} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order].astype(np.int64)
    levels, items = [], np.zeros(0, np.int64)
    for _ in range(most):
        packages = items[:len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(weight))
        items = both[by]
    need = 2 * len(weight) - 2
    for leaf in reversed(levels):
        k = int(leaf[:need].sum())
        out[order[:k]] += 1
        need = 2 * (need - k)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, as an integer of its length."""
    codes = np.zeros(len(lengths), np.int64)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - last
            last = int(lengths[i])
            codes[i] = code
            code += 1
    return codes


def look_up(lengths: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For every value of the next `most` bits: the id that they begin with, and its length."""
    # Codes ascend by length, then by id, without a gap.
    by = np.lexsort((np.arange(len(lengths)), lengths))
    by = by[lengths[by] > 0]
    wide = 1 << (most - lengths[by])
    ids, sizes = np.zeros(1 << most, np.uint32), np.zeros(1 << most, np.uint8)
    ids[:wide.sum()], sizes[:wide.sum()] = np.repeat(by, wide), np.repeat(lengths[by], wide)
    return ids, sizes


def to_bits(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """The bits of each document, padded to a byte, and the bit offsets of its checkpoints."""
    n = lengths[ids]
    ends = np.cumsum(n)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    total = np.concatenate([[0], ends])[bounds]
    size = (np.diff(total) + 7) // 8
    first = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = ends - n + (first[:-1] * 8 - total[:-1])[doc]
    word, shift = at >> 5, 64 - (at & 31) - n
    wide = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    words = int(first[-1] // 4 + 3)
    body = np.bincount(word, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=words)
    body += np.bincount(word + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)[:words]
    raw = body.astype(np.uint64).astype(">u4").tobytes()
    inside = np.arange(len(ids)) - bounds[:-1][doc]
    some = np.flatnonzero(inside % STRIDE == 0)
    marks = np.split(at[some] - first[:-1][doc[some]] * 8, np.cumsum((sizes + STRIDE - 1) // STRIDE)[:-1])
    return [raw[s:e] for s, e in zip(first[:-1], first[1:])], marks


def from_bits(bits: bytes, sizes: np.ndarray, marks: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a block, or of several in a row; every checkpoint is decoded as a lane of its own."""
    raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
    four = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    lanes = (sizes + STRIDE - 1) // STRIDE
    index = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    todo = np.minimum(STRIDE, np.repeat(sizes, lanes) - index * STRIDE)
    out = np.zeros((len(todo), int(todo.max(initial=0))), np.uint32)
    by = np.argsort(-todo, kind="stable")
    at, left = marks[by].copy(), todo[by]
    for step in range(out.shape[1]):
        going = int(np.searchsorted(-left, -step, "left"))     # lanes with more than `step` ids
        here = at[:going]
        value = (four[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)
        out[by[:going], step] = table[0][value]
        at[:going] = here + table[1][value]
    return out[np.arange(out.shape[1])[None] < todo[:, None]]


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def write_ids(tokens: DataFrame, vocabulary: int, path: str) -> None:
    """Writes (i long, n long, ids binary: little-endian 16-bit below 65 536 ids, else 32-bit) to `path`.

    `tokens` is read three times, so it should be a stored table. Rows come out in ascending i, nulls first.
    """
    spark = tokens.sparkSession
    kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                ids = np.frombuffer(b"".join(b.column(0).slice(at, 500).to_pylist()), kind)
                total += np.bincount(ids, minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "c"])

    counts = np.zeros(vocabulary, np.int64)
    # As many rows as the vocabulary has ids, whatever the corpus.
    for r in tokens.select("ids").mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c")).toLocalIterator():
        counts[r[0]] = r[1]
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, bits long").write.parquet(f"{path}/codes")

    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = tokens.where("i is not null").approxQuantile("i", [k / parts for k in range(1, parts)], 0.2 / parts)
    cuts = np.unique(np.array(cuts)).astype(np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sizes = b.column("n").to_numpy()
                ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), kind)
                bits, marks = to_bits(ids, sizes, codes, lengths)
                keys = b.column("i").fill_null(-(1 << 63)).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(cuts, keys, "right").astype(np.int32)), b.column("i"), b.column("n"),
                     pa.array(bits, pa.binary()), pa.array([m.astype("<i8").tobytes() for m in marks], pa.binary())],
                    ["part", "i", "n", "bits", "marks"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, held, n = None, 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held, n
            starts = _bounds([len(r[2]) for r in held])
            marks = np.concatenate([np.frombuffer(r[3], "<i8") + 8 * s for r, s in zip(held, starts)])
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([n], pa.int64()), pa.array([[r[0] for r in held]], pa.list_(pa.int64())),
                 pa.array([[r[1] for r in held]], pa.list_(pa.int64())), pa.array([marks.tolist()], pa.list_(pa.int64())),
                 pa.array([b"".join(r[2] for r in held)], pa.binary())],
                ["part", "block", "before", "n", "doc_ids", "sizes", "marks", "bits"])
            block, before, held, n = block + 1, before + n, [], 0
            return out

        for b in batches:
            for p, i, k, bits, marks in zip(*[b.column(c).to_pylist() for c in ("part", "i", "n", "bits", "marks")], strict=True):
                if held and (p != part or n >= BLOCK_IDS):
                    yield flush()
                if p != part:
                    part, block, before = p, 0, 0
                held.append((i, k, bits, marks))
                n += k
        if held:
            yield flush()

    (tokens.mapInArrow(encode, "part int, i long, n long, bits binary, marks binary")
     # A partition for each part, so that the files follow each other in the order of the ids.
     .repartitionById(parts, F.col("part")).sortWithinPartitions("part", "i")
     .mapInArrow(assemble, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary: little-endian unsigned 32-bit) from files of `write_ids`."""
    codes = spark.read.schema("id long, bits long").parquet(f"{path}/codes").toArrow()   # bounded by the vocabulary
    lengths = np.zeros(int(max(codes.column("id").to_pylist(), default=0)) + 1, np.int64)
    lengths[codes.column("id").to_numpy()] = codes.column("bits").to_numpy()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    firsts, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():   # one row per part
        firsts[r.part], total = total, total + r.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = look_up(lengths)
        for whole in batches:
            upto, at = np.cumsum(whole.column("n").to_numpy()), 0
            while at < whole.num_rows:
                most = READ_IDS + (int(upto[at - 1]) if at else 0)
                n = max(int(np.searchsorted(upto, most, "right")) - at, 1)
                b, at = whole.slice(at, n), at + n
                bits = b.column("bits").to_pylist()
                marks = b.column("marks")
                shift = 8 * np.repeat(_bounds(list(map(len, bits)))[:-1], np.diff(marks.offsets.to_numpy()))
                sizes = b.column("sizes").flatten().to_numpy()
                ids = from_bits(b"".join(bits), sizes, marks.flatten().to_numpy() + shift, table)
                to = _bounds(sizes)
                # The ids before each block, in the corpus and here.
                before = np.array([firsts[p] for p in b.column("part").to_pylist()], np.int64) + b.column("before").to_numpy()
                before -= _bounds(b.column("n").to_numpy())[:-1]
                docs = b.column("doc_ids")
                yield pa.RecordBatch.from_arrays(
                    [docs.flatten(), pa.array(to[:-1] + np.repeat(before, np.diff(docs.offsets.to_numpy()))), pa.array(sizes),
                     pa.array([ids[s:e].tobytes() for s, e in zip(to[:-1], to[1:])], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def tokenized(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(i long, n long, ids binary) of each row; a null text is empty, every text ends with `end_id`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, spaced)
        end = np.array([end_id], encoder.dtype).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids = [x + end for x in encoder.encode(b.column("t").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column("i"), pa.array([len(x) // encoder.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["i", "n", "ids"])
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "i long, n long, ids binary")


def coded_documents(docs: DataFrame) -> DataFrame:
    """Writes the ids of all documents and reads them back: their place, number and crc32.

    A null or empty text is its end id alone. Rows with a null id come first; equal ids keep all their
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/spanmeter-{uuid.uuid4().hex}"
    name = public_tokenizers.path("word_bpe_49k.json")
    tokens = tokenized(docs, name, False, END_ID)
    tokens.write.option("compression", "zstd").parquet(f"{path}/tokens")
    write_ids(spark.read.schema(tokens.schema).parquet(f"{path}/tokens"),
              Encoder.of(name, False).tokenizer.get_vocab_size(), f"{path}/files")
    return read_ids(spark, f"{path}/files").select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
