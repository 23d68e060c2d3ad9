"""Cutting and encoding of new pieces, and ids in files of several blocks."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import regex
from pyspark.sql import DataFrame

from spanmeter.llm import byte_bpe, huffman, tokens

SIGNS = "aZé×÷ßİ'stred 1９²\n\t  \x85\xa0.,!–中ſşŉ\x1c\x02<|>_ªº"


def _odd(n):
    draw = random.Random(4)
    return ["".join(draw.choice(SIGNS) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def test_letters_after_a_space_need_no_pattern(monkeypatch):
    asked = []
    kept = byte_bpe._Block._numbers
    monkeypatch.setattr(byte_bpe._Block, "_numbers", lambda self, piece: asked.append(piece) or kept(self, piece))
    texts = ["One größere word, one more", *_odd(500)]
    block = next(byte_bpe._blocks([pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "t": texts})], P.PATTERN))
    assert " größere" not in asked and " more" not in asked and " word," in asked
    words = list(block.number)
    for text, body in zip(texts, block.parts, strict=True):
        assert [words[k] for k in memoryview(body).cast("I")] == regex.findall(P.PATTERN, text)


def test_words_of_new_pieces_are_encoded_once(monkeypatch):
    encoder = tokens.Encoder(P.path("word_bpe_49k.json"), False)
    texts = ["Größere größere, (größere) it's\nGRÖSSERE", None, *_odd(2000)]
    assert encoder.encode(texts) == encoder._direct([t or "" for t in texts])
    # Pieces that are new but have only known words are not encoded again.
    monkeypatch.setattr(encoder, "model", None)
    monkeypatch.setattr(encoder, "tokenizer", None)
    assert len(encoder.encode(["größere.GRÖSSERE"])) == 1


def test_byte_level_words_of_new_pieces_are_encoded_once(monkeypatch):
    encoder = tokens.Encoder(P.path("byte_bpe_50k.json"), True)
    texts = ["x Größere größere, (größere) it's\nGRÖSSERE it's, <|endoftext|> end", None, *_odd(2000)]
    assert encoder.encode(texts) == encoder._direct([t or "" for t in texts])
    # Pieces that are new but have only known words are not encoded again; the first of a text is.
    whole = encoder._direct(["x größere,\nGRÖSSERE"])
    monkeypatch.setattr(encoder, "model", None)
    monkeypatch.setattr(encoder, "_learn_texts", None)
    assert encoder.encode(["x größere,\nGRÖSSERE"]) == whole


def test_a_piece_is_looked_up_once_for_all_texts_at_hand():
    class Counting(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return dict.get(self, *key)
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder = tokens.Encoder(P.path(name), spaced)
        encoder.known.number = Counting(encoder.known.number)
        texts = ["one two two one two"] * 50
        assert encoder.encode(texts) == encoder._direct(texts)
        assert encoder.known.number.asked == 2


def test_pieces_of_the_older_generation_are_taken_over(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder = tokens.Encoder(P.path(name), spaced)
        texts = _odd(400)
        found = [x for at in range(0, 400, 20) for x in encoder.encode(texts[at:at + 20])]
        assert found == encoder._direct(texts)
        assert len(encoder.older) > 50
        assert encoder.encode(texts[-30:]) == found[-30:]


def test_an_encoder_that_waits_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "IDLE_SECONDS", 0.2)
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    encoder = tokens.Encoder.of(P.path("byte_bpe_50k.json"), True)
    first = encoder.encode(["some words of a text"])
    end = time.monotonic() + 20
    while encoder.known and time.monotonic() < end:
        time.sleep(0.1)
    assert not encoder.known
    assert encoder.encode(["some words of a text"]) == first


def test_documents_are_coded_in_one_pass_and_read_in_several_blocks(spark, monkeypatch):
    def ranged(*_):
        raise AssertionError("a partitioning by range draws its sample from a pass of its own over what it deals out")
    monkeypatch.setattr(DataFrame, "repartitionByRange", ranged)
    draw = random.Random(6)
    texts = [" ".join(draw.choice(["one", "two,", "größere", "IT'S", "9"]) for _ in range(draw.randint(0, 2000))) for _ in range(400)]
    ids = list(range(-200, 200))
    draw.shuffle(ids)
    rows = spark.createDataFrame([*zip(ids, texts), (7_000, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in huffman.coded_documents(rows).collect()}
    encoder, start = tokens.Encoder(P.path("word_bpe_49k.json"), False), 0
    for i, body in sorted(zip([*ids, 7_000], encoder._direct([*texts, ""]), strict=True)):
        want = np.append(np.frombuffer(body, encoder.dtype), huffman.END_ID).astype("<u4")
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert len(found) == 401 and start > 4 * huffman.BLOCK_IDS


def test_blocks_in_a_row_are_decoded_at_once():
    draw = np.random.default_rng(3)
    lengths = huffman.code_lengths(np.bincount(draw.geometric(0.02, 50_000), minlength=900))
    used = np.flatnonzero(lengths)
    first, second = (huffman.to_bits(x, np.array([700, 0, 300]), huffman.canonical(lengths), lengths) + (x,)
                     for x in (draw.choice(used, 1000), draw.choice(used, 1000)))
    shifts = 8 * huffman._bounds([len(b) for b in [*first[0], *second[0]]])[:-1]
    marks = np.concatenate([m + s for m, s in zip([*first[1], *second[1]], shifts, strict=True)])
    table = huffman.look_up(lengths)
    got = huffman.from_bits(b"".join([*first[0], *second[0]]), np.array([700, 0, 300] * 2), marks, table)
    assert (got == np.concatenate([first[2], second[2]])).all()
    assert table[1].dtype == np.uint8
