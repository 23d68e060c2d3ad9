"""Each operator against a brute-force version on rows with nulls, empty texts, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import math
import pathlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanmeter.llm import (byte_bpe, cleaning, huffman, katz, language, minhash, multi_index, near, packing,
                           passages, tokens, toxicity, words)

SYL = ["ka", "lo", "mi", "ra", "tu", "ne", "so", "vi", "pe", "da"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYL) for _ in range(r.randint(1, 3))) for _ in range(n))


PASSAGE = prose(99, 60)
BASE = prose(1, 120)
TEXTS = [
    (0, BASE + "."), (1, BASE.upper() + "."), (2, BASE.replace(" ", "\n", 3) + " other words here"), (3, None), (4, ""), (5, " \n\t"),
    (6, "one two"), (7, "One  two"), (8, prose(2, 40) + " " + PASSAGE + " " + prose(3, 40)),
    (9, prose(4, 30) + " " + PASSAGE + " " + prose(5, 50) + ".\n" + prose(6, 25) + "."), (10, prose(7, 3000)),
    (11, "Ünïcode  words  and  'tis it's 12345 … ~~~\n\n\nend \x01 <|endoftext|> 日本語 "), (12, prose(8, 80) + "."), (None, "no id at all"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "en", k) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, t string, i int, lang string, n long")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def split(text):
    return [w for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]


def test_a_hash_depends_on_the_word_alone():
    a = words.words(pa.array(["the cat sat"]))[0]
    b, at = words.words(pa.array(["xx " * 3000 + "THE cat sat on", None, "sat"]))
    assert (a == b[3000:3003]).all() and b[at[2]] == a[2] and np.diff(at).tolist() == [3004, 0, 1]


def test_near_duplicates(docs, none):
    got = by_id(minhash.near_duplicates(docs))
    sets = {}
    for i, t in TEXTS:
        w = split((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    for i, _ in TEXTS:
        assert got[i].n_shingles == len(sets[i]), i
    assert [got[i].component_id for i in (0, 1, 2, 6, 7, 3, 4, 8, 9)] == [0, 0, 0, 6, 6, 3, 4, 8, 9]
    assert got[0].kept and not got[1].kept and not got[None].kept and got[None].component_id is None
    assert minhash.near_duplicates(none).collect() == []


def test_chains_of_near_copies_are_one_component(spark):
    w = BASE.split()
    rows = []
    for k in range(12):
        w = [*w[:k * 8], f"new{k}", *w[k * 8 + 1:]]
        rows.append((100 - k, " ".join(w)))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r.component_id for r in got.values()} == {89} and [i for i, r in got.items() if r.kept] == [89]


def test_near_vectors(spark):
    r = np.random.RandomState(3)
    centre = r.randn(8, 16)
    rows = [(k, (centre[k % 8] + r.randn(16) * [0.05, 0.4][k % 2]).tolist()) for k in range(160)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [1e-300] * 16),
             (206, [1.0, None]), (207, []), (None, rows[1][1]), (208, [3e300] * 16)]
    got = {x.vec_id: x for x in multi_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0).collect()}
    sound = {i: np.array(v) / np.abs(v).max() for i, v in rows if i is not None and i not in (202, 203, 204, 206, 207)}
    sound = {i: v / np.linalg.norm(v) for i, v in sound.items()}
    links = {i: [j for j, u in sound.items() if j != i and v @ u >= 0.95] for i, v in sound.items()}
    for i, found in links.items():
        assert got[i].n_links == len(found), i
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i].component_id == min(seen)
    assert [got[i].n_links for i in (202, 203, 204, 206, 207, None)] == [0] * 6
    assert multi_index.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_passages(docs, none):
    got = by_id(passages.document_passages(docs))
    w = split(TEXTS[9][1])
    (s, e), = got[9].spans
    assert 30 <= s and e <= 90 and e - s >= passages.MIN_WORDS and got[9].kept_in == [8]
    assert got[8].n_spans == 0 and got[12].n_spans == 0 and got[3].n_spans == 0 and got[None].n_spans == 0
    assert got[1].removed_words == 120 and got[2].removed_words > 60
    left, = passages.without(pa.array([TEXTS[9][1]]), [got[9].spans])
    assert split(left) == w[:s] + w[e:] and left.count("\n") == 1
    assert passages.without(pa.array(["a b\nc d\ne f"]), [[[2, 4]]]) == ["a b\ne f"]
    assert passages.without(pa.array(["a b\nc d"]), [[[0, 4]]]) == [""]
    assert passages.document_passages(none).collect() == []


def test_passages_over_short_lines(spark):
    """A passage of 60 words in lines of 12 stands in other lines, and in one line, of later documents."""
    w = PASSAGE.split()

    def lines(words, n):
        return "\n".join(" ".join(words[k:k + n]) for k in range(0, len(words), n))
    texts = [prose(31, 40) + "\n" + lines(w, 12) + "\n" + prose(32, 40), lines([*prose(33, 28).split(), "a1", *w, "b1", *prose(34, 30).split()], 12),
             prose(35, 14) + " a2\n\n" + lines(w, 7) + "\n\nb2 " + prose(36, 15), prose(37, 32) + " a3 " + PASSAGE + " b3 " + prose(38, 5)]
    got = by_id(passages.document_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert got[0].n_spans == 0
    for i, at in ((1, 29), (2, 15), (3, 33)):
        (s, e), = got[i].spans
        assert 0 in got[i].kept_in and at - 10 <= s <= at + 9 and at + 51 <= e <= at + 70


def test_a_passage_goes_to_its_last_word(spark):
    """Spans are the exact ranges of what repeats: 51 and 300 words in a line, and a text which repeats itself."""
    whole = prose(51, 300)
    half = " ".join(whole.split()[100:151])
    loop = " ".join(prose(52, 7).split() * 6)
    texts = [prose(53, 20) + " a0 " + whole + " b0 " + prose(54, 20)]
    texts += [f"{prose(60 + k, 20)} a{k} {half} b{k} {prose(80 + k, 20)}" for k in range(1, 9)]
    texts += ["c1 " + whole + " c2 " + prose(55, 140), "d1 " + loop + " d2"]
    got = by_id(passages.document_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert got[0].n_spans == 0
    for k in range(1, 9):
        assert got[k].spans == [[21, 72]] and got[k].kept_in == [0] and got[k].removed_words == 51
    assert got[9].spans == [[1, 301]] and got[9].kept_in == [0]
    assert got[10].spans == [[8, 43]] and got[10].kept_in == [10]


def test_passages_give_up_what_they_wrote_on_the_way(docs, spark):
    """Once the runs of repeated words are known, nothing keeps the table of all units on disk."""
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.rglob("*.parquet"))
    assert sum(r.n_spans for r in passages.document_passages(docs).collect()) > 0
    left = [pq.read_schema(f).names for f in set(shared.rglob("*.parquet")) - before]
    assert not [x for x in left if "h" in x or "keys" in x or "w" in x]
    assert [x for x in left if "clusters" in x]


def test_near_copies_in_short_lines(spark):
    """Hard-wrapped paragraphs are compared as paragraphs, however they are wrapped."""
    w = prose(41, 120).split()
    edited = [f"other{k}" if k % 40 == 20 else x for k, x in enumerate(w)]
    texts = ["\n".join(" ".join(x[k:k + n]) for k in range(0, 120, n)) for x, n in ((w, 12), (edited, 10))]
    got = by_id(passages.document_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert got[0].n_spans == 0 and got[1].spans == [[0, 120]] and got[1].kept_in == [0]


def test_every_repeat_of_twenty_words_has_a_seed():
    r = random.Random(5)
    for n in (20, 21, 35):
        w = prose(r.random(), n).split()
        seen = []
        for before, after in ((r.randint(0, 40), r.randint(0, 40)) for _ in range(30)):
            t = pa.array([prose(r.random(), 30), " ".join([*prose(r.random(), before + 1).split(), *w, *prose(r.random(), after + 1).split()])])
            u = pa.Table.from_batches(passages._units([pa.RecordBatch.from_arrays([pa.array([0, 1]), t], ["i", "t"])])).to_pylist()
            seen.append({x["h"] for x in u if x["kind"] == 1 and x["i"] == 1 and before + 1 <= x["at"] <= before + 1 + n - passages.SEED})
        assert set.intersection(*seen)


def test_crowded_buckets_in_blocks(spark, monkeypatch):
    """Sets around a few centres, all in one bucket: blocks of a few sets find what brute force finds."""
    monkeypatch.setattr(near, "BLOCK_SETS", 7)
    r = random.Random(4)
    centres = [r.sample(range(1000), 30) for _ in range(3)]
    sets = {i: sorted({*r.sample(centres[i % 3], r.choice([18, 24, 27, 29])), *r.sample(range(2000, 9000), r.randint(0, 3))})
            for i in range(60)}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            both = len(set(sets[a]) & set(sets[b]))
            if a < b and both * 100 >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rows = spark.createDataFrame([(i, len(v), [1, 2 + i % 3], v) for i, v in sets.items()],
                                 "id long, n long, keys array<long>, items array<long>")
    for crowd in (None, 3):
        found = near.links(rows.drop("items"), 1, lambda ids: rows.select("id", "items").join(ids, "id"), crowd=crowd)
        got = {r.id: r.component for r in found.collect()}
        assert {i: got.get(i, i) for i in sets} == {i: find(i) for i in sets}
    assert len({find(i) for i in sets}) > 3


def test_packing(docs, none):
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in packing.packed_documents(docs).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in TEXTS:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        n = sum(r.length for r in rows)
        assert n == 1024 or n & (n - 1) == 0
        assert sorted(r.offset for r in rows) == np.cumsum([0, *[r.length for r in sorted(rows, key=lambda r: r.offset)]])[:-1].tolist()
    assert packing.packed_documents(none).collect() == []


def test_a_packer_keeps_all_three_limits():
    r = random.Random(5)
    packer = packing.Packer(tokens=64, segments=4, loss=40, pool=16)
    examples = [(k, np.arange(r.randint(1, 200)), r.randint(0, 60)) for k in range(300)]
    made = [s for e in examples for s in packer.add(e)] + list(packer.finish())
    held = collections.defaultdict(int)
    for s in made:
        assert len(s) <= 4 and sum(n for _, _, n in s) <= 64 and sum(packer._loss(*p) for p in s) <= 40
        for e, _, n in s:
            held[e[0]] += n
    assert held == {k: len(x) for k, x, _ in examples}


def test_huffman_codes():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 0, 377])
    for most in (4, 6, 18):
        n = huffman.code_lengths(counts, most)
        assert n.max() <= most and (n > 0).tolist() == (counts > 0).tolist() and sum(2.0 ** -x for x in n if x) == 1
    assert huffman.code_lengths(np.array([0, 7])).tolist() == [0, 1]
    r = np.random.RandomState(1)
    ids, sizes = r.randint(0, 3000, 5000) ** 2 // 3000, np.array([0, 1, 2999, 0, 2000])
    lengths = huffman.code_lengths(np.bincount(ids))
    bits, marks = huffman.to_bits(ids, sizes, huffman.canonical(lengths), lengths)
    first = np.cumsum([0, *[len(b) for b in bits]])
    marks = np.concatenate([m + 8 * f for m, f in zip(marks, first)])
    assert (huffman.from_bits(b"".join(bits), sizes, marks, huffman.look_up(lengths)) == ids).all()


def test_id_files(docs, none):
    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tk.encode_special_tokens = True
    got, start = by_id(huffman.coded_documents(docs)), 0
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0])):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), i
        start += len(ids)
    assert huffman.coded_documents(none).collect() == []


def test_byte_bpe(docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.round_trip(docs))
    for i, t in TEXTS:
        ids = np.array(own.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest()), i
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.round_trip(none).collect() == []


def test_katz_against_dictionaries(docs, none):
    got = by_id(katz.document_scores(docs))
    end, uni, pair = object(), collections.Counter(), collections.Counter()
    tokens = {i: [*split((t or "").translate({c: c + 32 for c in range(65, 91)})), end] for i, t in TEXTS}
    for i, w in tokens.items():
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            uni.update(w)
            named = [None, *w]
            pair.update(zip(named[:-1], named[1:]))
    total, distinct = sum(uni.values()), len(uni)
    of = np.bincount(list(uni.values()), minlength=8)[1:7]
    known = katz.Words(total, distinct, of, np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)
    def p1(w):
        return uni[w] * known.of(np.array([uni[w]]))[0] * known.scale / total
    prob = {w: p1(w) for w in uni}
    follow, hist = pair, collections.Counter()
    for (h, _), c in pair.items():
        hist[h] += c
    d = dict(enumerate(katz.discounts(np.bincount(list(follow.values()), minlength=8)[1:7]), 1))
    seen = collections.defaultdict(dict)
    for (h, w), c in follow.items():
        seen[h][w] = d.get(c, 1) * c / (hist[h] + 1)
    def p2(h, w):
        if w in seen[h]:
            return seen[h][w]
        return (1 - sum(seen[h].values())) / (1 - sum(prob[x] for x in seen[h])) * prob.get(w, known.unknown * (1 - katz.SILENT))
    for h in list(hist)[:40]:
        back = (1 - sum(seen[h].values())) / (1 - sum(prob[x] for x in seen[h]))
        assert sum(p2(h, w) for w in prob) + back * known.unknown == pytest.approx(1)
    for i, w in tokens.items():
        base = sum(math.log10((uni[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        full = sum(math.log10(p2(h, x)) for h, x in zip([None, *w], w))
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(uni[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(full), i
    assert katz.document_scores(none).collect() == []


def test_katz_pairs_of_rare_words_are_their_own(spark, monkeypatch):
    """Whatever words have numbers, the scores are the same, and a pair of rare words is known as a pair."""
    r = random.Random(5)
    often = [prose(k, 1) for k in range(40)]
    rows = [(i, " ".join([r.choice(often) for _ in range(60)] + ["left right", "hapax%d" % i] + [r.choice(often) for _ in range(9)]))
            for i in range(40)] + [(100, "left right"), (101, "right left"), (102, "never seen right"), (103, None)]
    data = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = by_id(katz.document_scores(data))
    assert plain[100].score > plain[101].score + 1
    for share in (0.5, 0.01):
        monkeypatch.setattr(katz, "SHARE", share)
        for i, x in by_id(katz.document_scores(data)).items():
            assert (x.n_tokens, x.n_known, x.train_tokens) == (plain[i].n_tokens, plain[i].n_known, plain[i].train_tokens)
            assert x.base_score == pytest.approx(plain[i].base_score) and x.score == pytest.approx(plain[i].score), i


def test_byte_level_pieces_are_encoded_without_marks(monkeypatch):
    r = random.Random(8)
    odd = ["".join(r.choice("abTé's 19.,\n\t\u00a0\u3000\u0301日\x01\x1f  ") for _ in range(40)) for _ in range(300)]
    texts = [t for _, t in TEXTS] + [prose(20, 900), " a  b ", "x" * 2000, "<|endoftext|> Ġa"] + odd
    encoder = tokens.Encoder(P.path("byte_bpe_50k.json"), True)
    given, library = [], encoder.tokenizer

    class Watched:
        def encode_batch_fast(self, batch, **more):
            given.extend(batch)
            return library.encode_batch_fast(batch, **more)

    encoder.tokenizer = Watched()
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == np.array(library.encode(t or "", add_special_tokens=False).ids, encoder.dtype).tobytes(), t
    assert sum(t.count(tokens.MARK) for t in given) <= sum((t or "").count(tokens.MARK) for t in texts)


def test_languages(spark, docs, none):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.document_languages(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    one = by_id(language.document_languages(docs))
    assert [one[i].lang_pred for i in (0, 3, 4, 5, 11)] == ["en", "und", "und", "und", "en"] and one[3].score == 0
    assert language.document_languages(none).collect() == []


def test_toxicity(spark, docs, none):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.document_toxicity(spark, real, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9
    assert not any(r.predicted for r in got if r.toxic == 0)
    few = spark.createDataFrame([(0, None, 9), (None, 1, 9), (1, 0, 9)], "doc_id long, toxic int, text int")
    one = by_id(toxicity.document_toxicity(spark, docs, few))
    assert len(one) == len(TEXTS) and all(0 <= r.score <= 1 for r in one.values()) and one[3].score == one[4].score
    assert toxicity.document_toxicity(spark, none, few).collect() == []


def test_line_rules(spark, none):
    good = "\n".join(prose(k, 30) + "." for k in range(4))
    rows = [(0, good), (1, None), (2, ""), (3, good + "\nHome | Login | Menu\nAll rights reserved.\nno end to this line here"),
            (4, "a b c " * 40), (5, good.upper().replace(".", "!!")), (6, "# " * 60 + good)]
    got = by_id(cleaning.measured(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].kept for i in range(7)] == [True, False, False, True, False, False, True]
    assert got[3].clean_text == good and got[3].n_failed_lines == 3 and got[4].n_repeat_words == 120 and got[2].n_words == 0
    assert cleaning.line_quality(none).collect() == []


def test_short_repeats_which_touch_are_no_passage(spark):
    """150 texts, each made of parts of 13 words which stand in different earlier texts."""
    parts = [prose(500 + k, 13) for k in range(40)]
    rows = [(k, prose(700 + k, 30) + " " + p + " " + prose(800 + k, 30)) for k, p in enumerate(parts)]
    rows += [(100 + k, f"{prose(900 + k, 25)} {parts[k % 40]} {parts[(7 * k + 3) % 40]} {prose(1100 + k, 25)}") for k in range(150)]
    got = by_id(passages.document_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    places = collections.defaultdict(list)
    words_of = {i: t.split() for i, t in rows}
    for i, w in sorted(words_of.items()):
        for at in range(len(w) - 19):
            places[tuple(w[at:at + 20])].append((i, at))
    again = collections.defaultdict(set)
    for found in places.values():
        for i, at in found[1:]:
            again[i].update(range(at, at + 20))
    for i, _ in rows:
        assert {k for s, e in got[i].spans for k in range(s, e)} <= again[i], i


def test_a_very_long_text_and_repeated_ids_in_passages(spark):
    long = prose(31, 400_000)
    rows = [(1, long), (2, prose(32, 40) + " " + " ".join(long.split()[1000:1080]) + " " + prose(33, 40)), (3, PASSAGE), (3, PASSAGE), (3, PASSAGE)]
    got = passages.document_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {r.doc_id: r.spans for r in got}
    assert len(got) == 5 and [list(s) for s in spans[2]] == [[40, 120]] and spans[1] == []


def test_crowds_of_copies_below_and_above_the_threshold(spark, monkeypatch):
    """Edited copies of one text, of which some are just alike enough: crowded buckets, in several blocks."""
    monkeypatch.setattr(minhash, "CROWD", 8)
    monkeypatch.setattr(near, "BLOCK_SETS", 16)
    r, base = random.Random(5), BASE.split()
    rows = []
    for k in range(90):
        w = list(base)
        for at in r.sample(range(len(w)), r.choice([1, 3, 5, 6, 7])):
            w[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(w)))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: got[i].component_id for i in sets} == {i: find(i) for i in sets}
    assert len({find(i) for i in sets}) > 10
