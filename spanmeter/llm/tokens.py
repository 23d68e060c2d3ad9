"""Ids of whole texts by a public tokenizer, encoding each distinct piece of a worker's texts once.

A text is cut at spaces where the tokenizer's own pre-tokenisation always cuts, so the ids of the
pieces in a row are the ids of the text. The pieces which a worker has not met are encoded by the
library many at a time: where each begins with its space they follow each other as in a text, and the
bytes that the ids stand for say where one ends; else a mark stands between them. Where the tokenizer's pattern is known,
pieces of Latin letters, digits and punctuation are cut by it here, and the library's model gets each different
word once, in the form which the model reads. Known pieces have numbers and their ids lie in one array, so that a text is
a row of numbers, each different one looked up once per batch, and its ids are taken from the array at once. They are kept in two generations of
bounded size: when the younger one is full the older one is forgotten, but for what has been met since. A worker that
waits for work forgets all.
"""

from __future__ import annotations

import json
import re
import threading
import time
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, normalizers, pre_tokenizers

# Unicode white space, the characters with the property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_DOUBTFUL = re.compile(f" (?<=[{WHITE}] )")     # begins with a fixed character, so that the search skips to it
_SURE = re.compile(f"(?<=[^{WHITE}]) ")
MARK = "\x01"
# Characters which are their own NFC in any row, have one lower-case character each, and are of the same
# kind in every Unicode version; the last one of a piece is no white space.
_PLAIN = re.compile("[!-~\t\n\r\xa1-\u012f\u0131-\u017f\u2013\u2014\u2018-\u201f\u2026]*"
                    "[!-~\xa1-\u012f\u0131-\u017f\u2013\u2014\u2018-\u201f\u2026]")
_BETWEEN = "\x02"             # pieces; no plain one has it
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
# Fixed value: the pattern of byte-level pre-tokenisation, as its library documents it.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 800_000         # pieces of a generation
REMEMBERED_CHARS = 32_000_000
REMEMBERED_WORDS = 300_000
AT_ONCE = 128                # pieces in one text for the library
TAKEN = 1 << 18              # pieces whose ids are taken at once
IDLE_SECONDS = 4.0

_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _byte_characters() -> str:
    """The character which stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


_BYTES = _byte_characters()


def _own_pattern(path: str) -> str | None:
    """The pattern by which a tokenizer cuts a text, or for one that normalises what it has put into NFC and lower case;
    None for other kinds."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if found["model"]["type"] != "BPE" or found["post_processor"]:
        return None
    first = found["pre_tokenizer"] or {}
    if not found["normalizer"] and first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]:
        return _BYTE_LEVEL
    steps = (found["pre_tokenizer"] or {}).get("pretokenizers") or []
    if ((found["normalizer"] or {}).get("normalizers") == _NORMAL
            and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and "Regex" in steps[0]["pattern"]
            and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]):
        return steps[0]["pattern"]["Regex"]
    return None


def _forgetting() -> None:
    """Lets go of what the encoders know once none has been used for a while."""
    while True:
        time.sleep(IDLE_SECONDS / 4)
        for e in list(_ENCODERS.values()):
            with e.lock:
                if e.known and time.monotonic() - e.used > IDLE_SECONDS:
                    e.forget()
                    pa.default_memory_pool().release_unused()


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x with at least n places, those added empty."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


def _parted(keys: list[str], at: np.ndarray, chosen: list) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """The chosen keys and their numbers, then the others and theirs."""
    some = np.array([bool(c) for c in chosen], bool)
    return (list(compress(keys, chosen)), at[some], [k for k, c in zip(keys, chosen, strict=True) if not c], at[~some])


class _Known:
    """Ids of keys, found by the keys' numbers."""

    def __init__(self, dtype: np.dtype):
        self.number: dict[str, int] = {}
        self.ids, self.end = np.zeros(1 << 10, dtype), 0
        self.starts, self.sizes = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)

    def __len__(self) -> int:
        return len(self.number)

    def numbers_of(self, keys: pa.Array) -> tuple[np.ndarray, list[str]]:
        """The number of each key, and the keys which were not known: they got the last numbers, in a row, and need ids."""
        found = keys.dictionary_encode()
        once = found.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.number.get, once, repeat(-1)), np.int64, len(once))
        fresh = np.flatnonzero(number < 0)
        new = once[fresh].tolist()
        number[fresh] = np.arange(len(new)) + len(self)
        self.number.update(zip(new, number[fresh].tolist(), strict=True))
        return number[found.indices.to_numpy()], new

    def keep(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """`ids` holds the ids of the keys with the numbers `at` one after another."""
        upto = np.cumsum(sizes)
        self.starts, self.sizes = _room(self.starts, len(self)), _room(self.sizes, len(self))
        self.ids = _room(self.ids, self.end + len(ids))
        self.starts[at], self.sizes[at] = self.end + upto - sizes, sizes
        self.ids[self.end:self.end + len(ids)] = ids
        self.end += len(ids)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the numbered keys one after another."""
        out = [self.ids[:0]]
        for k in range(0, len(numbers), TAKEN):
            part = numbers[k:k + TAKEN]
            n = self.sizes[part]
            upto = np.cumsum(n)
            out.append(self.ids[np.repeat(self.starts[part] - upto + n, n) + np.arange(upto[-1])])
        return np.concatenate(out)


class Encoder:
    """`spaced`: the tokenizer keeps a space with the word after it (byte-level BPE); otherwise it drops them."""

    def __init__(self, path: str, spaced: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True   # their strings in a text are ordinary text
        self.spaced = spaced
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.mark_ids = [] if spaced else self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.forget()
        self.lock, self.used = threading.Lock(), time.monotonic()
        # A character of a byte-level token is a byte.
        tokens = {i: t.removesuffix("</w>") for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.width = np.array([len(tokens.get(i, "")) for i in range(max(tokens) + 1)])
        own = _own_pattern(path)
        self.lowers = own is not None and own != _BYTE_LEVEL
        if spaced and self.lowers:                    # its spaces are no part of words
            own = None
        self.pattern = None
        if own is not None:
            # No row of signs goes over what stands between pieces.
            self.pattern = regex.compile(_BETWEEN + "|" + own.replace(r"[^\s\p{L}\p{N}]", rf"[^\s\p{{L}}\p{{N}}{_BETWEEN}]"))
            self.lead = " " if spaced else ""
            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True
            self.model.normalizer = normalizers.Sequence([])
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")

    @staticmethod
    def of(path: str, spaced: bool) -> Encoder:
        if (path, spaced) not in _ENCODERS:
            if not _ENCODERS:
                threading.Thread(target=_forgetting, daemon=True).start()
            _ENCODERS[path, spaced] = Encoder(path, spaced)
        return _ENCODERS[path, spaced]

    def forget(self) -> None:
        self.known, self.older, self.words, self.chars = _Known(self.dtype), _Known(self.dtype), self._no_words(), 0

    def _no_words(self) -> _Known:
        """What stands between pieces has number 0 and no ids."""
        words = _Known(self.dtype)
        words.numbers_of(pa.array([_BETWEEN]))
        words.keep(np.zeros(1, np.int64), words.ids[:0], np.zeros(1, np.int64))
        return words

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _learn(self, pieces: list[str], at: np.ndarray) -> None:
        self.chars += sum(map(len, pieces))
        if self.pattern is not None:
            plain, at_plain, pieces, at = _parted(pieces, at, list(map(_PLAIN.fullmatch, pieces)))
            if plain:
                self.known.keep(at_plain, *self._by_words(plain))
        if pieces:
            self._learn_texts(pieces, at)

    def _by_words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain pieces one after another and their sizes, from those of the words in them."""
        text = self.lead + (_BETWEEN + self.lead).join(pieces)
        cut = self.pattern.findall(text.lower() if self.lowers else text)
        cut.append(_BETWEEN)
        if len(self.words) > REMEMBERED_WORDS:
            self.words = self._no_words()
        words = self.words
        numbers, new = words.numbers_of(pa.array(cut, pa.large_string()))
        first = len(words) - len(new)
        form = _BETWEEN.join(new).encode().decode("latin-1").translate(_BYTES).split(_BYTES[2]) if new else []
        for at in range(0, len(new), AT_ONCE):
            group = form[at:at + AT_ONCE]
            e = self.model.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0]
            ids = np.array(e.ids, self.dtype)
            sizes = self._sizes(list(map(len, group)), ids)
            if sizes is None:
                raise RuntimeError("the ids do not stand for the words")
            words.keep(np.arange(len(group)) + first + at, ids, sizes)
        # The last word of a piece is what stands after it.
        ends = np.flatnonzero(numbers == 0)
        if len(ends) != len(pieces):
            raise RuntimeError("the pieces do not end where they are marked")
        return words.of(numbers), np.diff(np.cumsum(words.sizes[numbers])[ends], prepend=0)

    def _sizes(self, wide: list[int], ids: np.ndarray) -> np.ndarray | None:
        """How many ids stand for each of the things that are so many bytes wide; None if that can't be told."""
        to, have = np.cumsum(wide), np.cumsum(self.width[ids])
        ends = np.searchsorted(have, to) + 1
        if ends[-1] != len(ids) or (have[ends - 1] != to).any():
            return None
        return np.diff(ends, prepend=0)

    def _learn_direct(self, pieces: list[str], at: np.ndarray) -> None:
        found = self._direct([" " + p for p in pieces] if self.spaced else pieces)
        ids = np.frombuffer(b"".join(found), self.dtype)
        self.known.keep(at, ids, np.array(list(map(len, found)), np.int64) // self.dtype.itemsize)

    def _learn_texts(self, pieces: list[str], at: np.ndarray) -> None:
        if self.spaced:                               # white space at a piece's end would run on into the next one
            fit = [bool(p) and len(p) < 1000 and not p[-1].isspace() for p in pieces]
        else:
            fit = [MARK not in p and len(p) < 1000 for p in pieces]
        plain, at_plain, rest, at_rest = _parted(pieces, at, fit)
        groups = [plain[k:k + AT_ONCE] for k in range(0, len(plain), AT_ONCE)]
        texts = [" " + " ".join(g) if self.spaced else f" {MARK} ".join(g) for g in groups]
        for k in range(0, len(texts), 64):
            found = self.tokenizer.encode_batch_fast(texts[k:k + 64], add_special_tokens=False)
            for j, (group, text, e) in enumerate(zip(groups[k:k + 64], texts[k:k + 64], found, strict=True), k):
                ids = np.array(e.ids, self.dtype)
                if self.spaced:
                    wide = [len(p) + 1 for p in group] if text.isascii() else [len(p.encode()) + 1 for p in group]
                    sizes = self._sizes(wide, ids)
                else:
                    ids, sizes = self._by_marks(group, ids)
                mine = at_plain[j * AT_ONCE:j * AT_ONCE + len(group)]
                if sizes is None:
                    self._learn_direct(group, mine)
                else:
                    self.known.keep(mine, ids, sizes)
        if rest:
            self._learn_direct(rest, at_rest)

    def _by_marks(self, group: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """The ids without the marks, and how many stand for each piece; None if that can't be told."""
        wide = len(self.mark_ids)
        last = np.flatnonzero(ids == self.mark_ids[-1])
        if len(last) != len(group) - 1:
            return ids, None
        kept = np.ones(len(ids), bool)
        kept[(last[:, None] - np.arange(wide)).reshape(-1)] = False
        return ids[kept], np.diff(np.append(last + 1 - wide, len(ids)), prepend=0) - np.append([0], np.full(len(last), wide))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of the encoder's `dtype`; null: none."""
        with self.lock:
            try:
                found = self._encode(texts)
            except BaseException:
                self.forget()                         # some pieces may have numbers without ids
                raise
            self.used = time.monotonic()
        return found

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.known, self.older, self.chars = _Known(self.dtype), self.known, 0
        known = self.known
        flat, bounds = self._pieces(texts)
        heads = []
        if self.spaced:
            heads = flat.take(pa.array(bounds[:-1])).to_pylist()
            tail = np.ones(len(flat), bool)
            tail[bounds[:-1]] = False
            flat, bounds = flat.filter(pa.array(tail)), bounds - np.arange(len(bounds))
        numbers, new = known.numbers_of(flat)
        at = np.arange(len(known) - len(new), len(known))
        older = self.older.number
        if older:
            again, at_again, new, at = _parted(new, at, [p in older for p in new])
            there = np.array([older[p] for p in again], np.int64)
            known.keep(at_again, self.older.of(there), self.older.sizes[there])
            self.chars += sum(map(len, again))
        if new:
            self._learn(new, at)
        upto = np.append(0, np.cumsum(known.sizes[numbers])) * self.dtype.itemsize
        ends = upto[bounds].tolist()
        body = known.of(numbers).tobytes()
        tails = [body[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
        if not self.spaced:
            return tails
        return [h + t for h, t in zip(self._direct(heads), tails, strict=True)]

    def _pieces(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts and the n + 1 bounds of the texts' pieces."""
        cut = pc.split_pattern(pa.array([t or "" for t in texts], pa.large_string()), " ")
        doubtful = [k for k, t in enumerate(texts) if t and _DOUBTFUL.search(t)] if self.spaced else []
        if doubtful:
            at = np.arange(len(texts))
            at[doubtful] = len(texts) + np.arange(len(doubtful))
            cut = pa.concat_arrays([cut, pa.array([_SURE.split(texts[k]) for k in doubtful], cut.type)]).take(pa.array(at))
        return cut.flatten(), np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy(), dtype=np.int64))
