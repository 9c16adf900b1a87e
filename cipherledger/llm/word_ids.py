"""Ids of texts through the tokenizers library, each word handed to it once.

Plain texts (ASCII and Latin-1 letters, nothing that could be a special token) are cut to the
tokenizer's words on arrays: character classes, contractions and 64-bit hashes of all words of
a lot of texts at once. A table of hashes has the ids of the words seen; new words go to the
library's model. What the library's first steps make of plain characters, and that they find
the same words, is asked when it is loaded. Other texts are cut at ASCII white space, and
chunks go to the library whole. That gives the ids of the whole text for a tokenizer whose
words never contain white space (``cuts=True``); for any other one ``cuts=False`` hands over
whole texts.

The chance that two of a million words share their hash is 3e-8.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

LATIN = "a-zß-öø-ÿ"
PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ÿ]*")
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\\s0-9{LATIN}]+")
SPACES = re.compile("[ \\t\\n\\r\\x0b\\x0c]+")
SPACE, LETTER, DIGIT, SIGN = range(4)
#: Characters cut at once; words hashed by place; slots and words of the table.
LOT, LONG, SLOTS, MOST = 1 << 18, 64, 1 << 20, 300_000
SHIFT = 64 - (SLOTS.bit_length() - 1)


@lru_cache
def classes() -> np.ndarray:
    text = "".join(map(chr, range(256)))
    kind = np.full(256, SIGN, np.uint8)
    kind[[m.start() for m in re.finditer(f"[{LATIN}]", text)]] = LETTER
    kind[ord("0"):ord("9") + 1] = DIGIT
    kind[[ord(c) for c in " \t\n\r"]] = SPACE
    return kind


@lru_cache
def factors() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the words of a lower-case plain text in Latin-1."""
    kind = classes()[text]
    before = np.r_[np.uint8(SPACE), kind[:-1]]
    first = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
    # contractions: an apostrophe that no sign precedes, and one or two letters
    mark = np.flatnonzero((text == ord("'")) & (before != SIGN))
    if len(mark):
        ends = np.r_[text, np.zeros(3, np.uint8)]
        one, two = ends[mark + 1], ends[mark + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for at, n in ((mark[short], 2), (mark[long], 3)):
            first[at + 1] = False
            rest = at + n
            rest = rest[rest < len(text)]
            first[rest[kind[rest] == LETTER]] = True
    after = np.r_[first[1:], True] | np.r_[kind[1:] == SPACE, True]
    return np.flatnonzero(first), np.flatnonzero((kind != SPACE) & after) + 1


def hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of every word, by its letters and their places."""
    import xxhash
    size = end - start
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    letters = text[np.repeat(start, size) + at].astype(np.uint64) + np.uint64(1)
    out = np.add.reduceat(letters * factors()[np.minimum(at, LONG - 1)], np.cumsum(size) - size)
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(text[start[k]:end[k]].tobytes())
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.maximum(out, np.uint64(1))


class Table:
    """Ids by the hash of a word: slots hold hashes and the words' numbers."""

    def __init__(self):
        self.hash, self.number = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.ids, self.first = array("I"), array("q", [0])

    def __len__(self) -> int:
        return len(self.first) - 1

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Numbers of hashes; -1 for those that are not there."""
        out, left = np.full(len(wanted), -1, np.int64), np.arange(len(wanted))
        slot = (wanted >> np.uint64(SHIFT)).astype(np.int64)
        while len(left):
            here = self.hash[slot]
            same = here == wanted[left]
            out[left[same]] = self.number[slot[same]]
            on = ~same & (here != 0)
            left, slot = left[on], (slot[on] + 1) % SLOTS
        return out

    def put(self, key: int, ids: list[int]) -> None:
        slot = key >> SHIFT
        while self.hash[slot]:
            slot = (slot + 1) % SLOTS
        self.hash[slot], self.number[slot] = key, len(self)
        self.ids.extend(ids)
        self.first.append(len(self.ids))

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words one after the other, and how many each has."""
        first = np.frombuffer(self.first, np.int64)
        count = first[numbers + 1] - first[numbers]
        at = np.arange(int(count.sum())) + np.repeat(first[numbers] - (np.cumsum(count) - count), count)
        return np.frombuffer(self.ids, np.uint32)[at], count


class Encoder:
    """Ids of texts as arrays of 32-bit numbers, with the end id."""

    def __init__(self, tokenizer_json: str, end: int, cuts: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer
        self.library, self.end, self.cuts = Tokenizer.from_str(tokenizer_json), np.array([end], np.uint32), cuts
        self.table = Table()
        plain = [c for c in map(chr, range(256)) if PLAIN.fullmatch(c) and not c.isspace()] if cuts else []
        self.as_model = {ord(c): self._first_steps(c)[0][0] for c in plain}
        sample = ("".join(plain) + " I'll don't WE'VE 's7 \"'re\n".join(plain)).replace("<|", "")
        self.direct = cuts and [w for w, _ in self._first_steps(sample)] == [w.translate(self.as_model) for w in WORDS.findall(sample.lower())]

    def _first_steps(self, text: str) -> list:
        return self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def is_plain(self, text: str) -> bool:
        return self.direct and "<|" not in text and PLAIN.fullmatch(text) is not None

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts, all at once."""
        if len(self.table) > MOST:
            self.table = Table()
        joined = np.frombuffer("\n".join(texts).lower().encode("latin-1"), np.uint8)
        start, end = words(joined)
        if not len(start):
            return [np.zeros(0, np.uint32)] * len(texts)
        keys = hashes(joined, start, end)
        numbers = self.table.find(keys)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            different, at = np.unique(keys[new], return_index=True)
            for key, k in zip(different.tolist(), new[at].tolist()):
                word = joined[start[k]:end[k]].tobytes().decode("latin-1").translate(self.as_model)
                self.table.put(key, [t.id for t in self.library.model.tokenize(word)])
            numbers[new] = self.table.find(keys[new])
        ids, count = self.table.ids_of(numbers)
        stops = np.cumsum([len(t) + 1 for t in texts])
        ends = np.r_[0, np.cumsum(count)][np.searchsorted(start, stops)]
        return np.split(ids, ends[:-1])

    def _mixed(self, text: str) -> np.ndarray:
        """Ids of a text that is not plain, chunk by chunk; runs of plain ones together."""
        out, held = [], []
        for chunk in SPACES.split(text):
            if self.is_plain(chunk):
                held.append(chunk)
            else:
                out += [*self._plain([" ".join(held)]), self._whole(chunk)] if held else [self._whole(chunk)]
                held = []
        return np.concatenate([*out, *(self._plain([" ".join(held)]) if held else [])])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        lot, size = [], 0
        for k, text in enumerate(texts):
            if not text:
                out[k] = self.end
            elif not self.cuts:
                out[k] = np.r_[self._whole(text), self.end]
            elif not self.is_plain(text):
                out[k] = np.r_[self._mixed(text), self.end]
            elif len(text) > LOT:
                out[k] = np.concatenate([*(self._plain([part])[0] for part in pieces(text)), self.end])
            else:
                lot.append(k)
                size += len(text)
            if lot and (size > LOT or k == len(texts) - 1):
                for i, ids in zip(lot, self._plain([texts[i] for i in lot])):
                    out[i] = np.r_[ids, self.end]
                lot, size = [], 0
        return out


def pieces(text: str) -> list[str]:
    """A long text cut at spaces into pieces of about a lot."""
    out, at = [], 0
    while len(text) - at > LOT:
        cut = text.find(" ", at + LOT)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]
