"""Encoding and decoding with merge-type piece vocabularies.

Adjacent symbols wait as pairs in an agenda ordered by the score of the piece they would
form; the best pair is merged until no pair forms a piece. Merges cross neither the start of
a run of whitespace marks nor a character that is in no piece, so texts are cut there, and
each cut is encoded once per worker. Short cuts are merged together, one agenda per row of a
matrix; long cuts have a heap each. New cuts of each Arrow batch are checked against the
sentencepiece library.

Null texts count as empty and give no ids. Repeated rows are kept, other columns pass
through unchanged unless they carry an output name, in which case the output replaces them.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Bounds of the memory a worker spends on remembered cuts, and of the rows merged together.
CACHE_ENTRIES, MATRIX_CHARS, MATRIX_ROWS = 200_000, 32, 8_192
SLICE_BYTES, CHECKED = 2_000_000, 256
NEVER = np.iinfo(np.int32).max


class MergeVocabulary:
    """Pieces and scores of a merge-type vocabulary with an identity normaliser."""

    def __init__(self, proto: bytes):
        import sentencepiece
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        if sp.normalize(" ｗ  b ") != f"{MARK}{MARK}ｗ{MARK}{MARK}b{MARK}":
            raise ValueError("only vocabularies with an identity normaliser and a leading mark are supported")
        if any(sp.is_unused(i) for i in range(sp.get_piece_size())):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.texts: list[str] = []
        self.byte_ids: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        controls: list[int] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.texts.append(piece.replace(MARK, " "))
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.byte_of[i] = int(piece[1:-1], 16)
            elif sp.is_control(i):
                self.texts[i] = ""
                controls.append(i)
            elif sp.is_unknown(i):
                self.texts[i] = sp.decode([i])
            else:
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
        self.unknown = sp.unk_id()
        alphabet = sorted(set().union(*self.ids))
        inside = "".join(map(re.escape, (c for c in alphabet if c != MARK)))
        marked_inside = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cutter = re.compile(f"[{inside}{MARK}]+|(?s:.)" if marked_inside else f"{MARK}*[{inside}]+|{MARK}+|(?s:.)")
        self.before = next(c for c in map(chr, range(0x110000)) if c not in alphabet and c != " ")
        self.before_ids = len(sp.encode(self.before))
        self._pairs(alphabet)
        self.is_byte = np.zeros(len(self.texts), bool)
        self.is_byte[list(self.byte_of)] = True
        self.marked = np.array([t.startswith(" ") for t in self.texts]) & ~self.is_byte
        self.marked[self.unknown] = False
        self.control = np.zeros(len(self.texts), bool)
        self.control[controls] = True
        self.known: dict[str, bytes] = {}

    def _pairs(self, alphabet: list[str]) -> None:
        """The pairs of symbols that form pieces, sorted, with the piece and its rank."""
        names = list(dict.fromkeys([*self.ids, *alphabet]))
        number = {p: k for k, p in enumerate(names)}
        self.symbol_ids = np.array([self.ids.get(p, -1) for p in names], np.int32)
        self.symbol_of_char = np.full(0x110000, -1, np.int32)
        for c in alphabet:
            self.symbol_of_char[ord(c)] = number[c]
        ranks = {s: k for k, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        rows = sorted((number[p[:k]] * len(names) + number[p[k:]], number[p], ranks[self.scores[p]])
                      for p in self.ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.n_symbols = len(names)
        self.pair_keys, self.pair_symbols, self.pair_ranks = (np.array(c, t) for c, t in zip(zip(*rows), (np.int64, np.int32, np.int32)))

    def _offers(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; NEVER where it forms none."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.n_symbols + right)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == key
        return np.where(found, self.pair_ranks[at], NEVER), self.pair_symbols[at]

    def merge_rows(self, cuts: list[str]) -> dict[str, bytes]:
        """Ids of many short cuts after all merges: in each row the pair of the best rank,
        the leftmost of equals, is merged in every round. Cuts with a symbol that is no
        piece are left out."""
        lengths = np.array([len(c) for c in cuts])
        chars = np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32)
        rows, width = np.repeat(np.arange(len(cuts)), lengths), int(lengths.max())
        cols = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbols = np.full((len(cuts), width + 1), -1, np.int32)
        symbols[rows, cols] = self.symbol_of_char[chars]
        ranks, pieces = self._offers(symbols[:, :-1], symbols[:, 1:])
        live, done, column = np.arange(len(cuts)), symbols.copy(), np.arange(width + 1)
        while True:
            best = ranks.argmin(axis=1)
            going = ranks[np.arange(len(best)), best] != NEVER
            if not going.all():
                done[live[~going]] = symbols[~going]
                live, symbols, ranks, pieces, best = live[going], symbols[going], ranks[going], pieces[going], best[going]
            if not len(live):
                break
            each = np.arange(len(live))
            merged = pieces[each, best]
            after = column[:-1] > best[:, None]
            symbols[:, :-1] = np.where(after, symbols[:, 1:], symbols[:, :-1])
            symbols[each, best] = merged
            ranks[:, :-1] = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            pieces[:, :-1] = np.where(after[:, :-1], pieces[:, 1:], pieces[:, :-1])
            symbols[:, -1], ranks[:, -1] = -1, NEVER
            ranks[each, best], pieces[each, best] = self._offers(merged, symbols[each, best + 1])
            some = best > 0
            left = best[some] - 1
            ranks[each[some], left], pieces[each[some], left] = self._offers(symbols[each[some], left], merged[some])
        used = done >= 0
        ids, ends = self.symbol_ids[done[used]], np.cumsum(used.sum(axis=1))
        known = np.minimum.reduceat(ids, np.r_[0, ends[:-1]]) >= 0
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return {c: raw[s:e] for c, s, e, ok in zip(cuts, [0, *ends], ends, known.tolist()) if ok}

    def merge(self, cut: str) -> list[str]:
        """Symbols of a cut after all merges. Equal scores go from left to right."""
        symbols, n = list(cut), len(cut)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, int]] = []
        scores = self.scores

        def offer(left: int, right: int) -> None:
            piece = symbols[left] + symbols[right]
            score = scores.get(piece)
            if score is not None:
                heapq.heappush(agenda, (-score, left, right, len(piece)))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one side has been merged meanwhile
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
                offer(left, after[right])
            if before[left] >= 0:
                offer(before[left], left)
        return [s for s in symbols if s]

    def encode_cut(self, cut: str) -> list[int]:
        out: list[int] = []
        for symbol in self.merge(cut):
            i = self.ids.get(symbol)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in symbol.encode()]
            else:
                out.append(self.unknown)
        return out

    def cuts(self, text: str) -> list[str]:
        return self.cutter.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode_batch(self, texts: list[str], check: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of each text."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        parts = [self.cuts(t) for t in texts]
        coded = [list(map(self.known.get, p)) for p in parts]
        fresh = self.encode_cuts(list({c for p, k in zip(parts, coded) if None in k for c, b in zip(p, k) if b is None}))
        if check:
            self.check(fresh)
        self.known.update((c, b) for c, b in fresh.items() if len(c) <= MATRIX_CHARS)
        coded = [b"".join([fresh[c] if b is None else b for c, b in zip(p, k)] if None in k else k) for p, k in zip(parts, coded)]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(b) // 4 for b in coded], out=offsets[1:])
        return np.frombuffer(b"".join(coded), np.int32), offsets

    def encode_cuts(self, cuts: list[str]) -> dict[str, bytes]:
        cuts.sort(key=len)
        out: dict[str, bytes] = {}
        short = [c for c in cuts if 1 < len(c) <= MATRIX_CHARS]
        for i in range(0, len(short), MATRIX_ROWS):
            out |= self.merge_rows(short[i:i + MATRIX_ROWS])
        out.update((c, np.array(self.encode_cut(c), np.int32).tobytes()) for c in cuts if c not in out)
        return out

    def check(self, fresh: dict[str, bytes]) -> None:
        """Raise where the library encodes a cut differently. A character that is in no
        piece stands before each cut, so that no mark is added to it."""
        if not fresh:
            return
        joined = [self.before + c.replace(MARK, " ") for c in fresh]
        theirs = self.library.encode(["".join(joined[i:i + CHECKED]) for i in range(0, len(joined), CHECKED)], num_threads=1)
        lead, apart = self.library.encode(self.before), np.array(self.library.encode(self.before * 2)[self.before_ids:], np.int32).tobytes()
        lead = np.array(lead[:len(lead) - len(apart) // 4], np.int32).tobytes()
        ours = list(fresh.values())
        for i, ids in enumerate(theirs):
            if np.array(ids, np.int32).tobytes() != lead + b"".join([apart + b for b in ours[i * CHECKED:(i + 1) * CHECKED]]):
                raise ValueError("the library encodes a part of these texts differently")

    def decode(self, ids: np.ndarray) -> str:
        """Text of a list of ids: runs of byte pieces are read as UTF-8, and the leading
        mark that encoding adds goes."""
        if not self.is_byte[ids].any():
            text = "".join([self.texts[i] for i in ids.tolist()])
        else:
            out, run = [], bytearray()
            for i in ids.tolist():
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(decode_bytes(run))
                    run.clear()
                out.append(self.texts[i])
            out.append(decode_bytes(run))
            text = "".join(out)
        shown = ids[~self.control[ids]][:1]
        return text[1:] if len(shown) and self.marked[shown[0]] else text


def decode_bytes(run: bytearray) -> str:
    """UTF-8 with one replacement character for each byte that fits nowhere."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (4, 3, 2, 1):
                try:
                    char = bytes(run[i:i + n]).decode()
                except UnicodeDecodeError:
                    continue
                if len(char) == 1:
                    out.append(char)
                    i += n
                    break
            else:
                out.append("�")
                i += 1
        return "".join(out)


def model_bytes(path: str) -> bytes:
    """The vocabulary file, read where the driver runs; tasks get its content."""
    with open(path, "rb") as f:
        return f.read()


_LOADED: dict[bytes, MergeVocabulary] = {}


def loaded(proto: bytes) -> MergeVocabulary:
    """One vocabulary per worker process."""
    if proto not in _LOADED:
        _LOADED.clear()
        _LOADED[proto] = MergeVocabulary(proto)
    return _LOADED[proto]


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([*[f for f in schema if f.name not in names], *fields])


def _coded(df: DataFrame, model_path: str, text: str, ids: str, decoded: str | None, check: bool) -> DataFrame:
    proto = model_bytes(model_path)
    new = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else [])
    out = _with(df.schema, *new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(proto)
        for b in sliced(batches, text):
            flat, offsets = vocabulary.encode_batch([t or "" for t in b.column(text).to_pylist()], check)
            columns = {ids: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))}
            if decoded:
                columns[decoded] = pa.array([vocabulary.decode(flat[s:e]) for s, e in zip(offsets[:-1], offsets[1:])], pa.string())
            yield _replace(b, out, columns)

    return df.mapInArrow(run, out)


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", check: bool = True) -> DataFrame:
    """Add the ids of each whole text, without begin or end ids."""
    return _coded(df, model_path, text, ids, None, check)


def encode_and_decode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", check: bool = True) -> DataFrame:
    """Add the ids and the text decoded from them, in one pass through one Python worker."""
    return _coded(df, model_path, text, ids, decoded, check)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each list of ids; null lists give empty texts."""
    proto, out = model_bytes(model_path), _with(df.schema, T.StructField(text, T.StringType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(proto)
        for b in batches:
            lists = b.column(ids)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lists.value_lengths().fill_null(0))]
            yield _replace(b, out, {text: pa.array([vocabulary.decode(flat[s:e]) for s, e in zip(offsets[:-1], offsets[1:])], pa.string())})

    return df.mapInArrow(run, out)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches where the bytes of a text column reach a bound, so that a worker's memory
    follows that bound and the longest text."""
    for b in batches:
        part = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)) // most
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][:len(part)]).tolist()
        for s, e in zip(starts, [*starts[1:], b.num_rows]):
            yield b.slice(s, e - s)


def _replace(batch: pa.RecordBatch, schema: T.StructType, new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in schema.names], names=schema.names)


def digests(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Ids and decoded text of each document, as counts and digests."""
    coded = encode_and_decode(docs.select(key, text), model_path, text)
    return coded.select(key, F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
