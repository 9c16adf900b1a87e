"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q, at least ``periods`` times q and
``least`` words long, that no neighbouring word extends. A run whose period is in [L, 2L)
for a dyadic L holds a whole block of L words, starting at a multiple of L, together with
its repetition q words later. So at every scale L each block is held against the window of
2L words that follows at distance L: the sum of squared differences at every distance is
two sums of squares less twice a correlation, and the correlation comes from an exact number-
theoretic transform. Distances without a mismatch seed extensions in both directions, which
compare words exactly; that also rejects what is zero only modulo the prime.

Texts of a batch stand in one sequence, longest first, with a word of its own between two of
them, so the texts that a scale can concern are its beginning. Blocks of more than
``MAX_BLOCK`` words are represented by their first ones. A seed inside a known run whose
period divides its distance is that run again and is not extended.

Defined cases: null and empty texts have no words and no runs; texts that repeat give equal
rows; other columns are not read; a null key is returned as null; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let

LEAST, PERIODS = 6, 4
#: The prime 7 * 2**20 + 1 and a primitive root: sums of 64 products stay below 2**53, so
#: double-precision matrix products of transforms are exact.
PRIME, ROOT, RADIX = 7_340_033, 3, 64
#: Longest block that is transformed; words and cells of a batch held at once.
MAX_BLOCK, BATCH_WORDS, CELLS = 2048, 1 << 17, 1 << 18


def _mod(x: np.ndarray) -> np.ndarray:
    """Residues of exact double-precision integers below 2**53."""
    x -= PRIME * np.floor(x / PRIME)
    x += PRIME * (x < 0)
    return x


@lru_cache
def _powers(n: int, inverse: bool) -> np.ndarray:
    """Powers of an n-th root of unity."""
    w = pow(ROOT, (PRIME - 1) // n, PRIME)
    w = pow(w, -1, PRIME) if inverse else w
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * w % PRIME)
    return np.array(out, np.float64)


@lru_cache
def _matrix(rows: int, n: int, inverse: bool) -> np.ndarray:
    return _powers(n, inverse)[np.arange(rows)[:, None] * np.arange(n) % n]


def transform(x: np.ndarray, n: int, inverse: bool = False) -> np.ndarray:
    """Transform of rows of at most n residues, filled up with zeros; not divided by n."""
    if n <= RADIX:
        return _mod(x @ _matrix(x.shape[1], n, inverse))
    if x.shape[1] < n:
        x = np.concatenate((x, np.zeros((len(x), n - x.shape[1]))), axis=1)
    rest = n // RADIX  # index i * rest + j goes to k + RADIX * l
    inner = _mod(np.matmul(_matrix(RADIX, RADIX, inverse), x.reshape(-1, RADIX, rest)))
    inner = _mod(inner * _powers(n, inverse)[np.arange(RADIX)[:, None] * np.arange(rest)])
    outer = transform(inner.reshape(-1, rest), rest, inverse).reshape(-1, RADIX, rest)
    return outer.transpose(0, 2, 1).reshape(-1, n)


def block_matches(values: np.ndarray, squares: np.ndarray, starts: np.ndarray, size: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) with no squared difference: blocks of ``size`` values at the starts,
    distances from ``at`` on, as many as a block has values. ``squares`` are prefix sums."""
    n = 2 * size
    blocks = values[starts[:, None] + np.arange(size)]
    windows = values[starts[:, None] + at + np.arange(n)]
    products = _mod(transform(blocks, n, inverse=True) * transform(windows, n))
    correlation = transform(products, n, inverse=True)[:, :size]  # n times the correlation
    ends = starts[:, None] + at + np.arange(size)
    both = squares[ends + size] - squares[ends] + (squares[starts + size] - squares[starts])[:, None]
    row, shift = np.nonzero(_mod(n * _mod(both) - 2 * correlation) == 0)
    return row, shift + at


def matched(words: np.ndarray, at: np.ndarray, apart: np.ndarray, step: int) -> np.ndarray:
    """How many consecutive words from ``at`` on, or back, equal the ones ``apart`` later."""
    reach, active, width = np.zeros(len(at), np.int64), np.arange(len(at)), 16
    while len(active):
        found = np.empty(len(active), np.int64)
        rows = max(1, CELLS // width)
        for i in range(0, len(active), rows):
            some = active[i:i + rows]
            cells = (at[some] + step * reach[some])[:, None] + step * np.arange(width)
            inside = (cells >= 0) & (cells + apart[some, None] < len(words))
            cells = np.where(inside, cells, 0)
            same = inside & (words[cells] == words[np.where(inside, cells + apart[some, None], 0)])
            found[i:i + rows] = np.where(same.all(axis=1), width, same.argmin(axis=1))
        reach[active] += found
        active = active[found == width]
        width = min(2 * width, 1 << 14)
    return reach


@lru_cache(4096)
def _primes(n: int) -> tuple[int, ...]:
    """The different prime factors."""
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return (*out, n) if n > 1 else tuple(out)


def _primitive(words: np.ndarray, start: int, period: int) -> bool:
    """Whether a run of this period has no smaller one; a smaller one would divide it."""
    return not any((words[start:start + period] == words[start + period // f:start + period // f + period]).all() for f in _primes(period))


def _covered(runs: np.ndarray, start: np.ndarray, stop: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether a known run holds a stretch and its period divides the distance. Two runs that
    both hold a block and its repetition would be one, so the one reaching farthest decides."""
    if not len(runs):
        return np.zeros(len(start), bool)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    farthest = np.maximum.accumulate(runs[:, 1] * len(runs) + np.arange(len(runs))) % len(runs)
    last = np.searchsorted(runs[:, 0], start, side="right") - 1
    run = runs[farthest[np.maximum(last, 0)]]
    return (last >= 0) & (run[:, 1] >= stop) & (apart % run[:, 2] == 0)


def find(words: np.ndarray, lengths: np.ndarray, least: int = LEAST, periods: int = PERIODS, max_block: int = MAX_BLOCK) -> np.ndarray:
    """(start, stop, period) of all runs in a sequence of texts, longest first, each followed
    by a word of its own; positions count in the sequence."""
    runs = np.zeros((0, 3), np.int64)
    if not len(lengths):
        return runs
    ends = np.cumsum(lengths + 1)
    values = (words * 2_654_435_761 % PRIME).astype(np.float64)
    size = 1
    while periods * size <= lengths[0]:
        n = int(ends[np.count_nonzero(lengths >= max(least, periods * size)) - 1]) if lengths[0] >= least else 0
        if not n:
            break
        block = min(size, max_block)
        # what follows the last text that counts differs from everything and is never matched
        held = np.r_[values[:n], np.zeros(3 * size + 2 * block)]
        squares = np.r_[0, np.cumsum(_mod(held * held))]
        at, apart = [], []
        for lot in range(0, n, size * max(1, CELLS // (2 * block))):
            starts = np.arange(lot, min(n, lot + size * max(1, CELLS // (2 * block))), size)
            for piece in range(size, 2 * size, block):
                row, distance = block_matches(held, squares, starts, block, piece)
                at.append(starts[row])
                apart.append(distance)
        at, apart = np.concatenate(at), np.concatenate(apart)
        inside = at + apart + block <= n
        at, apart = at[inside], apart[inside]
        if block == size:  # of blocks next to each other with one distance the first will do
            key = apart * (n + size) + at
            key.sort()
            key = key[np.r_[True, np.diff(key) != size][:len(key)]]
            at, apart = key % (n + size), key // (n + size)
        new = ~_covered(runs, at, at + apart + block, apart)
        at, apart = at[new], apart[new]
        ahead = matched(words, at, apart, 1)
        true = ahead >= block
        at, apart, ahead = at[true], apart[true], ahead[true]
        start, stop = at - matched(words, at - 1, apart, -1), at + ahead + apart
        whole = stop - start >= np.maximum(least, periods * apart)
        found = np.unique(np.stack((start, stop, apart), axis=1)[whole], axis=0)
        if len(found):
            runs = np.concatenate((runs, found[[_primitive(words, s, q) for s, _, q in found.tolist()]]))
        size *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _rows(keys: list, texts: list[list[bytes]], least: int, periods: int) -> Iterator[tuple]:
    """(key, words, runs, collapsed) of some texts."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    codes: dict[bytes, int] = {}
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    ends = np.cumsum(lengths + 1)
    sequence = np.empty(int(lengths.sum()) + len(order), np.int64)
    for i, stop, n in zip(order, ends.tolist(), lengths.tolist()):
        sequence[stop - n - 1:stop - 1] = [codes.setdefault(w, len(codes)) for w in texts[i]]
    sequence[ends - 1] = len(codes) + np.arange(len(order))
    runs = find(sequence, lengths, least, periods)
    change = np.zeros(len(sequence) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    text_of = np.searchsorted(ends, runs[:, 0], side="right")
    bounds = np.searchsorted(text_of, np.arange(len(order) + 1))
    for place, (i, stop, n) in enumerate(zip(order, ends.tolist(), lengths.tolist())):
        own, first = runs[bounds[place]:bounds[place + 1]], stop - n - 1
        words = texts[i]
        if len(own):
            words = [w for w, k in zip(words, kept[first:stop - 1].tolist()) if k]
        yield (keys[i], n, [{"start": s - first, "length": e - s, "period": q} for s, e, q in own.tolist()], b" ".join(words).decode())


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, periods: int = PERIODS,
             batch_words: int = BATCH_WORDS) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: its runs by start and period, and its
    words, joined by one space, without those that any run holds after its first period.
    Rows stay in their tasks; a task holds one batch of words, or one longer text."""
    kind = docs.schema[key].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, held = [], [], 0
            for i, t in enumerate(b.column(1)):
                keys.append(i)
                texts.append((t.as_py() or "").encode().split())
                held += len(texts[-1])
                if held >= batch_words or i == b.num_rows - 1:
                    at, n, runs, collapsed = zip(*_rows(keys, texts, least, periods))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(n, pa.int64()), pa.array(runs, run_type), pa.array(collapsed, pa.string())],
                                                     names=["id", "n_words", "runs", "collapsed"])
                    keys, texts, held = [], [], 0

    out = docs.select(F.col(key).alias("id"), text).mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", key)


def planted(key: Column, text: Column) -> Column:
    """The text with a periodic end in one of ten documents, as the query's contract has it:
    from word g % n on, words repeat with the period that g and n give."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        def rest(start: Column) -> Column:
            period = (F.lit(1) + F.floor((F.size(words) - start["a"]) / (F.lit(3) + g % 8))).cast("int")
            at = F.sequence(F.lit(0), F.size(words) - 1)
            return let(period, lambda p: F.array_join(F.transform(at, lambda i: F.get(words, F.when(i < start["a"], i).otherwise(start["a"] + (i - start["a"]) % p))), " "))

        return F.when(F.size(words) > 0, let(F.struct((g % F.size(words)).cast("int").alias("a")), rest)).otherwise(text)

    # the words are bound, as a lambda would cut the text again for every word
    return F.when(h % 10 == 0, let(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), periodic)).otherwise(text)


def digests(collapsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the greatest run and digests of the rows that ``collapse`` returns."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return collapsed.withColumn("best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-F.col("best.less") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
