"""Order MinHash fingerprints: signatures sensitive to edit distance.

Every k-mer of a text is numbered by its occurrences, so that repeats count. For each of
``slots`` orders, given by hash functions and their reversals, the ``tuple_size`` minimal
k-mers are selected, put back into text order and hashed together; the tuple's hash is one
slot of the fingerprint. Texts that
share k-mers in another order agree in few slots. The likeness of two fingerprints is the
share of equal slots.

Defined cases: null counts as empty; an empty text has no k-mer and every slot of its
fingerprint is zero, so two empty texts have likeness 1; a text shorter than k is one k-mer;
a text of fewer k-mers than a tuple gives the tuple of all. Equal texts have equal
fingerprints. Documents follow each other by ascending id; rows of one id are ordered by
text, repeated rows keep one result each, and rows with a null id come first, as in Spark's
order. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, SLOTS, TUPLE, BLOCK = 8, 64, 2, 65_536
#: Bytes of text in a range of ids on average. The driver keeps two numbers per range, so a
#: corpus of 100 TB takes a larger value, say 256 MB.
RANGE_BYTES = 16_000_000

_MIX, _POWER = np.uint64(0x9E3779B97F4A7C15), 0x100000001B3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@cache
def _functions(slots: int) -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and an offset for each hash function."""
    seeds = _mixed(np.arange(1, 2 * slots + 1, dtype=np.uint64))
    return (seeds[:slots] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[slots:] >> np.uint64(32)).astype(np.uint32)


def numbered_kmers(points: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-mer with its occurrence number, and its place in the text."""
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(k, len(points))
    h, width, out, done, power = points.astype(np.uint64) + np.uint64(1), 1, None, 0, _POWER
    while True:  # widths double, and the binary digits of k choose which to append
        if k & width:
            n = len(points) - done - width + 1
            out = h[:n] if out is None else out[:n] * np.uint64(power) + h[done:done + n]
            done += width
        if done == k:
            break
        h = h[:-width] * np.uint64(power) + h[width:] if width < len(h) else h[:0]
        power, width = power * power % 2**64, 2 * width
    bits = np.uint64(max(1, int(len(out) - 1).bit_length()))
    gram = _mixed(out)
    order = np.sort((gram >> bits << bits) | np.arange(len(out), dtype=np.uint64))  # equal k-mers by place
    place = (order & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    order >>= bits
    repeats = np.flatnonzero(order[1:] == order[:-1]) + 1
    code = gram[place] * _MIX
    if len(repeats):  # the n-th repeat in a run of repeats is occurrence n
        step = np.arange(len(repeats))
        run = np.flatnonzero(np.concatenate(([True], repeats[1:] != repeats[:-1] + 1)))
        code[repeats] += (step - np.repeat(run, np.diff(np.append(run, len(repeats)))) + 1).astype(np.uint64)
    return _mixed(code), place


def fingerprint(points: np.ndarray, k: int = K, slots: int = SLOTS, tuple_size: int = TUPLE) -> np.ndarray:
    """16 bits for each slot."""
    kmers, place = numbered_kmers(points, k)
    if not len(kmers):
        return np.zeros(slots, np.uint16)
    short = (kmers >> np.uint64(32)).astype(np.uint32)
    factors, offsets = _functions(slots // 2)
    size = min(tuple_size, len(kmers))
    # all hashes below this bound; more than enough unless there are few k-mers or bad luck
    bound = np.uint32(min(2**32 - 1, 2**32 * (size + 8) // len(kmers)))
    rows, cols, values = [], [], []
    for i in range(0, len(kmers), BLOCK):
        part = short[i:i + BLOCK]
        for f in range(0, slots // 2, step := max(1, BLOCK // len(part))):
            h = (part ^ offsets[f:f + step, None]) * factors[f:f + step, None]
            if bound >= 2**31:
                at = np.arange(h.size)
                for upper, value in ((0, h), (1, ~h)):
                    rows.append(2 * (at // len(part) + f) + upper)
                    cols.append(at % len(part) + i)
                    values.append(value.ravel())
            else:  # hashes near either end, with one comparison
                at = np.flatnonzero(h + bound <= 2 * bound)
                value = h.ravel()[at]
                upper = value > bound
                rows.append(2 * (at // len(part) + f) + upper)
                cols.append(at % len(part) + i)
                values.append(np.where(upper, ~value, value))
    row, col, value = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
    counts = np.bincount(row, minlength=slots)
    for slot in np.flatnonzero(counts < size).tolist():  # too few below the bound
        h = (short ^ offsets[slot // 2]) * factors[slot // 2]
        h = ~h if slot % 2 else h
        least = np.argsort(h, kind="stable")[:size]
        keep = row != slot
        row, col, value = np.append(row[keep], np.full(size, slot)), np.append(col[keep], least), np.append(value[keep], h[least])
    by_hash = np.argsort(row.astype(np.uint64) << np.uint64(32) | value, kind="stable")
    counts = np.bincount(row, minlength=slots)
    first = np.cumsum(counts) - counts
    chosen = col[by_hash[first[:, None] + np.arange(size)]]
    chosen = np.take_along_axis(chosen, np.argsort(place[chosen], axis=1), axis=1)
    code = np.zeros(slots, np.uint64)
    for j in range(size):
        code = _mixed(code * _MIX + kmers[chosen[:, j]])
    return (code >> np.uint64(48)).astype(np.uint16)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def edited(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last half of the text replaced by as much of the beginning of the next one."""
    half = len(points) // 2
    return np.concatenate((points[:len(points) - half], following[:half]))


def _hex(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, slots: int = SLOTS, tuple_size: int = TUPLE) -> DataFrame:
    """(key, fingerprint) of every row, without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array((_hex(fingerprint(code_points(t.as_py()), k, slots, tuple_size)) for t in b.column(1)), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["id", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", key)


def likeness(a, b, slots: int = SLOTS):
    """Share of equal slots of two fingerprint columns."""
    width = F.length(a) / slots
    same = F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.substring(a, (i * width + 1).cast("int"), width.cast("int")) == F.substring(b, (i * width + 1).cast("int"), width.cast("int")))
    return F.size(same) / F.lit(float(slots))


OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, slots: int = SLOTS, tuple_size: int = TUPLE,
               range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Rows are cut into ranges of ids. The first row of each range also goes, as a guard, to
    the range before it (the very first one to the last), so texts are shuffled once and
    every row meets its successor in its own task. A task keeps one row at a time.
    """
    keyed = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("id"), F.col(key).isNull().alias("no_id"), text)
    ids = keyed.select("id", F.octet_length(text).alias("bytes"))
    total = ids.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    ranges = max(1, -(-int(total) // range_bytes))
    cuts = ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    bounds = np.unique(np.array(cuts, np.float64).astype(np.int64))
    of = lambda column: np.searchsorted(bounds, column, side="right")

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(b.column(0).to_numpy()).astype(np.int32))], names=["id", "part"])

    # the least id of every range: one row per range reaches the driver
    first = (keyed.select("id").mapInArrow(number, "id long, part int")
             .groupBy("part").agg(F.min("id").alias("id")).orderBy("part").collect())
    full = [r.part for r in first]
    before = {r.id: full[i - 1] for i, r in enumerate(first)}

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "guard", "id", "no_id", "text"]
        for b in parts:
            key_values = b.column(0).to_numpy()
            part = of(key_values).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(b.num_rows, bool)), *b.columns], names=names)
            at = [i for i, v in enumerate(key_values.tolist()) if v in before]
            if at:
                guards = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([before[v] for v in guards.column(0).to_pylist()], pa.int32()), pa.array(np.ones(len(at), bool)), *guards.columns], names=names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, id, no_id, points, fingerprint of the row that waits for its successor
        for b in parts:
            rows = []
            for part, guard, i, no_id, t in zip(*(c.to_pylist() for c in b.columns)):
                points = code_points(t)
                own = fingerprint(points, k, slots, tuple_size)
                if held is not None and held[0] == part:
                    rows.append(_row(held, points, own, k, slots, tuple_size))
                held = None if guard else (part, i, no_id, points, own)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    dealt = keyed.mapInArrow(deal, "part int, guard boolean, id long, no_id boolean, text string")
    return (dealt.repartition("part").sortWithinPartitions("part", "guard", "id", "text")
            .mapInArrow(run, OUT).withColumnRenamed("doc_id", key))


def _row(held: tuple, following: np.ndarray, next_own: np.ndarray, k: int, slots: int, tuple_size: int) -> dict:
    _, i, no_id, points, own = held
    new = edited(points, following)
    after = fingerprint(new, k, slots, tuple_size)
    return {"doc_id": None if no_id else i, "n_chars": len(points), "edited_sha256": hashlib.sha256(new.tobytes().decode("utf-32-le").encode()).hexdigest(),
            "fingerprint": _hex(own), "edited_fingerprint": _hex(after),
            "near_edited": float((own == after).mean()), "near_next": float((own == next_own).mean())}
