"""SimHash fingerprints and near-duplicate components through a Gray-order index.

Two fingerprints within ``distance`` bits agree on at least ``blocks - distance`` of the
blocks their bits are cut into. Every choice of that many blocks is a mask, and the
fingerprints that share the bits under a mask form a top node with no accumulated
difference. Within a node fingerprints are sorted by Gray rank; groups of neighbours factor
the bits they share into upper nodes, and a search drops a whole group as soon as the
differences accumulated down to it exceed the distance. The nodes of a batch, small or large,
are one index, whose groups also know the nodes they hold. All links of a node are found, but
only a spanning star of each linked group leaves it.

A node with more than ``node_rows`` fingerprints is cut into parts by hash and every two
parts meet in one task, so a hot node is spread and no link is lost.

Defined cases: null and empty texts have fingerprint zero, which links like any other;
rows with a null id are fingerprinted but belong to no component (null); repeated rows keep
one row each; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stage, write_stage
from .components import connected_components

SEED, SHINGLE, DISTANCE = 42, 4, 4
BLOCKS, NODE_ROWS, FAN_OUT, QUERY_ROWS = 6, 4096, 16, 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a text as a signed number."""
    import xxhash
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]][:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest, ones, step = xxhash.xxh64_digest, np.zeros(64, np.int64), 65_536
    for i in range(0, n, step):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[i:i + step], stops[i:i + step])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).view(np.uint64).reshape(-1, 8)
        # bytes hold counts of at most 255 rows, eight at a time
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array((fingerprint(t.as_py(), shingle) for t in b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", key)


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """One signed mask for each choice of blocks that must agree."""
    cuts = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    parts = [((1 << (e - s)) - 1) << s for s, e in zip(cuts[:-1], cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in map(sum, combinations(parts, blocks - distance))]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence: the prefix parity of its bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of groups over codes in Gray order, those of one node next to each other. Each
    group holds the bits its codes share that no group above holds, and its range of nodes."""

    def __init__(self, codes: np.ndarray, node: np.ndarray, fan_out: int = FAN_OUT):
        self.codes, self.node, self.fan_out = codes, node, fan_out
        self.levels: list[tuple[np.ndarray, ...]] = []
        both, either, low, high = codes, codes, node, node
        while True:
            starts = np.arange(0, len(both), fan_out)
            both, either = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(either, starts)
            low, high = low[starts], high[np.minimum(starts + fan_out, len(high)) - 1]
            self.levels.append((~(both ^ either), both, low, high))
            if len(both) == 1:
                break
        for k in range(len(self.levels) - 1):  # bits an upper group holds are counted there
            mask, *rest = self.levels[k]
            above = np.repeat(self.levels[k + 1][0], fan_out)[:len(mask)]
            self.levels[k] = (mask & ~above, *rest)

    def search(self, queries: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) positions within the distance, each query in its own node."""
        query, group = np.arange(len(queries), dtype=np.int32), np.zeros(len(queries), np.int32)
        apart = np.zeros(len(queries), np.uint8)
        for k in reversed(range(len(self.levels))):
            mask, pattern, low, high = self.levels[k]
            apart = apart + np.bitwise_count((queries[query] ^ pattern[group]) & mask[group])
            near = (apart <= distance) & (low[group] <= node[query]) & (node[query] <= high[group])
            child = group[near][:, None] * self.fan_out + np.arange(self.fan_out, dtype=np.int32)
            inside = child < (len(self.levels[k - 1][0]) if k else len(self.codes))
            query, apart = (np.repeat(x[near], inside.sum(axis=1)) for x in (query, apart))
            group = child[inside]
        near = (np.bitwise_count(queries[query] ^ self.codes[group]) <= distance) & (self.node[group] == node[query])
        return query[near], group[near]


def least_labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position each of n positions reaches through pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            old = label.copy()
            np.minimum.at(label, old[a], low)
            np.minimum.at(label, old[b], low)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label != label[label]).any():
                label = label[label]
            if (label[a] == label[b]).all():
                break
    return label


def node_links(codes: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, least code it reaches) inside equal node numbers, through one index of
    all nodes, however many codes each has."""
    order = np.lexsort((gray_rank(codes), node))
    index = GrayIndex(codes[order], node[order])

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(codes), QUERY_ROWS):
            q, c = index.search(index.codes[i:i + QUERY_ROWS], index.node[i:i + QUERY_ROWS], distance)
            later = c > q + i
            yield order[q[later] + i], order[c[later]]

    label = least_labels(len(codes), pairs())
    moved = label != np.arange(len(codes))
    return codes[moved], codes[label[moved]]


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints within the distance: their
    components are those of all links."""
    nodes = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(blocks, distance)])).alias("mask", "bits"))
    sizes = nodes.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    parts = F.ceil(F.col("rows") / node_rows).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meets = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("part")))
    unit = ["mask", "bits", "low", "high"]
    units = (nodes.join(sizes, ["mask", "bits"]).withColumn("parts", parts).withColumn("part", part)
             .withColumn("other", F.explode(meets))
             .select("fp", F.col("mask").cast("long"), "bits", F.least("part", "other").cast("long").alias("low"),
                     F.greatest("part", "other").cast("long").alias("high")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 5
        for b in batches:
            columns = [np.r_[old, b.column(k).to_numpy(zero_copy_only=False)] for k, old in enumerate(rest)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[1:]], axis=0)) + 1
            cut = int(new[-1]) if len(new) else 0
            if cut:
                yield _found([c[:cut] for c in columns], distance)
            rest = [c[cut:] for c in columns]
        if len(rest[0]):
            yield _found(rest, distance)

    return units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "a bigint, b bigint").distinct()


def _found(columns: list[np.ndarray], distance: int) -> pa.RecordBatch:
    changes = np.any([c[1:] != c[:-1] for c in columns[1:]], axis=0)
    a, b = node_links(columns[0].view(np.uint64), np.r_[0, np.cumsum(changes)], distance)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE,
                    shingle: int = SHINGLE, blocks: int = BLOCKS, node_rows: int = NODE_ROWS) -> DataFrame:
    """(key, fingerprint, component_id) of every row; the component is the smallest key
    reachable over links. The fingerprints are written once, as texts are read once."""
    fps = write_stage(fingerprints(docs, key, text, shingle), "fingerprints")
    least = write_stage(fps.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    groups = write_stage(connected_components(links(least.select("fp"), distance, blocks, node_rows)), "components")
    placed = least.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = write_stage(placed.join(ids, "component").select("fp", "component_id"), "fingerprint-components")
    drop_stage(least, groups)
    return fps.join(of_fp, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))
