"""K-d tree partitioning into shards of near-equal bytes.

A node of the tree is split along its widest metadata dimension at the weighted median, or
at the share its two sides need when their shard counts differ, until every leaf is one
shard of the target bytes. Medians are found by summing bytes in slices of the dimension and
slicing the part that holds the median again, so a pass returns a bounded number of sums per
node and no row leaves the executors. Rows of equal value, such as a hot source, are told
apart by a hash of their id, so that a cut can pass through them. The tree compiles to one
column expression.

Law: ``bytes``. Defined cases: null texts have no bytes and the crc of the empty text; a
null or absent language or source counts as zero; rows that repeat one id share its place in
the tree, and rows equal in all columns may be exchanged among their slots; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_stage

SHARDS, ROW_BYTES = 40, 16
#: Slices of a pass, the part of a shard's bytes a cut may be off, rows numbered in one window.
SLICES, TOLERANCE, NUMBERED_ROWS = 1024, 0.002, 50_000
#: A place on a dimension: its value in the high bits, a hash of the id in the low ones.
VALUE_BITS, TIE_BITS = 31, 31


@dataclass
class Node:
    first: int
    shards: int
    dimension: str = ""
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return self.left.leaves() + self.right.leaves() if self.left else [self]

    def column(self) -> Column:
        """The first shard of the leaf a row falls into."""
        if not self.left:
            return F.lit(self.first)
        return F.when(F.col(self.dimension) < F.lit(self.cut), self.left.column()).otherwise(self.right.column())


def named(docs: DataFrame, name: str) -> Column:
    """A name as a number; equal names stay together."""
    if name not in docs.columns:
        return F.lit(0)
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")).bitwiseAND(F.lit((1 << VALUE_BITS) - 1)), F.lit(0))


def metadata(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """(id, size, text_crc32) and the places on the dimensions: size, language, source."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    values = {"by_size": (F.log2(size.cast("double")) * F.lit(2.0 ** (VALUE_BITS - 6))).cast("long"), "by_lang": named(docs, "lang"), "by_source": named(docs, "source")}
    tie = F.xxhash64(key).bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    places = [F.shiftleft(v.cast("long"), TIE_BITS).bitwiseOR(tie).alias(n) for n, v in values.items()]
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32")
    return docs.select(F.col(key).alias("id"), size.alias("size"), crc, *places), list(values)


def grow(rows: DataFrame, dimensions: list[str], shards: int = SHARDS, tolerance: float = TOLERANCE) -> Node:
    """The tree over metadata rows. The driver sees at most ``SLICES`` sums per node."""
    tree, spread, target = Node(0, shards), None, 0.0
    ends = [f(d).alias(f"{e}_{d}") for d in dimensions for e, f in (("low", F.min), ("high", F.max))]
    while True:
        found = {r.node: r for r in rows.groupBy(tree.column().alias("node")).agg(F.sum("size").alias("total"), *ends).collect()}
        open_nodes = [n for n in tree.leaves() if n.shards > 1 and n.first in found]
        if not open_nodes:
            return tree
        if spread is None:
            spread = {d: max(1, found[0][f"high_{d}"] - found[0][f"low_{d}"]) for d in dimensions}
            target = found[0].total / shards
        searches = {}
        for n in open_nodes:
            r = found[n.first]
            n.dimension = max(dimensions, key=lambda d: (r[f"high_{d}"] - r[f"low_{d}"]) / spread[d])
            searches[n.first] = Search(n, r[f"low_{n.dimension}"], r[f"high_{n.dimension}"] + 1, r.total * (n.shards // 2) / n.shards)
        cut(rows, tree, searches, target * tolerance)
        for n in open_nodes:
            half = n.shards // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)


@dataclass
class Search:
    node: Node
    low: int
    high: int
    wanted: float
    done: bool = False

    @property
    def width(self) -> int:
        return -(-(self.high - self.low) // SLICES)


def cut(rows: DataFrame, tree: Node, searches: dict[int, Search], tolerance: float) -> None:
    """Set the cut of every searched node where its left side has the wanted bytes."""
    while True:
        going = [s for s in searches.values() if not s.done]
        if not going:
            return
        part = F.lit(None).cast("long")
        for s in going:
            inside = (F.col("node") == s.node.first) & (F.col(s.node.dimension) >= s.low) & (F.col(s.node.dimension) < s.high)
            part = F.when(inside, F.expr(f"({s.node.dimension} - {s.low}L) div {s.width}L")).otherwise(part)
        sums: dict[int, list] = {}
        for r in (rows.withColumn("node", tree.column()).withColumn("part", part).where("part IS NOT NULL")
                  .groupBy("node", "part").agg(F.sum("size").alias("bytes")).collect()):
            sums.setdefault(r.node, []).append((r.part, r.bytes))
        for s in going:
            for at, held in sorted(sums[s.node.first]):
                if held >= s.wanted:
                    break
                s.wanted -= held
            low, width = s.low + at * s.width, s.width
            s.low, s.high = low, min(s.high, low + width)
            if held <= tolerance or s.high - s.low <= 1:
                s.done, s.node.cut = True, s.low if s.wanted < held / 2 else s.high


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE,
          numbered_rows: int = NUMBERED_ROWS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Slots count from 0 in each shard: windows number parts of a shard, and the rows of the
    parts before are added.
    """
    rows, dimensions = metadata(docs, key, text)
    rows = write_stage(rows, "shard-metadata")
    tree = grow(rows, dimensions, shards, tolerance)
    parts = max(1, -(-rows.count() // (shards * numbered_rows)))
    placed = rows.select("id", "size", "text_crc32", tree.column().alias("shard"), F.pmod(F.xxhash64("id", "text_crc32"), F.lit(parts)).alias("part"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = placed.withColumn("n", F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")) - 1)
    return numbered.join(offsets, ["shard", "part"]).select(
        F.col("id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("n") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
