"""Near-duplicate vectors through int8 tile products with rigorous error bounds.

Vectors are normalised and quantised to ``scale * int8`` with the length of the remaining
error kept per vector. The product of two quantised tiles bounds every cosine from both
sides: |u.v - s t q.r| <= |s q| |f| + |e| |t r| + |e| |f| for errors e and f. Pairs whose
lower bound reaches the threshold are links, pairs whose upper bound does not are none, and
only the others are recomputed in double precision.

Equal vectors of one label form a class first, so copies are compared once. The classes of
a label are dealt to blocks by hash and every two blocks of a label meet in one task, which
emits link counts and a spanning star but no pairs. Comparing all vectors of a label is
quadratic in the label; blocks spread that work and bound what a task holds.

Defined cases: vectors with a null id or label, null, empty, zero, or with null or
non-finite components link with nothing, as do vectors of different lengths; rows with a
null id have a null component and are not kept; repeated rows are copies and count as other
vectors. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_stage, write_stage
from .components import connected_components
from .simhash import least_labels

THRESHOLD, BLOCK_ROWS, TILE = 0.93, 2048, 512
#: int8 products of this many components are exact in single precision: 1024 * 127 * 127 < 2**24.
EXACT = 1024
#: Rounding of the double-precision arithmetic around the bounds.
ROUNDING = 1e-9


def comparable(vector: Column) -> Column:
    """Whether a vector can link: components all finite, none null, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, their int8 forms, scales, lengths of the scaled forms and of the errors."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    unit = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    near = small * scale[:, None]
    return unit, small, scale, np.sqrt(np.einsum("ij,ij->i", near, near)), np.sqrt(((unit - near) ** 2).sum(axis=1))


def tile_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows. Single precision holds every sum of a slice exactly."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        out += a[:, k:k + EXACT].astype(np.float32) @ b[:, k:k + EXACT].astype(np.float32).T
    return out


def tile_links(left: tuple, right: tuple, threshold: float) -> np.ndarray:
    """Which pairs of two quantised tiles reach the threshold."""
    (u, q, s, n, e), (v, r, t, m, f) = left, right
    about = tile_products(q, r) * s[:, None] * t[None]
    bound = n[:, None] * f[None] + e[:, None] * m[None] + e[:, None] * f[None] + ROUNDING
    linked = about - bound >= threshold
    i, j = np.nonzero((about + bound >= threshold) & ~linked)
    for k in range(0, len(i), 65_536):
        a, b = i[k:k + 65_536], j[k:k + 65_536]
        linked[a, b] = np.einsum("ij,ij->i", u[a], v[b]) >= threshold
    return linked


def unit_links(side: np.ndarray, both: bool, copies: np.ndarray, vectors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with links in a task's unit: position, linked rows of others, least position
    reached. The two sides are compared with each other; a unit of one block with itself."""
    parts = quantise(vectors)
    count = np.zeros(len(side), np.int64)
    rows = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)] if both else [np.arange(len(side))] * 2

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(rows[0]), TILE):
            a = rows[0][i:i + TILE]
            left = tuple(p[a] for p in parts)
            for j in range(0 if both else i, len(rows[1]), TILE):
                b = rows[1][j:j + TILE]
                linked = tile_links(left, tuple(p[b] for p in parts), threshold)
                if not both and i == j:
                    np.fill_diagonal(linked, False)
                count[a] += linked @ copies[b]
                if both or i != j:
                    count[b] += copies[a] @ linked
                x, y = np.nonzero(linked)
                yield a[x], b[y]

    label = least_labels(len(side), pairs())
    some = np.flatnonzero(count)
    return some, count[some], label[some]


def partial_links(classes: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, links, b) for classes (class_id, label, embedding, copies): linked rows found by
    one task, and a class it reaches."""
    sizes = classes.groupBy("label", F.size("embedding").alias("dims")).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    units = (classes.withColumn("dims", F.size("embedding")).join(sizes, ["label", "dims"]).withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.col("label").cast("string").alias("label"), "dims",
                     F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     (F.col("block") > F.col("other")).cast("int").alias("side"), "class_id", "copies", "embedding"))
    unit = ["label", "dims", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(4))))
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])] if keys else []
            for s, e in zip(starts, [*starts[1:], len(keys)]):
                if keys[s] != now and held:
                    yield found(held)
                    held = []
                now = keys[s]
                held.append(b.slice(s, e - s))
        if held:
            yield found(held)

    def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        side, ids, copies = (t.column(k).to_numpy() for k in (4, 5, 6))
        vectors = np.concatenate([c.flatten().to_numpy() for c in t.column(7).chunks]).astype(np.float64).reshape(len(ids), -1)
        both = t.column(2)[0].as_py() != t.column(3)[0].as_py()
        at, links, least = unit_links(side, both, copies, vectors, threshold)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links), pa.array(ids[least])], names=["a", "links", "b"])

    return units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "a bigint, links bigint, b bigint")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("embedding"))
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & comparable(F.col("embedding")))
    classes = write_stage(usable.groupBy("label", "embedding").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    found = write_stage(partial_links(classes, threshold, block_rows), "vector-links")
    groups = connected_components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    placed = (classes.join(links.withColumnRenamed("a", "class_id"), "class_id", "left")
              .join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
              .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                      F.coalesce("component", "class_id").alias("component_id")))
    placed = write_stage(placed, "vector-components")
    drop_stage(classes, found)
    id_links = F.coalesce(F.when(F.col("id").isNotNull(), F.col("n_links")), F.lit(0))
    component = F.coalesce(F.when(F.col("id").isNotNull(), F.col("component_id")), F.col("id"))
    return rows.join(placed, ["label", "embedding"], "left").select(
        F.col("id").alias(key), id_links.cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
