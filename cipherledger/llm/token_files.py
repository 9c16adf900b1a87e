"""Files of token ids: frequency-ranked, in byte-aligned variable-length coding.

Texts are encoded once; ids are then ranked by how often the corpus has them, so that the
frequent ones take one byte. A file holds the ids of consecutive documents in ascending key
order. Each id is its rank in one to four bytes, low byte first, and the byte counts stand
apart: a control byte has the counts of four ids, two bits each. Reading looks every control
byte up in tables that give the places of sixteen output bytes at once.

File layout, little-endian: the magic bytes, four 64-bit numbers (documents, ids, control
bytes, data bytes), then keys (64-bit, signed), null flags of keys (8-bit), lengths (64-bit),
control bytes and data bytes. The last control byte is filled up with ids of rank zero. The
folder also has ``ranks`` (rank, id) and ``manifest`` (one row per file) as Parquet.

Tasks write files under new names and report them; the manifest names the files of the
attempts that were committed, so what a lost or repeated attempt leaves is never read. The
folder may be on any file system pyarrow reaches by its address.

Texts are encoded by ``word_ids``, which hands a word to the library once.

Defined cases: null and empty texts have only the end id; rows with a null key come first
and keep a null key; rows that repeat a key stand next to each other in any order; other
columns are not read; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_stage, write_stage
from .word_ids import Encoder

#: Ids in a file at least, but for the last of a task; rows in a task's range.
FILE_IDS, RANGE_ROWS = 1 << 23, 1 << 15
#: Ids coded at once; bytes that the writer of ids holds before it writes them.
STEP, GROUP_BYTES = 1 << 18, 8 << 20
MAGIC = b"TOKVB001"
HEAD = struct.Struct("<8s4Q")


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(*key) -> Encoder:
    """One encoder per worker process."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def _forget() -> None:
    """Let the worker's encoder go. A function of the module, as a table that a task's own
    function names would be a copy."""
    _ENCODERS.clear()


@lru_cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By control byte: data bytes of its four ids, place of each of the sixteen output bytes
    among them, and whether that output byte has one."""
    counts = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1
    before = np.cumsum(counts, axis=1) - counts
    at = np.arange(4)
    used = at < counts[:, :, None]
    place = np.where(used, before[:, :, None] + at, 0)
    return counts.sum(axis=1), place.reshape(256, 16), used.reshape(256, 16).astype(np.uint8)


def code(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks; a number of them that four divides."""
    r = ranks.astype("<u4")
    counts = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    control = (counts.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= counts[:, None]].tobytes()


def decode(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The ranks of control and data bytes."""
    total, place, used = tables()
    sizes = total[control]
    first = np.cumsum(sizes) - sizes
    return (data[first[:, None] + place[control]] * used[control]).view("<u4").reshape(-1)


class FileParts:
    """The bytes of a file that grows by documents; ids are coded as soon as there are enough."""

    def __init__(self, rank: np.ndarray):
        self.rank, self.keys, self.lengths = rank, [], []
        self.control, self.data, self.rest, self.held = [], [], [], 0

    @property
    def ids(self) -> int:
        return sum(self.lengths)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        for i in range(0, len(ids), STEP):
            self.rest.append(self.rank[ids[i:i + STEP]])
            self.held += len(self.rest[-1])
            if self.held >= STEP:
                self._code(self.held % 4)

    def _code(self, left: int) -> None:
        ranks = np.concatenate(self.rest)
        control, data = code(ranks[:len(ranks) - left])
        self.control.append(control)
        self.data.append(data)
        self.rest, self.held = [ranks[len(ranks) - left:]], left

    def close(self) -> list[bytes]:
        self.rest.append(np.zeros(-self.held % 4, self.rank.dtype))
        self.held += len(self.rest[-1])
        self._code(0)
        head = HEAD.pack(MAGIC, len(self.keys), self.ids, sum(map(len, self.control)), sum(map(len, self.data)))
        return [head, np.array([k or 0 for k in self.keys], "<i8").tobytes(), np.array([k is None for k in self.keys], np.uint8).tobytes(),
                np.array(self.lengths, "<u8").tobytes(), *self.control, *self.data]


def unpack(content: bytes, id_of: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """(key, ids) of a file's documents; ``id_of`` has the id of each rank."""
    magic, docs, n, n_control, n_data = HEAD.unpack_from(content)
    if magic != MAGIC or len(content) != HEAD.size + 17 * docs + n_control + n_data:
        raise ValueError("not a whole file of token ids")
    at = HEAD.size
    keys = np.frombuffer(content, "<i8", docs, at).tolist()
    null = np.frombuffer(content, np.uint8, docs, at + 8 * docs).tolist()
    lengths = np.frombuffer(content, "<u8", docs, at + 9 * docs).astype(np.int64)
    control = np.frombuffer(content, np.uint8, n_control, at + 17 * docs)
    data = np.frombuffer(content, np.uint8, n_data, at + 17 * docs + n_control)
    ids, done, total = np.empty(4 * n_control, id_of.dtype), 0, tables()[0]
    for i in range(0, n_control, STEP // 4):
        part = control[i:i + STEP // 4]
        size = int(total[part].sum())
        ids[4 * i:4 * (i + len(part))] = id_of[decode(part, data[done:done + size])]
        done += size
    stops = np.cumsum(lengths)
    for key, gone, stop, length in zip(keys, null, stops.tolist(), lengths.tolist()):
        yield (None if gone else key), ids[stop - length:stop]


def encoded(docs: DataFrame, tokenizer_path: str, end: int, key: str = "doc_id", text: str = "text", cuts: bool = True) -> DataFrame:
    """(id, ids) of every row: 16-bit numbers where the vocabulary has no more, else 32-bit."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    width = id_width(tokenizer_json, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_json, end, cuts)
        for b in batches:
            for s in range(0, b.num_rows, 512):  # a part of a batch at a time, as texts may be long
                part = b.slice(s, 512)
                ids = [i.astype(width).tobytes() for i in encoder.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(run, "id long, ids binary")


@lru_cache(2)
def _vocabulary(tokenizer_json: str) -> int:
    from tokenizers import Tokenizer
    return max(Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True).values()) + 1


def id_width(tokenizer_json: str, end: int) -> str:
    return "<u2" if max(_vocabulary(tokenizer_json), end + 1) <= 1 << 16 else "<u4"


def ranked(ids: DataFrame, width: str) -> DataFrame:
    """(rank, id): ids by falling count, ties by id. Tasks count their ids before the
    shuffle; the result has at most a row for each id of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()  # this worker may have encoded before
        counts = np.zeros(0, np.int64)
        for b in batches:
            for t in b.column(0):
                new = np.bincount(np.frombuffer(t.as_buffer(), width))
                if len(new) > len(counts):
                    new[:len(counts)] += counts
                    counts = new
                else:
                    counts[:len(new)] += new
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["id", "n"])

    counts = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"), "id")


MANIFEST = "part int, seq int, name string, docs long, ids long, bytes long"


def write_files(docs: DataFrame, folder: str, tokenizer_path: str, end: int, key: str = "doc_id", text: str = "text",
                cuts: bool = True, file_ids: int = FILE_IDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write the files of a table into a folder and return their manifest.

    Rows are dealt to ranges of keys; rows that repeat a key are spread by a random number
    that is written with them, so that no key is too much for a task.
    """
    spark = docs.sparkSession
    coded = encoded(docs, tokenizer_path, end, key, text, cuts)
    with open(tokenizer_path, encoding="utf-8") as f:
        width = id_width(f.read(), end)
    coded = write_stage(coded.withColumn("turn", F.rand(7)), "token-ids", **{"parquet.block.size": GROUP_BYTES})
    ranked(coded, width).write.parquet(f"{folder}/ranks")
    table = rank_table(spark, folder)
    rank = np.zeros(int(table.max(initial=0)) + 1, np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext
        _forget()
        target, root = fs.FileSystem.from_uri(f"{folder}/files")
        part, seq = TaskContext.get().partitionId(), 0
        for f in _files(batches, width, rank, file_ids):
            parts = f.close()
            name = f"part-{part:07d}-{seq:05d}-{uuid.uuid4().hex}.tok"
            target.create_dir(root, recursive=True)
            with target.open_output_stream(f"{root}/{name}") as out:
                for content in parts:
                    out.write(content)
            yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "name": name, "docs": len(f.keys), "ids": f.ids, "bytes": sum(map(len, parts))}], schema=schema)
            seq += 1

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
    ranges = max(1, -(-coded.count() // range_rows), min(spark.sparkContext.defaultParallelism, coded.rdd.getNumPartitions()))
    order = [F.col("id").asc_nulls_first(), F.col("turn")]
    coded.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    drop_stage(coded)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _files(batches: Iterable[pa.RecordBatch], width: str, rank: np.ndarray, file_ids: int) -> Iterator[FileParts]:
    """Rows of a task in files of about ``file_ids`` ids."""
    f, held = FileParts(rank), 0
    for b in batches:
        for k, t in zip(b.column(0), b.column(1)):
            f.add(k.as_py(), np.frombuffer(t.as_buffer(), width))
            held += f.lengths[-1]
            if held >= file_ids:
                yield f
                f, held = FileParts(rank), 0
    if f.keys:
        yield f


def rank_table(spark: SparkSession, folder: str) -> np.ndarray:
    """The id of each rank: as many rows as the corpus has different ids of the vocabulary."""
    rows = spark.read.parquet(f"{folder}/ranks").toPandas().sort_values("rank")
    return rows["id"].to_numpy(np.uint32)


def read_files(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in a folder's files. ``start``
    counts the ids of all documents before it, in this file and in those before."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], f"{key} long, start long, n_tokens long, ids_crc32 long")
    id_of = rank_table(spark, folder)
    # sums of tasks, of which there are few, then of each task's files
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.join(tasks, "part").select("name", (F.col("before") + F.coalesce(F.sum("ids").over(here), F.lit(0))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, start in zip(b.column(0), b.column(1)):
                out, at = [], start.as_py()
                for k, ids in unpack(content.as_buffer(), id_of):
                    out.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[key, "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(f"{folder}/files")
    named = files.select(F.substring_index("path", "/", -1).alias("name"), "content")
    return named.join(starts, "name").select("content", "start").mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")
