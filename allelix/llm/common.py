"""Helpers that several operators share: bounded Arrow batches, shared folders, files in any store."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once, and of the Arrow batches that carry rows to and from Python.
BATCH_BYTES, ARROW_BYTES = 1 << 20, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, it is a new local one, but for a cluster it must be set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="allelix-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


class Folders:
    """The folders that one call of an operator writes: no other call knows them, so calls may run beside each other."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        """Write once to the shared folder and read again: cuts the lineage, and survives a lost executor."""
        path = new_dir(self.spark, what)
        df.write.parquet(path)
        self.paths.append(path)
        file_system, at = self._at(path)
        file_system.deleteOnExit(at)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, keep: int) -> None:
        """Deletes the folders but for the last ``keep``: nothing later may read them."""
        gone = self.paths[: len(self.paths) - keep]
        self.paths = self.paths[len(gone) :]
        for path in gone:
            file_system, at = self._at(path)
            file_system.delete(at, True)

    def part(self) -> Folders:
        """The folders of one part of the call, to be forgotten before the others."""
        return Folders(self.spark)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, what: str) -> DataFrame:
    """As Folders.stored, for a table that the result of the call reads: it goes when the session's process ends."""
    return Folders(df.sparkSession).stored(df, what)


def file_system(path: str):
    """pyarrow's file system for a path or URI, and the path inside it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads: other columns, whatever their names, never meet its own."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def crc_part(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``most`` bytes of text at most, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to ARROW_BYTES in this session, where it allows more: both sides of a task keep whole batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)  # none before Spark 4.1
    if held and not (held.rstrip("b").isdigit() and int(held.rstrip("b")) <= ARROW_BYTES):
        spark.conf.set(name, str(ARROW_BYTES))


def let_go() -> None:
    """Gives free memory back to the system at a task's end: Python workers live on, idle, beside the next stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not all C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def grouped_map(rows: DataFrame, key: str, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """applyInArrow by one column, with memory given back after each group."""
    small_batches(rows.sparkSession)

    def work(group: pa.Table) -> pa.Table:
        try:
            return f(group)
        finally:
            let_go()

    return rows.groupBy(key).applyInArrow(work, schema)


def mapped(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch]], schema: str, column: str | None = "text", most: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow with one function per task, made there by ``make``, over batches of bounded size; without a column as Spark cuts them."""
    small_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, batch, part = make(), None, None
        for batch in batches:
            for part in slices(batch, column, most) if column else (batch,):
                if part.num_rows:
                    yield f(part)
        del f, batch, part
        let_go()

    return df.mapInArrow(work, schema)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts, as one flat array.

    values: the words; doc: each word's row; first: each row's first word, with the total at the end.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = lists.flatten()
        doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        full = pc.greater(pc.binary_length(flat), 0)
        keep = full.to_numpy(zero_copy_only=False)
        if not keep.all():
            flat, doc = flat.filter(full), doc[keep]
        self.values, self.doc, self.n = flat, doc, len(lists)
        self.first = np.searchsorted(doc, np.arange(self.n + 1))

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        coded = self.values.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def lengths(self) -> np.ndarray:
        return np.diff(self.first)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser on unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def string_hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string's bytes, the same in every process."""
    import xxhash

    f = xxhash.xxh3_64_intdigest
    return np.fromiter((f(x, seed) for x in values.cast(pa.binary()).to_pylist()), np.uint64, len(values))
