"""Rows of the triangle of distances, one text a sample, without a table of pairs.

Samples are packed as in ``pairs``, numbered in order, and cut into blocks. A task gets a block beside all blocks before it, which
pass by one after another; of each it keeps the distances alone, in the fewest bytes that hold them. So what is shuffled are packed
samples, once for each later block, and a task holds one block, one passing block and HELD bytes of distances. A block has fewer
samples where rows are longer; one row of the triangle, which is one text, is held in any case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pairs import PLANES, n_parts, n_words, packed
from .running import numbered

#: Bytes of distances that a task holds, samples of a block at most, bytes of planes of a block's part, of texts of a batch, and pairs compared at once.
HELD, MOST, PART_BYTES, TEXT_BYTES, AT_ONCE = 64 << 20, 1024, 1 << 20, 8 << 20, 1 << 16


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to TEXT_BYTES in this session, where it allows more."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    if held and not (held.rstrip("b").isdigit() and int(held.rstrip("b")) <= TEXT_BYTES):
        spark.conf.set(name, str(TEXT_BYTES))


def agreeing(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    """Adds the agreeing loci of each sample of a (planes x samples) with each of b to out; some samples of a at a time."""
    step = max(1, AT_ONCE // max(1, b.shape[1]))
    for at in range(0, a.shape[1], step):
        x = a[:, at : at + step, None]
        for w in range(0, len(a), PLANES):
            apart = x[w] ^ b[w]
            for k in range(1, PLANES - 1):
                apart |= x[w + k] ^ b[w + k]
            np.invert(apart, out=apart)
            apart &= x[w + PLANES - 1]
            apart &= b[w + PLANES - 1]
            out[at : at + step] += np.bitwise_count(apart)


def shown(n_loci: int) -> np.ndarray:
    """Each distance's text with the space behind it, filled with zeros to one width."""
    texts = [f"{k} ".encode() for k in range(n_loci + 1)]
    width = -(-len(texts[-1]) // 4) * 4
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), f"V{width}")


class Block:
    """The rows of a group: its own samples, and the distances to those that have passed by."""

    def __init__(self, samples: int, places: int, kind: type):
        self.ids, self.loci, self.planes = [None] * 3
        self.parts: list[np.ndarray] = []
        self.found = np.zeros((samples, places), kind)
        self.same, self.at = None, 0

    def meet(self, part: int, last: bool, loci: np.ndarray, planes: np.ndarray) -> None:
        if self.same is None:
            self.same = np.zeros((len(self.ids), len(loci)), np.int32)
        agreeing(self.parts[part], planes, self.same)
        if last:
            self.found[: len(self.ids), self.at : self.at + len(loci)] = np.minimum(self.loci[:, None], loci) - self.same
            self.at, self.same = self.at + len(loci), None


def texts_of(batches: Iterator[pa.RecordBatch], parts: int, most: int, n_loci: int) -> Iterator[pa.RecordBatch]:
    """sample_id, row from sorted blocks: each group's own one first, then those before it. most: samples of a block."""
    table = shown(n_loci)
    kind = next(k for k in (np.uint8, np.uint16, np.int32) if n_loci <= np.iinfo(k).max)

    def finished(block: Block) -> Iterator[pa.RecordBatch]:
        for k in range(parts):
            block.meet(k, k == parts - 1, block.loci, block.parts[k])
        first, ids, rows, size = block.at - len(block.ids), [], [], 0
        for r, sample in enumerate(block.ids):
            rows.append(table[block.found[r, : first + r]].tobytes().translate(None, b"\0"))
            ids.append(sample)
            size += len(rows[-1])
            if size >= TEXT_BYTES:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(rows, pa.string())], ["sample_id", "row"])
                ids, rows, size = [], [], 0
        if ids:
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(rows, pa.string())], ["sample_id", "row"])

    group, block = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            number, own, part = (batch.column(c)[k].as_py() for c in ("group", "own", "part"))
            ids, loci, *planes = (batch.column(c)[k].values.to_numpy() for c in range(3, batch.num_columns))
            planes = np.stack(planes).astype(np.uint64)
            if own:
                if number != group:
                    if block:
                        yield from finished(block)
                    group, block = number, None  # the one before is let go first
                    block = Block(len(ids), number * most + len(ids), kind)
                    block.ids, block.loci = ids, loci.astype(np.int32)
                block.parts.append(planes)
            else:
                block.meet(part, part == parts - 1, loci.astype(np.int32), planes)
    if block:
        yield from finished(block)


def distance_texts(cells: DataFrame, n_loci: int, n_samples: int | None = None) -> DataFrame:
    """sample_id, row: the distances of a sample to all samples before it, in their order, each followed by a space."""
    small_batches(cells.sparkSession)
    ids = cells.select("sample_id").distinct()
    n, parts = n_samples or ids.count(), n_parts(n_loci)
    held = max(1, n) * (1 if n_loci < 1 << 8 else 2 if n_loci < 1 << 16 else 4)
    most = max(1, min(MOST, HELD // held, PART_BYTES // (8 * PLANES * n_words(n_loci))))
    planes = [f"p{k}" for k in range(PLANES * n_words(n_loci))]
    placed = packed(cells, n_loci).join(numbered(ids, ["sample_id"], "place"), "sample_id")
    block = F.floor(F.col("place") / most)
    each = placed.groupBy(block.alias("block"), "part").agg(F.array_sort(F.collect_list(F.struct("place", F.col("sample_id").alias("id"), "n_loci", *planes))).alias("s"))
    groups = F.sequence(F.col("block"), F.lit(math.ceil(n / most) - 1).cast("long"))
    sent = each.withColumn("group", F.explode(groups)).select("group", (F.col("group") == F.col("block")).alias("own"), "part", "block", *[F.col(f"s.{c}").alias(c) for c in ("id", "n_loci", *planes)])
    dealt = sent.repartition("group").sortWithinPartitions("group", F.desc("own"), "block", "part").drop("block")
    return dealt.mapInArrow(lambda batches: texts_of(batches, parts, most, n_loci), "sample_id long, row string")
