"""Weighted joint counts of states at pairs of loci, and overlaps of weighted row sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import N_STATES

#: Samples of a word, and loci of a block of a tile.
WORD, BLOCK_LOCI = 64, 512


def bitmaps(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """part, word, weight, locus, s0 to s4: for 64 samples of one weight and a locus, which of them are in each state.

    The samples of a weight are dealt into parts by a hash of their ids, and numbered inside them, so a weight that many samples
    share is cut, and the numbers are the same whenever they are computed again.
    """
    states = cells.groupBy("sample_id").agg(F.collect_list(F.struct("locus", "state")).alias("states"))
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = states.join(weights.select("sample_id", "weight"), "sample_id").withColumn("part", F.pmod(F.xxhash64("sample_id"), F.lit(n)))
    place = F.row_number().over(Window.partitionBy("part", "weight").orderBy("sample_id")) - 1
    each = rows.withColumn("place", place).select("part", F.floor(F.col("place") / WORD).alias("word"), F.expr(f"shiftleft(1L, place % {WORD})").alias("bit"), "weight", F.inline("states"))
    return each.groupBy("part", "word", "weight", "locus").agg(*[F.bit_or(F.when(F.col("state") == s, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"s{s}") for s in range(N_STATES)])


def crosstable(cells: DataFrame, weights: DataFrame, first: Column | None = None, second: Column | None = None, init: float = 0.0, dense: bool = True, n_loci: int | None = None) -> DataFrame:
    """locus_i, locus_j, state_i, state_j, weight for pairs of loci (i < j, or as the conditions on locus_i and locus_j say).

    A pair's cell is the number of bits that the bitmaps of its two states share, in each word, times the word's weight. Bitmaps
    of a word meet in tiles of blocks of loci, an equi-join, so a pair takes a row for 64 samples, conditions on one locus are
    applied below the join, and what is shuffled after it is a row for each pair of loci and task. Samples that all have
    different weights fill no words: then a row is made for each sample and pair, no more.
    dense: all 25 combinations of a pair that some sample has, with init added. n_loci: their number, else it is looked up.
    """
    loci = n_loci or (cells.agg(F.max("locus")).first()[0] or 0) + 1
    blocks = -(-loci // BLOCK_LOCI)
    block = F.floor(F.col("locus") / BLOCK_LOCI).cast("int")
    rows = bitmaps(cells, weights)
    tile = lambda k: F.explode(F.sequence(block, F.lit(blocks - 1)) if k == "i" else F.sequence(F.lit(0), block)).alias("far")
    side = lambda k: rows.select("part", "word", "weight", F.col("locus").alias(f"locus_{k}"), *[F.col(f"s{s}").alias(f"{k}{s}") for s in range(N_STATES)], block.alias(f"block_{k}"), tile(k))
    a, b = side("i"), side("j")
    if blocks > 1:  # the left row goes to the blocks from its own on, the right one to those up to its own
        a, b = a.withColumnRenamed("far", "to_block").withColumn("from_block", F.col("block_i")), b.withColumnRenamed("far", "from_block").withColumn("to_block", F.col("block_j"))
        met = a.join(b, ["part", "word", "weight", "from_block", "to_block"])
    else:
        met = a.drop("far").join(b.drop("far"), ["part", "word", "weight"])
    met = met.where("locus_i < locus_j")
    for condition in (first, second):
        if condition is not None:
            met = met.where(condition)
    states = [(x, y) for x in range(N_STATES) for y in range(N_STATES)]
    shared = {(x, y): F.bit_count(F.col(f"i{x}").bitwiseAND(F.col(f"j{y}"))) for x, y in states}
    sums = [F.sum(F.col("weight") * shared[c]).alias(f"w{c[0]}_{c[1]}") for c in states] + [F.sum(shared[c]).alias(f"n{c[0]}_{c[1]}") for c in states]
    wide = met.groupBy("locus_i", "locus_j").agg(*sums)
    each = F.array(*[F.struct(F.lit(x).alias("state_i"), F.lit(y).alias("state_j"), (F.col(f"w{x}_{y}") + init).alias("weight"), F.col(f"n{x}_{y}").alias("n")) for x, y in states])
    found = wide.where(" + ".join(f"n{x}_{y}" for x, y in states) + " > 0").select("locus_i", "locus_j", F.inline(each))
    return (found if dense else found.where("n > 0")).drop("n")


def overlap_weights(left: DataFrame, right: DataFrame, weights: DataFrame) -> DataFrame:
    """i, j, weight: for two lists of disjoint row sets (set_id, sample_id) the summed weight of each non-empty overlap."""
    a, b = left.withColumnRenamed("set_id", "i"), right.withColumnRenamed("set_id", "j")
    return a.join(b, "sample_id").join(weights.select("sample_id", "weight"), "sample_id").groupBy("i", "j").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def zero_sum(matrix: DataFrame, keys: list[str], row: str = "state_i", column: str = "state_j", value: str = "weight") -> DataFrame:
    """Each value less its row's and its column's mean plus the mean of all, within each matrix."""
    mean = lambda *by: F.avg(value).over(Window.partitionBy(*keys, *by))
    return matrix.withColumn("gauged", F.col(value) - mean(row) - mean(column) + mean())
