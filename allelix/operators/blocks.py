"""The block dictionary: for each strip of 32 loci the distinct words of states, and the samples that carry each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import BLOCK
from . import intervals


def words(sequences: DataFrame) -> DataFrame:
    """sample_id, block, word: the sequences cut into strips."""
    last = F.floor((F.length("sequence") - 1) / BLOCK).cast("int")
    each = sequences.where(F.length("sequence") > 0).select("sample_id", "sequence", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    return each.select("sample_id", "block", F.substring(F.col("sequence"), F.col("block") * BLOCK + 1, F.lit(BLOCK)).alias("word"))


def sequences_of(cells: DataFrame, symbol: Column | None = None) -> DataFrame:
    """sample_id, sequence: the states as digits (or symbols) in order of locus."""
    shown = F.col("state").cast("string") if symbol is None else symbol
    ordered = F.array_sort(F.collect_list(F.struct("locus", shown.alias("s"))))
    return cells.groupBy("sample_id").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "").alias("sequence"))


def dictionary(strips: DataFrame) -> DataFrame:
    """block, word, first_sample, carriers: one row for each distinct word of a strip.

    The carriers' ids stay in the words table (block, word, sample_id), which is the long form of the row sets.
    """
    return strips.groupBy("block", "word").agg(F.min("sample_id").alias("first_sample"), F.count("*").alias("carriers"))


def word_numbers(strips: DataFrame) -> DataFrame:
    """sample_id, block, word_number: each strip's words numbered by the first sample that carries them."""
    numbered = dictionary(strips).withColumn("word_number", F.row_number().over(Window.partitionBy("block").orderBy("first_sample")) - 1)
    return strips.join(numbered.select("block", "word", "word_number"), ["block", "word"]).select("sample_id", "block", "word_number")


def statistics(strips: DataFrame) -> DataFrame:
    """One row: distinct words over all strips; least, mean (whole), median and most of a strip; strips; bytes of 32 states a word
    against those of all rows.
    """
    per = strips.groupBy("block").agg(F.count_distinct("word").alias("n"), F.count("*").alias("rows"))
    place = F.row_number().over(Window.orderBy("n", "block")) - 1
    size = F.count("*").over(Window.partitionBy())
    ranked = per.withColumn("place", place).withColumn("size", size)
    middle = F.floor(F.col("size") / 2) - F.when(F.col("size") % 2 == 1, 1).otherwise(0)
    found = ranked.agg(F.sum("n").alias("words"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.when(F.col("place") == F.greatest(middle, F.lit(0)), F.col("n"))).alias("median"), F.count("*").alias("strips"), F.sum("rows").alias("all_words"))
    return found.select("words", "least", F.floor(F.col("words") / F.col("strips")).alias("mean"), "median", "most", "strips", (F.col("words") * BLOCK).alias("bytes"), (F.col("words") / F.col("all_words")).alias("ratio"))


def compression(strips: DataFrame) -> DataFrame:
    """One row: states, bytes of the distinct words (a byte a state), bytes of the sets of their carriers in hybrid pieces (eight each),
    uncompressed over compressed bytes, and bits for each state.
    """
    sets = strips.select(F.concat_ws(":", "block", "word").alias("set_id"), F.col("sample_id").alias("first"), F.col("sample_id").alias("last"))
    index = intervals.hybrid_pieces(intervals.fused(sets)).agg((F.count("*") * 8).alias("index_bytes"))
    words_ = strips.select("block", "word").distinct().agg((F.count("*") * BLOCK).alias("word_bytes"))
    found = strips.agg(F.coalesce(F.sum(F.length("word").cast("long")), F.lit(0)).alias("states")).crossJoin(F.broadcast(words_)).crossJoin(F.broadcast(index))
    size = F.col("word_bytes") + F.col("index_bytes")
    return found.select("states", "word_bytes", "index_bytes", F.try_divide("states", size).alias("ratio"), F.try_divide(size * 8, "states").alias("bits_per_state"))
