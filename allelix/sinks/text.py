"""Text forms of alignments, lists and matrices; each returns rows (place, line) that ``write_lines`` puts in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.states import to_symbol
from ..model import N_STATES
from ..operators.blocks import sequences_of
from ..operators.triangle import distance_texts
from .files import write_free


def write_lines(lines: DataFrame, path: str, *place: str) -> str:
    """One text file a range of places, in order over all files, in a folder of the first free name, which is returned."""
    return write_free(lines.orderBy(*place).select("line"), path)


def fasta(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """sample_id, line: ``>name`` and the sequence in lower case, on two lines."""
    rows = sequences_of(cells, to_symbol(F.col("state")))
    return samples.join(rows, "sample_id", "left").select("sample_id", F.concat(F.lit(">"), "name", F.lit("\n"), F.coalesce("sequence", F.lit(""))).alias("line"))


def sequence_lines(sequences: DataFrame) -> DataFrame:
    """sample_id, line: as fasta(), of whole sequences (sample_id, sequence), named by their ids."""
    return sequences.select("sample_id", F.concat(F.lit(">"), F.col("sample_id").cast("string"), F.lit("\n"), F.coalesce("sequence", F.lit(""))).alias("line"))


def loci_lines(loci: DataFrame, base: int = 1) -> DataFrame:
    return loci.select("ord", (F.col("locus") + base).cast("string").alias("line"))


def weight_lines(weights: DataFrame) -> DataFrame:
    return weights.select("sample_id", F.format_string("%.8e", F.col("weight")).alias("line"))


def six_digits(x: Column) -> Column:
    """A number with six significant digits and no zeros at its end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", x.cast("double")), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def frequency_lines(freq: DataFrame, value: str = "freq") -> DataFrame:
    """locus, line: the five states' numbers, each followed by a space."""
    shown = [F.max(F.when(F.col("state") == s, F.col(value))) for s in range(N_STATES)]
    return freq.groupBy("locus").agg(F.concat(*[x for s in shown for x in (six_digits(s), F.lit(" "))]).alias("line"))


def phandango(cells: DataFrame, samples: DataFrame, loci: DataFrame, base: int = 1) -> DataFrame:
    """place, line: a header of loci and a line of symbols for each sample; the first locus stands again at the end."""
    head = loci.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "locus"))), lambda x: F.concat(F.lit('"L'), (x["locus"] + base).cast("string"), F.lit(':o1"'))).alias("h"))
    header = head.select(F.lit(-1).cast("long").alias("place"), F.concat_ws(",", F.lit('"locus"'), F.array_join("h", ","), F.element_at("h", 1)).alias("line"))
    symbols = F.transform(F.array_sort(F.collect_list(F.struct("locus", "state"))), lambda x: F.concat(F.lit('"'), to_symbol(x["state"]), F.lit('"')))
    rows = cells.groupBy("sample_id").agg(symbols.alias("s")).join(samples, "sample_id")
    lines = rows.select(F.col("sample_id").alias("place"), F.concat_ws(",", F.concat(F.lit('"'), "name", F.lit('"')), F.array_join("s", ","), F.element_at("s", 1)).alias("line"))
    return header.unionByName(lines)


def triangle(distances: DataFrame, samples: DataFrame) -> DataFrame:
    """place, line: row i has the distances to all samples before it, each followed by a space; row 0, which has none, is the line ``n=``."""
    n = samples.agg(F.count("*").alias("n"), F.min("sample_id").alias("first"))
    rows = distances.groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "distance"))), lambda x: F.concat(x["distance"].cast("string"), F.lit(" "))), "").alias("row"))
    named = samples.join(rows, samples["sample_id"] == rows["i"], "left").crossJoin(F.broadcast(n))
    head = F.when(F.col("sample_id") == F.col("first"), F.concat(F.lit("n="), F.col("n").cast("string"))).otherwise("")
    return named.select(F.col("sample_id").alias("place"), F.concat(head, F.coalesce("row", F.lit(""))).alias("line"))


def distance_triangle(cells: DataFrame, samples: DataFrame, n_loci: int) -> DataFrame:
    """As triangle() of all distances of the cells, without a table of pairs; samples has every sample of the cells."""
    n = samples.agg(F.count("*").alias("n"), F.min("sample_id").alias("first"))
    bare = samples.join(cells.select("sample_id").distinct(), "sample_id", "left_anti").select("sample_id", F.lit("").alias("row"))
    named = distance_texts(cells, n_loci).unionByName(bare).crossJoin(F.broadcast(n))
    head = F.when(F.col("sample_id") == F.col("first"), F.concat(F.lit("n="), F.col("n").cast("string"))).otherwise("")
    return named.select(F.col("sample_id").alias("place"), F.concat(head, "row").alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """i, j, line: the two nodes, the weight with six digits, and the flag, separated by spaces."""
    return edges.select("i", "j", F.concat_ws(" ", "i", "j", six_digits(F.col("weight")), F.col("flag").cast("int")).alias("line"))
