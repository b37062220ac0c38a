"""FASTA files, plain, gzip or xz."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.states import normal_sequence
from ..model import Alignment, samples_of
from . import xz
from .lines import lines_of_pieces, records_of_lines


def _records(lines: DataFrame) -> DataFrame:
    """file, offset, name, body: records from (file, offset, value), split again at each > that begins or stands in a body."""
    # The text reader cuts at line end and >. The first record keeps its >; a > inside a body line starts one too.
    text = F.regexp_replace("value", "^>", "")
    head = F.substring_index(text, "\n", 1)
    body = F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise("")
    whole = lines.where(F.length("value") > 0).select("file", "offset", head.alias("head"), F.split(body, ">", -1).alias("parts"))
    each = whole.select("file", "offset", F.posexplode("parts").alias("part", "text"), "head")
    name = F.when(F.col("part") == 0, F.col("head")).otherwise(F.substring_index("text", "\n", 1))
    rest = F.when(F.col("part") == 0, F.col("text")).otherwise(F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(""))
    return each.select("file", "offset", "part", name.alias("name"), F.regexp_replace(rest, r"[ \t\n\x0B\f\r]", "").alias("body"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, name, body: records numbered in file order."""
    if path.endswith(".xz"):
        return records_of_lines(lines_of_pieces(xz.read_pieces(spark, path)))
    raw = spark.read.option("lineSep", "\n>").text(path)
    records = _records(raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("offset"), "value"))
    # Ids follow (file, place): numbered within the file's splits first, then by the splits' sizes.
    part = F.shiftright("offset", 33)
    within = F.row_number().over(Window.partitionBy("file", "split").orderBy("offset", "part"))
    placed = records.withColumn("split", part).withColumn("within", within)
    sizes = placed.groupBy("file", "split").agg(F.count("*").alias("size"))
    before = sizes.select("file", "split", (F.sum("size").over(Window.orderBy("file", "split")) - F.col("size")).alias("before"))
    return placed.join(F.broadcast(before), ["file", "split"]).select((F.col("before") + F.col("within") - 1).alias("sample_id"), "name", "body")


def normal_sequences(records: DataFrame) -> DataFrame:
    """sample_id, name, sequence: records in normal symbols, as whole texts."""
    return records.select("sample_id", "name", normal_sequence(F.col("body")).alias("sequence"))


def alignment_of(records: DataFrame, name: str = "alignment", genome_size: int = 0, strict: bool = False) -> Alignment:
    """An alignment from sample_id, name, body. The number of loci is the greatest length; strict: lengths must be equal."""
    sequences = normal_sequences(records)
    bounds = sequences.agg(F.count("*").alias("n"), F.max(F.length("sequence")).alias("most"), F.min(F.length("sequence")).alias("least")).first()
    if not bounds["n"]:
        raise ValueError(f"{name} has no sequences")
    if strict and bounds["most"] != bounds["least"]:
        raise ValueError(f"{name} has sequences of {bounds['least']} to {bounds['most']} loci")
    from ..fixtures import sequence_cells

    samples = sequences.select("sample_id", "name", F.lit(1).cast("long").alias("multiplicity"), F.lit(1.0).alias("weight"))
    return Alignment(sequence_cells(sequences), samples, name, genome_size or bounds["most"])


def read_alignment(spark: SparkSession, path: str, genome_size: int = 0, strict: bool = False) -> Alignment:
    """The alignment of a FASTA file, named by the file without its extensions."""
    stem = os.path.basename(path)
    for end in (".gz", ".xz"):
        stem = stem.removesuffix(end)
    return alignment_of(read_records(spark, path), stem.rsplit(".", 1)[0], genome_size, strict)


def read_alignments(spark: SparkSession, paths: list[str], most: int = 1, mapping: DataFrame | None = None, **options) -> list[Alignment]:
    """Alignments of several files; the mapping (ord, locus), of as many entries as loci, belongs to the first."""
    from dataclasses import replace

    if not paths:
        raise ValueError("no alignment file")
    if len(paths) > most:
        raise ValueError(f"{len(paths)} alignment files; at most {most}")
    found = [read_alignment(spark, p, **options) for p in paths]
    if mapping is not None:
        if (n := mapping.count()) != (loci := found[0].n_loci()):
            raise ValueError(f"the mapping list has {n} entries, the alignment {loci} loci")
        found[0] = replace(found[0], translation=mapping)
    return found


def save(alignment: Alignment, path: str) -> None:
    """The alignment's tables as Parquet below path."""
    alignment.cells.write.mode("overwrite").parquet(f"{path}/cells")
    alignment.samples.write.mode("overwrite").parquet(f"{path}/samples")
    if alignment.translation is not None:
        alignment.translation.write.mode("overwrite").parquet(f"{path}/translation")
    facts = [(alignment.name, alignment.n_original_positions, alignment.translation is not None)]
    alignment.cells.sparkSession.createDataFrame(facts, FACTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


FACTS = "name string, n_original_positions int, translated boolean"


def load(spark: SparkSession, path: str, name: str | None = None) -> Alignment:
    """What save() wrote; name: another name for it."""
    facts = spark.read.schema(FACTS).parquet(f"{path}/facts").first()
    translation = spark.read.parquet(f"{path}/translation") if facts["translated"] else None
    return Alignment(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/samples"), name or facts["name"], facts["n_original_positions"], translation)


__all__ = ["alignment_of", "load", "read_alignment", "read_alignments", "read_records", "records_of_lines", "samples_of", "save"]
