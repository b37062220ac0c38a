"""Projections on loci and samples, filters, and ordered lists of loci."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import Threshold
from ..model import GAP
from . import frequencies as freq
from . import running


def subset(cells: DataFrame, loci: DataFrame) -> DataFrame:
    """The listed loci in the order of the list, repeats kept; a cell's new locus is its place in the list."""
    return cells.join(loci, "locus").select("sample_id", F.col("ord").cast("int").alias("locus"), "state")


def include(cells: DataFrame, loci: DataFrame) -> DataFrame:
    return cells.join(loci.select("locus"), "locus", "left_semi").select("sample_id", "locus", "state")


def exclude(cells: DataFrame, loci: DataFrame) -> DataFrame:
    return cells.join(loci.select("locus"), "locus", "left_anti").select("sample_id", "locus", "state")


def between(cells: DataFrame, begin: int, end: int | None = None) -> DataFrame:
    """The loci from begin on, up to and with end."""
    return cells.where((F.col("locus") >= begin) & (F.lit(True) if end is None else F.col("locus") <= end))


def subsample(cells: DataFrame, samples: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells and samples of the chosen (ord, sample_id), renumbered by the list; weights start again at 1."""
    rows = cells.join(chosen, "sample_id").select(F.col("ord").alias("sample_id"), "locus", "state")
    named = samples.join(chosen, "sample_id").select(F.col("ord").alias("sample_id"), "name", "multiplicity", F.lit(1.0).alias("weight"))
    return rows, named


def keep_samples(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """The cells of the chosen samples under their own ids."""
    return cells.join(chosen.select("sample_id"), "sample_id", "left_semi").select("sample_id", "locus", "state")


def snp_filter(cells: DataFrame, samples: DataFrame, maf: float = 0.01, gap: float = 0.15, rule: Threshold | Callable[[Column], Column] = Threshold(">1"), maf_strict: bool = False) -> DataFrame:
    """Loci where the number of states other than the gap with a frequency of at least maf meets the rule, and the gap's is at most gap.

    Frequencies are over samples, those without a cell included. With a maf of 0 every state meets it, absent ones too, so that all
    loci pass; maf_strict: a state must occur.
    """
    f = freq.frequencies(cells, samples)
    common = (F.col("freq") >= maf) & (F.col("n") > 0) if maf_strict else F.col("freq") >= maf
    per = f.groupBy("locus").agg(F.count_if((F.col("state") != GAP) & common).alias("significant"), F.max(F.when(F.col("state") == GAP, F.col("freq"))).alias("gaps"))
    return per.where(rule(F.col("significant")) & (F.col("gaps") <= gap)).select("locus")


def entropy_filter(cells: DataFrame, samples: DataFrame, threshold: float, pseudocount: float = 0.0) -> DataFrame:
    return freq.entropies(cells, samples, pseudocount).where(F.col("entropy") > threshold).select("locus")


def filter_name(maf: float, gap: float, rule: str = "gt01") -> str:
    return f"filtered_ge{int(maf * 100):03d}maf_le{int(gap * 100):03d}gf_{rule}-lt05states"


def entropy_filter_name(threshold: float) -> str:
    return f"entropy_gt{int(threshold * 1e6):06d}"


def numbered(loci: DataFrame) -> DataFrame:
    """ord, locus in ascending order of the distinct loci given."""
    rows = running.running_chunks(loci.select(F.col("locus").cast("long").alias("locus")), "locus", {"n": F.lit(1)})
    return rows.select((F.col("n") - 1).alias("ord"), "locus")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Items of the left list that the right one lacks; order and repeats kept."""
    return left.join(right.select("locus"), "locus", "left_anti").select("ord", "locus")


def combine(left: DataFrame, right: DataFrame) -> DataFrame:
    """left[right[k]] for each k."""
    inner = right.select("ord", F.col("locus").alias("at"))
    return inner.join(left.select(F.col("ord").alias("at"), "locus"), "at").select("ord", "locus")
