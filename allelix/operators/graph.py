"""Weighted edge lists over loci."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import circular_distance, linear_distance
from .select import numbered


def build(pairs: DataFrame, i: str = "i", j: str = "j", weight: str = "weight", flag: Column | None = None) -> DataFrame:
    """Edges with the smaller node first."""
    return pairs.select(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), F.col(weight).cast("double").alias("weight"), (F.lit(False) if flag is None else flag).alias("flag"))


def ordered(edges: DataFrame) -> DataFrame:
    """Heaviest first; ties by the second node, then the first."""
    return edges.orderBy(F.desc("weight"), "j", "i")


def joined(*graphs: DataFrame) -> DataFrame:
    """All edges of all graphs, repeats kept."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out


def nodes(edges: DataFrame, condition: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """The distinct end points of the edges that meet the condition."""
    rows = edges if condition is None else edges.where(condition(edges))
    return rows.select(F.explode(F.array("i", "j")).alias("locus")).distinct()


def ordered_nodes(edges: DataFrame, condition: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """ord, locus: nodes() in ascending order, numbered."""
    return numbered(nodes(edges, condition))


def found(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The edges between the pairs of nodes (a, b) that are wanted, whichever of the two comes first; each edge once."""
    pairs = wanted.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    return edges.join(pairs, ["i", "j"], "left_semi").select("i", "j", "weight", "flag")


def output(edges: DataFrame, translation: DataFrame, size: int, base: int = 1, linear: bool = False) -> DataFrame:
    """pos1, pos2, distance, flag, weight: end points in original coordinates, and how far apart they are."""
    a = translation.select(F.col("ord").alias("i"), F.col("locus").alias("p"))
    b = translation.select(F.col("ord").alias("j"), F.col("locus").alias("q"))
    apart = linear_distance(F.col("p"), F.col("q")) if linear else circular_distance(F.col("p"), F.col("q"), F.lit(size))
    return edges.join(a, "i").join(b, "j").select((F.col("p") + base).alias("pos1"), (F.col("q") + base).alias("pos2"), apart.alias("distance"), F.col("flag").cast("int").alias("flag"), F.format_string("%.6f", "weight").alias("weight"))
