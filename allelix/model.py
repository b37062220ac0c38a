"""The data model: an alignment is a table of samples by loci, each cell one of five states.

cells   sample_id long, locus int (from 0), state int (0 a, 1 t, 2 c, 3 g, 4 gap)
samples sample_id long, name string, multiplicity long, weight double
loci    ord long, locus long: an ordered list, repeats allowed
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the data format: the symbols of the states 0 to 4, and the loci of a storage block.
SYMBOLS = "atcg-"
N_STATES, GAP, BLOCK = 5, 4, 32

CELLS = "sample_id long, locus int, state int"
SAMPLES = "sample_id long, name string, multiplicity long, weight double"
LOCI = "ord long, locus long"


@dataclass(frozen=True)
class Alignment:
    """Tables of one alignment. translation: loci (ord, locus) in original coordinates, None for the identity."""

    cells: DataFrame
    samples: DataFrame
    name: str = "alignment"
    n_original_positions: int | None = None
    translation: DataFrame | None = None

    def with_weights(self, weights: DataFrame) -> Alignment:
        """weights: sample_id, weight."""
        return replace(self, samples=self.samples.drop("weight").join(weights.select("sample_id", "weight"), "sample_id", "left"))

    def n_loci(self) -> int:
        return (self.cells.agg(F.max("locus")).first()[0] or -1) + 1


def samples_of(cells: DataFrame) -> DataFrame:
    """Samples named by their ids, with multiplicity and weight 1."""
    return cells.select("sample_id").distinct().select("sample_id", F.col("sample_id").cast("string").alias("name"), F.lit(1).cast("long").alias("multiplicity"), F.lit(1.0).alias("weight"))
