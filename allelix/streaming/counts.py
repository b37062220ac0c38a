"""State counts over streams of cells: counts are sums, so an aggregate in update or complete mode keeps them current."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.frequencies import counts


def state_counts(stream: DataFrame) -> DataFrame:
    """locus, state, n of a stream of cells; write it in complete or update mode."""
    return counts(stream)
