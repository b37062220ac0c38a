"""Counts, frequencies, entropies and presence of states at each locus.

All are one partial aggregation by locus with a conditional sum for each state, so the shuffle carries one row for
each locus and task however many samples there are, and states that never occur are counted as 0 without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import guarded_xlogx
from ..model import GAP, N_STATES


def _by_state(cells: DataFrame, value: Column, name: str) -> DataFrame:
    """locus, state, name: the sum of value for each state, five rows a locus."""
    wide = cells.groupBy("locus").agg(*[F.sum(F.when(F.col("state") == s, value).otherwise(F.lit(0).cast("double" if name == "weight" else "long"))).alias(f"s{s}") for s in range(N_STATES)])
    each = F.array(*[F.struct(F.lit(s).alias("state"), F.col(f"s{s}").alias(name)) for s in range(N_STATES)])
    return wide.select("locus", F.inline(each))


def counts(cells: DataFrame) -> DataFrame:
    return _by_state(cells, F.lit(1).cast("long"), "n")


def frequencies(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Counts over the number of samples, those without a cell included; 0 where there is none."""
    n = samples.agg(F.count("*").alias("samples"))
    return counts(cells).crossJoin(F.broadcast(n)).select("locus", "state", "n", F.when(F.col("samples") > 0, F.col("n") / F.col("samples")).otherwise(0.0).alias("freq"))


def occurrences(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Counts with each sample's multiplicity."""
    return _by_state(cells.join(samples.select("sample_id", "multiplicity"), "sample_id"), F.col("multiplicity"), "n")


def weighted_counts(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Sums of weight times multiplicity."""
    weighed = samples.select("sample_id", (F.col("weight") * F.col("multiplicity")).alias("w"))
    return _by_state(cells.join(weighed, "sample_id"), F.col("w"), "weight")


def effective_size(samples: DataFrame) -> DataFrame:
    return samples.agg(F.sum(F.col("multiplicity") * F.col("weight")).alias("neff"))


def weighted_frequencies(cells: DataFrame, samples: DataFrame, pseudocount: float = 0.0) -> DataFrame:
    """(weighted count + pseudocount) / (effective size + pseudocount * states)."""
    size = F.broadcast(effective_size(samples))
    return weighted_counts(cells, samples).crossJoin(size).select("locus", "state", ((F.col("weight") + pseudocount) / (F.col("neff") + pseudocount * N_STATES)).alias("freq"))


def entropies(cells: DataFrame, samples: DataFrame, pseudocount: float = 0.0) -> DataFrame:
    """locus, entropy: in natural units over all five states, the gap included."""
    return weighted_frequencies(cells, samples, pseudocount).groupBy("locus").agg((-F.sum(guarded_xlogx(F.col("freq")))).alias("entropy"))


def presence(cells: DataFrame) -> DataFrame:
    """For each locus a mask of the states that occur, their number, the mask without the gap, and the gap's bit."""
    mask = cells.groupBy("locus").agg(F.bit_or(F.expr("shiftleft(1, state)")).alias("mask"))
    return mask.select("locus", "mask", F.bit_count("mask").cast("int").alias("n_states"), F.col("mask").bitwiseAND(F.lit((1 << GAP) - 1)).alias("mask_wo_gap"), F.col("mask").bitwiseAND(F.lit(1 << GAP)).alias("gap_bit"))


def state_distribution(cells: DataFrame) -> DataFrame:
    """n_states, positions, polymorphic: how many loci have so many states, and whether that is more than one."""
    return presence(cells).groupBy("n_states").agg(F.count("*").alias("positions")).select("n_states", "positions", (F.col("n_states") > 1).alias("polymorphic"))
