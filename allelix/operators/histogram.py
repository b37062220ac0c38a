"""Histograms of numbers with count, mean and variance for each bin, and moments over the bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(values: DataFrame, value: str, binwidth: float = 0.001, skip_zeros: bool = True) -> DataFrame:
    """bin, cnt, mean, variance of the non-empty bins: bin is value / binwidth, rounded half away from zero."""
    rows = values.where(F.col(value) != 0) if skip_zeros else values
    bins = F.round(F.col(value) / F.lit(binwidth)).cast("long")
    return rows.groupBy(bins.alias("bin")).agg(F.count(value).alias("cnt"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def moments(bins: DataFrame, compat: bool = False) -> DataFrame:
    """One row: cnt, bincount, mean, variance, std over the bins.

    compat: sums divided by one less than the count, as in the original formulas, instead of the sample moments.
    """
    n = F.sum("cnt")
    over = F.greatest(n - 1, F.lit(1)) if compat else n
    sums = bins.agg(n.alias("cnt"), F.count("*").alias("bincount"), (F.sum(F.col("mean") * F.col("cnt")) / over).alias("mean"), (F.sum((F.col("variance") + F.col("mean") * F.col("mean")) * F.col("cnt")) / over).alias("square"))
    variance = F.col("square") - F.col("mean") * F.col("mean")
    return sums.select("cnt", "bincount", "mean", variance.alias("variance"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"))


def cumulative(bins: DataFrame) -> DataFrame:
    """bins with running: the count of the bin and all lower ones. A histogram has few bins, so one window orders them."""
    return bins.withColumn("running", F.sum("cnt").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def csv_lines(bins: DataFrame, binwidth: float) -> DataFrame:
    """bin, line: mean count variance mean/std share of each bin, three decimals, separated by spaces."""
    total = F.sum("cnt").over(Window.partitionBy())
    std = F.sqrt("variance")
    shown = [F.format_string("%.3f", x.cast("double")) for x in (F.col("mean"), F.col("cnt"), F.col("variance"), F.when(std > 0, F.col("mean") / std).otherwise(0.0), F.col("cnt") / total * binwidth)]
    return bins.select("bin", F.concat_ws(" ", *shown).alias("line"))
