"""Sets of integers, as sorted arrays in columns and as long tables (set_id, member); run-length codes and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import fused


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def split(a: Column, b: Column) -> Column:
    """What only a has, what only b has, and what both have."""
    return F.struct(difference(a, b).alias("only_a"), difference(b, a).alias("only_b"), intersection(a, b).alias("both"))


def union_all(sets: DataFrame, group: str) -> DataFrame:
    """group, member: the union of all sets of a group, from long tables (group, member)."""
    return sets.select(group, "member").distinct()


def gather(sets: DataFrame, weights: DataFrame) -> DataFrame:
    """set_id, weight: the summed weight of each set's members."""
    return sets.join(weights, "member").groupBy("set_id").agg(F.sum("weight").alias("weight"))


def gather_parts(left: DataFrame, right: DataFrame, weights: DataFrame) -> DataFrame:
    """set_id, only_a, only_b, both: the summed weights of the left sets' members that the right set of the same id lacks, the other way
    round, and of the members of both; for sets that are on both sides. Long tables: a set may be of any size.
    """
    sides = left.select("set_id", "member", F.lit(1).alias("side")).unionByName(right.select("set_id", "member", F.lit(2).alias("side")))
    each = sides.groupBy("set_id", "member").agg(F.bit_or("side").alias("side")).join(weights, "member")
    part = lambda k: F.sum(F.when(F.col("side") == k, F.col("weight")).otherwise(0.0))
    both = each.groupBy("set_id").agg(part(1).alias("only_a"), part(2).alias("only_b"), part(3).alias("both"), F.bit_or("side").alias("sides"))
    return both.where("sides = 3").drop("sides")


def ranges(sets: DataFrame) -> DataFrame:
    """set_id, first, last: runs of consecutive members. A set may hold any share of all members."""
    return fused(sets.select("set_id", F.col("member").alias("first"), F.col("member").alias("last")))


def range_text(sets: DataFrame) -> DataFrame:
    """set_id, text: the runs in hexadecimal, ``a-b`` or ``c``, separated by commas."""
    return text_of(ranges(sets))


def text_of(ranges: DataFrame) -> DataFrame:
    """range_text() from intervals in normal form."""
    shown = F.lower(F.when(F.col("first") == F.col("last"), F.hex("first")).otherwise(F.concat(F.hex("first"), F.lit("-"), F.hex("last"))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", shown.alias("t")))), lambda x: x["t"]), ",")
    return ranges.groupBy("set_id").agg(joined.alias("text"))


def members_of_text(text: Column) -> Column:
    """The members of a range_text(), as an array in the order of the text."""
    number = lambda t: F.conv(t, 16, 10).cast("long")
    return F.flatten(F.transform(F.filter(F.split(text, ","), lambda t: t != ""), lambda t: F.sequence(number(F.split_part(t, F.lit("-"), F.lit(1))), number(F.split_part(t, F.lit("-"), F.lit(-1))))))


def run_lengths(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """group, run, value, count: consecutive equal values in order."""
    w = Window.partitionBy(group).orderBy(*order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w) - 1)
    return runs.groupBy(group, "run", value).agg(F.count("*").alias("count"))


def decoded(runs: DataFrame, group: str, value: str) -> DataFrame:
    """group, place, value from the runs."""
    w = Window.partitionBy(group).orderBy("run")
    before = F.sum("count").over(w) - F.col("count")
    return runs.withColumn("before", before).select(group, F.explode(F.sequence(F.col("before"), F.col("before") + F.col("count") - 1)).alias("place"), value)
