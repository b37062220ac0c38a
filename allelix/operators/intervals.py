"""Sets of whole numbers as intervals: fusion, intersection and difference without listing a member, and the hybrid text form.

A table (set_id, first, last) has closed intervals, as many a set as wanted, which may overlap, touch, lie in each other or be
empty (last < first: no members). An operator sweeps over the interval ends: an interval counts +1 at its first number and -1
after its last, equal places are added up first, and the running sum tells how many intervals of each operand cover a stretch.
The running sum is made in chunks of a set, so that large sets are cut over tasks. Results are in normal form: disjoint intervals that do not touch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_chunks

#: Members of a window of the hybrid text form (a fixed value of the format).
WIDE = 32


def _ends(ranges: DataFrame, mine: int) -> DataFrame:
    """set_id, at, x, y: the steps at an interval's ends, in x for the first operand and in y for the second."""
    step = lambda at, by: F.struct(at.cast("long").alias("at"), *[F.lit(by * (k == mine)).cast("long").alias(c) for k, c in enumerate("xy")])
    return ranges.where("last >= first").select("set_id", F.inline(F.array(step(F.col("first"), 1), step(F.col("last") + 1, -1))))


def swept(a: DataFrame, b: DataFrame | None, inside: Callable[[Column, Column], Column]) -> DataFrame:
    """set_id, first, last: the maximal stretches where inside(in a, in b) holds; it must not hold outside of both."""
    ends = _ends(a, 0) if b is None else _ends(a, 0).unionByName(_ends(b, 1))
    steps = ends.groupBy("set_id", "at").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).where("x <> 0 OR y <> 0")
    depth = running_chunks(steps, "at", {"in_x": F.col("x"), "in_y": F.col("y")}, ["set_id"])
    now = inside(F.col("in_x") > 0, F.col("in_y") > 0)
    was = inside(F.col("in_x") - F.col("x") > 0, F.col("in_y") - F.col("y") > 0)
    turns = depth.where(now != was).select("set_id", "at", now.alias("begins"))
    # Beginnings and ends alternate, so both of a stretch have seen as many beginnings.
    placed = running_chunks(turns, "at", {"stretch": F.when(F.col("begins"), 1).otherwise(0)}, ["set_id"])
    return placed.groupBy("set_id", "stretch").agg(F.min("at").alias("first"), (F.max("at") - 1).alias("last")).drop("stretch")


def fused(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """The normal form of a, or of a and b together."""
    return swept(a, b, lambda x, y: x | y)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return swept(a, b, lambda x, y: x & y)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return swept(a, b, lambda x, y: x & ~y)


def sizes(ranges: DataFrame) -> DataFrame:
    """set_id, members, pieces of intervals in normal form."""
    return ranges.groupBy("set_id").agg(F.sum(F.col("last") - F.col("first") + 1).alias("members"), F.count("*").alias("pieces"))


def _hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def hybrid_pieces(ranges: DataFrame) -> DataFrame:
    """set_id, window, until, bits from intervals in normal form, none below 0: runs of full windows up to ``until``, which is not of
    the run, and bit fields of the windows that have some members.
    """
    first, last = F.col("first"), F.col("last")
    low, high = F.floor(first / WIDE), F.floor(last / WIDE)
    whole_from, whole_to = F.floor((first + WIDE - 1) / WIDE), F.floor((last + 1) / WIDE)
    field = lambda w: F.struct(w.alias("window"), F.greatest(first - w * WIDE, F.lit(0)).alias("a"), F.least(last - w * WIDE, F.lit(WIDE - 1)).alias("b"))
    # A window at either end of the interval is in part inside unless the whole windows have it.
    parts = F.filter(F.array_distinct(F.array(field(low), field(high))), lambda p: (p["window"] < whole_from) | (p["window"] >= whole_to))
    ones = F.expr("shiftleft(shiftleft(1L, cast(b - a + 1 AS int)) - 1L, cast(a AS int))")
    fields = ranges.select("set_id", F.inline(parts)).groupBy("set_id", "window").agg(F.bit_or(ones).alias("bits")).select("set_id", "window", F.lit(None).cast("long").alias("until"), "bits")
    runs = ranges.where(whole_from < whole_to).select("set_id", whole_from.alias("window"), whole_to.alias("until"), F.lit(None).cast("long").alias("bits"))
    return runs.unionByName(fields)


def hybrid_text(ranges: DataFrame) -> DataFrame:
    """set_id, text: the pieces in order, in hexadecimal, ``begin-end`` (end not included) or ``begin:bits``, separated by commas."""
    begin = _hex(F.col("window") * WIDE)
    shown = F.when(F.col("bits").isNull(), F.concat(begin, F.lit("-"), _hex(F.col("until") * WIDE))).otherwise(F.concat(begin, F.lit(":"), _hex(F.col("bits"))))
    each = hybrid_pieces(ranges).select("set_id", F.struct("window", shown.alias("t")).alias("p"))
    return each.groupBy("set_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), ",").alias("text"))


def from_hybrid_text(texts: DataFrame) -> DataFrame:
    """The intervals of hybrid_text(), in normal form. An item that is neither form raises."""
    number = lambda t: F.conv(t, 16, 10).cast("long")
    items = texts.select("set_id", F.explode(F.filter(F.split("text", ","), lambda t: t != "")).alias("item"))
    good = F.when(F.col("item").rlike("^[0-9a-f]+[-:][0-9a-f]+$"), F.col("item")).otherwise(F.raise_error(F.concat(F.lit("no piece of a set: "), "item")).cast("string"))
    pieces = items.select("set_id", good.alias("item")).select("set_id", F.contains("item", F.lit(":")).alias("field"), number(F.regexp_extract("item", "^[^-:]+", 0)).alias("begin"), number(F.regexp_extract("item", "[^-:]+$", 0)).alias("value"))
    runs = F.array(F.struct(F.col("begin").alias("first"), (F.col("value") - 1).alias("last")))
    # A run of a field begins at a bit with none below it, and ends at one with none above; as many begin as end, in order.
    bits = f"(value & {(1 << WIDE) - 1}L)"
    at = lambda where: F.expr(f"filter(sequence(0, {WIDE - 1}), k -> (shiftright({where}, k) & 1L) = 1L)")
    begins, ends = at(f"({bits} & ~shiftleft({bits}, 1))"), at(f"({bits} & ~shiftright({bits}, 1))")
    single = F.zip_with(begins, ends, lambda x, y: F.struct((F.col("begin") + x).alias("first"), (F.col("begin") + y).alias("last")))
    return fused(pieces.select("set_id", F.inline(F.when(F.col("field"), single).otherwise(runs))))
