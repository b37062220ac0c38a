"""Running sums in order over a whole table or inside groups, and what follows from them: numbering, and joining tables by place.

The order is cut into chunks of bounded size; each chunk is summed alone and begins with the sums of all chunks before it, a
row a chunk. So no task holds a whole order, and a group that holds a large share of the rows is cut like any other. Where
the order is a whole number its chunks are known (``running_chunks``, one reading of the table); any other order is dealt by
ranges (``running``), whose bounds come from a sample of a fixed number of rows, so what it reads should be a table, not a long
computation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a chunk, and rows read for each bound of a range.
CHUNK, SAMPLED = 1 << 16, 20


def running_chunks(rows: DataFrame, order: str, sums: dict[str, Column], group: list[str] | None = None, before: list[str] | None = None) -> DataFrame:
    """rows with a column for each of sums: the sum of its whole numbers in this row and all before it, in order of the number in
    column order (which tells all rows of a group apart), inside each group, or over all rows in order of the columns before.
    """
    group, before = group or [], before or []
    keys = [*group, *before, "_chunk"]
    # One key, never null, for the window, the totals and the join: the rows are dealt once, and stay.
    cut = rows.withColumn("_chunk", F.struct(*group, *before, F.floor(F.col(order) / CHUNK).alias("_chunk")))
    upto = Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = cut.withColumns({name: F.sum(x.cast("long")).over(upto) for name, x in sums.items()})
    totals = cut.groupBy("_chunk").agg(*[F.sum(x.cast("long")).alias(name) for name, x in sums.items()])
    part = {k: F.col("_chunk").getField(k) for k in keys}
    earlier = Window.partitionBy(*[part[k] for k in group]).orderBy(*[part[k] for k in keys[len(group) :]]).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_chunk", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    met = each.join(carried, "_chunk")
    return met.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_chunk", *[f"_{name}" for name in sums])


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """As running_chunks over all rows, for an order of any columns that tell all rows apart."""
    spark, n = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The bounds are values of the driver, so that every reading of the rows is cut alike.
    some = rows.select(*order).orderBy(F.xxhash64(*order), *order).limit(SAMPLED * n).orderBy(*order)
    bounds = [tuple(r) for r in some.collect()][SAMPLED - 1 :: SAMPLED]
    kind = rows.select(F.array(F.struct(*order)).alias("_bounds")).schema
    held = F.broadcast(spark.createDataFrame([(bounds,)], kind))
    dealt = rows.crossJoin(held).withColumn("_range", F.size(F.filter("_bounds", lambda x: x < F.struct(*order)))).drop("_bounds")
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = dealt.withColumns({name: F.sum(x.cast("long")).over(upto) for name, x in sums.items()})
    totals = dealt.groupBy("_range").agg(*[F.sum(x.cast("long")).alias(name) for name, x in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    return each.join(F.broadcast(before), "_range").withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_range", *[f"_{name}" for name in sums])


def numbered(rows: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """rows with their place in the order, from 0."""
    return running(rows, order, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def zipped(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str], what: str = "the two lists") -> DataFrame:
    """ord and the columns of both tables, row by row in their orders; a query over tables of unequal lengths raises."""
    a, b = numbered(left, left_order, "ord"), numbered(right, right_order, "ord")
    met = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "ord", "full")
    return met.where(F.when(F.col("_a") & F.col("_b"), True).otherwise(F.raise_error(F.lit(f"{what} differ in length")).cast("boolean"))).drop("_a", "_b")
