"""Lists of loci and of numbers, in text files or strings.

The order of a list is its meaning. Files are read line by line and numbered by running sums, so no task holds a list; a folder
is read in order of its files' names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import numbered, running

PLACE = ["file", "line", "k"]
ITEM = r"^[0-9]+(-[0-9]+)?$"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def _until_bad(tokens: Column, pattern: str) -> Column:
    """The tokens before the first that does not match."""
    bad = F.array_position(F.transform(tokens, lambda x: x.rlike(pattern)), False)
    return F.when(bad > 0, F.slice(tokens, 1, F.greatest((bad - 1).cast("int"), F.lit(0)))).otherwise(tokens)


def loci_of(texts: DataFrame, text: str = "value", base: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """ord, locus of each text, beside its columns keep: items n or a-b (none if b < a), less base; reading stops at the first bad item."""
    items = _until_bad(_tokens(F.col(text)), ITEM)
    bounds = F.transform(items, lambda x: F.struct(F.split_part(x, F.lit("-"), F.lit(1)).cast("long").alias("a"), F.split_part(x, F.lit("-"), F.lit(-1)).cast("long").alias("b")))
    each = F.flatten(F.transform(F.filter(bounds, lambda r: r["a"] <= r["b"]), lambda r: F.sequence(r["a"], r["b"])))
    return texts.select(*keep, F.posexplode(each).alias("ord", "locus")).select(*keep, F.col("ord").cast("long").alias("ord"), (F.col("locus") - base).alias("locus"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """file, line, k, token of the files at path."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    return lines.select("file", "line", F.posexplode(_tokens(F.col("value"))).alias("k", "token"))


def read_loci(spark: SparkSession, path: str, base: int = 0) -> DataFrame:
    """ord, locus as loci_of() has them."""
    tokens = read_tokens(spark, path)
    place = F.struct(*PLACE)
    bad = tokens.where(~F.col("token").rlike(ITEM)).agg(F.min(place).alias("bad"))
    good = tokens.crossJoin(F.broadcast(bad)).where(F.col("bad").isNull() | (place < F.col("bad"))).drop("bad")
    bound = lambda k: F.split_part("token", F.lit("-"), F.lit(k)).try_cast("long")
    sized = good.select(*PLACE, bound(1).alias("a"), bound(-1).alias("b")).where("a <= b")
    placed = running(sized, PLACE, {"upto": F.col("b") - F.col("a") + 1})
    each = F.transform(F.sequence("a", "b"), lambda v: F.struct((F.col("upto") - 1 - F.col("b") + v).alias("ord"), (v - base).alias("locus")))
    return placed.select(F.inline(each))


def loci_from_text(spark: SparkSession, text: str, base: int = 0) -> DataFrame:
    return loci_of(spark.createDataFrame([(text,)], "value string"), base=base)


def loci_from(spark: SparkSession, values: list[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "ord long, locus long")


def values_of(texts: DataFrame, text: str = "value") -> DataFrame:
    """ord, value: the numbers of one text; a bad one raises."""
    each = F.transform(_tokens(F.col(text)), lambda x: x.cast("double"))
    return texts.select(F.posexplode(each).alias("ord", "value")).select(F.col("ord").cast("long").alias("ord"), "value")


def read_values(spark: SparkSession, path: str) -> DataFrame:
    tokens = read_tokens(spark, path).select(*PLACE, F.col("token").cast("double").alias("value"))
    return numbered(tokens, PLACE).select("ord", "value")


def quoted(text: Column) -> Column:
    """What stands in the first double or single quotes of the text."""
    double = F.regexp_extract(text, '^\\s*"([^"]*)"', 1)
    return F.when(text.rlike('^\\s*"'), double).otherwise(F.regexp_extract(text, "^\\s*'([^']*)'", 1))
