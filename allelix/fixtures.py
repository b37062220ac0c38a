"""Alignments derived from the driver's tables: whole tables, and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.states import normal_sequence, to_state


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut into five states at -0.1, 0, 0.1 and 0.2."""
    x = F.col("x").cast("double")
    state = F.when(x < F.lit(-0.1), 0).when(x < 0, 1).when(x < F.lit(0.1), 2).when(x < F.lit(0.2), 3).otherwise(4)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("locus", "x")).select("sample_id", "locus", state.alias("state"))


def embedding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiplicity from the label, weight from the id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.col("vec_id").cast("string").alias("name"), (F.col("label") + 1).cast("long").alias("multiplicity"), (F.lit(1.0) / (1 + F.col("vec_id") % 4)).alias("weight"))


def document_sequences(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """sample_id, sequence: each whole text in normal symbols, of the documents chosen."""
    return table(spark, sf_dir, "documents").where(where).select(F.col("doc_id").alias("sample_id"), normal_sequence(F.col("text")).alias("sequence"))


def document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character of every text is a locus; rows are as long as their texts."""
    return sequence_cells(document_sequences(spark, sf_dir))


def sequence_cells(sequences: DataFrame) -> DataFrame:
    each = sequences.where(F.length("sequence") > 0).select("sample_id", F.posexplode(F.split("sequence", "")).alias("locus", "symbol"))
    return each.select("sample_id", "locus", to_state(F.col("symbol")).alias("state"))


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last event of each of thirty days; a gap for errors and days without one."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    days = e.select(F.col("user_id").alias("sample_id"), F.datediff("ts", F.lit("2024-01-01")).alias("locus"), "ts", "event_id", kind.alias("kind"))
    last = days.groupBy("sample_id", "locus").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"))
    grid = e.select(F.col("user_id").alias("sample_id")).distinct().select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("locus"))
    return grid.join(last, ["sample_id", "locus"], "left").select("sample_id", "locus", F.coalesce("kind", F.lit(4)).alias("state"))


def line_key() -> Column:
    """A hash of a line item's unique columns."""
    return F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def line_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(line_key().alias("sample_id"), F.col("l_quantity").alias("weight"))


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five loci of each line item; its weight is the quantity. Ids are hashes of the row's unique columns."""
    r = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2).otherwise(4)
    status = F.when(F.col("l_linestatus") == "F", 0).when(F.col("l_linestatus") == "O", 1).otherwise(4)
    quantity = F.least(F.floor((F.col("l_quantity") - 1) / 12.5), F.lit(3)).cast("int")
    bucket = lambda c: (F.round(F.col(c) * 100).cast("int") % 5).cast("int")
    states = F.array(flag, status, quantity, bucket("l_discount"), bucket("l_tax"))
    return r.select(line_key().alias("sample_id"), F.col("l_quantity").alias("weight"), F.posexplode(states).alias("locus", "state"))
