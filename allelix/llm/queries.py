"""The queries of this subpackage: each applies one operator to its whole table, and derives the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_clusters, decontaminate, jaccard_tiles, language_id, line_chunks, pii_crf, ppm_scores, rule_ensemble, segment_samples, token_files, warc_index, whitening
from . import quality_rules as rules
from .common import crc_part, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.personal_data(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = crc_part(F.col("doc_id"))
    return rule_ensemble.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), part != 1, F.coalesce(part == 1, F.lit(False)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = crc_part(F.col("doc_id"))
    return language_id.languages(table(spark, sf_dir, "documents"), part != 1, F.coalesce(part == 1, F.lit(False)))


def op5_segment_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_samples.sampled_segmentations(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_chunks.dedup_lines(table(spark, sf_dir, "documents"))
    kept = F.col("_kept")
    return rows.select("doc_id", *[kept[c].alias(c) for c in ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")], F.length(kept["text"]).cast("long").alias("kept_chars"), F.md5(kept["text"]).alias("kept_md5"))


def op6_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_chunks.dedup_passages(table(spark, sf_dir, "documents"))
    kept = F.col("_kept")
    return rows.select("doc_id", *[kept[c].alias(c) for c in ("n_lines", "n_removed_lines")], F.length(kept["text"]).cast("long").alias("kept_chars"), F.md5(kept["text"]).alias("kept_md5"))


def op7_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_tiles.jaccard_components(table(spark, sf_dir, "documents"), join=jaccard_tiles.Join(words=3, percent=90))
    return found.select("doc_id", "n_shingles", "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op11_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return ppm_scores.scores(table(spark, sf_dir, "documents"), part != 1, F.coalesce(part == 1, F.lit(False)))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_clusters.clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii_crf, op2_quality_rules, op3_rule_ensemble, op4_language_id, op5_segment_samples, op6_line_chunks, op6_line_passages, op7_jaccard_tiles, op8_decontaminate, op9_token_files, op10_warc_index, op11_ppm_scores, op12_whitening, op13_ball_clusters)}
