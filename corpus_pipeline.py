"""A training corpus from documents: quality rules, line dedup, near duplicates, decontamination, segmentations.

Each stage takes all that its predecessor kept and is written as Parquet in the shared folder before the next one
reads it. All but the last return the columns of documents.

1. quality rules: documents that fail the base rule or repeat too much of themselves go;
2. line dedup: chunks of lines that recur anywhere go, all but the first; documents left without a word go;
3. near duplicates: of documents whose five-word shingles are similar by 0.8 or more, directly or through others, the
   one with the smallest id stays;
4. decontamination: documents with a benchmark item within the edit limit go;
5. segmentations: the token ids of three sampled SentencePiece segmentations of each document, with inclusion scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from allelix.llm import decontaminate, jaccard_tiles, line_chunks, quality_rules, segment_samples
from allelix.llm.common import Folders, table
from allelix.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_chunks.without_repeats(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_tiles.one_of_each(docs, join=jaccard_tiles.Join(words=5, percent=80))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def segment_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segment_samples.sampled_segmentations(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_stage),
    ("decontamination", benchmark_stage),
    ("segmentations", segment_stage),
]

#: SQL expresses neither suffix arrays nor sampled segmentations; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = table(spark, sf_dir, "documents"), Folders(spark)
    for name, stage in STAGES:
        docs = own.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        own.forget(keep=1)  # the stage before has been read
    return docs
