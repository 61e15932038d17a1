"""From raw documents to token files: the stages of the training-text pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from llm.decontaminate import without_benchmark
from llm.mixing import in_mixed_order
from llm.near_duplicates import without_near_duplicates
from llm.quality import without_rejected
from llm.token_files import default_tokenizer, ids_crc32, read_token_files, write_token_files
from panelspark.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and so do the lines above their host's limit in the others."""
    cleaned = without_rejected(docs.withColumn("_length", F.length("text")), every_text=True, remove_lines=True)
    length = F.when(F.length("text") < F.col("_length"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", length).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group (5-word shingles, similarity of 0.8 or more) the document with the least id stays."""
    return without_near_duplicates(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that gives every source the same weight as long as it lasts."""
    return in_mixed_order(docs)


def stored_order(docs: DataFrame) -> list[str | Column]:
    """Order in which the rows of a Parquet folder were written; by id for other frames."""
    path = F.col("_metadata.file_path")
    order = [F.length(path), path, F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:
        return ["doc_id"]
    return order


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the order of the mixture, written to files and read back: one row per document."""
    out = scratch_path(spark, "pipeline-tokens")
    write_token_files(docs, out, default_tokenizer(), order=stored_order(docs), special_ids=True)
    return read_token_files(spark, out, bits=32).select(
        "doc_id", "position", "start", "n_tokens", ids_crc32("ids", "id_bits").alias("ids_crc32")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

# Near duplicates, SimHash windows and token ids are beyond SQL; tests/llm compares run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; returns what the last one does."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
