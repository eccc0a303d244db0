"""Documents to token identifiers: quality rules, line dedup, near duplicates, benchmark passages, encoding.

Every stage takes (spark, docs, folder) and returns the rows it keeps; all but the last return
the columns of ``documents``. Each result is written as Parquet and read by the next stage, so a
lost executor never costs more than the stage it was working on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conforank.llm.decontaminate import without_items
from conforank.llm.jaccard import keep_one
from conforank.llm.line_dedup import dedup_lines
from conforank.llm.pieces import encode_pieces
from conforank.llm.quality import keep_good
from conforank.storage import write_table


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines of ten or more documents go; ``n_chars`` follows the text. A document may become empty and stays."""
    out = dedup_lines(docs).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_items(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Identifiers in place of the text, in small batches: workers still hold memory of the stages before."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), batch_chars=500_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]
#: The robust rules and the encoding are beyond SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``: doc_id, lang, source, n_chars, ids and n_tokens of what stays."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
