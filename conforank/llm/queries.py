"""Registered queries of this folder: name -> (Spark function of (spark, folder), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .align import alignment_digests
from .common import table
from .decontaminate import find_items
from .html_text import extract_pages
from .jaccard import near_duplicate_groups
from .language import held_out, identify_language, train_language
from .line_dedup import dedup_lines
from .pieces import encode_and_decode
from .quality import judge_quality
from .simhash import simhash_groups
from .substring_dedup import dedup_sentence_runs
from .token_count import count_tokens
from .toxicity import score_toxicity, train_toxicity
from .trie import conversation_trie

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(oracle: str | None = None):
    def add(function: Query) -> Query:
        REGISTRY[function.__name__] = (function, oracle)
        return function

    return add


@register(sql.LINE_DEDUP)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register()
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return find_items(docs, table(spark, folder, "benchmark"))


@register(sql.SUBSTRING_DEDUP)
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = dedup_sentence_runs(table(spark, folder, "documents").select("doc_id", "text"), alone_words=25)
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register()
def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages").select("page_id", "url", "html"))


@register()
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(table(spark, folder, "documents").select("doc_id", "text", "lang", "source")).drop("lang", "source")


@register()
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(table(spark, folder, "documents").select("doc_id", "text"))


@register()
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    model = train_toxicity(docs, labels)
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


@register()
def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


@register()
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train_language(docs.where(~F.col("held_out")))
    return identify_language(docs, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@register()
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@register()
def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(table(spark, folder, "documents").select("doc_id", "text"))


@register()
def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return alignment_digests(docs, *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))


@register(sql.CONVERSATION_TRIE)
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(table(spark, folder, "conversations"))


@register()
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
