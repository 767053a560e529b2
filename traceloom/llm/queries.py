"""Registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import mixing, preference_format

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceloom.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceloom.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceloom.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceloom.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    n_lines, n_removed = out.columns[-2:]
    return out.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"), "text", "lang", "source", "n_chars")


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are the chosen and the rejected side of pair k."""
    from traceloom.llm.preference_format import preference_pairs

    return preference_pairs(table(spark, sf_dir, "conversations"), F.expr("conv_id div 2"), F.expr("conv_id % 2 = 0"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceloom.llm.mixing import mixing_weights

    return mixing_weights(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceloom.llm.quality_classifier import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceloom.llm.vector_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from traceloom.llm.language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_packing": op2_packing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op6_quality_rules": op6_quality_rules,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op1_line_dedup": op1_line_dedup,
    "op3_preference_format": op3_preference_format,
    "op9_mixing": op9_mixing,
    "op10_quality_classifier": op10_quality_classifier,
    "op7_vector_search": op7_vector_search,
    "op5_language_model": op5_language_model,
}

ORACLE_SQL: dict[str, str] = {
    "op3_preference_format": preference_format.ORACLE,
    "op9_mixing": mixing.oracle(),
}
