"""Queries of the training-data operators, one each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary files lie; a parameter of the operators.
TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str, folder: str = TOKENIZERS) -> str:
    """Path of a vocabulary file: through the installed package if there is one."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{folder}/{name}"
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_class_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .words import class_ngram_scores

    return class_ngram_scores(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_round_trip

    return bpe_round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    return mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages

    return languages(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import write_tokens

    return write_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).digests()


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import neighbours

    return neighbours(_table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cnn import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judged

    return judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_class_ngram, op2_bpe, op3_mixing, op4_token_counts, op5_simhash, op6_language, op7_token_files, op8_neighbours, op9_quality, op10_rules)}


def oracle_sql() -> dict[str, str]:
    """None of these is expressible in SQL: each is tested against brute force, a round trip or held-out rows."""
    return {}
