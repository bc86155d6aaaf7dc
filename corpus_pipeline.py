"""From raw documents to encoded training text: five stages, each one operator of quire.llm.

In every stage but the last columns come out as they went in, whatever their names; null ids and repeated rows are
rows like others, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.bpe import bpe_round_trip
from quire.llm.common import stored
from quire.llm.langid import accepted
from quire.llm.mixing import mixed
from quire.llm.registry import vocabulary
from quire.llm.rules import kept
from quire.llm.simhash import one_of_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language.

    Learnt from the rows with a language. Texts that are null, empty or without a letter go; so do those farther from
    every centroid than nearly all of their language's sample. Without any language given, all go. Ties between
    languages go to the first by name and reject nothing.
    """
    return accepted(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep; learnt from the labels of those that are left.

    Texts with under 50 words (null and empty ones too) or mostly repeated windows go. Without labels of both kinds
    nothing else does. Labels without an id or without a value teach nothing; of an id's several labels the smallest counts.
    """
    return kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    The one with the smallest id stays, null ids last; between rows of one id the smallest fingerprint, then the smallest
    hash of all columns. Texts without a word (null and empty ones too) have one fingerprint and are one group.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null texts have no words and are taken whole times only; a null source is a source, last in order. Rows that agree
    in id, source and size share their copies; those that come first by a hash of all columns get the further ones.
    """
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's text and the text they decode to, with counts and digests of both.

    One row for each that comes in, with doc_id and no other column of it. A null text is encoded as the empty one.
    """
    return bpe_round_trip(docs, vocabulary("byte_bpe_50k.json"), keep=True)


STAGES = [("language", language), ("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: Models and random rounding cannot be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder and read again."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        df = stored(stage(spark, df, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, df, sf_dir)
