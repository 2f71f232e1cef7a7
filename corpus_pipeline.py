"""The corpus pipeline: stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opfold.llm import copies, mixing, phrases, quality, toxicity
from opfold.llm.common import kept_by_score, read, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are judged as texts without any mark of quality. Every
    row is judged by itself, repeated ones too; columns stay as they are.
    """
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    return kept_by_score(docs, quality.scores_of(spark, model), lambda scores: scores >= quality.THRESHOLD)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier marks as toxic go.

    Null and empty texts hold no evidence and stay, unless most labels are toxic.
    """
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return kept_by_score(docs, toxicity.scores_of(spark, model), lambda scores: scores < toxicity.THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8.

    The one with the least id; of null and empty texts, copies of each other,
    one stays. Different texts under one id are judged each by itself.
    """
    return copies.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item go; null and empty texts have none."""
    return phrases.decontaminate(docs, read(spark, sf_dir, "benchmark"), min_items=1)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in a mixture of the sources by target weight; a null source is one of them."""
    return mixing.mix(docs)


STAGES = [("quality_classifier", quality_filter), ("toxicity", toxicity_filter), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix)]
#: The classifiers, SimHash components and the schedule are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two stages the rows lie in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
