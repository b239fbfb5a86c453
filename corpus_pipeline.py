"""Pipeline over the corpus: each stage takes the documents the stage before it kept.

All stages but the last return the columns of ``documents``; the last adds ``mix_copies``, how often
the mix takes a document.  Every stage keeps its own rules for nulls, empty texts and repeated rows;
see the operators it calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetspeed.llm import decontamination, ngram_join, personal_data, quality_classifier, source_mixing
from fleetspeed.llm.common import read, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_good(spark, docs, read(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, linked by five words at 80 %; op8's four at 85 % bind that query only."""
    return ngram_join.keep_one(spark, docs, ngram_join.Join(shingle=5, percent=80))


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items go."""
    return decontamination.keep_clean(spark, docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind."""
    return personal_data.redact(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the number of copies it takes."""
    return source_mixing.take(spark, docs, read(spark, sf_dir, "labels"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("benchmark decontamination", free_of_benchmarks),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
]

# A trained classifier and a bootstrapped graph can't be written in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
