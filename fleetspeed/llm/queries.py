"""One query for each operator of this package, over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.llm import (
    chat_formatting,
    conversation_repair,
    decontamination,
    language_id,
    license_scan,
    ngram_join,
    periodic_runs,
    personal_data,
    quality_classifier,
    quality_rules,
    source_mixing,
    suffix_dedup,
    url_filters,
)
from fleetspeed.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(spark, read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(spark, read(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting.rotate(spark, read(spark, sf_dir, "conversations"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries of a block and an allow list, derived from a digest of each host of the pages."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    numbered = hosts.withColumn("x", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    rows = F.array(
        _entry("block", F.col("host"), "add", F.col("x") % 500, F.col("x") % 3 == 0),
        _entry("block", F.col("host"), "remove", F.col("x") % 500 + 60 + F.col("x") % 90, F.col("x") % 3 == 0),
        _entry("block", F.col("host"), "add", F.col("x") % 500 + 200, F.col("x") % 6 == 0),
        _entry("allow", F.col("host"), "add", F.col("x") % 400, F.col("x") % 7 == 0),
        _entry("block", parent, "add", F.col("x") % 600, F.col("x") % 11 == 0),
    )
    return numbered.select(F.explode(F.array_compact(rows)).alias("e")).select("e.*")


def _entry(name, pattern, action, day, condition):
    at = F.timestamp_seconds(F.lit(1672531200) + day * 86400)
    return F.when(
        condition,
        F.struct(F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"), at.alias("at")),
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture of a time that follows from its id, over two years from 2023."""
    pages = read(spark, sf_dir, "pages")
    second = F.lit(1672531200) + F.pmod(F.col("page_id") * 7919, F.lit(730)) * 86400 + F.pmod(F.col("page_id"), F.lit(86400))
    captures = pages.select("page_id", "url", F.timestamp_seconds(second).alias("fetched_at"))
    found = url_filters.judge(captures, list_entries(pages))
    return found.select(
        "page_id", "host", "verdict", "matched", F.unix_seconds("fetched_at").alias("fetched"), F.unix_seconds("since").cast("string").alias("since")
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(spark, read(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.classes(spark, read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.report(spark, read(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(spark, read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return conversation_repair.report(spark, conversation_repair.damaged(conversations), conversations)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, by a checksum of their ids, get a periodic tail first."""
    return periodic_runs.report(spark, read(spark, sf_dir, "documents"), prepare=periodic_runs.periodic_tail)


def queries() -> dict[str, Query]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op6_url_filters": op6_url_filters,
        "op2_source_mixing": op2_source_mixing,
        "op3_quality_rules": op3_quality_rules,
        "op4_license_scan": op4_license_scan,
        "op9_decontamination": op9_decontamination,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_ngram_join": op8_ngram_join,
        "op10_personal_data": op10_personal_data,
        "op5_quality_classifier": op5_quality_classifier,
        "op11_language_id": op11_language_id,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_periodic_runs": op13_periodic_runs,
    }
