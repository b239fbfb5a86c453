"""URL filters: dated list entries against captures, each judged by the lists as they were at its time.

A list changes by dated entries that add or remove a host or domain.  Every addition becomes the
interval from its date to the next entry of the same list and pattern; of entries at one moment the
removal counts.  A capture matches the entries of its host and of every parent domain whose interval
holds its fetch time.  The most specific match decides; where a block and an allow list name the same
domain, blocking wins.

Intervals and captures meet by pattern and 30-day period: an interval stands in every period it
overlaps up to the last fetch time, so the as-of join is an equality join whose rows of one host
are spread over the periods.  Equal (host, time) pairs are judged once and joined back, so a host with
most of all captures is no burden.

Defined cases: entries with a null in list, pattern, action or date are void; a URL without a host, a
null URL and a null fetch time match nothing and are ``kept``; repeated captures get the same verdict;
user names, ports and letter case of a host don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD_DAYS = 30
BLOCK, ALLOW = "block", "allow"
RESULT = ("host", "verdict", "matched", "since")  # columns of the result; captures' own of these names go


def host_of(url: Column) -> Column:
    """Lower-cased host of an http or https URL, null without one."""
    found = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.transform(starts, lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))


def _period(time: Column) -> Column:
    return F.floor(F.unix_seconds(time) / (PERIOD_DAYS * 86400)).cast("long")


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``list``, ``pattern``, ``valid_from`` and ``valid_to`` (null: open) from dated additions and removals."""
    one = (
        entries.where(F.col("list").isin(BLOCK, ALLOW) & F.col("action").isin("add", "remove"))
        .where(F.col("pattern").isNotNull() & F.col("at").isNotNull())
        .groupBy("list", F.lower("pattern").alias("pattern"), "at")
        .agg(F.max("action").alias("action"))
    )
    following = F.lead("at").over(Window.partitionBy("list", "pattern").orderBy("at"))
    return (
        one.withColumn("valid_to", following)
        .where(F.col("action") == "add")
        .select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")
    )


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures (``url``, ``fetched_at`` and any columns) with host, verdict and the entry that decided."""
    hosts = captures.withColumn("host", host_of(F.col("url")))
    moments = hosts.where("host IS NOT NULL AND fetched_at IS NOT NULL").select("host", "fetched_at").distinct()
    newest = moments.agg(F.max(F.unix_micros("fetched_at"))).first()[0]  # one number
    last = F.timestamp_micros(F.lit(newest).cast("long"))
    until = F.coalesce(F.least("valid_to", last), last)
    active = (
        validity_intervals(entries)
        .where(F.col("valid_from") <= last)
        .withColumn("period", F.explode(F.sequence(_period(F.col("valid_from")), _period(until))))
    )
    asked = moments.select(
        "host", "fetched_at", F.explode(domains_of(F.col("host"))).alias("pattern"), _period(F.col("fetched_at")).alias("period")
    )
    inside = (F.col("fetched_at") >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))
    )
    decided = (
        asked.join(active, ["pattern", "period"])
        .where(inside)
        .groupBy("host", "fetched_at")
        .agg(F.max(F.struct(F.length("pattern").alias("n"), "list", "pattern", "valid_from")).alias("best"))
    )
    return (
        hosts.alias("h")
        .join(decided.alias("d"), ["host", "fetched_at"], "left")
        .select(
            *(F.col(f"h.{c}") for c in captures.columns if c not in RESULT),
            F.col("h.host"),
            F.when(F.col("best.list") == BLOCK, F.lit("blocked"))
            .when(F.col("best.list") == ALLOW, F.lit("allowed"))
            .otherwise(F.lit("kept"))
            .alias("verdict"),
            F.col("best.pattern").alias("matched"),
            F.col("best.valid_from").alias("since"),
        )
    )
