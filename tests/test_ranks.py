"""Exact ranks within keys, against a sort of each key."""

import random

from pyspark.sql import functions as F

from fleetspeed.operators import ranks


def test_ranks_with_copies_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(ranks, "COPIES_A_STEP", 7)
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.randrange(40)) for _ in range(900)] + [(1, 5)] * 300
    df = spark.createDataFrame(rows, "k long, v long").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranks.ranked(spark, ranks.counted(df, "copies"), ["k"], [F.col("v")], "rank", "copies")
        got = [tuple(r) for r in ranks.with_copies(found, "rank", "copies").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for key in (None, 1, 2):
        own = sorted(v for k, v in rows if k == key)
        assert sorted((r, v) for k, v, r in got if k == key) == list(enumerate(own))


def test_rows_of_one_key_lie_in_many_pieces(spark):
    df = spark.range(40_000).selectExpr("CAST(0 AS long) AS k", "id AS v", "id % 10 AS payload")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranks.ranked(spark, df, ["k"], [-F.col("v")], "rank")
        assert found.where("rank + v <> 39999").count() == 0 and found.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranks.ranked(spark, df.limit(0), ["k"], [F.col("v")], "rank").count() == 0
