"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal.

Features of a text are its words and word pairs, as written and by shape (``Aa``, ``a#``), hashed
into ``2 ** bits`` weights.  Each occurrence counts the same share of the text, so a score is one
sparse dot product.  Training takes a bounded sample of the labelled rows, dealt to ``shards``
learners whose weights are averaged; scoring goes over every whole text where it lies.

Null and empty texts have no features and get the score of the intercept.  Rows with a null
``doc_id`` are scored and never trained on.  Repeated rows are scored alike, and of the rows of one
labelled document one is trained on, the text of least hash.  Several labels of one document count as the largest.  Without any labelled row all scores are 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.llm import common
from fleetspeed.llm.words import SMALL_BLOCK, Words, ngrams, shape_blocks, u64, word_blocks

HELD_OUT = 2
THRESHOLD = 0.7


@dataclass(frozen=True)
class Training:
    bits: int = 18
    sample_rows: int = 16_000  # bound of the labelled rows that are trained on
    shards: int = 2
    epochs: int = 8
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 0.001
    l2: float = 0.001
    scale: float = 20.0


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never used; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _features(column: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, number of rows, row and weight index of every feature occurrence."""
    shift = u64(64 - bits)
    for as_written, by_shape in zip(
        word_blocks(column, lower=False, block=SMALL_BLOCK), shape_blocks(column, SMALL_BLOCK), strict=True
    ):
        rows, places = [], []
        for salt, words in ((0x51, as_written), (0xA7, by_shape)):
            owner = words.owner()
            salted = Words(words.row, words.first, words.hash ^ u64(salt), words.begin, words.end)
            for n in (1, 2):
                grams, first = ngrams(salted, n)
                rows.append(owner[first])
                places.append((grams >> shift).astype(np.int64))
        yield as_written.row, as_written.rows, np.concatenate(rows), np.concatenate(places)


def _sparse(batches: Iterator[pa.RecordBatch], training: Training) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index, value, sizes = [], [], []
        for _, n, rows, places in _features(batch["text"], training.bits):
            keys, counts = np.unique(rows << training.bits | places, return_counts=True)
            owner = keys >> training.bits
            total = np.bincount(rows, minlength=n)
            index.append((keys & ((1 << training.bits) - 1)).astype(np.int32))
            value.append((counts / total[owner] * training.scale).astype(np.float32))
            sizes.append(np.bincount(owner, minlength=n))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
        offsets = pa.array(offsets.astype(np.int32))
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0), kind))
            for x, kind in ((index, pa.int32()), (value, pa.float32()))
        ]
        yield pa.RecordBatch.from_arrays([batch["_deal"], batch["_label"], *lists], ["deal", "label", "places", "shares"])


def _learn(rows: pd.DataFrame, training: Training) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal; the last one is the intercept."""
    size = 1 << training.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    examples = [
        (np.append(i, size), np.append(v, 1.0).astype(np.float64), y)
        for i, v, y in zip(rows["places"], rows["shares"], rows["label"], strict=True)
    ]

    def weights(z, n):
        shrunk = np.sign(z) * np.maximum(np.abs(z) - training.l1, 0)
        return -shrunk / ((training.beta + np.sqrt(n)) / training.alpha + training.l2)

    for _ in range(training.epochs):
        for place, share, label in examples:
            zi, ni = z[place], n[place]
            w = weights(zi, ni)
            gradient = (1 / (1 + np.exp(-np.clip(w @ share, -30, 30))) - label) * share
            squared = gradient * gradient
            z[place] = zi + gradient - (np.sqrt(ni + squared) - np.sqrt(ni)) / training.alpha * w
            n[place] = ni + squared
    return weights(z, n)


def train(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> np.ndarray | None:
    """Weights from the labelled documents that are not held out; none without such documents."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").cast("int").alias("_label"))
        .withColumn("_deal", F.xxhash64("doc_id"))
        .orderBy("_deal", "doc_id")
        .limit(training.sample_rows)
    )
    # The sample is bounded by sample_rows rows of three numbers.
    # One row for each of them, however often it stands: rows of an id meet as the least so far.
    texts = (
        common.with_text(docs)
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "_deal", "_label")
        .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("_least"))
        .select("_deal", "_label", "_least.text")
    )
    sparse = texts.select("_deal", "_label", "text").mapInArrow(
        lambda batches: _sparse(batches, training), "deal long, label int, places array<int>, shares array<float>"
    )

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.assign(_n=rows["places"].map(len)).sort_values(["deal", "label", "_n"], kind="stable")
        return pd.DataFrame({"rows": [len(rows)], "weights": [_learn(ordered, training).astype("<f8").tobytes()]})

    learned = (
        sparse.withColumn("_shard", F.pmod(F.shiftright("deal", 7), F.lit(training.shards)))
        .groupBy("_shard")
        .applyInPandas(shard, "rows long, weights binary")
        .collect()  # at most one row of weights for each shard
    )
    if not learned:
        return None
    total = sum(r["rows"] for r in learned)
    return sum(np.frombuffer(r["weights"], "<f8") * (r["rows"] / total) for r in sorted(learned, key=lambda r: r["weights"]))


def score(spark: SparkSession, docs: DataFrame, weights: np.ndarray | None, name: str, training: Training = Training()) -> DataFrame:
    """The documents with one more column: how likely label 1 is, from 0 to 1."""
    if weights is None:
        return docs.withColumn(name, F.lit(1.0))
    shared = spark.sparkContext.broadcast(weights)  # 2 ** bits numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            parts = []
            for _, n, rows, places in _features(batch["text"], training.bits):
                total = np.bincount(rows, minlength=n)
                sums = np.bincount(rows, w[places], minlength=n)
                margin = np.divide(sums, total, out=np.zeros(n), where=total > 0) * training.scale + w[-1]
                parts.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
            values = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    return docs.mapInArrow(scored, docs.select("*", F.lit(0.0).cast("double").alias(name)).schema)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, training: Training = Training()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    rows = common.with_text(docs)
    scored = score(spark, rows, train(rows, labels, training), "score", training)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, training: Training = Training()) -> DataFrame:
    """The documents that the classifier does not reject, with their columns as they are."""
    name = common.unused(docs, "_quality_score")
    weights = train(docs, labels, training)
    return score(spark, docs, weights, name, training).where(F.col(name) >= THRESHOLD).select(*docs.columns)
