"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask keeps at one place of a text; the masks leave out
other words, so a seed survives a substitution there.  Seeds of documents and of benchmark items
are joined, each hit fixes how the two texts lie against each other, and the words along that
alignment are compared: a document is contaminated where a stretch of ``stretch`` words (or the
whole item, if shorter) agrees in at least 80 %.

Words are runs of letters and digits in lower case.  Before the join a bit table of fixed size drops
document seeds that no item has; it has no false negatives, and the join is exact.  Items of up to
six words get further masks, which keep all words that may have to agree; documents are searched with
them only if such items exist.  Items without words match nothing.  Null and empty texts are clean.  Rows with the same ``doc_id`` and text get the
same result, rows with the same ``doc_id`` and other texts are judged each by its own text; a null
``doc_id`` is an id like any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.llm.common import same_document, stored, with_text
from fleetspeed.llm.words import SMALL_BLOCK, Words, mix, u64, word_blocks

# Fixed masks of five kept words each: any 13 words, or 7 to 12 as a whole, that agree in 80 % keep one.
MASKS = ("11111", "110111", "111011", "1011011", "1100111", "11010101")
# Further masks for items of so many words: whole ones, or all but one word where that is 80 %.
SHORT_MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "10111", "11011", "11101"),
    6: ("101111", "111101"),
}
ALL_MASKS = MASKS + tuple(sorted({m for masks in SHORT_MASKS.values() for m in masks}))
FILTER_BITS = 22


@dataclass(frozen=True)
class Overlap:
    stretch: int = 13
    percent: int = 80


def _seeds(words: Words, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of one mask and the index of the word each starts at."""
    mask = ALL_MASKS[number]
    count = len(words.hash) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, u64), np.zeros(0, np.int64)
    last = np.repeat(words.first[1:], np.diff(words.first))
    at = np.flatnonzero(np.arange(count) + len(mask) <= last[:count])
    seed = np.full(len(at), number + 1, u64)
    for k, kept in enumerate(mask):
        if kept == "1":
            seed = seed * u64(0xC2B2AE3D27D4EB4F) + words.hash[at + k]
    return mix(seed), at


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and seeds of each item; of equal seeds of an item the first place is enough."""
    for batch in batches:
        rows: list[tuple] = []
        for words in word_blocks(batch["text"], "plain", block=SMALL_BLOCK):
            all_seeds = [_seeds(words, n) for n in range(len(ALL_MASKS))]
            for row in range(words.rows):
                low, high = words.first[row], words.first[row + 1]
                seeds = [all_seeds[n] for n in masks_of([high - low])]
                spans = [np.searchsorted(a, [low, high]) for _, a in seeds]
                own = [(s[b:e], a[b:e] - low) for (s, a), (b, e) in zip(seeds, spans, strict=True)]
                values, first = np.unique(np.concatenate([s for s, _ in own]), return_index=True)
                places = np.concatenate([a for _, a in own])[first]
                rows.append((words.hash[low:high].view(np.int64), values.view(np.int64), places.astype(np.int32)))
        lists = [pa.array([r[k] for r in rows], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch["item_id"], *lists], ["item_id", "words", "seeds", "places"])


def masks_of(sizes: Iterable[int]) -> list[int]:
    """Numbers of the masks for items of these sizes."""
    short = {m for n in sizes for m in SHORT_MASKS.get(int(n), ())}
    return [n for n, mask in enumerate(ALL_MASKS) if n < len(MASKS) or mask in short]


def _slots(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = u64((1 << bits) - 1)
    return seeds & low, (seeds >> u64(32)) & low


def benchmark_seeds(spark: SparkSession, benchmark: DataFrame) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Items with words and seeds under a key of their own, the bit table of their seeds, and the masks in use."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    schema = "item_id long, words array<long>, seeds array<long>, places array<int>"
    items = stored(
        spark, texts.mapInArrow(_item_seeds, schema).withColumn("item", F.monotonically_increasing_id()), "benchmark-items"
    )
    seed = F.col("seed")
    low = (1 << FILTER_BITS) - 1
    slots = (
        items.select(F.explode("seeds").alias("seed"))
        .select(F.explode(F.array(seed.bitwiseAND(low), F.shiftrightunsigned(seed, 32).bitwiseAND(low))).alias("slot"))
        .distinct()
    )
    table = np.zeros(1 << FILTER_BITS, bool)  # at most 2 ** FILTER_BITS slots come back
    table[slots.toArrow()["slot"].to_numpy()] = True
    sizes = items.select(F.size("words").alias("n")).where(F.col("n") <= max(SHORT_MASKS)).distinct().collect()
    return items, table, masks_of(r["n"] for r in sizes)


def _candidates(batches: Iterator[pa.RecordBatch], table: np.ndarray, masks: list[int]) -> Iterator[pa.RecordBatch]:
    """Documents with any seed that an item may have: their words, and those seeds with their places."""
    for batch in batches:
        rows, lists = [], []
        for words in word_blocks(batch["text"], "plain", block=SMALL_BLOCK):
            found = []
            for number in masks:
                seeds, at = _seeds(words, number)
                first, second = _slots(seeds, FILTER_BITS)
                hit = table[first]
                hit[hit] = table[second[hit]]
                found.append((seeds[hit], at[hit]))
            seeds, at = (np.concatenate(x) for x in zip(*found, strict=True))
            owner = np.searchsorted(words.first, at, "right") - 1
            order = np.argsort(owner, kind="stable")
            seeds, at, owner = seeds[order], at[order], owner[order]
            rows_hit, begin = np.unique(owner, return_index=True)
            ends = np.append(begin, len(owner))[1:]
            for row, low, high in zip(rows_hit, begin, ends, strict=True):
                start = words.first[row]
                rows.append(words.row + int(row))
                lists.append(
                    (
                        words.hash[start : words.first[row + 1]].view(np.int64),
                        seeds[low:high].view(np.int64),
                        (at[low:high] - start).astype(np.int32),
                    )
                )
        taken = batch.select(["doc_id", "_text_hash"]).take(pa.array(rows, pa.int64()))
        values = [pa.array([x[k] for x in lists], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*taken.columns, *values], ["doc_id", "_text_hash", "words", "seeds", "places"])


def _agreement(frames: Iterator[pd.DataFrame], overlap: Overlap) -> Iterator[pd.DataFrame]:
    """Rows whose aligned words agree well enough, with the share of the item's words that agree."""
    for frame in frames:
        kept, shares = [], []
        for n, (ours, theirs, length) in enumerate(zip(frame["ours"], frame["theirs"], frame["length"], strict=True)):
            equal = np.asarray(ours) == np.asarray(theirs)
            width = min(overlap.stretch, length)
            if len(equal) < width:
                continue
            sums = np.concatenate([[0], np.cumsum(equal)])
            if 100 * int((sums[width:] - sums[:-width]).max()) >= overlap.percent * width:
                kept.append(n)
                shares.append(float(equal.sum()) / length)
        yield frame.iloc[kept][["doc_id", "_text_hash", "item_id"]].assign(overlap=shares)


def find_overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, overlap: Overlap = Overlap()) -> DataFrame:
    """``doc_id``, ``_text_hash``, ``item_id`` and ``overlap`` for every verified alignment."""
    items, table, masks = benchmark_seeds(spark, benchmark)
    shared = spark.sparkContext.broadcast(table)  # 2 ** FILTER_BITS bytes
    texts = with_text(docs).select("doc_id", F.xxhash64("text").alias("_text_hash"), F.lower("text").alias("text"))
    candidates = stored(
        spark,
        texts.mapInArrow(
            lambda batches: _candidates(batches, shared.value, masks),
            "doc_id long, _text_hash long, words array<long>, seeds array<long>, places array<int>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "decontamination",
    )
    ours = candidates.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        "row", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at")
    )
    theirs = items.select("item", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        "item", F.col("s.seeds").alias("seed"), F.col("s.places").alias("item_at")
    )
    aligned = ours.join(theirs, "seed").select("row", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    shift = F.col("shift")
    own_start, item_start = F.greatest(shift, F.lit(0)), F.greatest(-shift, F.lit(0))
    common = F.least(F.size("d.words") - own_start, F.size("i.words") - item_start)
    pairs = (
        aligned.join(candidates.select("row", "doc_id", "_text_hash", "words").alias("d"), "row")
        .join(items.select("item", "item_id", "words").alias("i"), "item")
        .select(
            "doc_id",
            "_text_hash",
            "item_id",
            F.slice("d.words", own_start + 1, common).alias("ours"),
            F.slice("i.words", item_start + 1, common).alias("theirs"),
            F.size("i.words").alias("length"),
        )
    )
    return pairs.mapInPandas(
        lambda frames: _agreement(frames, overlap), "doc_id long, _text_hash long, item_id long, overlap double"
    )


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, overlap: Overlap = Overlap()) -> DataFrame:
    """For every row: ``contaminated``, the number of items found, their ids and the largest share of one."""
    found = (
        find_overlaps(spark, docs, benchmark, overlap)
        .groupBy("doc_id", "_text_hash")
        .agg(
            F.sort_array(F.collect_set("item_id")).alias("item_ids"),
            F.max("overlap").alias("best_overlap"),
        )
    )
    rows = with_text(docs).select("doc_id", F.xxhash64("text").alias("_text_hash"))
    none = F.array().cast("array<long>")
    return rows.join(found, same_document(rows, found, "_text_hash"), "left").select(
        rows["doc_id"],
        found["item_ids"].isNotNull().alias("contaminated"),
        F.size(F.coalesce("item_ids", none)).alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("best_overlap", F.lit(0.0)).alias("best_overlap"),
    )


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, overlap: Overlap = Overlap()) -> DataFrame:
    """The documents without a verified overlap, with their columns as they are."""
    found = stored(
        spark, find_overlaps(spark, docs, benchmark, overlap).select("doc_id", "_text_hash").distinct(), "contaminated"
    )
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(
        found, docs["doc_id"].eqNullSafe(found["doc_id"]) & (text_hash == found["_text_hash"]), "left_anti"
    )
