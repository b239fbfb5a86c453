"""Repeated strings: against a set of all earlier strings."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, edited, odd_rows, prose, repeats_removed, same  # noqa: E402

from fleetspeed.llm import suffix_dedup, words  # noqa: E402


def check(spark, rows, repeats=suffix_dedup.Repeats()):
    found = suffix_dedup.report(spark, spark.createDataFrame(rows, DOCS), repeats).collect()
    plain = repeats_removed(rows, repeats.length)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found]
    same(got, [(r[0], *plain[(r[0], r[1] or "")]) for r in rows])


def unique_ids(rows):
    """An id with several texts has no order that a plain version could know."""
    ids, kept = {}, []
    for row in rows:
        if ids.setdefault(row[0], row[1]) == row[1]:
            kept.append(row)
    return kept


def near_copies(n=30):
    base = prose(1, 250)
    rng = random.Random(2)
    rows = [(k, edited(base, k, rng.random() * 0.1), "en", "s", 0) for k in range(n)]
    rows += [(100 + k, prose(k + 20, 60) + base[rng.randrange(900) :][:200] + prose(k + 70, 5), "en", "s", 0) for k in range(n)]
    rows.append((99, "abcabcabd" * 300, "en", "s", 0))
    return rows


def test_odd_rows(spark):
    check(spark, unique_ids(odd_rows()))


def test_near_copies(spark):
    check(spark, near_copies())


@pytest.mark.parametrize("most, size", [(3, 4 << 20), (20_000, 2000)])
def test_large_anchors_and_small_tasks(spark, most, size):
    check(spark, near_copies(), suffix_dedup.Repeats(most_runs=most, task_bytes=size))


def test_texts_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2048)
    rows = [(1, prose(1, 3000), "en", "s", 0), (2, prose(2, 50) + prose(1, 3000)[5000:9000], "en", "s", 0)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([0, 0]), pa.array([r[1] for r in rows])], ["doc", "tag", "text"]
    )
    monkeypatch.setattr(words, "BLOCK", 2048)
    pieces = pa.Table.from_batches(list(suffix_dedup._run_rows(iter([batch]), suffix_dedup.Repeats())))
    starts = {}
    for doc, place in zip(pieces["doc"].to_pylist(), pieces["place"].to_pylist(), strict=True):
        first = place >> 16 & (1 << 31) - 1
        starts.setdefault(doc, []).extend(range(first, first + (place & 65535) - 99))
    for doc, text in ((r[0], r[1]) for r in rows):
        assert sorted(starts[doc]) == list(range(len(text.encode()) - 99))


def test_empty_table(spark):
    check(spark, [])


def plain_intervals(shards, length):
    """Starts of each string that occurs twice or more, in the strings laid end to end with a gap each."""
    groups, at = {}, 0
    for text in (t for s in shards for t in s):
        for k in range(len(text) - length + 1):
            groups.setdefault(text[k : k + length], set()).add(at + k)
        at += len(text) + 1
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("length", [5, 6, 7, 16, 33])
def test_repeated_starts_over_shards(length):
    rng = random.Random(length)
    for trial in range(60):
        base = bytes(rng.choice(b"ab\xff\x00") for _ in range(200))
        texts = []
        for _ in range(rng.randrange(1, 12)):
            low = rng.randrange(150)
            text = bytearray(base[low : low + rng.randrange(1, 120)])
            if text and rng.random() < 0.5:
                text[rng.randrange(len(text))] = ord("c")
            texts.append(bytes(text))
        cuts = sorted(rng.sample(range(1, len(texts)), min(len(texts) - 1, trial % 4)))
        shards = [texts[a:b] for a, b in zip([0, *cuts], [*cuts, len(texts)])]
        starts, number, common = suffix_dedup.repeated_starts(shards, length)
        groups = {}
        for start, n in zip(starts.tolist(), number.tolist(), strict=True):
            groups.setdefault(n, []).append(start)
        assert sorted(sorted(g) for g in groups.values()) == plain_intervals(shards, length)
        joined = b"|".join(texts) + b"|"
        assert all(c <= length for c in common) and len(common) == len(joined)


def test_common_prefixes_with_other_shards():
    _, _, common = suffix_dedup.repeated_starts([[b"xabcdefgh"], [b"abcdezz"], [b"qabcd"]], 6)
    joined = "xabcdefgh|abcdezz|qabcd|"
    assert common[joined.index("abcdef")] == 4 and common[joined.index("qabcd") + 1] == 4 and common[0] == 0


def test_a_transform_is_sorted():
    rng = random.Random(3)
    text = np.array([rng.choice([0, 1, 1, 2]) for _ in range(400)] + [0], np.uint16)
    order, rank = suffix_dedup.transform(text, 12)
    key = lambda p: tuple(text[p : min(p + 12, p + list(text[p:]).index(0) + 1)])
    keys = [key(p) for p in order]
    assert keys == sorted(keys)
    assert all((key(p) == key(q)) == (rank[p] == rank[q]) for p in range(0, 400, 3) for q in range(0, 400, 7))


def test_rows_that_stand_twice_are_no_copies_of_themselves(spark):
    rows = [(1, prose(1, 200), "en", "s", 0)] * 3 + [(2, prose(2, 90) + prose(2, 90), "en", "s", 0)] * 2 + [(None, prose(3, 80), "en", "s", 0)] * 2
    rows += [(4, prose(1, 200)[300:700], "en", "s", 0)] * 2
    check(spark, rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    assert {r["n_removed"] for r in suffix_dedup.report(spark, docs).where("doc_id = 1").collect()} == {0}


@pytest.mark.parametrize("length, gram", [(25, 8), (101, 24), (200, 24), (301, 30)])
def test_other_lengths(spark, length, gram):
    rows = near_copies(12) + [(1, prose(1, 400), "en", "s", 0)]
    check(spark, unique_ids(rows), suffix_dedup.Repeats(length=length, gram=gram, shard_bytes=3000))


def test_lengths_that_places_cannot_hold():
    for length, gram in ((24, 24), (100, 2), (40_000, 24)):
        with pytest.raises(ValueError):
            suffix_dedup.Repeats(length=length, gram=gram)


def test_fingerprints_tell_words_apart_that_one_ring_cannot():
    """Thue-Morse words of 2 ** 11 letters and more are equal modulo 2 ** 64 for every odd base."""
    word = b"a"
    for _ in range(11):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(word + word.translate(bytes.maketrans(b"ab", b"ba")), np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * words.power("up")[: len(data)], out=sums[1:])
    begin, end = np.array([0, len(word)]), np.array([len(word), 2 * len(word)])
    one_ring = (sums[end] - sums[begin]) * words.power("down")[begin]
    first, second = suffix_dedup._fingerprints(data, sums, begin, end)
    assert one_ring[0] == one_ring[1] and first != second


def test_the_filter_holds_every_id(spark):
    ids = spark.range(0, 3_000_000, 7).selectExpr("id * 31 - 5000 AS doc")
    table = suffix_dedup._filter(ids)
    import pyarrow as pa

    kept = list(suffix_dedup._chosen(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(0, 3_000_000, 7) * 31 - 5000)], ["doc"])]), table))
    assert kept[0].num_rows == 428_572 and len(table) <= 1 << 20
    others = list(suffix_dedup._chosen(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(1 << 21) * 31 - 4999)], ["doc"])]), table))
    assert others[0].num_rows < 0.2 * (1 << 21)


def test_texts_of_one_id_with_hashes_alike_in_24_bits(spark):
    """Two texts of the null id whose text hashes have equal low bits stay two texts."""
    bodies = [prose(1, 60) * 2, prose(2, 45) + prose(3, 30) * 2]
    text = F.concat(F.col("id").cast("string"), F.lit(" "), F.when(F.col("id") % 2 == 0, bodies[0]).otherwise(bodies[1]))
    tagged = spark.range(30_000).withColumn("tag", F.xxhash64(text).bitwiseAND(F.lit((1 << 24) - 1)))
    pair = (
        tagged.groupBy("tag")
        .agg(F.min_by("id", F.col("id") % 2).alias("even"), F.max_by("id", F.col("id") % 2).alias("odd"))
        .where("even % 2 = 0 AND odd % 2 = 1")
        .orderBy("tag")
        .first()
    )
    rows = [(None, f"{n} {bodies[n % 2]}", "en", "s", 0) for n in (pair["even"], pair["odd"])]
    check(spark, rows)
    check(spark, rows, suffix_dedup.Repeats(most_runs=0))
