"""n-gram Jaccard join: against all pairs, on odd rows and on lists that need the second phase."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, edited, jaccard_classes, odd_rows, prose, same  # noqa: E402

from fleetspeed.llm import ngram_join  # noqa: E402


def result(spark, rows, join=ngram_join.Join()):
    found = ngram_join.classes(spark, spark.createDataFrame(rows, DOCS), join).collect()
    return [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found]


def expected(rows):
    return [(row[0], n, component if n else row[0]) for row, (n, component, _) in zip(rows, jaccard_classes(rows), strict=True)]


def test_odd_rows(spark):
    rows = odd_rows()
    same(result(spark, rows), expected(rows))


def test_empty_table(spark):
    assert result(spark, []) == []


@pytest.mark.parametrize("bits", [4, 18])
def test_chains_and_common_passages(spark, bits):
    """Chains of ever more edited copies link only step by step; many texts share a passage."""
    rng = random.Random(7)
    rows, passage = [], prose(99, 60)
    for family in range(6):
        text = prose(family + 50, 60 + 20 * family)
        for step in range(9):
            rows.append((len(rows) * 3, text, "en", "s", 0))
            text = edited(text, rng.randrange(10**6), 0.012)
    for n in range(25):
        rows.append((1000 + n, passage + " " + prose(300 + n, rng.randrange(1, 14)), "en", "s", 0))
    rng.shuffle(rows)
    same(result(spark, rows, ngram_join.Join(count_bits=bits, position_block=4)), expected(rows))


def test_second_phase_finds_links_away_from_the_leader(spark):
    """Sets that share their rarest shingle with a leader they don't link to, but link with each other."""
    rng = random.Random(3)
    core = prose(1, 100).split()
    rows = []
    for n in range(40):
        own = list(core)
        for _ in range(rng.randrange(0, 7)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(5)}"
        rows.append((n, " ".join(own), "en", "s", 0))
    same(result(spark, rows, ngram_join.Join(count_bits=6, position_block=2)), expected(rows))


def test_keep_one(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", node int")
    kept = ngram_join.keep_one(spark, docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    best = {}
    for row, (n, component, stands) in zip(rows, jaccard_classes(rows), strict=True):
        if not n:
            best[("empty", len(best))] = row
        elif row[0] == component:
            best.setdefault(stands, row)
    assert ids == sorted((r[0] is not None, r[0] or 0, r[1] or "") for r in best.values())
