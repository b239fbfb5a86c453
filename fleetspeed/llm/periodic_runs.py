"""Periodic runs: stretches of words that repeat with a fixed period, found by Lyndon roots.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends; runs
of ``shortest`` words and ``least_exponent`` periods or more are reported.  Every such run is the
extension of a Lyndon root: a place whose longest Lyndon word, under an order of the words or its
reverse, has the length of the period.

1. Words become numbers, exactly.  A run of eight words and more repeats its 8-grams, so only zones
   in which every 8-gram occurs again in the text can hold one; zones cover runs and their neighbours.
2. In a zone, phase one of Baier's grouping suffix sorter gives the Lyndon array: suffixes lie in groups,
   first by their word, and groups are taken from the highest down.  Every suffix of the group taken
   is absorbed by the head of the block before it, and heads that absorbed equally often leave their
   group together for one just above it.  Groups end up with their longest Lyndon word as context.
   The same pass over the reversed order gives the second array; suffixes are never sorted.
3. A root followed by its copy is extended both ways by longest common extensions, a binary search
   over prefix hashes for all roots at once.  Every run is then compared word by word.

Texts are rows of their own, so nothing is shuffled.  A text is read in pieces: four bytes a word and
its different words are held.

Defined cases: null and empty texts have no words and no runs; the smallest period counts; runs may
overlap; repeated rows get equal results; a null ``doc_id`` is kept.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.llm.common import with_text

SPACES = b" \t\n\x0b\x0c\r"
PIECE = 1 << 20
GRAM = 8
u64 = np.uint64
_ODD = u64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Runs:
    shortest: int = 24
    least_exponent: int = 3

    def __post_init__(self):
        # Zones are exact for these values only: see ``repeating_zones``.
        if self.least_exponent < 3 or self.shortest < 3 * GRAM:
            raise ValueError(f"runs need three periods and {3 * GRAM} words at least")


def numbered(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Words of a text as numbers, and the word of each number."""
    known: dict[bytes, int] = {}
    codes = array("i")
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in SPACES:
            end += 1
        codes.extend([known.setdefault(word, len(known)) for word in data[at:end].split()])
        at = end
    return np.frombuffer(codes, np.int32) if codes else np.zeros(0, np.int32), list(known)


def lyndon_array(codes: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place; the end counts as smaller than all."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    edges = np.flatnonzero(np.diff(codes[order])) + 1
    members = [part.tolist() for part in np.split(order, edges)]
    top = len(members) - 1
    below = list(range(-1, top))
    above = [*range(1, top + 1), -1]
    group = np.empty(n, np.int64)
    group[order] = np.repeat(np.arange(top + 1), np.diff(np.concatenate([[0], edges, [n]])))
    group = group.tolist()
    length = [1] * n
    head_before = list(range(-1, n))  # head of the block that ends before a place
    while top >= 0:
        own = [i for i in members[top] if group[i] == top]
        members[top] = None
        if own:
            size = length[own[0]]
            absorbed: dict[int, int] = {}
            for i in own:
                head = head_before[i]
                head_before[i + size] = head
                if head >= 0:
                    absorbed[head] = absorbed.get(head, 0) + 1
            parts: dict[tuple[int, int], list[int]] = {}
            for head, times in absorbed.items():
                length[head] += times * size
                parts.setdefault((group[head], times), []).append(head)
            left, under = -1, -1
            for old, times in sorted(parts):
                # More repetitions stand above fewer ones, and all of them above the rest.
                under = under if old == left else old
                left, new = old, len(members)
                members.append(parts[old, times])
                for head in members[new]:
                    group[head] = new
                over = above[under]
                below.append(under)
                above.append(over)
                below[over] = new
                above[under] = new
                under = new
        top = below[top]
    return np.array(length, np.int64)


def _prefix_hash(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    powers = np.full(len(codes) + 1, _ODD, u64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.zeros(len(codes) + 1, u64)
    np.cumsum((codes.astype(u64) + u64(1)) * powers[:-1], out=sums[1:])
    return sums, powers


def repeating_zones(codes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches whose 8-grams all occur twice or more in the text.

    A run of period q has 3 q and 24 words at least, so each of its 8-grams has its equal q words
    later or earlier in the run; a neighbour that would extend it is in the zone as well.
    """
    n = len(codes) - GRAM + 1
    if n < 2:
        return []
    spread = (codes.astype(u64) + u64(1)) * _ODD
    spread ^= spread >> u64(29)
    grams = np.zeros(n, u64)
    for k in range(GRAM):
        grams = grams * u64(0xD6E8FEB86659FD93) + spread[k : k + n]
    ordered = np.sort(grams)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(grams, kind="stable")
    equal = grams[order][1:] == grams[order][:-1]
    again = np.zeros(n + 2, bool)
    again[1:-1][order] = np.append(equal, False) | np.append(False, equal)
    edges = np.flatnonzero(again[1:] != again[:-1])
    return [(a, b + GRAM - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _extent(codes: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """Run around a root, compared word by word."""
    differ = np.flatnonzero(codes[:-period] != codes[period:])
    k = np.searchsorted(differ, at)
    start = int(differ[k - 1]) + 1 if k else 0
    end = int(differ[k]) + period if k < len(differ) else len(codes)
    return start, end


def _extended(codes: np.ndarray, lyndon: np.ndarray, runs: Runs) -> set[tuple[int, int, int]]:
    """Start, length and period of the runs that roots of one Lyndon array extend to."""
    n = len(codes)
    sums, powers = _prefix_hash(codes)

    def equal(a, b, size):
        """Whether the words from ``a`` and from ``b``, which is behind it, are equal."""
        return (sums[a + size] - sums[a]) * powers[b - a] == sums[b + size] - sums[b]

    root = np.flatnonzero(np.arange(n) + 2 * lyndon <= n)
    root = root[equal(root, root + lyndon[root], lyndon[root])]
    if not len(root):
        return set()
    period = lyndon[root]

    def longest(most, test):
        low, high = np.zeros(len(root), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = test(middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low

    right = longest(n - root - period, lambda m: equal(root, root + period, m))
    left = longest(root, lambda m: equal(root - m, root - m + period, m))
    start, end = root - left, root + period + right
    wanted = (end - start >= runs.shortest) & (end - start >= runs.least_exponent * period)
    found = set()
    extents = np.stack([start, end, period])[:, wanted]
    extents, own = np.unique(extents, axis=1, return_inverse=True)
    for k, (s, e, q) in enumerate(extents.T.tolist()):
        if np.array_equal(codes[s : e - q], codes[s + q : e]):
            found.add((s, e - s, q))
            continue
        for at in root[wanted][own == k].tolist():  # hashes of different words were equal
            s, e = _extent(codes, at, q)
            if e - s >= max(runs.shortest, runs.least_exponent * q):
                found.add((s, e - s, q))
    return found


def runs_of(codes: np.ndarray, runs: Runs = Runs()) -> list[tuple[int, int, int]]:
    """Start, length and period of every run, by start, then period."""
    found = set()
    for low, high in repeating_zones(codes):
        if high - low < runs.shortest:
            continue
        ranks = np.unique(codes[low:high], return_inverse=True)[1]
        for order in (ranks, ranks.max() - ranks):
            found |= {(low + s, size, q) for s, size, q in _extended(order, lyndon_array(order), runs)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that stay when each run is cut to its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def _joined(codes: np.ndarray, words: list[bytes]) -> bytes:
    pieces = (codes[at : at + PIECE].tolist() for at in range(0, len(codes), PIECE))
    return b" ".join(b" ".join([words[k] for k in piece]) for piece in pieces)


Prepare = Callable[[int | None, np.ndarray], np.ndarray]


def _report(batches: Iterator[pa.RecordBatch], runs: Runs, prepare: Prepare | None) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    for batch in batches:
        texts = batch["text"].cast(pa.binary())
        for at in range(0, len(batch), 64):  # results leave in small batches: texts may be long
            part = batch.slice(at, 64)
            sizes, found, collapsed = [], [], []
            for doc, text in zip(part["doc_id"].to_pylist(), texts.slice(at, 64), strict=True):
                codes, words = numbered(text.as_py() or b"")
                if prepare is not None:
                    codes = prepare(doc, codes)
                own = runs_of(codes, runs)
                sizes.append(len(codes))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                collapsed.append(_joined(codes[kept_words(len(codes), own)] if own else codes, words))
            columns = [pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, runs: Runs = Runs(), prepare: Prepare | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length and period by start) and ``collapsed`` text.

    ``prepare`` may change the word numbers of a document before the search.
    """
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return with_text(docs).mapInArrow(lambda batches: _report(batches, runs, prepare), schema)


def periodic_tail(doc_id: int | None, codes: np.ndarray) -> np.ndarray:
    """A tenth of the documents, by a checksum of the id, get a periodic tail; a null id gets none."""
    digest = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(codes), digest // 10
    if digest % 10 or not n:
        return codes
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([codes[:a], codes[a + np.arange(n - a) % p]])


def _strongest(runs: Column) -> Column:
    """The run of the greatest length / period; of equal ones the first, then the one of least period."""

    def better(best: Column, run: Column) -> Column:
        ahead = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(ahead, run).otherwise(best)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, better)


def report(spark: SparkSession, docs: DataFrame, runs: Runs = Runs(), prepare: Prepare | None = None) -> DataFrame:
    """``n_runs``, the strongest run and digests of all runs and of the collapsed text, for every row."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return (
        find_runs(docs, runs, prepare)
        .withColumn("best", _strongest(F.col("runs")))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            best["start"].alias("start"),
            best["length"].alias("length"),
            best["period"].alias("period"),
            F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
            F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )
