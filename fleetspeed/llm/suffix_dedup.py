"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if some string of ``length`` bytes around it also starts earlier.  Matches lie within
documents, which are ordered by ``doc_id``; all strings are judged on the input.

1. Every string of ``length`` bytes holds an anchor, the k-gram with the least hash in it, so equal
   strings have equal anchors.  Consecutive strings with the same anchor form a run.  Runs are sorted by
   anchor and content, where content is known by two fingerprints of different rings (modulo 2 ** 64 and
   a prime) mixed into one number.  Equal runs are one row of a transform with several places: all places but
   the first are removed whole, and only anchors with different runs go on, each run once.  Copies
   within a block of texts are told apart before the shuffle and dealt anywhere, so a passage that all
   texts share meets once a block, not once a text.
2. Runs of one anchor meet in a task, in shards of ``shard_bytes``.  Each shard gets its own transform: its
   rows sorted by their first ``length`` bytes, with the strings repeated inside the shard.
3. The transforms, laid end to end, are the first interleave.  Each step puts the two symbols before a row in
   front of it and stably deals the rows by them: the interleave then is sorted by a prefix two
   symbols longer.  A block with rows of one shard only needs no more merging, its own transform has the rest,
   so its rows leave; the last step a row is seen in is its common prefix with other shards.  After
   ``length`` symbols the blocks left are the intervals that span shards.  No suffix is sorted anew.
4. In each interval the earliest start stays; the others are removed.

Anchors with more runs than a task should hold are solved by an exact shuffle of string hashes.

Null texts are empty.  Rows with the same ``doc_id`` and text are one document, which is no copy of itself, and get
the same result; of rows with one ``doc_id`` and other texts the smaller text hash counts as earlier.  A null
``doc_id`` comes first.  Texts under ``length`` bytes stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.llm.common import stored, with_text
from fleetspeed.llm.words import BLOCK, mix, power, text_blocks, text_bytes, u64

NULL_ID = -(1 << 63)
_START = 16  # bits of a place: start (31), run length (16)
_SIZE = (1 << _START) - 1
COPY = np.int64(-(1 << 63))  # sign of a place: the run is known to be a copy


@dataclass(frozen=True)
class Repeats:
    length: int = 100
    gram: int = 24
    task_bytes: int = 2 << 20  # bytes of runs that are merged at a time
    shard_bytes: int = 1 << 19  # bytes of runs in a transform
    most_runs: int = 20_000  # runs of one anchor that are merged in one task

    def __post_init__(self):
        if not 4 <= self.gram < self.length or 2 * self.length - self.gram > _SIZE:
            raise ValueError(f"anchors must be of 4 bytes or more and shorter than strings, and runs no longer than {_SIZE} bytes")


_PRIME = (1 << 31) - 1
_ROOT = 1_103_515_245
_residues: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo the prime."""
    if n not in _residues:
        tables = []
        for base in (_ROOT, pow(_ROOT, -1, _PRIME)):
            table = np.ones(1, np.int64)
            while len(table) <= n:  # twice as many each time
                table = np.concatenate([table, table * pow(base, len(table), _PRIME) % _PRIME])
            tables.append(table[: n + 1])
        _residues[n] = tuple(table.astype(np.uint32) for table in tables)
    return _residues[n]


def _fingerprints(data: np.ndarray, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of byte strings, from two rings: prefix sums modulo 2 ** 64 are given, those modulo the prime are made here."""
    up, down = _prime_powers(BLOCK)
    residue = np.zeros(len(data) + 1, np.int64)
    sums_of = residue[1:]  # made in place: blocks are large
    sums_of[:] = data
    sums_of += 1
    sums_of *= up[: len(data)]
    sums_of %= _PRIME
    np.cumsum(sums_of, out=sums_of)
    second = (residue[end] - residue[begin]) % _PRIME * down[begin] % _PRIME
    first = mix((sums[end] - sums[begin]) * power("down")[begin])
    return mix(first ^ (second.astype(u64) * u64(0x9E3779B97F4A7C15)))

def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every ``width`` consecutive ones."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, np.iinfo(u64).max, u64)
    padded[: len(keys)] = keys
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _runs(data: np.ndarray, offsets: np.ndarray, repeats: Repeats):
    """Anchor, content hash, start, length and row of each run in a block."""
    length, gram = repeats.length, repeats.gram
    if len(data) < length:
        return None
    sums = np.zeros(len(data) + 1, u64)
    np.cumsum((data.astype(u64) + u64(1)) * power("up")[: len(data)], out=sums[1:])
    down = power("down")
    grams = mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    place = np.arange(len(grams), dtype=u64)
    least = _sliding_least((grams >> u64(24) << u64(24)) | place, length - gram + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + length <= ends)
    if not len(starts):
        return None
    anchor = (least[starts] & u64((1 << 24) - 1)).astype(np.int64)
    first = np.append(True, (np.diff(anchor) != 0) | (np.diff(starts) != 1))
    head = np.flatnonzero(first)
    begin = starts[head]
    end = starts[np.append(head[1:], len(starts)) - 1] + length
    content = _fingerprints(data, sums, begin, end)
    row = np.searchsorted(offsets, begin, "right") - 1
    return grams[anchor[head]], content, begin - offsets[row], end - begin, row


def _known_in_block(anchor, content, doc, tag, place) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs of a block: which equal an earlier one of it and need not meet the others to be known as
    copies, and which are the same place of the same document once more."""
    order = np.argsort(content, kind="stable")
    equal = content[order][1:] == content[order][:-1]
    own = order[np.append(equal, False) | np.append(False, equal)] if len(order) > 1 else order[:0]
    own = own[np.lexsort((place[own], tag[own], doc[own], anchor[own], content[own]))]
    again, repeated = np.zeros(len(own), bool), np.zeros(len(own), bool)
    again[1:] = (content[own][1:] == content[own][:-1]) & (anchor[own][1:] == anchor[own][:-1])
    repeated[1:] = again[1:]
    for key in (doc, tag, place):
        repeated[1:] &= key[own][1:] == key[own][:-1]
    return own[again & ~repeated], own[repeated]


def _run_rows(batches: Iterator[pa.RecordBatch], repeats: Repeats) -> Iterator[pa.RecordBatch]:
    step = BLOCK - repeats.length + 1
    for batch in batches:
        doc, tag = batch["doc"].to_numpy(), batch["tag"].to_numpy()
        for row, data, offsets in text_blocks(batch["text"]):
            if len(data) <= BLOCK:
                parts = [(0, _runs(data, offsets, repeats))]
            else:  # one long text
                parts = (
                    (at, _runs(part, np.array([0, len(part)]), repeats))
                    for at in range(0, len(data), step)
                    for part in [data[at : at + BLOCK]]
                )
            for at, found in parts:
                if found is None:
                    continue
                anchor, content, start, size, own = found
                own = own + row
                place = (start + at) << _START | size
                copies, repeated = _known_in_block(anchor, content, doc[own], tag[own], place)
                anchor[copies] = mix((doc[own] ^ tag[own] ^ place)[copies].view(u64))  # anywhere
                place[copies] |= COPY
                columns = (anchor.view(np.int64), content.view(np.int64), doc[own], tag[own], place)
                columns = [np.delete(c, repeated) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "content", "doc", "tag", "place"])


def _first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor, content, document, tag and place: copies of runs, and the first of each.

    First runs come with their anchor, and only if the anchor has another run.  Between batches only the
    last row and the open anchor's first run are kept.
    """
    last = None  # the last row
    waiting = None  # the open anchor's first run, while it is the only one
    for batch in batches:
        anchor, content, doc, tag, place = (batch[k].to_numpy() for k in ("anchor", "content", "doc", "tag", "place"))
        known = place < 0
        if known.any():
            none = pa.nulls(int(known.sum()), pa.int64())
            copies = (doc[known], tag[known], place[known] & ~COPY)
            yield pa.RecordBatch.from_arrays([none, *map(pa.array, copies)], ["anchor", "doc", "tag", "place"])
            anchor, content, doc, tag, place = (x[~known] for x in (anchor, content, doc, tag, place))
        # The same place of a document that stands twice is one place.
        rows = np.stack([anchor, content, doc, tag, place])
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        if last is not None and len(anchor):
            fresh[0] = (rows[:, 0] != last).any()
        anchor, content, doc, tag, place = rows[:, fresh]
        n = len(anchor)
        if not n:
            continue
        new_anchor, new_run = np.ones(n, bool), np.ones(n, bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_run[1:] = new_anchor[1:] | (content[1:] != content[:-1])
        if last is not None and last[0] == anchor[0]:
            new_anchor[0] = False
            new_run[0] = last[1] != content[0]
        group = np.cumsum(new_anchor)  # 0: continues the open anchor
        runs = np.bincount(group[new_run], minlength=group[-1] + 1)
        # The open anchor counts one run more: the one that waits, or those given out before.
        open_before = last is not None and last[0] == anchor[0]
        several = runs > 1
        if open_before:
            several[0] = runs[0] > 0
        firsts = new_run & several[group]
        out_doc, out_tag, out_place = [doc[~new_run]], [tag[~new_run]], [place[~new_run]]
        out_anchor = [np.zeros(0, np.int64)]
        mask = [np.ones(int((~new_run).sum()), bool)]
        if open_before and waiting is not None and several[0]:
            out_doc.append(waiting[1:2])
            out_tag.append(waiting[2:3])
            out_place.append(waiting[3:4])
            out_anchor.append(waiting[0:1])
            mask.append(np.zeros(1, bool))
            waiting = None
        out_doc.append(doc[firsts])
        out_tag.append(tag[firsts])
        out_place.append(place[firsts])
        mask.append(np.zeros(int(firsts.sum()), bool))
        anchors = np.concatenate([np.zeros(len(mask[0]), np.int64), *out_anchor[1:], anchor[firsts]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors, mask=np.concatenate(mask)), *(pa.array(np.concatenate(x)) for x in (out_doc, out_tag, out_place))],
            ["anchor", "doc", "tag", "place"],
        )
        if group[-1] > 0:  # an anchor began in this batch and is open now
            head = np.flatnonzero(new_anchor)[-1]
            waiting = None if several[group[-1]] else np.array([anchor[head], doc[head], tag[head], place[head]])
        last = rows[:, -1]


_CHUNK = 18  # slots of a piece of the filter, as a power of two


def _filter(ids: DataFrame) -> np.ndarray:
    """Bits that hold every id, eight slots or more for each; others pass by chance only.

    At most 2 ** 29 bits, 64 MB: beyond 64 million ids more and more others pass, and results stay the same.
    It is put together from pieces that tasks make, so the driver never sees the ids.
    """
    n = ids.count()
    bits = min(29, max(_CHUNK, (8 * n).bit_length()))
    slot = F.col("doc").bitwiseAND(F.lit((1 << bits) - 1))
    pieces = (
        ids.select(F.shiftright(slot, _CHUNK).alias("piece"), slot.bitwiseAND(F.lit((1 << _CHUNK) - 1)).alias("at"))
        .groupBy("piece")
        .agg(F.collect_set("at").alias("ats"))  # at most 2 ** 18 numbers
        .mapInArrow(_bitmaps, "piece long, bits binary")
    )
    table = np.zeros((1 << bits - _CHUNK, 1 << _CHUNK - 3), np.uint8)
    for row in pieces.collect():
        table[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return table.ravel()


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for ats in batch["ats"]:
            held = np.zeros(1 << _CHUNK, bool)
            held[ats.values.to_numpy()] = True
            found.append(np.packbits(held, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch["piece"], pa.array(found, pa.binary())], ["piece", "bits"])


def _chosen(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = batch["doc"].to_numpy() & (8 * len(table) - 1)
        yield batch.filter(pa.array(table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the runs listed for each text."""
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        anchors, docs, tags, places, parts = [], [], [], [], []
        for row in range(len(batch)):
            own = batch["places"][row].values.to_numpy()
            low = offsets[row] + (own >> _START & ((1 << 31) - 1))
            parts += [data[a:b].tobytes() for a, b in zip(low, low + (own & _SIZE), strict=True)]
            places.append(own)
            anchors.append(batch["anchors"][row].values.to_numpy())
            docs.append(np.full(len(own), batch["doc"][row].as_py()))
            tags.append(np.full(len(own), batch["tag"][row].as_py()))
        columns = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (anchors, docs, tags, places)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], ["anchor", "doc", "tag", "place", "bytes"])


def transform(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a shard sorted by their first ``length`` symbols, and the first of those equal in all of them.

    A zero ends a string: nothing behind it is compared.  Prefixes are doubled; rows that are alone are done.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols up to the end mark
    padded = np.concatenate([text, np.zeros(4, text.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(4):
        key = key << 9 | np.where(left >= k, padded[k : k + n], 0)
    order = np.argsort(key, kind="stable")
    spot = np.arange(n)  # where the rows that are still tied stand
    tied = order
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, spot, 0))
    window = 4
    while True:
        alone = new & np.append(new[1:], True)
        spot, tied = spot[~alone], tied[~alone]
        if not len(tied) or window == length:
            # Rows that are tied up to their end mark are not repeated strings of the full length.
            return order, rank
        step = min(window, length - window)
        ahead = np.where(left[tied] > step, rank[np.minimum(tied + step, n - 1)] + 1, 0)
        both = rank[tied] * (n + 1) + ahead
        deal = np.argsort(both, kind="stable")
        tied, both = tied[deal], both[deal]
        new = np.append(True, both[1:] != both[:-1])
        order[spot] = tied
        rank[tied] = np.maximum.accumulate(np.where(new, spot, 0))
        window += step


def repeated_starts(shards: list[list[bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, in the strings of all shards laid end to end with a gap byte after each, of strings that occur
    twice or more, and the number of the repeated interval each belongs to; and for each place the
    common prefix with strings of other shards, to two symbols below ``length``."""
    text = np.concatenate([np.frombuffer(b"\xff".join(s) + b"\xff", np.uint8) + np.uint8(1) for s in shards])
    sizes = np.array([sum(map(len, s)) + len(s) for s in shards])
    first = np.concatenate([[0], np.cumsum(sizes)])
    # A byte 255 would be taken for an end mark: marks are known by their place.
    wide = text.astype(np.uint16)
    marks = np.cumsum([len(p) + 1 for s in shards for p in s]) - 1
    wide[text == 0] = 256
    wide[marks] = 0
    del text
    shard = np.repeat(np.arange(len(shards), dtype=np.int32), sizes)
    # Places within a task are numbers of 32 bits.
    rows, interval = np.empty(len(wide), np.int32), np.empty(len(wide), np.int32)
    for low, high in zip(first[:-1], first[1:], strict=True):
        order, rank = transform(wide[low:high], length)
        rows[low:high] = order + low
        interval[low:high] = rank + low
    ahead = np.diff(marks, prepend=-1)  # symbols of each string with its mark
    left = np.repeat(marks.astype(np.int32), ahead) - np.arange(len(wide), dtype=np.int32)
    common = np.zeros(len(wide), np.int32)

    block, depth = np.zeros(len(rows), np.int32), 0
    spanning = np.zeros(0, np.int32)
    while depth < length and len(shards) > 1:
        step = min(2, length - depth)
        rows = rows - step
        clean = (rows >= 0) & (left[np.maximum(rows, 0)] >= step)
        rows, block = rows[clean], block[clean]
        symbols = wide[rows].astype(np.int32)
        if step == 2:
            symbols = symbols << 9 | wide[rows + 1]
        deal = _dealt(symbols)
        rows, block, symbols = rows[deal], block[deal], symbols[deal]
        edge = np.append(True, (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1]))[: len(rows)]
        head = np.flatnonzero(edge)
        size = np.diff(np.append(head, len(rows)))
        # Rows of a block stand in the order of the shards.
        mixed = np.repeat(shard[rows[head]] != shard[rows[head + size - 1]], size)
        rows, block = rows[mixed], np.cumsum(edge, dtype=np.int32)[mixed]
        depth += step
        common[rows] = depth
        spanning = rows
        if not len(rows):
            break
    whole = np.flatnonzero(left >= length)
    if len(spanning):
        interval[spanning] = len(wide) + block
    values, number, counts = np.unique(interval[whole], return_inverse=True, return_counts=True)
    again = counts[number] > 1
    found, number = whole[again], number[again]
    order = np.argsort(number, kind="stable")
    return found[order], number[order], common


def _dealt(symbols: np.ndarray) -> np.ndarray:
    """Stable order of symbols of 18 bits: numbers of 16 bits are dealt in linear time."""
    low = np.argsort((symbols & 0x1FF).astype(np.uint16), kind="stable")
    return low[np.argsort((symbols[low] >> 9).astype(np.uint16), kind="stable")]


def _shards(parts: list[bytes], size: int) -> list[list[bytes]]:
    """Consecutive strings in shards of about ``size`` bytes."""
    number = np.cumsum([len(p) + 1 for p in parts]) // size
    edges = np.flatnonzero(np.diff(number)) + 1
    return [parts[a:b] for a, b in zip([0, *edges], [*edges, len(parts)], strict=True)]


def _later_starts(docs, tags, places, parts: list[bytes], repeats: Repeats) -> pa.RecordBatch:
    """Removed stretches found by merging runs: all but the earliest start of every repeated interval."""
    sizes = np.array([len(p) + 1 for p in parts])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    starts, interval, _ = repeated_starts(_shards(parts, repeats.shard_bytes), repeats.length)
    run = np.searchsorted(begin, starts, "right") - 1
    tag = tags[run]
    at = (places[run] >> _START & ((1 << 31) - 1)) + starts - begin[run]
    doc = docs[run]
    order = np.lexsort((at, tag, doc, interval))
    later = np.zeros(len(order), bool)
    later[1:] = interval[order][1:] == interval[order][:-1]
    doc, tag, at = doc[order][later], tag[order][later], at[order][later]
    order = np.lexsort((at, tag, doc))
    doc, tag, at = doc[order], tag[order], at[order]
    if not len(doc):
        return _stretches(doc, tag, at, at)
    head = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(tag) != 0) | (np.diff(at) > repeats.length)))
    tail = np.append(head[1:], len(doc)) - 1
    return _stretches(doc[head], tag[head], at[head], at[tail] + repeats.length)


def _stretches(doc, tag, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (doc, tag, start, end)], ["doc", "tag", "start", "end"])


def _merged_runs(batches: Iterator[pa.RecordBatch], repeats: Repeats) -> Iterator[pa.RecordBatch]:
    """Runs sorted by anchor are merged ``task_bytes`` at a time, an anchor's runs always together."""
    held: list[pa.RecordBatch] = []
    size = 0

    def solve(table: pa.Table) -> pa.RecordBatch:
        docs, tags, places = (table[k].to_numpy() for k in ("doc", "tag", "place"))
        return _later_starts(docs, tags, places, table["bytes"].to_pylist(), repeats)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < repeats.task_bytes:
            continue
        table = pa.Table.from_batches(held)
        anchors = table["anchor"].to_numpy()
        open_from = int(np.searchsorted(anchors, anchors[-1]))  # its runs may go on in the next batch
        if open_from:
            yield solve(table.slice(0, open_from))
        held = table.slice(open_from).combine_chunks().to_batches()
        size = sum((places & _SIZE).sum() for places in (b["place"].to_numpy() for b in held))
    if held:
        yield solve(pa.Table.from_batches(held))


def _string_rows(batches: Iterator[pa.RecordBatch], repeats: Repeats) -> Iterator[pa.RecordBatch]:
    """Hash, document and start of every string of runs."""
    for batch in batches:
        parts = batch["bytes"].to_pylist()
        docs, tags, places = (batch[k].to_numpy() for k in ("doc", "tag", "place"))
        for low in range(0, len(parts), 4096):
            own = parts[low : low + 4096]
            data = np.frombuffer(b"".join(own), np.uint8)
            begin = np.concatenate([[0], np.cumsum([len(p) for p in own])])
            sums = np.zeros(len(data) + 1, u64)
            np.cumsum((data.astype(u64) + u64(1)) * power("up")[: len(data)], out=sums[1:])
            run = np.repeat(np.arange(len(own)), np.diff(begin))
            at = np.flatnonzero(np.arange(len(data)) + repeats.length <= begin[run + 1])
            hashed = mix((sums[at + repeats.length] - sums[at]) * power("down")[at])
            place = places[low + run[at]]
            start = (place >> _START & ((1 << 31) - 1)) + at - begin[run[at]]
            columns = (hashed.view(np.int64), docs[low + run[at]], tags[low + run[at]], start)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["string", "doc", "tag", "start"])


def removed_stretches(spark: SparkSession, texts: DataFrame, repeats: Repeats) -> DataFrame:
    """``doc``, ``tag``, ``start`` and ``end`` of stretches whose bytes go; they may overlap."""
    runs = texts.select("doc", "tag", "text").mapInArrow(
        lambda b: _run_rows(b, repeats), "anchor long, content long, doc long, tag long, place long"
    )
    sorted_runs = runs.repartition("anchor").sortWithinPartitions("anchor", "content", "doc", "tag", "place")
    found = stored(spark, sorted_runs.mapInArrow(_first_runs, "anchor long, doc long, tag long, place long"), "runs")
    start = F.shiftright("place", _START).bitwiseAND(F.lit((1 << 31) - 1))
    copies = found.where("anchor IS NULL").select(
        "doc", "tag", start.alias("start"), (start + F.col("place").bitwiseAND(F.lit(_SIZE))).alias("end")
    )
    first = found.where("anchor IS NOT NULL")
    many = stored(spark, first.groupBy("anchor").count().where(F.col("count") > repeats.most_runs).select("anchor"), "large-anchors")
    shared = spark.sparkContext.broadcast(_filter(first.select("doc", "tag").distinct()))  # at most 64 MB
    listed = first.groupBy("doc", "tag").agg(F.collect_list(F.struct("place", "anchor")).alias("runs"))
    wanted = texts.select("doc", "tag", "text").mapInArrow(lambda b: _chosen(b, shared.value), "doc long, tag long, text string")
    contents = (
        wanted.dropDuplicates(["doc", "tag"])
        .join(listed, ["doc", "tag"])
        .select("doc", "tag", "text", F.col("runs.place").alias("places"), F.col("runs.anchor").alias("anchors"))
        .mapInArrow(_contents, "anchor long, doc long, tag long, place long, bytes binary")
    )
    schema = "doc long, tag long, start long, end long"
    merge = lambda b: _merged_runs(b, repeats)
    if not many.head(1):
        later = contents.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(merge, schema)
        return copies.union(later)
    contents = stored(spark, contents, "run-contents")
    small = contents.join(many, "anchor", "left_anti")
    later = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(merge, schema)
    strings = (
        contents.join(many, "anchor", "left_semi")
        .select("doc", "tag", "place", "bytes")
        .mapInArrow(lambda b: _string_rows(b, repeats), "string long, doc long, tag long, start long")
    )
    earliest = strings.groupBy("string").agg(F.min(F.struct("doc", "tag", "start")).alias("first"))
    again = (
        strings.join(earliest, "string")
        .where(F.struct("doc", "tag", "start") > F.col("first"))
        .select("doc", "tag", "start", (F.col("start") + repeats.length).alias("end"))
    )
    return copies.union(later).union(again)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each text without the bytes of its stretches."""
    names = ["doc", "tag", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        removed, spans, digests = [], [], []
        for row in range(len(batch)):
            start = batch["starts"][row].values.to_numpy()
            end = batch["ends"][row].values.to_numpy()
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(end[order])
            head = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
            low, high = start[head], reach[np.append(head[1:], len(start)) - 1]
            own = data[offsets[row] : offsets[row + 1]]
            digest, at = hashlib.sha256(), 0
            for a, b in zip(low, high, strict=True):
                digest.update(own[at:a])
                at = b
            digest.update(own[at:])
            removed.append(int((high - low).sum()))
            spans.append(len(low))
            digests.append(digest.hexdigest())
        columns = [batch["doc"], batch["tag"], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names)


def report(spark: SparkSession, docs: DataFrame, repeats: Repeats = Repeats()) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every row."""
    texts = with_text(docs).select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"),
        F.xxhash64("text").alias("tag"),
        "text",
        "doc_id",
    )
    stretches = stored(
        spark,
        removed_stretches(spark, texts, repeats)
        .groupBy("doc", "tag")
        .agg(F.collect_set(F.struct("start", "end")).alias("s"))
        .select("doc", "tag", F.col("s.start").alias("starts"), F.col("s.end").alias("ends")),
        "stretches",
    )
    shared = spark.sparkContext.broadcast(_filter(stretches))  # at most 64 MB
    changed = (
        texts.select("doc", "tag", "text")
        .mapInArrow(lambda b: _chosen(b, shared.value), "doc long, tag long, text string")
        .dropDuplicates(["doc", "tag"])
        .join(stretches, ["doc", "tag"])
        .mapInArrow(_without, "doc long, tag long, n_removed long, n_spans long, kept_sha256 string")
    )
    rows = texts.select(
        "doc_id", "doc", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("_whole")
    )
    zero = F.lit(0).cast("long")
    return rows.join(changed, ["doc", "tag"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "_whole").alias("kept_sha256"),
    )
