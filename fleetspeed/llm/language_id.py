"""Language identification as a mixture: the shares of languages in a text, by expectation-maximisation.

Each word of a text is taken to come from one language, drawn by the text's unknown shares.  How likely
a language makes a word follows from byte n-grams up to ``order`` 4, each order smoothed by the one
below.  A text starts with its likeliest single language.  The language whose share would raise the
likelihood most is tried next: expectation-maximisation estimates the shares of the larger set, which
stands if its log likelihood gains more than ``penalty`` + log(words) / 2.  The likelihood of shares is
concave, so a bound on the gain closes most texts without an estimate, and losslessly so.

N-grams are counted over all labelled rows: a sparse table for each task and language, summed by
Spark.  The model holds ``model_bytes`` at most, however many languages or rows there are: its tables
get narrower with more languages.  Texts are scored where they lie, without a shuffle.

Defined cases: a text that is null or has no letter has no languages (``und``, score 0), and so has
every text if no row is labelled.  Rows with a null ``doc_id``, text or language are not learned from.
Equal shares follow by language name.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.llm.common import unused
from fleetspeed.llm.quality_classifier import held_out
from fleetspeed.llm.words import BLOCK, INSIDE, text_blocks, word_blocks

UNKNOWN = "und"
DOCUMENTS = -1  # slot that counts documents
_TABLES = 7  # n-grams of four orders, contexts of the upper three
_CHUNK = 1 << 20  # bytes of words that are looked up at a time


@dataclass(frozen=True)
class Mixture:
    bits: int = 16  # slots of a table, as a power of two
    model_bytes: int = 64 << 20  # bound of the model
    smoothing: float = 3.0
    penalty: float = 6.0
    rounds: int = 30  # of expectation-maximisation
    open_tables: int = 16  # languages that a task counts before it gives out sums


class Model(NamedTuple):
    languages: list[str]  # by name
    counts: np.ndarray  # languages x slots
    log_prior: np.ndarray
    bits: int


class Tokens(NamedTuple):
    """Words of consecutive rows; each different word once."""

    row: int
    rows: int
    data: np.ndarray
    begin: np.ndarray  # of the different words
    end: np.ndarray
    word: np.ndarray  # which one each token is
    weight: np.ndarray  # how many words the token stands for
    owner: np.ndarray  # row of each token, from 0, ascending


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of a long text between words."""
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and INSIDE["plain"][data[end]]:
            end += 1
        yield at, end
        at = end


def _tokens(column: pa.Array) -> Iterator[Tokens]:
    lower = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    for row, data, offsets in text_blocks(lower):
        if len(data) <= BLOCK:
            cuts = [(0, len(data))]
        else:
            cuts = list(_pieces(data))
        parts = []
        for low, high in cuts:
            piece = offsets - low if len(cuts) == 1 else np.array([0, high - low])
            buffers = [None, pa.py_buffer(np.ascontiguousarray(piece, np.int64)), pa.py_buffer(np.ascontiguousarray(data[low:high]))]
            texts = pa.LargeStringArray.from_buffers(len(piece) - 1, buffers[1], buffers[2])
            for words in word_blocks(texts, "plain", lower=False):
                hashes, first, word = np.unique(words.hash, return_index=True, return_inverse=True)
                owner = words.owner() + words.row
                if len(cuts) == 1:
                    parts.append((hashes, words.begin[first] + piece[words.row], words.end[first] + piece[words.row], word, np.ones(len(word)), owner))
                else:  # one text: a token for each different word
                    n = np.bincount(word, minlength=len(hashes)).astype(float)
                    parts.append((hashes, words.begin[first] + low, words.end[first] + low, np.arange(len(hashes)), n, np.zeros(len(hashes), np.int64)))
        if len(parts) > 1:
            sizes = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
            parts = [tuple(np.concatenate(x) for x in zip(*[(*p[:3], p[3] + s, *p[4:]) for p, s in zip(parts, sizes, strict=True)], strict=True))]
        for _, begin, end, word, weight, owner in parts:
            yield Tokens(row, len(offsets) - 1, data, begin, end, word, weight, owner)


def _slots(data: np.ndarray, begin: np.ndarray, end: np.ndarray, bits: int):
    """Slots of the n-grams and contexts at each byte of words and their ends, and the first byte of each."""
    size = end - begin
    total = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(total[-1])
    number = np.arange(len(size))
    padded = np.full(total[-1] + 4 * len(size), 0x20, np.uint8)
    padded[index + np.repeat(4 * number + 3, size)] = data[index + np.repeat(begin - total[:-1], size)]
    first = total[:-1] + number
    at = np.arange(total[-1] + len(size)) + np.repeat(3 * (number + 1), size + 1)
    b = padded.astype(np.uint32)
    grams = [b[at]]
    for k in (1, 2, 3):
        grams.append(grams[-1] | b[at - k] << np.uint32(8 * k))
    contexts = [g >> np.uint32(8) for g in grams[1:]]
    found = []
    for table, values in enumerate((*grams, *contexts)):
        h = values * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        found.append((h >> np.uint32(32 - bits)).astype(np.int64) + (table << bits))
    return found, first


def _chunks(begin: np.ndarray, end: np.ndarray) -> Iterator[slice]:
    reach = np.cumsum(end - begin + 4)
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _CHUNK, "right")))
        yield slice(at, stop)
        at = stop


def _counted(batches: Iterator[pa.RecordBatch], bits: int, open_tables: int) -> Iterator[pa.RecordBatch]:
    """Sums of n-grams by language over the rows of a task."""
    tables: dict[str, np.ndarray] = {}

    def given_out() -> Iterator[pa.RecordBatch]:
        for name, table in tables.items():
            used = np.flatnonzero(table)
            columns = [pa.array([name] * len(used), pa.string()), pa.array(used - 1, pa.int64()), pa.array(table[used], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "slot", "n"])
        tables.clear()

    for batch in batches:
        names = batch["lang"].to_pylist()
        for tokens in _tokens(batch["text"]):
            own = names[tokens.row : tokens.row + tokens.rows]
            for name in sorted(set(own)):
                if name not in tables:
                    if len(tables) >= open_tables:
                        yield from given_out()
                    tables[name] = np.zeros((_TABLES << bits) + 1, np.int64)
                table = tables[name]
                mine = np.array([x == name for x in own])
                table[0] += int(mine.sum())
                chosen = mine[tokens.owner] if len(tokens.owner) else np.zeros(0, bool)
                weight = np.bincount(tokens.word[chosen], tokens.weight[chosen], len(tokens.begin))
                used = np.flatnonzero(weight)
                begin, end, weight = tokens.begin[used], tokens.end[used], weight[used]
                for part in _chunks(begin, end):
                    slots, _ = _slots(tokens.data, begin[part], end[part], bits)
                    times = np.repeat(weight[part], end[part] - begin[part] + 1)
                    for where in slots:
                        low = int(where.min())
                        sums = np.bincount(where - low, times)
                        table[low + 1 : low + 1 + len(sums)] += sums.astype(np.int64)
    yield from given_out()


def learn(docs: DataFrame, mixture: Mixture = Mixture()) -> Model | None:
    """N-gram counts of every language of ``docs`` (``text``, ``lang``); none without such rows."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    n = rows.select("lang").distinct().count()
    if not n:
        return None
    bits = mixture.bits
    while n * _TABLES * 4 << bits > mixture.model_bytes:
        bits -= 1
        if bits < 10:
            raise ValueError(f"{n} values of lang don't fit a model of {mixture.model_bytes} bytes")
    counts = rows.mapInArrow(lambda b: _counted(b, bits, mixture.open_tables), "lang string, slot long, n long")
    # At most a row for each slot of the model, which is bounded by model_bytes.
    found = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(pc.unique(found["lang"]).to_pylist())
    table = np.zeros((n, _TABLES << bits), np.float32)
    seen = np.zeros(n)
    for batch in found.to_batches():
        language = pc.index_in(batch["lang"], pa.array(names)).to_numpy(zero_copy_only=False)
        slot, sums = batch["slot"].to_numpy(), batch["n"].to_numpy()
        grams = slot != DOCUMENTS
        table[language[grams], slot[grams]] = sums[grams]
        seen[language[~grams]] = sums[~grams]
    return Model(names, table, np.log(seen / seen.sum()), bits)


def _log_likelihood(tokens: Tokens, model: Model, smoothing: float) -> np.ndarray:
    """Log probability of each different word under each language."""
    out = np.zeros((len(tokens.begin), len(model.languages)))
    size = 1 << model.bits
    for part in _chunks(tokens.begin, tokens.end):
        slots, first = _slots(tokens.data, tokens.begin[part], tokens.end[part], model.bits)
        for k, counts in enumerate(model.counts):
            p = (counts[slots[0]] + np.float32(1)) / np.float32(counts[:size].sum() + 256)
            for order in (1, 2, 3):
                p = (counts[slots[order]] + np.float32(smoothing) * p) / (counts[slots[order + 3]] + np.float32(smoothing))
            out[part, k] = np.add.reduceat(np.log(p), first)
    return out


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by owner, which ascends."""
    out = np.zeros((n, *values.shape[1:]))
    if len(owner):
        head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[head]] = np.add.reduceat(values, head, axis=0)
    return out


def estimate(
    likelihood: np.ndarray, weight: np.ndarray, owner: np.ndarray, shares: np.ndarray, rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """Shares after expectation-maximisation from given ones, whose zeros stay, and the log likelihood."""
    total = _sums(weight, owner, len(shares))[:, None]
    for _ in range(rounds):
        joint = shares[owner] * likelihood
        joint *= (weight / joint.sum(axis=1))[:, None]
        shares = _sums(joint, owner, len(shares)) / total
    mixed = np.log((shares[owner] * likelihood).sum(axis=1))
    return shares, _sums(weight * mixed, owner, len(shares))


def select_languages(logs: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, log_prior: np.ndarray, mixture: Mixture) -> np.ndarray:
    """Shares of the language set of highest penalised likelihood, grown by one language at a time.

    ``logs`` has a row for each token and ``owner`` its text, ascending; texts without tokens get zeros.
    """
    shares = np.zeros((n, logs.shape[1]))
    if not len(owner):
        return shares
    # The likeliest language of a word counts 1; no other one less than exp(-60).
    likelihood = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60.0))
    words = _sums(weight, owner, n)
    single = _sums(weight[:, None] * np.log(likelihood), owner, n)
    best = np.argmax(single + log_prior, axis=1)
    worded = np.flatnonzero(words)
    shares[worded, best[worded]] = 1.0
    value = single[np.arange(n), best]
    price = mixture.penalty + 0.5 * np.log(np.maximum(words, 1))
    open_rows = words > 0
    while True:
        chosen = open_rows[owner]
        if not chosen.any() or logs.shape[1] == 1:
            return shares
        texts, place = np.unique(owner[chosen], return_inverse=True)
        p, w, own = likelihood[chosen], weight[chosen], shares[texts]
        mixed = (own[place] * p).sum(axis=1)
        slope = _sums((w / mixed)[:, None] * p, place, len(texts))
        slope[own > 0] = 0
        candidate = np.argmax(slope, axis=1)
        # Shares can't gain more than this over the present ones.
        worth = slope[np.arange(len(texts)), candidate] - words[texts] > price[texts]
        open_rows[texts[~worth]] = False
        texts, keep = texts[worth], worth[place]
        if not len(texts):
            continue
        place = np.cumsum(worth)[place[keep]] - 1
        larger = own[worth] * 0.8
        larger[np.arange(len(texts)), candidate[worth]] = 0.2
        found, gained = estimate(p[keep], w[keep], place, larger, mixture.rounds)
        better = gained - price[texts] > value[texts]
        shares[texts[better]] = found[better]
        value[texts[better]] = gained[better] - price[texts[better]]
        open_rows[texts[~better]] = False


def shares_of(column: pa.Array, model: Model, mixture: Mixture = Mixture()) -> np.ndarray:
    """Shares of the languages in each text of an Arrow column."""
    out = np.zeros((len(column), len(model.languages)))
    for tokens in _tokens(column):
        logs = _log_likelihood(tokens, model, mixture.smoothing)[tokens.word]
        out[tokens.row : tokens.row + tokens.rows] = select_languages(
            logs, tokens.weight, tokens.owner, tokens.rows, model.log_prior, mixture
        )
    return out


def _as_lists(shares: np.ndarray, names: list[str]) -> pa.Array:
    """Languages of each row with their shares, largest first."""
    row, language = np.nonzero(shares)
    share = shares[row, language]
    order = np.lexsort((language, -share, row))
    row, language, share = row[order], language[order], share[order]
    offsets = np.searchsorted(row, np.arange(len(shares) + 1)).astype(np.int32)
    structs = pa.StructArray.from_arrays([pa.array(names).take(pa.array(language)), pa.array(share, pa.float64())], ["lang", "share"])
    return pa.ListArray.from_arrays(pa.array(offsets), structs)


def identify(spark: SparkSession, docs: DataFrame, model: Model | None, name: str = "languages", mixture: Mixture = Mixture()) -> DataFrame:
    """The rows of ``docs`` with one more column: languages and their shares, largest first."""
    kind = "array<struct<lang:string,share:double>>"
    if model is None:
        return docs.withColumn(name, F.array().cast(kind))
    shared = spark.sparkContext.broadcast(model)  # at most model_bytes
    letters, columns = unused(docs, "_letters"), docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.if_else(batch[letters], batch["text"], "")
            found = _as_lists(shares_of(text, shared.value, mixture), shared.value.languages)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), found], [*columns, name])

    lettered = docs.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return lettered.mapInArrow(scored, docs.withColumn(name, F.array().cast(kind)).schema)


def report(spark: SparkSession, docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and all ``languages`` of every row.

    Rows that are held out by their id are never learned from; their languages are not looked at.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = learn(known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), mixture)
    first = F.try_element_at("languages", F.lit(1))
    shown = F.transform("languages", lambda x: F.concat(x["lang"], F.lit(":"), F.format_number(x["share"], 3)))
    return identify(spark, known.select("doc_id", "text"), model, "languages", mixture).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce(first["lang"], F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce(first["share"], F.lit(0.0)).alias("score"),
        F.array_join(shown, ",").alias("languages"),
    )
