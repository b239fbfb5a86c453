"""Quality rules as a short-circuit cascade.

Each rule is a condition on a text that says when to reject it.  On a sample the time a rule takes
and the share it rejects are measured; rules are then asked in the order of rejections per cost,
and a row that one rule rejects is not shown to the next.  A rule's time is the least of several passes,
less that of a pass without rules, over rows that hold the measures it will find there; below the
resolution of the clock rules cost the same, and those that reject more come first.  The order
changes the work only, never what is kept.

All of it is columns: the measures below are DataFrame functions of one text and need no shuffle.
Null and empty texts have no words and measure 0.  Repeated rows are measured alike; ``doc_id`` is
carried along, null or not.  Empty input gives no rows, and an empty sample leaves the rules in
their given order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.llm.common import WORD, let, stored, unused, with_text

# Fixed values of the query's definition.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_PLACE_BITS = 31


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long")


def _same_as_neighbour(values: Column, key) -> Column:
    """Elements of a sorted array whose key also has the element before or after."""

    def repeated(value: Column, at: Column) -> Column:
        before = (at > 0) & (key(F.get(values, at - 1)) == key(value))
        after = (at < F.size(values) - 1) & (key(F.get(values, at + 1)) == key(value))
        return before | after

    return F.filter(values, repeated)


def n_repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    A text whose window hashes all differ has none.  Else windows are sorted as numbers of 33 hash
    bits and the place, and those whose hash bits meet again are compared as text, so the count is
    exact.
    """
    places = F.sequence(F.lit(0), F.size(words) - 3)
    low = (1 << _PLACE_BITS) - 1

    def hashed(at: Column) -> Column:
        return F.xxhash64(F.get(words, at), F.get(words, at + 1), F.get(words, at + 2))

    def packed(value: Column, at: Column) -> Column:
        return F.shiftleft(value, _PLACE_BITS).bitwiseOR(at.cast("long"))

    def window(at: Column) -> Column:
        place = at.bitwiseAND(F.lit(low)).cast("int")
        text = F.concat_ws(" ", F.get(words, place), F.get(words, place + 1), F.get(words, place + 2))
        return F.struct(text.alias("text"), place.alias("at"))

    def covered(starts: Column) -> Column:
        gaps = F.transform(
            starts, lambda start, n: F.coalesce(F.least(F.get(starts, n + 1) - start, F.lit(3)), F.lit(3))
        )
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def from_sorted(values: Column) -> Column:
        close = F.transform(_same_as_neighbour(values, lambda v: F.shiftright(v, _PLACE_BITS)), window)
        return let(F.sort_array(close), exact)

    def exact(windows: Column) -> Column:
        repeated = F.transform(_same_as_neighbour(windows, lambda w: w["text"]), lambda w: w["at"])
        return let(F.sort_array(repeated), covered)

    def counted(hashes: Column) -> Column:
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, let(F.sort_array(F.transform(hashes, packed)), from_sorted)).otherwise(nothing)

    nothing = F.lit(0).cast("long")
    return F.when(F.size(words) < 3, nothing).otherwise(let(F.transform(places, hashed), counted))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measures of every text, and the text."""
    text = F.col("text")
    counts = let(
        word_list(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            word_chars(w).alias("word_chars"),
            n_repeat_words(w).alias("n_repeat_words"),
        ),
    )
    return (
        with_text(docs)
        .select("doc_id", "text", counts.alias("_counts"))
        .select(
            "doc_id",
            "_counts.*",
            n_symbols(text).alias("n_symbols"),
            n_dup_lines(text).alias("n_dup_lines"),
            "text",
        )
    )


# How each measure is made from a text; a frame that has it as a column gives the column instead.
MEASURES = {
    "n_words": n_words,
    "word_chars": lambda text: word_chars(word_list(text)),
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_lines": lambda text: F.size(F.split(text, "\n")),
    "n_capitals": lambda text: F.regexp_count(text, F.lit("[A-Z]")),
    "n_small": lambda text: F.regexp_count(text, F.lit("[a-z]")),
}


@dataclass(frozen=True)
class Rule:
    """``reject`` maps a function from measure names to columns to a condition; null counts as false."""

    name: str
    reject: Callable[[Callable[[str], Column]], Column]

    def rejects(self, text: Column, known: frozenset[str] = frozenset()) -> Column:
        return F.coalesce(self.reject(lambda m: F.col(m) if m in known else MEASURES[m](text)), F.lit(False))


RULES = (
    # A third of a symbol a word: lists of separators, decorated words.
    Rule("symbols", lambda m: m("n_symbols") * 3 > m("n_words")),
    # More than half of the lines copy an earlier one.
    Rule("duplicate_lines", lambda m: m("n_dup_lines") * 2 > m("n_lines")),
    # More capitals than small letters.
    Rule("shouting", lambda m: m("n_capitals") > m("n_small")),
    # Words of prose have 2 to 20 characters on average.
    Rule("word_length", lambda m: ~m("word_chars").between(m("n_words") * 2, m("n_words") * 20)),
)


@dataclass(frozen=True)
class Sampling:
    """The rows that costs are measured on: a share of all, at most ``rows`` of them."""

    fraction: float = 0.02
    rows: int = 2000
    seed: int = 11
    passes: int = 3
    resolution: float = 0.25  # of the time of a pass without rules


def ordered_rules(
    spark: SparkSession, docs: DataFrame, rules=RULES, sampling: Sampling = Sampling(), known: frozenset[str] = frozenset()
) -> list[tuple[Rule, float, float]]:
    """Rules by rejection per cost, each with its seconds a row and share of rejected rows.

    ``known`` names the measures that are columns already when the rules are asked.
    """
    drawn = with_text(docs).sample(sampling.fraction, sampling.seed).limit(sampling.rows)
    sample = stored(spark, measured(drawn).select("text", *sorted(known)), "rule-sample")
    rows = sample.count()
    if not rows:
        return [(rule, 0.0, 0.0) for rule in rules]

    def timed(condition: Column) -> tuple[float, int]:
        seconds, counted = [], 0
        for _ in range(sampling.passes):
            started = time.perf_counter()
            counted = sample.agg(F.count_if(condition)).first()[0]
            seconds.append(time.perf_counter() - started)
        return min(seconds), counted

    # The same columns are read without a rule.
    empty, _ = timed(F.length("text") + sum((F.col(m) for m in sorted(known)), F.lit(0)) < 0)
    least = sampling.resolution * empty
    found = []
    for rule in rules:
        seconds, rejected = timed(rule.rejects(F.col("text"), known))
        found.append((rule, max(seconds - empty, least) / rows, rejected / rows))
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(rules: list[Rule], text: Column, known: frozenset[str] = frozenset()) -> Column:
    """Name of the first rule that rejects the text, null if none does; later rules aren't evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(text, known), F.lit(rule.name)).otherwise(verdict)
    return verdict


def report(spark: SparkSession, docs: DataFrame, rules=RULES, sampling: Sampling = Sampling()) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every row; rows that fail the base are not shown to the rules."""
    known = frozenset(("n_words", "word_chars", "n_symbols", "n_dup_lines"))
    order = [rule for rule, _, _ in ordered_rules(spark, docs, rules, sampling, known)]
    too_short = F.col("n_words") < MIN_WORDS
    repetitive = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    failed = F.col("base_failed")
    return (
        measured(docs)
        .withColumn("base_failed", too_short | repetitive)
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            F.when(failed, F.lit(False)).otherwise(cascade(order, F.col("text"), known).isNull()).alias("kept"),
        )
    )


def keep_passing(spark: SparkSession, docs: DataFrame, rules=RULES, sampling: Sampling = Sampling()) -> DataFrame:
    """The documents no rule rejects, with their columns as they are."""
    order = [rule for rule, _, _ in ordered_rules(spark, docs, rules, sampling)]
    name = unused(docs, "_rejected_by")
    verdict = cascade(order, F.coalesce(docs["text"], F.lit("")))
    return docs.withColumn(name, verdict).where(F.col(name).isNull()).drop(name)
