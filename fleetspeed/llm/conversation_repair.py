"""Repair of broken conversations at least cost, by depth-first branch and bound.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles: perhaps a system turn, then pairs of
user and assistant.  Edits are Keep (0), Insert an empty user or assistant turn (3), Rerole to
either of them (3) and Delete (4, a must for blank and repeated turns); a truncated turn that stays adds 3.
Of the cheapest repairs the one whose edits' initials sort first is taken.

The search walks states (turns read, what the output expects next) with an explicit stack.  A prefix of
edits goes if the state was reached before by a cheaper one, or one as cheap that sorts first (the
dominance table); if its cost and the bound of the rest exceed the incumbent's; or if they are equal and
its edits sort behind the incumbent's.  Bounds come from the end backwards, where a system turn alone is
let through as a conversation.  Branches of least bound are tried first.

Conversations are cut by exact rank into parts of ``part_turns`` turns.  Each part is solved for every
state it may start and end in; a scan over the parts, which holds the four open states only, picks
the states in between; then every part is replayed on its own.  So a conversation of any size is
searched in many tasks.  What one task must do is the digest of a conversation: it streams.

Defined cases: nulls in ids and numbers are a space in ``damaged``'s checksum, in roles and texts they are one
space; turns of equal number follow by role, then text; null numbers come first; repeated rows are repeated turns.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.llm.common import stored
from fleetspeed.operators.ranks import counted, ranked, with_copies

SPACES = " \t\n\x0b\x0c\r"
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3  # costs
# What stands before: nothing, a system turn, a user turn, a whole pair.
NOTHING, SYSTEM, USER, PAIR = range(4)
STATES = range(4)
ENDS = frozenset({NOTHING, PAIR})
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"


@dataclass(frozen=True)
class Repair:
    part_turns: int = 128


class Solution(NamedTuple):
    cost: int
    audit: str


def follow(state: int) -> int:
    """State after the user or assistant turn that is expected."""
    return PAIR if state == USER else USER


def kept(state: int, initial: str) -> int | None:
    """State after a turn that is kept, if it may stand there."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    return follow(state) if initial == ("a" if state == USER else "u") else None


def bounds(initials: tuple[str, ...], faults: tuple[str, ...], exits: frozenset[int]) -> list[list[float]]:
    """For each number of turns read and each state: least cost of the rest in the relaxed problem.

    There an output of a system turn alone counts as a whole pair, so no true cost is below.
    """
    never = float("inf")
    ends = exits | ({SYSTEM} if PAIR in exits else set()) | ({PAIR} if SYSTEM in exits else set())

    def inserted(row: list[float]) -> list[float]:
        row[PAIR] = min(row[PAIR], row[USER] + INSERT)
        row[USER] = min(row[USER], row[PAIR] + INSERT)
        for state in (NOTHING, SYSTEM):
            row[state] = min(row[state], row[USER] + INSERT)
        return row

    table = [inserted([0.0 if state in ends else never for state in STATES])]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        rest, row = table[-1], []
        extra = TRUNCATED if fault == CUT else 0
        for state in STATES:
            best = rest[state] + DELETE
            if fault not in (BLANK, DUPLICATE):
                best = min(best, rest[follow(state)] + REROLE + extra)
                after = kept(state, initial)
                if after is not None:
                    best = min(best, rest[after] + extra)
            row.append(best)
        table.append(inserted(row))
    return table[::-1]


def search(initials: tuple[str, ...], faults: tuple[str, ...], entry: int, exits: frozenset[int]) -> Solution | None:
    """Cheapest edits from one state to one of ``exits``, of equal ones those that sort first."""
    rest = bounds(initials, faults, exits)
    n = len(initials)
    incumbent: Solution | None = None
    reached: dict[tuple[int, int], Solution] = {(0, entry): Solution(0, "")}
    stack = [(0, entry, Solution(0, ""))]

    def hopeless(at: int, state: int, prefix: Solution) -> bool:
        least = prefix.cost + rest[at][state]
        if least == float("inf"):
            return True
        if incumbent is None or least < incumbent.cost:
            return False
        return least > incumbent.cost or prefix.audit > incumbent.audit[: len(prefix.audit)]

    while stack:
        at, state, prefix = stack.pop()
        if reached[at, state] != prefix or hopeless(at, state, prefix):
            continue
        if at == n and state in exits and (incumbent is None or prefix < incumbent):
            incumbent = prefix
        branches = [(at, follow(state), INSERT, "I")]
        if at < n:
            branches.append((at + 1, state, DELETE, "D"))
            if faults[at] not in (BLANK, DUPLICATE):
                extra = TRUNCATED if faults[at] == CUT else 0
                branches.append((at + 1, follow(state), REROLE + extra, "R"))
                after = kept(state, initials[at])
                if after is not None:
                    branches.append((at + 1, after, extra, "K"))
        found = []
        for where, into, cost, edit in branches:
            longer = Solution(prefix.cost + cost, prefix.audit + edit)
            if (where, into) in reached and reached[where, into] <= longer or hopeless(where, into, longer):
                continue
            found.append((longer.cost + rest[where][into], edit, where, into, longer))
        for _, _, where, into, longer in sorted(found, reverse=True):  # the best one is popped first
            if (where, into) not in reached or longer < reached[where, into]:
                reached[where, into] = longer
                stack.append((where, into, longer))
    return incumbent


@lru_cache(maxsize=4096)
def solutions(initials: tuple[str, ...], faults: tuple[str, ...], first: bool, last: bool) -> tuple[tuple[int, int, int, str], ...]:
    """Cheapest edits of a part between every two states it may start and end in."""
    entries = (NOTHING,) if first else STATES
    exits = [frozenset({e}) for e in (ENDS if last else STATES)]
    found = ((entry, exit_, search(initials, faults, entry, exit_)) for entry in entries for exit_ in exits)
    return tuple((entry, *exit_, s.cost, s.audit) for entry, exit_, s in found if s is not None)


def _edited(rows: list[dict], entry: int, audit: str) -> list[dict]:
    """Turns after the edits."""
    out, at, state = [], 0, entry
    for edit in audit:
        row = None if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = kept(state, row["role"][:1])
            out.append({"role": row["role"], "text": row["text"]})
        else:
            role = "assistant" if state == USER else "user"
            state = follow(state)
            out.append({"role": role, "text": row["text"] if row else ""})
    return out


# Columns of turns in parts: rank, number, role, text, fault.
TURN = "struct<rank:long,turn:long,role:string,text:string,fault:string>"


def faulty(spark: SparkSession, turns: DataFrame, repair: Repair) -> DataFrame:
    """Turns in order, ``part_turns`` a row, with the first fault of each: ``conv_id``, ``part``, ``last`` and ``turns``."""
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    order = [F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), F.col("role"), F.col("text")]
    in_order = ranked(spark, counted(clean, "_copies"), ["conv_id"], order, "rank", "_copies")
    rows = stored(spark, with_copies(in_order, "rank", "_copies"), "repair-turns")
    # The first of equal turns, found from partial results and joined by its own place: no key is crowded.
    firsts = rows.groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("rank").alias("rank"))
    left, right = rows.alias("l"), firsts.select("conv_id", "rank").alias("r")
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.rank") == F.col("r.rank"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (
        F.when(bare == "", BLANK)
        .when(F.col("r.rank").isNull(), DUPLICATE)
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT)
    )
    marked = left.join(right, same, "left").select("l.*", fault.alias("fault"))
    part = F.floor(F.col("rank") / repair.part_turns).cast("long")
    parts = marked.groupBy("conv_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "turn", "role", "text", "fault"))).alias("turns")
    )
    ends = parts.groupBy("conv_id").agg(F.max("part").alias("_end"))
    same = F.col("p.conv_id").eqNullSafe(F.col("e.conv_id"))
    return parts.alias("p").join(ends.alias("e"), same).select("p.*", (F.col("part") == F.col("_end")).alias("last"))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("entry", pa.int64()), ("exit", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        rows = []
        for part, last, initials, faults in zip(*(batch[c].to_pylist() for c in ("part", "last", "initials", "faults")), strict=True):
            found = solutions(tuple(initials), tuple(f or "" for f in faults), part == 0, last)
            rows.append([dict(zip(("entry", "exit", "cost", "audit"), s, strict=True)) for s in found])
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["part"], batch["last"], pa.array(rows, kind)], ["conv_id", "part", "last", "solved"])


class _Open(NamedTuple):
    """Best edits up to a part's end, for one state there: what no state agrees on yet."""

    cost: int
    audit: str
    chosen: tuple[tuple[int, int, int, str], ...]  # part, entry, cost, audit


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From parts sorted by conversation and part: the state, cost and edits of each in the cheapest repair.

    Choices that all open states share are given out at once, so few parts are held.
    """
    names = ["conv_id", "part", "entry", "cost", "audit"]
    kinds = [pa.int64()] * 4 + [pa.string()]
    open_states: dict[int, _Open] = {}
    out: list[tuple] = []
    for batch in batches:
        for conv, part, last, solved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part == 0:
                open_states = {NOTHING: _Open(0, "", ())}
            best: dict[int, _Open] = {}
            for s in solved:
                before = open_states.get(s["entry"])
                if before is None:
                    continue
                step = (part, s["entry"], s["cost"], s["audit"])
                longer = _Open(before.cost + s["cost"], before.audit + s["audit"], (*before.chosen, step))
                if s["exit"] not in best or longer[:2] < best[s["exit"]][:2]:
                    best[s["exit"]] = longer
            if last:
                best = {0: min(best.values(), key=lambda o: o[:2])}
            while (first := {o.chosen[:1] for o in best.values()}) and len(first) == 1 and (step := next(iter(first))):
                out.append((conv, *step[0]))
                best = {k: _Open(o.cost, o.audit[len(step[0][3]) :], o.chosen[1:]) for k, o in best.items()}
            open_states = best
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            rows = [_edited(*x) for x in zip(*(part[c].to_pylist() for c in ("turns", "entry", "audit")), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], [*part.schema.names, "repaired"])


def repaired_parts(spark: SparkSession, turns: DataFrame, repair: Repair = Repair()) -> DataFrame:
    """Parts of conversations with ``turns`` as they were, ``repaired`` ones, ``cost`` and ``audit``."""
    parts = stored(spark, faulty(spark, turns, repair), "repair-parts")
    signs = parts.select(
        "conv_id",
        "part",
        "last",
        F.transform("turns", lambda t: F.substring(t["role"], 1, 1)).alias("initials"),
        F.transform("turns", lambda t: t["fault"]).alias("faults"),
    )
    kind = "array<struct<entry:long,exit:long,cost:long,audit:string>>"
    solved = signs.mapInArrow(_solved, f"conv_id long, part long, last boolean, solved {kind}")
    in_order = solved.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    chosen = in_order.mapInArrow(_chosen, "conv_id long, part long, entry long, cost long, audit string")
    same = F.col("p.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("p.part") == F.col("c.part"))
    both = parts.alias("p").join(chosen.alias("c"), same).select("p.conv_id", "p.part", "turns", "entry", "cost", "audit")
    schema = f"conv_id long, part long, turns array<{TURN}>, entry long, cost long, audit string, repaired array<struct<role:string,text:string>>"
    return both.mapInArrow(_replayed, schema)


def repaired_turns(spark: SparkSession, turns: DataFrame, repair: Repair = Repair()) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``part``, ``place`` in the part, ``role`` and ``text``."""
    return repaired_parts(spark, turns, repair).select("conv_id", "part", F.posexplode("repaired").alias("place", "_t")).select(
        "conv_id", "part", "place", "_t.role", "_t.text"
    )


FIELDS = ("gaps", BLANK, DUPLICATE, CUT, "illegal", "cost")
LEGAL = ("su", "ua", "au")


def _summaries(parts: DataFrame) -> DataFrame:
    """What the digest of a conversation needs from a part: counts, first and last turn, and the text."""
    initials = F.transform("turns", lambda t: F.substring(t["role"], 1, 1))
    numbers = F.filter(F.transform("turns", lambda t: t["turn"]), lambda n: n.isNotNull())
    pairs = F.zip_with(F.slice("initials", 1, F.size("initials") - 1), F.slice("initials", 2, F.size("initials")), lambda a, b: F.concat(a, b))

    def having(fault: str) -> Column:
        return F.size(F.filter("turns", lambda t: t["fault"] == fault)).cast("long").alias(fault)

    return (
        parts.withColumn("initials", initials)
        .withColumn("numbers", numbers)
        .select(
            "conv_id",
            "part",
            *[having(fault) for fault in (BLANK, DUPLICATE, CUT)],
            F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL))).cast("long").alias("illegal"),
            F.col("initials")[0].alias("first"),
            F.element_at("initials", -1).alias("final"),
            F.array_min("numbers").alias("least"),
            F.array_max("numbers").alias("most"),
            F.size(F.array_distinct("numbers")).cast("long").alias("distinct"),
            "cost",
            "audit",
            F.size("repaired").alias("n_repaired"),
            F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").alias("text"),
        )
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its parts in order; texts pass through and are not held."""
    names = ["conv_id", *FIELDS, "audit", "repaired_sha256"]
    kinds = [pa.int64()] * (len(FIELDS) + 1) + [pa.string()] * 2
    out: list[tuple] = []
    state: dict | None = None

    def closed() -> None:
        if state is not None:
            gaps = 0 if state["least"] is None else state["most"] - state["least"] + 1 - state["distinct"]
            counts = (gaps, state[BLANK], state[DUPLICATE], state[CUT], state["illegal"], state["cost"])
            out.append((state["conv_id"], *counts, state["audit"].getvalue(), state["sha"].hexdigest()))

    for batch in batches:
        for at in range(0, len(batch), 256):
            for row in batch.slice(at, 256).to_pylist():
                if row["part"] == 0:
                    closed()
                    state = dict.fromkeys((*FIELDS, "distinct"), 0) | {
                        "conv_id": row["conv_id"], "least": None, "most": None, "final": None,
                        "audit": io.StringIO(), "sha": hashlib.sha256(), "any": False,
                    }
                for name in (BLANK, DUPLICATE, CUT, "illegal", "cost", "distinct"):
                    state[name] += row[name]
                if row["part"] and state["final"] + row["first"] not in LEGAL:
                    state["illegal"] += 1
                if row["least"] is not None:
                    state["distinct"] -= state["most"] == row["least"]  # numbers ascend over the parts
                    state["least"] = row["least"] if state["least"] is None else state["least"]
                    state["most"] = row["most"]
                state["final"] = row["final"]
                state["audit"].write(row["audit"])
                if row["n_repaired"]:
                    state["sha"].update(b"\n" * state["any"] + row["text"].encode())
                    state["any"] = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
    closed()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def report(spark: SparkSession, turns: DataFrame, conversations: DataFrame, repair: Repair = Repair()) -> DataFrame:
    """Faults, cost, edits and a digest of the repaired text for each ``conv_id`` of ``conversations``.

    Conversations without turns have zeros and the digest of an empty text.
    """
    summaries = _summaries(repaired_parts(spark, turns, repair))
    in_order = summaries.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    counts = ", ".join(f"{name} long" for name in FIELDS)
    found = in_order.mapInArrow(_digests, f"conv_id long, {counts}, audit string, repaired_sha256 string").alias("f")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("i")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return ids.join(found, F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left").select(
        "i.conv_id",
        *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in FIELDS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns after damage by a checksum of conversation and number: lost, emptied, cut, repeated or of another role."""
    space = F.lit(" ")

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), space)

    lot = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    changed = conversations.select(
        "conv_id",
        "turn",
        F.when(lot == 4, "user").otherwise(role).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        lot.alias("_lot"),
    )
    times = F.when(F.col("_lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return changed.where(F.col("_lot") != 0).withColumn("_time", F.explode(times)).drop("_lot", "_time")
