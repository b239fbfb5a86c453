"""Conversation repair: against trying all edits, and against a whole-conversation search."""

import hashlib
import random
import re
import sys
import zlib
from itertools import product
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import same  # noqa: E402

from fleetspeed.llm import conversation_repair as cr  # noqa: E402
from fleetspeed.llm import queries  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string"
COST = {"K": 0, "I": 3, "R": 3, "D": 4}


def every_repair(initials, faults):
    """Cheapest edits by trying each edit of each turn with up to two insertions at each place."""
    n, best = len(initials), None
    inserts = [("",), ("I",), ("I", "I")]
    for edits in product("KRD", repeat=n):
        if any(f in ("blank", "duplicate") and e != "D" for e, f in zip(edits, faults)):
            continue
        base = sum(COST[e] for e in edits) + sum(3 for e, f in zip(edits, faults) if f == "truncated" and e != "D")
        for gaps in product(inserts, repeat=n + 1):
            audit = "".join("".join(g) + e for g, e in zip(gaps, (*edits, "")))
            cost = base + 3 * audit.count("I")
            if best is not None and (cost, audit) >= best:
                continue
            for roles in product("ua", repeat=sum(e in "RI" for e in audit)):
                given, kept, out = iter(roles), iter(initials), ""
                for e in audit:
                    initial = next(kept) if e != "I" else None
                    out += next(given) if e in "RI" else initial if e == "K" else ""
                if re.fullmatch("(s?(ua)+)?", out):
                    best = (cost, audit)
                    break
    return best


def cheapest(initials, faults):
    """(cost, audit) state by state over the whole conversation; held against every_repair below."""
    layer = {"": (0, "")}  # what the output ends with: nothing, s, u, a

    def spread(found):
        for _ in range(4):
            for state, (cost, audit) in list(found.items()):
                into = "a" if state == "u" else "u"
                if into not in found or (cost + 3, audit + "I") < found[into]:
                    found[into] = (cost + 3, audit + "I")
        return found

    for initial, fault in zip(initials, faults):
        following = {}
        for state, (cost, audit) in spread(layer).items():
            steps = [(state, 4, "D")]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                expected = "a" if state == "u" else "u"
                steps.append((expected, 3 + extra, "R"))
                if initial == expected or initial == "s" and state == "":
                    steps.append((initial, extra, "K"))
            for into, price, edit in steps:
                if into not in following or (cost + price, audit + edit) < following[into]:
                    following[into] = (cost + price, audit + edit)
        layer = following
    return min(v for k, v in spread(layer).items() if k in ("", "a"))


def plain_rows(conversations):
    """The report of each conversation after damage, in plain Python."""
    by_id = {}
    for conv, turn, role, text in conversations:
        rows = by_id.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        lot = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        role = "user" if lot == 4 else role
        rows += [(turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    out = []
    for conv, rows in by_id.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        cost, audit = cheapest(initials, faults)
        numbers = {r[0] for r in rows} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        lines, state, at = [], "", 0
        for e in audit:
            row = rows[at] if e != "I" else None
            at += e != "I"
            if e == "D":
                continue
            role = row[1] if e == "K" else "assistant" if state == "u" else "user"
            state = role[0]
            lines.append(f"{role}:{row[2] if row else ''}")
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def made(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        n = rng.randrange(1, most)
        for turn in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("system" if turn == 0 and conv % 3 == 0 else ("user", "assistant")[turn % 2])
            text = rng.choice(["Yes.", "no", "what?", "", " \n", None]) if rng.random() < 0.3 else f"t{rng.randrange(500)} said!\n"
            rows.append((conv, None if rng.random() < 0.05 else turn + 3 * (rng.random() < 0.1), role if rng.random() > 0.03 else rng.choice(["system", "tool", "", None]), text))
    return rows


def test_search_against_all_edits():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randrange(0, 5)
        initials = tuple(rng.choice("suax") for _ in range(n))
        faults = tuple(rng.choice(["", "", "blank", "duplicate", "truncated"]) for _ in range(n))
        expected = every_repair(initials, faults)
        assert tuple(cr.search(initials, faults, cr.NOTHING, cr.ENDS)) == expected == cheapest(initials, faults)


def test_bounds_are_never_above_the_cost():
    rng = random.Random(6)
    for _ in range(100):
        n = rng.randrange(0, 12)
        initials = tuple(rng.choice("sua") for _ in range(n))
        faults = tuple(rng.choice(["", "blank", "truncated"]) for _ in range(n))
        for entry in cr.STATES:
            for exit_ in cr.STATES:
                found = cr.search(initials, faults, entry, frozenset({exit_}))
                if found:
                    assert cr.bounds(initials, faults, frozenset({exit_}))[0][entry] <= found.cost


def test_long_conversations_stay_cheap_to_search():
    rng = random.Random(7)
    initials = tuple(rng.choice("ssuuuaaax") for _ in range(1500))
    faults = tuple(rng.choice(["", "", "truncated", "blank"]) for _ in range(1500))
    assert tuple(cr.search(initials, faults, cr.NOTHING, cr.ENDS)) == cheapest(initials, faults)


@pytest.mark.parametrize("part_turns", [1, 3, 128])
def test_report_in_parts(spark, part_turns):
    rows = made(part_turns, 25, 30) + [(None, 4, "user", "a?"), (None, None, None, None), (77, 0, "user", "x.")] + [(78, 2, "user", "Hi.")] * 5
    table = spark.createDataFrame([(*r, "z") for r in rows], TURNS + ", audit string")
    found = cr.report(spark, cr.damaged(table), table, cr.Repair(part_turns=part_turns)).collect()
    same(found, plain_rows(rows))


def test_conversations_that_are_lost_and_empty_tables(spark):
    gone = next(k for k in range(500) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Hi.")], TURNS)
    row = cr.report(spark, cr.damaged(table), table).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cr.report(spark, table.limit(0), table.limit(0)).count() == 0


def test_repaired_turns_read_well(spark):
    table = spark.createDataFrame(made(9, 20, 40), TURNS)
    rows = cr.repaired_turns(spark, table, cr.Repair(part_turns=5)).orderBy("conv_id", "part", "place").collect()
    by_id = {}
    for r in rows:
        by_id[r["conv_id"]] = by_id.get(r["conv_id"], "") + r["role"][:1]
    assert by_id and all(re.fullmatch("(s?(ua)+)?", x) for x in by_id.values())


def test_query_on_the_whole_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op12_conversation_repair(spark, path).collect(), plain_rows(rows))
