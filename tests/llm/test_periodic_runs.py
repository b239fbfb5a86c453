"""Periodic runs: against all periods of all stretches."""

import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, odd_rows, prose, same, words  # noqa: E402

from fleetspeed.llm import periodic_runs, queries  # noqa: E402


def all_runs(w, shortest=24, times=3):
    """Runs by trying every period: maximal stretches in which words q apart agree."""
    found = {}
    for q in range(1, len(w) // times + 1):
        at = 0
        while at + q < len(w):
            end = at
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= max(shortest, times * q) and (at, length) not in found:
                found[at, length] = q  # the first period found is the smallest
            at = end + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def longest_lyndon(w):
    """Length of the longest Lyndon word at each place, by its definition."""
    out = []
    for i in range(len(w)):
        out.append(max(k for k in range(1, len(w) - i + 1) if all(w[i : i + k] < w[j : i + k] for j in range(i + 1, i + k))))
    return out


def planted(doc_id, w):
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    a = h // 10 % len(w)
    p = 1 + (len(w) - a) // (3 + h // 10 % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def plain_row(doc_id, text):
    w = planted(doc_id, words(text))
    runs = all_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(lines), digest(kept))


def periodic_texts():
    rng = random.Random(4)
    texts = []
    for k in range(60):
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 12))]
        body = unit * rng.randrange(2, 30) + unit[: rng.randrange(len(unit))]
        texts.append(prose(k, rng.randrange(30)) + " " + " ".join(body) + "\n" + prose(k + 99, rng.randrange(20)))
    texts += [" ".join(rng.choice("ab") for _ in range(300)) for _ in range(20)]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    return [*texts, " ".join(fibonacci[-1]), "x " * 100, ("a b " * 20 + "c ") * 5, "w " * 23, "w " * 24]


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefghij"])
def test_lyndon_arrays(letters):
    rng = random.Random(7)
    for _ in range(150):
        w = [rng.choice(letters) for _ in range(rng.randrange(1, 40))]
        codes = np.array([ord(x) for x in w])
        assert periodic_runs.lyndon_array(codes).tolist() == longest_lyndon(w)


def test_runs_of_small_alphabets():
    rng = random.Random(8)
    for text in periodic_texts():
        w = words(text)
        codes, known = periodic_runs.numbered(text.encode())
        assert [known[k].decode() for k in codes] == w
        assert periodic_runs.runs_of(codes) == all_runs(w)
    for _ in range(300):
        codes = np.array([rng.randrange(2) for _ in range(rng.randrange(24, 120))])
        assert periodic_runs.runs_of(codes) == all_runs(codes.tolist())


def test_equal_hashes_of_different_words(monkeypatch):
    """Extensions that go too far by a collision are mended word by word."""
    flat = lambda codes: (np.zeros(len(codes) + 1, np.uint64), np.ones(len(codes) + 1, np.uint64))
    codes = np.array([1, 2] * 20 + [3, 4, 5])
    monkeypatch.setattr(periodic_runs, "_prefix_hash", flat)
    assert all_runs(codes.tolist())[0] in periodic_runs.runs_of(codes)


def test_words_over_pieces(monkeypatch):
    text = prose(3, 400) + " x\x0by\x0cz\t" + "long" * 50
    whole = periodic_runs.numbered(text.encode())
    monkeypatch.setattr(periodic_runs, "PIECE", 37)
    parts = periodic_runs.numbered(text.encode())
    assert whole[0].tolist() == parts[0].tolist() and whole[1] == parts[1]
    assert periodic_runs._joined(*parts) == " ".join(words(text)).encode()


def test_report_on_odd_rows(spark):
    rows = [(*r, "x", 1.5) for r in odd_rows() if r[0] != 13] + [(1000 + k, t, "en", "s", 0, "x", 1.5) for k, t in enumerate(periodic_texts())]
    docs = spark.createDataFrame(rows, DOCS + ", runs string, start double")
    found = periodic_runs.report(spark, docs, prepare=periodic_runs.periodic_tail).collect()
    same(found, [plain_row(r[0], r[1]) for r in rows])
    assert sum(r["n_runs"] > 0 for r in found) > 40


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "go " + "on and " * 20 + "stop", "en", "s", 0), (2, None, "en", "s", 0)], DOCS)
    rows = periodic_runs.find_runs(docs).orderBy("doc_id").collect()
    assert rows[0]["collapsed"] == "go on and stop" and [tuple(r) for r in rows[0]["runs"]] == [(1, 40, 2)]
    assert rows[1]["collapsed"] == "" and rows[1]["runs"] == []
    assert periodic_runs.report(spark, docs.limit(0)).count() == 0


def test_query_reads_the_whole_table(spark):
    found = queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(table) and not re.search("None", str([r["runs_sha256"] for r in found]))
    short = {r["doc_id"]: plain_row(r["doc_id"], r["text"]) for r in table if len(words(r["text"])) < 700}
    same([r for r in found if r["doc_id"] in short], short.values())
