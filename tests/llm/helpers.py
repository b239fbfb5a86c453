"""Documents with every odd case, and plain Python versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACED = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans({chr(65 + n): chr(97 + n) for n in range(26)})


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ré", "tu", "ßa", "ne", "po"]
    words = ["".join(rng.choice(syllables) for _ in range(1 + k % 4)) + str(k % 7) * (k % 50 == 0) for k in range(vocabulary)]
    return " ".join(rng.choice(words) + ("\n" if k % 13 == 12 else "") for k in range(n))


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"neu{rng.randrange(1000)}" for w in text.split(" "))


def odd_rows() -> list[tuple]:
    """Nulls, empty, blank, short and long texts, repeated ids and rows, copies and near copies."""
    base = prose(1, 300)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),  # exact copy
        (2, base, "en", "a", 1),  # repeated row
        (3, edited(base, 5, 0.02), "en", "b", 1),
        (4, edited(base, 6, 0.05), None, None, None),
        (5, None, "en", "b", 0),
        (6, "", "en", "b", 0),
        (7, " \n\t\r ", "en", "b", 0),
        (8, "one", "en", "c", 3),
        (9, "One", "en", "c", 3),
        (10, "one two three", "en", "c", 3),
        (None, prose(2, 80), "en", "c", 3),
        (None, None, None, None, None),
        (11, prose(3, 120) + "\n" + base[:400], "de", "c", 3),
        (11, prose(4, 90), "de", "c", 3),  # id used twice
        (12, "spam " * 4000, "de", "d", 20000),
        (13, prose(5, 20000), "de", "d", 9),
        (14, "é" * 700, "de", "d", 9),
        (15, "same line here\n" * 9 + base[-300:], "de", "d", 9),
    ]
    return rows


def words(text, pattern=SPACED, lower=False):
    text = text or ""
    return re.findall(pattern, text.translate(LOWER) if lower else text)


def jaccard_classes(rows, n=4, percent=85):
    """(set size, component, row that stands for it) of each row by comparing all pairs."""
    sets = []
    for _, text, *_ in rows:
        w = words(text, lower=True)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[root(k)] = min(least.get(root(k), row[0]), row[0])
    return [(len(sets[k]), least.get(root(k)), root(k)) for k in range(len(rows))]


def repeats_removed(rows, length=100):
    """{(doc_id, text): (bytes, removed, spans, digest)} by a set of all earlier strings."""
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, found = set(), {}
    for key in order:
        data = key[1].encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            part = data[at : at + length]
            if part in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(part)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        found[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return found


def rule_measures(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(SPACED, x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed)


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def personal_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PERSONAL.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and _luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fits:
                found.append((m.start(), rank, kind, m.end()))
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def same(left, right):
    """Rows as multisets, nulls included."""
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, left), key=key) == sorted(map(tuple, right), key=key)
