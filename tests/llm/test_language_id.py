"""Language shares: held-out accuracy, mixtures of known shares, and plain versions of each step."""

import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, odd_rows, same  # noqa: E402

from fleetspeed.llm import language_id, queries  # noqa: E402

SOUNDS = {
    "aa": ["ka", "lo", "mi", "tu"],
    "bb": ["zer", "gno", "pli", "tar"],
    "cc": ["éu", "ßo", "çha", "noi"],
}


def speech(lang, seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, speech(lang, 31 * k + ord(lang[0]), 60), lang, "s", 0) for k in range(40) for lang in SOUNDS]
    return language_id.learn(spark.createDataFrame(rows, DOCS))


def shares(model, texts, **options):
    found = language_id.shares_of(pa.array(texts, pa.string()), model, language_id.Mixture(**options))
    return [{name: x for name, x in zip(model.languages, row, strict=True) if x} for row in found]


def test_single_languages_and_mixtures(model):
    texts = [speech("bb", 900, 3), speech("aa", 901, 80) + " " + speech("cc", 902, 40), " ".join(speech(x, 903, 50) for x in SOUNDS)]
    one, two, three = shares(model, texts)
    assert one == {"bb": 1.0}
    assert set(two) == {"aa", "cc"} and abs(two["aa"] - 2 / 3) < 0.05
    assert set(three) == set(SOUNDS) and all(abs(x - 1 / 3) < 0.05 for x in three.values())
    assert set(shares(model, [texts[1]], penalty=1e6)[0]) == {"aa"}


def test_shares_are_the_likeliest(model):
    """No finer grid of shares of two languages has a higher likelihood."""
    rng = np.random.default_rng(3)
    likelihood, weight = rng.random((50, 2)) + 1e-3, rng.integers(1, 5, 50).astype(float)
    owner = np.repeat([0, 1], 25)
    found, value = language_id.estimate(likelihood, weight, owner, np.full((2, 2), 0.5), 400)
    for text in (0, 1):
        own = owner == text
        grid = [(weight[own] * np.log(x * likelihood[own, 0] + (1 - x) * likelihood[own, 1])).sum() for x in np.linspace(0, 1, 2001)]
        assert value[text] >= max(grid) - 1e-6
    assert np.allclose(found.sum(axis=1), 1)


def test_likelihoods_by_counting(spark):
    """Word probabilities against counts kept in dictionaries."""
    rows = [(1, "Ab ba abba, ab", "xx", "s", 0), (2, "zu bau", "yy", "s", 0)]
    model = language_id.learn(spark.createDataFrame(rows, DOCS), language_id.Mixture(bits=20))
    counts = {}
    for lang, text in (("xx", ["ab", "ba", "abba", "ab"]), ("yy", ["zu", "bau"])):
        for word in text:
            padded = "   " + word + " "
            for at in range(3, len(padded)):
                for k in range(4):
                    for key in ((lang, k, padded[at - k : at + 1]), (lang, "before", k, padded[at - k : at])):
                        counts[key] = counts.get(key, 0) + 1
    tokens = next(language_id._tokens(pa.array(["abu"])))
    logs = language_id._log_likelihood(tokens, model, 3.0)
    for lang, got in zip(model.languages, logs[0], strict=True):
        total = 0.0
        for at in range(3, 7):
            padded = "   abu "
            p = (counts.get((lang, 0, padded[at]), 0) + 1) / (counts[lang, "before", 0, ""] + 256)
            for k in (1, 2, 3):
                p = (counts.get((lang, k, padded[at - k : at + 1]), 0) + 3 * p) / (counts.get((lang, "before", k, padded[at - k : at]), 0) + 3)
            total += math.log(p)
        assert abs(got - total) < 1e-4


def test_long_texts_in_pieces(model, monkeypatch):
    texts = [speech("aa", 5, 900) + " " + speech("bb", 6, 500), "x", "", speech("cc", 7, 30), "z" * 4000 + " " + speech("bb", 8, 90)]
    whole = language_id.shares_of(pa.array(texts), model)
    for module in (language_id, sys.modules["fleetspeed.llm.words"]):
        monkeypatch.setattr(module, "BLOCK", 256)
    monkeypatch.setattr(language_id, "_CHUNK", 100)
    assert np.allclose(whole, language_id.shares_of(pa.array(texts), model), atol=1e-4)


def test_more_languages_narrow_the_model(spark):
    rows = [(k, speech("aa", k, 20), f"l{k % 30:02d}", "s", 0) for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.learn(docs, language_id.Mixture(model_bytes=4 << 20))
    assert len(model.languages) == 30 and model.counts.nbytes <= 4 << 20
    with pytest.raises(ValueError):
        language_id.learn(docs, language_id.Mixture(model_bytes=1000))


def test_report_on_odd_rows(spark):
    rows = [(*r, "x", 1.5) for r in odd_rows()] + [(50, "12 !! 34", "en", "s", 0, "x", 1.5), (51, "Ωμέγα", "en", "s", 0, "x", 1.5)]
    docs = spark.createDataFrame(rows, DOCS + ", languages string, _letters double")
    found = language_id.report(spark, docs).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    unknown = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert {5, 6, 7, 50} <= unknown and 51 not in unknown
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found if r["doc_id"] is not None)
    same(found, language_id.report(spark, docs).collect())
    assert language_id.report(spark, docs.limit(0)).count() == 0
    nothing = language_id.report(spark, docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert set(language_id.identify(spark, docs, language_id.learn(docs), "found").columns) == {*docs.columns, "found"}


def test_held_out_accuracy_and_labels(spark):
    path = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in queries.op11_language_id(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    known = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [k for k, r in found.items() if r["held_out"]]
    assert len(found) == len(known) and sum(found[k]["lang_pred"] == known[k] for k in held) >= 0.97 * len(held)
    # The languages of held-out rows change nothing.
    turned = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2, 'zz', lang) AS lang")
    same(found.values(), language_id.report(spark, turned).collect())
