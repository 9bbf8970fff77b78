"""Language identification: held-out accuracy, filters without false negatives, odd texts."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np

import __spark_entry__ as entry
from tabsonde.llm.language import LEAST, SlicedBloom, learn, ngrams, predict


def test_ngrams():
    data = "aB, é".encode() + b"" + b"x"
    codes, rows = ngrams(np.frombuffer(data, np.uint8), np.array([0, len(data) - 1, len(data) - 1, len(data)]))
    got = sorted((int(r), int(c & np.uint64((1 << (8 * int(s))) - 1)).to_bytes(int(s), "big"))
                 for r, c, s in zip(rows, codes, [int(c) >> 24 if int(c) >> 24 == 3 else int(c) >> 32 for c in codes]))
    e = "é".encode()
    assert got == sorted([(0, b" ab"), (0, b"ab "), (0, b" ab "), (0, b" " + e), (0, e + b" "), (0, b" " + e + b" "),
                          (2, b" x ")])


def test_filters_hold_every_language():
    rng = np.random.default_rng(1)
    grams = [rng.integers(0, 2**40, 500).tolist() for _ in range(130)]
    bloom = SlicedBloom(grams)
    for i, g in enumerate(grams):
        masks = bloom.containing(np.array(g, np.uint64))
        assert ((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = rng.integers(2**41, 2**42, 20_000, dtype=np.uint64)
    share = bloom.shares(other, np.zeros(len(other), np.int64), 1)
    assert share.max() < 0.01  # false positives are taken off


def test_planted_languages(spark):
    rnd = random.Random(4)
    words = {name: ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(300)]
             for name, letters in (("aa", "abcde"), ("bb", "efghij"), ("cc", "éèàç"))}
    def text(name):
        return " ".join(rnd.choice(words[name]) for _ in range(rnd.randint(5, 60)))
    rows = [(i, name, text(name)) for i, name in enumerate(["aa", "bb", "cc"] * 60)]
    train = spark.createDataFrame([*rows, (900, None, text("aa")), (901, "bb", None)], "doc_id long, lang string, text string")
    model = learn(train)
    assert {m[0] for m in model} == {"aa", "bb", "cc"}
    assert learn(train.repartition(7)) == model
    ask = [(i, name, text(name)) for i, name in enumerate(["aa", "bb", "cc"] * 30)]
    odd = [(100, "und", None), (101, "und", ""), (102, "und", " 12,!\n"), (103, "und", "\u2014 \u00d7 5"),
           (104, None, "z"), (105, None, "中文"), (106, "aa", text("aa") * 3000), (None, "bb", text("bb"))]
    got = {r["doc_id"]: r for r in predict(
        spark.createDataFrame([(i, t, 0.5) for i, _, t in ask + odd], "doc_id long, text string, score double"), model).collect()}
    for i, name, _ in ask + odd:
        if name:
            assert got[i]["lang_pred"] == name, i
        assert 0 <= got[i]["score"] <= 1 and got[i]["lang_pred"] in {"aa", "bb", "cc", "und"}
    assert got[104]["lang_pred"] != "und" and got[105]["lang_pred"] != "und"
    empty = train.limit(0)
    assert learn(empty) == [] and predict(empty, model).count() == 0
    assert predict(train.select("doc_id", "text"), []).filter("lang_pred <> 'und'").count() == 0


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entry.queries()["op10_language_id"](spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held)
    assert len(held) > 200 and right / len(held) > 0.97


def test_verdicts_against_plain_sets(spark):
    """Shares of n-grams by Python sets; false positives of the filters bound the difference."""
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]

    def grams(text):
        folded = " " + "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in text) + " "
        raw = folded.encode()
        return [raw[i:i + n] for n in (3, 4) for i in range(len(raw) - n + 1) if b" " not in raw[i + 1:i + n - 1]]

    learnt = collections.defaultdict(collections.Counter)
    for i, text, lang in docs:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            learnt[lang].update(grams(text))
    sets = {k: {g for g, n in c.items() if n >= LEAST * c.total()} for k, c in learnt.items()}
    got = {r["doc_id"]: r for r in entry.queries()["op10_language_id"](spark, sf).collect()}
    for i, text, _ in docs:
        found = grams(text or "")
        if not any(map(str.isalpha, text or "")):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        share = {k: sum(g in s for g in found) / len(found) for k, s in sets.items()}
        best = max(share.values())
        assert abs(got[i]["score"] - best) < 0.02 + 1 / len(found) and share[got[i]["lang_pred"]] > best - 0.02
