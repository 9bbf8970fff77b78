"""Measures against a text-by-text computation, bands on planted texts."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest

from tabsonde.llm.fertility import measures, quality
from tabsonde.llm.queries import vocabulary


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = collections.Counter(windows)
    again = set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            again |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    out = [None, "", " \n\t", "\n\n a\n a\na\n", "a b c d e f g h " * 30, "\U0001f600中文 x", "z" * 70_000, "#*$%&|<>",
           "line one\nline two\nline one\r\nline one\n\nline two"]
    for _ in range(200):
        out.append(rnd.choice([" ", "\n", "  "]).join(rnd.choice(["a", "bb", "été", "я", "|", "\n"])
                                                    for _ in range(rnd.randrange(120))))
    return out


def test_measures(spark, texts):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in measures(frame.repartition(3), vocabulary("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(t), i
        ids = [x for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") for x in model.encode(w)]
        assert r["n_tokens"] == len(ids) and r["n_byte_tokens"] == sum(map(model.is_byte, ids))
        n = len(ids)
        want = -sum(c / n * math.log2(c / n) for c in collections.Counter(ids).values()) if n else 0.0
        assert abs(r["token_entropy"] - want) < 1e-9


def test_bands(spark):
    rnd = random.Random(2)
    vocab = ["".join(rnd.choice("aeioubcdfglmnprst") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(80, 300))), rnd.choice(["aa", "bb", None]))
            for i in range(600)]
    rows += [(900, " ".join("#%" + str(rnd.random()) for _ in range(200)), "aa"), (901, None, None), (902, "a b", "aa"),
             (903, " ".join("ᚠᚡᚢ" for _ in range(100)), "zz"),
             (904, " ".join("".join(chr(rnd.randint(0x100, 0x2FF)) for _ in range(6)) for _ in range(100)), "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality(frame, vocabulary("piece_bpe_32k.model")).collect()}
    assert len(got) == len(rows)
    assert sum(got[i]["kept"] for i in range(600)) >= 597
    assert not any(got[i]["kept"] for i in (900, 901, 902, 903, 904))
    assert got[901]["base_failed"] and got[902]["base_failed"] and not got[900]["base_failed"]
    assert quality(frame.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def measured(spark, parts):
    """Measured rows: (number of them, language, script, characters per token, byte share), each spread a little."""
    from functools import reduce

    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F
    fixed = {c: 300 for c in ("n_words", "word_chars", "n_tokens")} | {
        c: 0 for c in ("n_symbols", "n_dup_lines", "n_repeat_words", "n_byte_tokens")}
    return reduce(DataFrame.unionByName, [
        spark.range(n).select(
            (F.col("id") + 10_000_000 * i).alias("doc_id"), F.lit(lang).cast("string").alias("lang"),
            *(F.lit(v).cast("long").alias(c) for c, v in fixed.items()),
            (F.lit(chars) + F.col("id") % 10 / 50).alias("chars_per_token"), F.lit(byte).cast("double").alias("byte_share"),
            (F.lit(6.0) + F.col("id") % 7 / 20).alias("token_entropy"), F.lit(script).alias("script"))
        for i, (n, lang, script, chars, byte) in enumerate(parts)])


def judged(spark, monkeypatch, parts):
    """Rows kept of each part."""
    from tabsonde.llm import fertility
    monkeypatch.setattr(fertility, "measures", lambda docs, tokenizer, carry: docs)
    got = quality(measured(spark, parts), "").filter("kept").selectExpr("doc_id div 10000000 AS part").groupBy("part").count()
    kept = {r["part"]: r["count"] for r in got.collect()}
    return [kept.get(i, 0) for i in range(len(parts))]


def test_band_of_a_rare_language_in_a_large_corpus(spark, monkeypatch):
    parts = [(1_200_000, "aa", "latin", 4.0, 0), (110, "rare", "latin", 2.0, 0), (3, "rare", "latin", 4.0, 0),
             (90, "few", "latin", 2.0, 0), (500, None, "latin", 4.0, 0)]
    assert judged(spark, monkeypatch, parts) == [1_200_000, 110, 0, 0, 500]


def test_band_of_byte_share(spark, monkeypatch):
    parts = [(500, "aa", "latin", 4.0, 0), (3, "aa", "latin", 4.0, 0.4), (3, "aa", "latin", 4.0, 0.02),
             (300, "zz", "three_byte", 1.0, 0.1), (2, "zz", "three_byte", 1.0, 1.0), (200, "ru", "four_byte", 0.3, 1.0),
             (2, "few", "three_byte", 1.0, 1.0)]
    assert judged(spark, monkeypatch, parts) == [500, 0, 3, 300, 0, 200, 0]


def test_registered_query(spark):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in entry.queries()["op1_token_fertility"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for d in rows:
        r, want = got[d["doc_id"]], brute(d["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    good = [r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()]
    good = [i for i in good if not got[i]["base_failed"]]
    assert sum(got[i]["kept"] for i in good) >= 0.98 * len(good)
