"""Substring deduplication against a search over all windows."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest

from tabsonde.llm.cover import difference_cover, substring_dedup


def brute(texts, size=35):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        drop = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                drop |= set(range(i, i + size))
        out.append((len(w), len(drop), b" ".join(x for i, x in enumerate(w) if i not in drop).decode()))
    return out


@pytest.mark.parametrize("period", [1, 2, 7, 13, 21, 30, 31])
def test_cover_reaches_every_pair(period):
    cover = set(difference_cover(period).tolist())
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


@pytest.mark.parametrize("size,period", [(35, 21), (6, 3), (8, 8), (5, 1)])
def test_random_texts(spark, size, period):
    rnd = random.Random(size)
    vocabulary = ["a", "b", "é", " x"]
    texts = [None, "", " \t\n", "a " * 500, "word"]
    for _ in range(150):
        texts.append(rnd.choice([" ", "\n", "\x0b  "]).join(rnd.choice(vocabulary) for _ in range(rnd.randrange(80))))
    passage = " ".join(str(rnd.random()) for _ in range(60))
    texts += [" ".join([str(rnd.random()) for _ in range(rnd.randrange(30))] + [passage] + ["end", str(i)])
              for i in range(60)]
    texts += texts[20:30]
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, kept_text string")
    got = {r["doc_id"]: r for r in substring_dedup(frame.repartition(3), size, period).collect()}
    for i, want in enumerate(brute(texts, size)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == want, i


def test_ids_repeat_or_are_null(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(1, passage), (1, "x " + passage), (None, passage + " y"), (None, None)],
                                  "doc_id long, text string")
    got = sorted((r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(frame).collect())
    assert got == [(0, 0, ""), (40, 40, ""), (41, 40, "x"), (41, 40, "y")]
    assert substring_dedup(frame.limit(0)).count() == 0


def test_registered_query(spark):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute([r["text"] for r in rows])
    got = {r["doc_id"]: r for r in entry.queries()["op3_substring_dedup"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r, (n, gone, kept) in zip(rows, want):
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_removed"], g["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
