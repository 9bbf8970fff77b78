"""Repeated byte strings against a search over all windows; the merge against sorting."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tabsonde.llm import suffixes
from tabsonde.llm.suffixes import common, depths, front_code, front_decode, judge_group, merge, repeated_bytes


def brute(texts, size):
    seen = collections.Counter(t[i:i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        drop = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i:i + size]] > 1:
                drop[i:i + size] = b"\1" * size
        spans, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and drop[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = j + 1
        out.append((len(t), sum(drop), spans, bytes(b for b, d in zip(t, drop) if not d)))
    return out


def test_merge_is_sorting_and_compares_no_known_prefix(monkeypatch):
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(14))) for _ in range(rnd.randrange(30)))
                for _ in range(k)]
        coded = [front_decode(front_code(r)) for r in runs]
        assert [c[1] for c in coded] == runs
        calls = []

        def counted(a, b, known):
            assert a[:known] == b[:known]  # what is skipped is indeed equal
            calls.append(known)
            return common(a, b, known)

        monkeypatch.setattr(suffixes, "common", counted)
        got, before = [], b""
        for run, i, shared in merge(coded):
            item = runs[run][i]
            assert shared == common(before, item, 0) or not got
            got.append(item)
            before = item
        monkeypatch.setattr(suffixes, "common", common)
        assert got == sorted(x for r in runs for x in r)


def test_depths():
    rnd = random.Random(2)
    for _ in range(100):
        items = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(1, 9))]
        for i, got in enumerate(depths(items)):
            assert got == {common(items[i], o, 0) for j, o in enumerate(items) if j != i}


@pytest.mark.parametrize("size,gram", [(40, 8), (200, 32), (20, 5)])
def test_texts(spark, size, gram):
    rnd = random.Random(size)
    passage = " ".join(str(rnd.random()) for _ in range(2 * size // 10)).encode()
    texts = [b"", b"x", "é".encode() * size, b"ab" * 3 * size, b"a" * 3 * size, b"abc" * size]
    for i in range(60):
        body = [bytes(rnd.choice(b"abcdefghij ") for _ in range(rnd.randrange(2 * size))) for _ in range(3)]
        cut = rnd.randrange(len(passage))
        body.insert(rnd.randrange(3), rnd.choice([passage, passage[cut:], passage[:cut], b""]))
        texts.append(b"".join(body))
    base = bytes(rnd.choice(b"abcdefghij ") for _ in range(12 * size))
    for i in range(25):  # near copies with changes
        copy = bytearray(base)
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(copy))
            copy[at:at + rnd.randrange(3)] = bytes(rnd.choice(b"XYZ") for _ in range(rnd.randrange(3)))
        texts.append(bytes(copy))
    texts += texts[10:16]
    rows = [(i, t.decode("latin1") if i != 2 else t.decode(), "c") for i, t in enumerate(texts)]
    texts = [r[1].encode() for r in rows] + [b""]
    rows.append((len(rows), None, None))
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(4)
    got = {r["doc_id"]: r for r in repeated_bytes(frame, size, gram, carry=["kept"][:0]).collect()}
    for i, want in enumerate(brute(texts, size)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) == want, i
        assert r["n_spans"] == len(want[2])


def test_hot_line(spark):
    """A line in every row: no bucket gets an entry for each row, and windows across its borders are found."""
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    line = "".join(rnd.choice("KLMNOPQRST") for _ in range(150))
    rows = [(i, noise(250) + line + noise(250)) for i in range(400)]
    rows += [(400 + i, noise(30) + rows[i][1][200 + i:480] + noise(30)) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("_row_key", F.col("doc_id"))
    buckets = [0] * 64
    for r in suffixes.exchanged(frame, 200, 32, 64, hot=50).filter("run IS NOT NULL").select("bucket", "sizes").collect():
        buckets[r["bucket"]] += len(r["sizes"]) // 4
    assert max(buckets) <= 60
    wanted = brute([t.encode() for _, t in rows], 200)
    assert sum(w[1] for w in wanted) > 10_000
    for hot in (50, 10_000):
        got = {r["doc_id"]: r for r in repeated_bytes(frame.drop("_row_key"), 200, 32, hot=hot).collect()}
        for (i, _), want in zip(rows, wanted):
            assert (got[i]["n_removed"], [tuple(s) for s in got[i]["spans"]], bytes(got[i]["kept"])) == want[1:], i


def test_long_rows_in_stretches(spark, monkeypatch):
    rnd = random.Random(8)
    long = "".join(rnd.choice("abcdefgh") for _ in range(5000))
    rows = [(1, long + "!" + long[700:900]), (2, "?" + long[4000:4300]), (3, None)]
    monkeypatch.setattr(suffixes, "STRETCH", 512)
    monkeypatch.setattr(suffixes.arrays, "CHUNK", 256)
    got = {r["doc_id"]: r for r in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 60, 12).collect()}
    for (i, t), want in zip(rows, brute([(t or "").encode() for _, t in rows], 60)):
        assert (got[i]["n_removed"], bytes(got[i]["kept"])) == (want[1], want[3])


def test_ids_repeat_or_are_null(spark):
    text = "".join(random.Random(3).choice("abcdef") for _ in range(300))
    rows = [(1, text), (1, text + "x"), (None, "y" + text), (None, None)]
    got = sorted((r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in
                 repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, b""), (300, 300, b""), (301, 300, b"x"), (301, 300, b"y")]
    assert repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_query(spark):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in entry.queries()["op8_suffix_dedup"](spark, sf).collect()}
    for r, want in zip(rows, brute([r["text"].encode() for r in rows], 200)):
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (
            want[0], want[1], len(want[2]), hashlib.sha256(want[3]).hexdigest())
