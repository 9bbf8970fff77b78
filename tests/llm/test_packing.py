"""Packing against the tokenizer itself and a document-by-document best fit."""

from __future__ import annotations

import collections
import random
import struct
import zlib

import pytest

from tabsonde.llm.packing import best_fit_decreasing, pack
from tabsonde.llm.queries import vocabulary


def brute_bins(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in free if r >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(capacity - n)
    return sorted(free)


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_one_by_one(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([5, 16, 100, 257])
    lengths = [rnd.randint(1, rnd.choice([capacity, max(1, capacity // 4)])) for _ in range(rnd.randrange(1, 400))]
    counts = collections.Counter(lengths)
    used, ranks = collections.defaultdict(list), collections.defaultdict(set)
    for length, rank, items, first, per, offset in best_fit_decreasing(counts, capacity):
        for i in range(items):
            ranks[length].add(rank + i)
            used[first + i // per].append((offset + i % per * length, length))
    assert {k: len(v) for k, v in ranks.items()} == dict(counts)
    free = []
    for placed in used.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
        free.append(capacity - at)
    assert sorted(free) == brute_bins(lengths, capacity)


def check(spark, rows, capacity, group):
    from tokenizers import Tokenizer
    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    frame = spark.createDataFrame(rows, "doc_id long, text string, length string, ids string")
    got = pack(frame.repartition(3), path, capacity, 1, True, group).collect()
    want = []
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            raw = struct.pack(f"<{len(part)}I", *part)
            want.append((i, k, at, len(part), zlib.crc32(raw), raw))
    have = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    free = []
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        free.append(capacity - at)
    assert sorted(free) == brute_bins([w[3] for w in want], capacity)


def test_texts_and_edges(spark):
    rnd = random.Random(5)
    texts = [None, "", " \n", "It's. I'LL say: don't... 'S <|endoftext|>x <|ENDOFTEXT|> a<|startoftext|>", "x" * 3000,
             "H̱ ẖ İSTANBUL ΣΣ. é. É, naïve. ÉTÉ, K",
             "中文。 \U0001f600. a b c 12.5, 3.", "word " * 5000, "?!. !!, a., .a ,. \x00 z"]
    letters = "abcdefghijklmnopqrstuvwxyz.,'éA"
    texts += [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9)))
                       for _ in range(rnd.randrange(60))) for _ in range(150)]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, texts[3], "x", "y"), (None, "lost", "x", None)]
    check(spark, rows, 64, 7)
    check(spark, rows, 4096, 200_000)
    assert pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary("word_bpe_49k.json")).count() == 0


def test_registered_query(spark):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = entry.queries()["op9_best_fit_packing"](spark, sf).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    lengths = []
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = t.encode(d["text"], add_special_tokens=False).ids + [1]
        for r in by_doc.pop(d["doc_id"]):
            part = ids[r["start"]:r["start"] + r["length"]]
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]
            assert r["length"] == 4096 or r["start"] + r["length"] == len(ids)
            lengths.append(r["length"])
    assert not by_doc
    assert len({r["sequence_id"] for r in got}) == len(brute_bins(lengths, 4096))
