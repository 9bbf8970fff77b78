"""Hashes: arithmetic modulo the prime against Python's, and sequences that collide modulo powers of two."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tabsonde.llm import arrays
from tabsonde.llm.cover import substring_dedup
from tabsonde.llm.fertility import quality
from tabsonde.llm.queries import vocabulary
from tabsonde.llm.setjoin import jaccard_classes


def thue_morse(letters: str, steps: int = 10) -> str:
    word = letters[0]
    for _ in range(steps):
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


ONE, TWO = thue_morse("ab"), thue_morse("ba")


def test_products():
    rnd = random.Random(1)
    p = int(arrays.PRIME)
    a, b = ([rnd.choice([0, 1, p - 1, p - 2, 1 << 60, rnd.randrange(p)]) for _ in range(3000)] for _ in range(2))
    got = arrays.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist()
    assert got == [x * y % p for x, y in zip(a, b)]


@pytest.mark.parametrize("kind", [np.uint64, np.uint8])
def test_windows_are_polynomials(kind):
    rnd = random.Random(2)
    values = np.array([rnd.randrange(int(np.iinfo(kind).max) + 1) for _ in range(400)], kind)
    p, base, more = int(arrays.PRIME), arrays.BASE[0], int(kind is np.uint8)
    start, end = np.array([0, 3, 17, 0, 399]), np.array([400, 9, 380, 1, 400])
    want = [sum((int(v) + more) * pow(base, i, p) for i, v in enumerate(values[s:e])) % p for s, e in zip(start, end)]
    got = arrays.between(arrays.running(values, base), start, end, base)
    assert got.tolist() == arrays.mix(np.array(want, np.uint64)).tolist()


@pytest.mark.parametrize("lane", [0, 1])
def test_no_certain_collisions(lane):
    for steps in range(6, 14):
        data = np.frombuffer((thue_morse("ab", steps) + thue_morse("ba", steps)).encode(), np.uint8)
        half = len(data) // 2
        sums = arrays.running(data, arrays.BASE[lane])
        h = arrays.between(sums, np.array([0, half]), np.array([half, 2 * half]), arrays.BASE[lane])
        assert h[0] != h[1]


def test_operators_tell_such_words_apart(spark):
    rest = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{ONE} {rest}", "en"), (2, f"{TWO} {rest}", "en"), (3, f"{rest}\n{ONE}\n{TWO}", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    cut = {r["doc_id"]: r["n_removed"] for r in substring_dedup(docs.filter("doc_id < 3"), window=35).collect()}
    assert cut == {1: 0, 2: 0}
    lines = {r["doc_id"]: r["n_dup_lines"] for r in quality(docs, vocabulary("piece_bpe_32k.model")).collect()}
    assert lines == {1: 0, 2: 0, 3: 0}
    pair = spark.createDataFrame([(1, ONE), (2, TWO), (3, f"{ONE} x"), (4, f"{TWO} x")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_classes(pair).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert len(re.findall("ab", ONE)) > 100


def test_workers_give_freed_memory_back():
    import pyarrow as pa

    def held() -> int:
        with open("/proc/self/status") as f:
            return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) >> 10

    column, pins, before = pa.array(["x" * 1000] * 4), [], held()
    for _ in arrays.chunks(column, 1000):
        arrays_of_chunk = [np.ones(12_000) for _ in range(1000)]  # 96 MB in blocks of the heap
        pins.append(np.ones(12_000))  # the last block in use lies above them
        del arrays_of_chunk
    assert held() - before < 50
