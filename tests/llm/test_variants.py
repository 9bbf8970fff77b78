"""Spelling variants against brute force: pairs of an acceptor, whole groups, planted slips."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest

from tabsonde.llm import variants
from tabsonde.llm.queries import QUERIES


def grouped(words: dict[str, int]):
    """word -> (form, root, n, n_near, form_n), by looking up every word with one edit."""
    alphabet = sorted(set("".join(words)))
    near = collections.defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            edits = {w[:i] + w[i + 1:]} | {w[:i] + c + w[i:] for c in alphabet} | {w[:i] + c + w[i + 1:] for c in alphabet}
            near[w] |= {x for x in edits if x in words and x != w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def result(frame):
    rows = frame.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def vocabulary(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


@pytest.mark.parametrize("letters,lengths,number,most,widest", [
    ("ab", (1, 7), 90, 20_000, 64), ("ab", (3, 8), 200, 4, 2), ("abcdéÿ", (5, 9), 3000, 20_000, 64),
    ("abcdéÿ", (5, 6), 3000, 30, 1), ("a𝄞字", (1, 5), 150, 9, 64)])
def test_random_words(spark, monkeypatch, letters, lengths, number, most, widest):
    """All settings cut partitions differently and give the same groups."""
    monkeypatch.setattr(variants, "MOST", most)
    monkeypatch.setattr(variants, "WIDEST", widest)
    rnd = random.Random(number)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(*lengths))): rnd.choice([3, 5, 6, 11, 40, 700])
             for _ in range(number)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert result(variants.spelling_variants(frame)) == grouped(words)


def test_long_words_and_chains(spark):
    base = "".join(random.Random(5).choice("abcdefgh") for _ in range(3000))
    words = {base: 100, base[:1500] + base[1501:]: 50, base[:-1]: 25, base[:2999] + "z": 12, "x" * 700: 9, "x" * 701: 4,
             "y" * 70: 3, "y" * 72: 3}
    words |= {"q" * 5 + "r" * k: 2 ** (12 - k) for k in range(10)}  # forms in a row
    frame = spark.createDataFrame([*words.items(), (None, 4), ("", 9)], "word string, n long")
    got = result(variants.spelling_variants(frame))
    assert got == grouped(words) and got["q" * 5 + "r" * 9][1] == "q" * 5


def test_texts(spark):
    """Runs, case, slips and counts of texts; nulls, empty texts, repeated rows and extra columns."""
    rnd = random.Random(8)
    stems = ["Colour", "centre", "naïve", "ÀÉÎÕÜ", "straße", "analyse", "abcd", "wörter", "×÷×÷×"]
    docs = [(1, None), (None, "colour colour"), (2, ""), (3, "12 ,;")]
    docs += [(rnd.randrange(400), " ".join(rnd.choice(stems) for _ in range(60)) + "," + rnd.choice(stems).upper())
             for _ in range(300)]
    docs += docs[-20:]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, word int, n int")
    want = vocabulary([(("" if i is None else i), t) for i, t in docs])
    words = variants.vocabulary_of(frame)
    assert dict(map(tuple, words.collect())) == want
    assert result(variants.spelling_variants(words)) == grouped(want)
    assert len(want) > 12
    assert variants.spelling_variants(variants.vocabulary_of(frame.limit(0))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(QUERIES["op13_spelling_variants"](spark, sf)) == grouped(vocabulary(docs))
