"""Token counts against the library, for every character, odd joints, long runs and whole tables."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tabsonde.llm import arrays
from tabsonde.llm.queries import QUERIES, vocabulary
from tabsonde.llm.tokencounts import ByteBpe, token_counts

PATH = vocabulary("byte_bpe_50k.json")
EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@pytest.fixture(scope="module")
def model():
    return ByteBpe(PATH)


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def counted(model, texts):
    return [n for _, _, data, offsets in arrays.chunks(pa.array(texts, pa.string()), 1 << 21)
            for n in model.count(data, offsets).tolist()]


def test_every_character(model):
    texts = [f"a{c}1 {c}{c} {c}'s" for c in EVERY[::5]]
    assert counted(model, texts) == library(texts)


def test_random_joints(model):
    rnd = random.Random(1)
    parts = ["a", "b", "'", "s", "re", "'ll", "'t", "1", "22", " ", "  ", "\n", "\t", "é", "字", "​", " ", "!", "🙂",
             "<|endoftext|>", "<|endoftext|", "\r\n", "x'", "the", "ing", " the", "\x1c", "²", "١", "ſ", "\x00"]
    texts = [None, "", *("".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(20_000))]
    assert counted(model, texts) == library(texts)


def test_long_runs(model):
    rnd = random.Random(2)
    texts = ["a" * 100_001, "ab" * 50_000, " " * 70_000, "字" * 30_000, "\n" * 999, "aaaa" + "b" * 17,
             *("".join(rnd.choice(letters) for _ in range(150_000)) for letters in ("acgt", "abcdefghijklmnopqrstuvwxyz"))]
    assert counted(model, texts) == library(texts)
    assert counted(model, texts[::-1]) == library(texts[::-1])


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op12_token_counts"](spark, sf).collect()}
    assert set(got) == set(docs)
    for (i, text), n in zip(docs.items(), library(docs.values())):
        r = got[i]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), n, n > 1024)


def test_odd_tables(spark):
    """Nulls, empty texts, repeated rows and columns named like results; a table without rows."""
    rows = [(1, None, 9), (None, "", 9), (2, "two words", 9), (2, "two words", 9), (3, "<|endoftext|>", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(frame, PATH, 1).collect())
    assert got == [(0, 0, 0, False), (1, 0, 0, False), (2, 9, 2, True), (2, 9, 2, True), (3, 13, 1, False)]
    assert token_counts(frame.limit(0), PATH).count() == 0
