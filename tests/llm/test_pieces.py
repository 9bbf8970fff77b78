"""Viterbi against the library's unigram search and against a plain dynamic programme."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tabsonde.llm import pieces
from tabsonde.llm.pieces import SPACE, Vocabulary, decode, encode
from tabsonde.llm.queries import vocabulary


@pytest.fixture(scope="module")
def model():
    return Vocabulary(vocabulary("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    """The same pieces and scores, with the file's model type set to unigram."""
    import sentencepiece
    raw = bytearray(open(vocabulary("piece_bpe_32k.model"), "rb").read())
    at = raw.index(b"tok_v0") + len(b"tok_v0")
    assert raw[at:at + 2] == b"\x18\x02"
    raw[at + 1] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(raw))


def slow(model, text):
    """Best path, longest piece first among equals, one character after another."""
    if not text:
        return []
    text = SPACE + text.replace(" ", SPACE)
    names = {}
    for i, s in zip(model.ids.tolist(), model.scores.tolist()):
        names[model.bytes[i].decode().replace(" ", SPACE)] = (i, s)
    best = [(0.0, 0, None)] + [(-np.inf, 0, None)] * len(text)
    for s in range(len(text)):
        for n in range(1, min(model.longest, len(text) - s) + 1):
            i, score = names.get(text[s:s + n], (None, model.unknown if n == 1 else -np.inf))
            if best[s][0] + score > best[s + n][0]:
                best[s + n] = (best[s][0] + score, s, i)
    ids, at = [], len(text)
    while at:
        _, s, i = best[at]
        ids[:0] = [i] if i is not None else model.byte_id[list(text[s].encode())].tolist()
        at = s
    return ids


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_like_the_library(spark, model, library):
    """Against the best of the library's n-best search (its one-best search takes short cuts); single precision
    and equal scores aside."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    words = sorted({w for t in texts for w in t.split()})[::5]
    assert len(words) > 1000
    same = 0
    for word, got in zip(words, model.encode(words)):
        best = library.nbest_encode_as_ids(word, 4)[0]
        if any(map(library.is_byte, best)):
            continue
        score = [sum(map(library.get_score, x)) for x in (ids(got), best)]
        assert score[0] >= score[1], word
        same += ids(got) == best
    assert same > 0.98 * len(words)


def test_like_plain_search(model):
    rnd = random.Random(3)
    texts = ["", " ", "  a", "a  b ", "\n\ttab", "中文字符 é \U0001f600", "x" * 500, SPACE + "a", "a" + SPACE * 5 + "b", "\x00"]
    texts += ["".join(rnd.choice("ab ethión\u2581é中\n") for _ in range(rnd.randrange(40))) for _ in range(200)]
    for text, got in zip(texts, model.encode(texts)):
        assert ids(got) == slow(model, text), text
        assert model.decode(got) == text.replace(SPACE, " ")


def test_long_words_in_stretches(model, monkeypatch):
    rnd = random.Random(9)
    text = "".join(rnd.choice("entheria") for _ in range(700))
    whole = slow(model, text)
    monkeypatch.setattr(pieces, "CELLS", 64)
    model.known.clear()
    assert ids(model.encode([text])[0]) == whole


def test_cache_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 5)
    for i in range(20):
        assert ids(model.encode([f"a{i} b{i} c{i}"])[0]) == slow(model, f"a{i} b{i} c{i}")
        assert len(model.known) <= 8


def test_frames(spark, model):
    path = vocabulary("piece_bpe_32k.model")
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "long " * 30_000), (4, "中\ntext")]
    frame = spark.createDataFrame([(*r, "ids") for r in rows], "doc_id long, text string, ids string")
    out = encode(frame, path)
    got = out.collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted(
        (i or 0, len(slow(model, t or ""))) for i, t in rows)
    assert all(r["round_trip"] and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in got)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in decode(out, path).collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert encode(frame.limit(0), path).count() == 0


def test_registered_query(spark):
    import __spark_entry__ as entry
    got = entry.queries()["op4_sentencepiece"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r["round_trip"] for r in got)
