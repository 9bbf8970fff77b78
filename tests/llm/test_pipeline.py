"""Every stage on its own input, against brute force; decisions take effect and rows stay whole."""

from __future__ import annotations

import re

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tabsonde.llm.exchange import stored
from tabsonde.llm.fertility import ENTROPY_TOKENS, SHORT, SPREAD, measures
from tabsonde.llm.queries import vocabulary

import test_setjoin
import test_packing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def passed(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF), name))
    return docs


def rows(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_columns(passed):
    for d in passed[1:5]:
        assert d.columns == passed[0].columns and d.dtypes == passed[0].dtypes


def test_quality(spark, passed):
    """Bands recomputed with numpy from all rows that pass the base rules."""
    m = measures(passed[0], vocabulary("piece_bpe_32k.model"), ["lang"]).toPandas()
    ok = ~((m.n_words < 20) | (100 * m.n_repeat_words > 30 * m.n_words))
    m["ratio"] = m.token_entropy / np.log2(m.n_tokens.clip(2, ENTROPY_TOKENS))
    scale = np.sqrt(1 + SHORT / m.n_tokens.clip(lower=1))
    kept = ok.copy()
    for column, name in (("chars_per_token", "lang"), ("ratio", "lang")):
        for value, group in m[ok].groupby(name):
            within = ok & (m[name] == value)
            middle = np.percentile(m[column][within].round(4), 50)
            off = ((m[column] - middle) / scale).round(4)
            low, high = np.percentile(off[within], [25, 75])
            wide = SPREAD * (high - low)
            kept &= ~within | off.between(low - wide - 1e-3, high + wide + 1e-3)
    got, want = set(rows(passed[1])), set(m.doc_id[kept].tolist())
    assert len(got ^ want) <= 0.005 * len(m)  # values rounded at the bands' edges
    before = rows(passed[0])
    assert all(tuple(r) == tuple(before[i]) for i, r in rows(passed[1]).items())


def test_exact(passed):
    before, after = rows(passed[1]), rows(passed[2])
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", before[i]["text"] or ""), i)
    assert set(after) == set(first.values())
    assert all(tuple(r) == tuple(before[i]) for i, r in after.items())


def test_near(passed):
    before, after = rows(passed[2]), rows(passed[3])
    want = {c for _, _, c in test_setjoin.brute([(i, r["text"]) for i, r in before.items()], 5, 80)}
    assert set(after) == want
    assert all(tuple(r) == tuple(before[i]) for i, r in after.items())


def test_passages(passed):
    from test_cover import brute
    before, after = rows(passed[3]), rows(passed[4])
    ids = sorted(before)
    for i, (n, gone, kept) in zip(ids, brute([before[i]["text"] for i in ids], pipeline.PASSAGE)):
        if gone and gone == n:
            assert i not in after
            continue
        r = after[i]
        assert " ".join(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) == kept and r["n_chars"] == len(r["text"])
        if not gone:
            assert r["text"] == before[i]["text"]


def test_sequences(passed):
    got = passed[5].collect()
    assert {r["doc_id"] for r in got} == set(rows(passed[4]))
    lengths = [r["length"] for r in got]
    assert len({r["sequence_id"] for r in got}) == len(test_packing.brute_bins(lengths, 4096))


def test_clean_documents_stay(spark, passed):
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    base = {r["doc_id"] for r in measures(passed[0], vocabulary("piece_bpe_32k.model"))
            .filter("n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words").collect()}
    assert len(good & base & set(rows(passed[1]))) >= 0.98 * len(good & base)


def test_odd_tables(spark):
    words = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame(
        [(1, None, None, None, None, 1), (1, words, "en", "s", 3, 2), (None, words, "en", "s", 3, 3), (2, "", "en", None, 0, 4),
         (2, words + " tail of it", None, "s", 5, 5)],
        "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for docs in (frame, frame.limit(0)):
        for i, (name, stage) in enumerate(pipeline.STAGES):
            docs = stored(stage(spark, docs, SF), name)
            if i < 4:
                assert docs.columns == frame.columns
        assert docs.count() <= 5


def test_run(spark):
    """All stages at once, at the smallest scale: pieces lie in their sequences without gaps."""
    got = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    assert len({(r["doc_id"], r["piece"]) for r in got}) == len(got) > 50
