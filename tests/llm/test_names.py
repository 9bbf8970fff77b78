"""Columns of docs named like the operators' own keys, results and helpers change nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tabsonde.llm import cover, fertility, packing, setjoin, streamdedup, suffixes
from tabsonde.llm.exchange import stored
from tabsonde.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
NAMES = ["_row_key", "_row", "_block", "_language", "_c0", "_own", "_script", "key", "kept", "digest", "rep", "a", "b",
         "component", "sig", "block", "bucket", "n_words", "n_removed", "kept_text", "kept_bytes", "n_shingles", "size",
         "keep", "n_bytes", "n_spans", "spans", "base_failed", "length", "script", "odd name.x"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *(F.lit(7).alias(c) for c in NAMES))


def same(one, two):
    columns = [c for c in one.columns if c != "_row_key"]
    kind = lambda f: sorted(map(repr, f.select(*(f"`{c}`" for c in columns)).collect()))
    return kind(one) == kind(two)


@pytest.mark.parametrize("run", [
    lambda d: fertility.quality(d, vocabulary("piece_bpe_32k.model")), setjoin.jaccard_classes,
    lambda d: cover.substring_dedup(d), lambda d: suffixes.repeated_bytes(d), streamdedup.exact_dedup,
    lambda d: packing.pack(d, vocabulary("word_bpe_49k.json"), 4096, 1).drop("sequence_id", "offset")],
    ids=["fertility", "setjoin", "cover", "suffixes", "streamdedup", "packing"])
def test_operators(docs, clashing, run):
    assert same(run(docs), run(clashing))


@pytest.mark.parametrize("run", [cover.substring_dedup, suffixes.repeated_bytes])
def test_carried_columns(docs, clashing, run):
    got = run(clashing, carry=["_row_key", "_block", "key", "odd name.x"])
    assert got.filter("_row_key = 7 AND _block = 7 AND key = 7 AND `odd name.x` = 7").count() == docs.count()
    with pytest.raises(ValueError):
        run(clashing, carry=["n_removed"])


def test_stages(spark, docs, clashing):
    one, two = docs, clashing
    for name, stage in pipeline.STAGES[:-1]:
        one, two = stored(stage(spark, one, SF), name), stored(stage(spark, two, SF), name)
        assert two.columns == clashing.columns and two.filter("_row_key <> 7").isEmpty()
        assert same(one, two.select(*docs.columns)), name
