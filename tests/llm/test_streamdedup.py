"""Exact deduplication against grouping in Python, also when digests collide and files arrive later."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tabsonde.llm.exchange import shared_folder
from tabsonde.llm.streamdedup import exact_dedup, ingest, sha256

TEXTS = [None, "", "  ", " ", "a b", "a  b", "a\tb", "a\n\r\x0b\x0c b", "A b", " a b", "a b ", "a b", "x" * 50_000, "c"]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        norm = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        out.append((i, min(groups[norm]), len(groups[norm]), i == min(groups[norm]), norm))
    return sorted(out)


@pytest.mark.parametrize("weak", [False, True])
def test_equal_texts(spark, weak):
    rows = [(1000 - i, TEXTS[i % len(TEXTS)]) for i in range(300)] + [(i, f"text {i}") for i in range(100)]
    frame = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, digest string").repartition(4)
    digest = (lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 2))) if weak else sha256
    got = sorted(tuple(r)[:4] for r in exact_dedup(frame, digest, per_copy=5).collect())
    assert got == [w[:4] for w in brute(rows)]
    if not weak:
        sums = {r["doc_id"]: bytes(r["digest"]).hex() for r in exact_dedup(frame).collect()}
        assert sums == {w[0]: hashlib.sha256(w[4].encode()).hexdigest() for w in brute(rows)}


def test_ids_repeat_or_are_null(spark):
    rows = [(2, "a"), (2, "a"), (None, "a"), (3, "b"), (None, "c"), (None, None)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["keep_id"], r["group_size"], r["kept"]) for r in got if r["keep_id"] is not None) == [
        (2, 3, False), (2, 3, False), (2, 3, True), (3, 1, True)]
    assert [(r["group_size"], r["kept"]) for r in got if r["keep_id"] is None] == [(1, True)] * 2
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_state_lives_on(spark):
    folder = shared_folder(spark)

    def arrive(rows):
        frame = spark.createDataFrame(rows, "d string, id long")
        frame.select(F.col("d").cast("binary").alias("digest"), F.struct(
            F.lit(False).alias("missing"), F.col("id").alias("doc_id"), F.col("id").alias("key"),
            F.lit(1).cast("long").alias("n_bytes"), F.lit("").alias("locator")).alias("keep")
        ).write.mode("append").parquet(f"{folder}/entries")
        held = ingest(spark, f"{folder}/entries", f"{folder}/state")
        return sorted((bytes(r["digest"]).decode(), r["keep"]["doc_id"], r["size"]) for r in held.collect())

    assert arrive([("p", 5), ("q", 7), ("p", 6)]) == [("p", 5, 2), ("q", 7, 1)]
    assert arrive([("p", 3), ("r", 9), ("q", 8)]) == [("p", 3, 3), ("q", 7, 2), ("r", 9, 1)]
