"""Topic models: planted topics, many terms, results independent of partitions, odd texts."""

from __future__ import annotations

import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsonde.functions import text as words
from tabsonde.functions import topicblocks as blocks
from tabsonde.operators import text
from tabsonde.plans.storage import Scratch


def planted(spark, texts, per_topic, topics=3, words=40):
    """Texts of `words` terms, each text about one topic; topic i has the terms i * per_topic and on."""
    pick = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda j: F.concat(F.lit("term"), F.translate(
        ((F.pmod(F.xxhash64("id", j), F.lit(per_topic)) + (F.col("id") % topics) * per_topic)).cast("string"), "0123456789", "abcdefghij")))
    return spark.range(texts).select("id", (F.col("id") % topics).alias("truth"), F.array_join(pick, " ").alias("text"))


def agreement(mixture, truth):
    """Share of texts whose strongest topic is the one most texts of their planted topic have."""
    best = mixture.groupBy("id").agg(F.max_by("topic", "share").alias("topic")).join(truth, "id")
    counts = best.groupBy("truth", "topic").count().collect()
    top = {t: max(r["count"] for r in counts if r.truth == t) for t in {r.truth for r in counts}}
    chosen = {max((r for r in counts if r.truth == t), key=lambda r: r["count"]).topic for t in top}
    return sum(top.values()) / sum(r["count"] for r in counts), len(chosen)


def test_planted_topics(spark):
    df = planted(spark, 150, 60)
    mixture = text.topic_mixture(df, "text", ["id"], 3, iterations=12)
    assert mixture.count() == 450
    for r in mixture.groupBy("id").agg(F.sum("share").alias("s")).collect():
        assert r.s == pytest.approx(1.0)
    share, found = agreement(mixture, df.select("id", "truth"))
    assert share > 0.95 and found == 3
    got = text.topics(df, "text", 3, 5, iterations=2).collect()
    assert len(got) == 15 and got[0].perplexity < 180  # of 180 terms
    again = text.topics(df.repartition(5), "text", 3, 5, iterations=2).collect()
    assert [(r.topic, r.rank, r.term) for r in again] == [(r.topic, r.rank, r.term) for r in got]


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, "the and", 2), (4, "alpha beta beta", 2), (4, "alpha beta beta", 2)],
                               "id int, text string, n int")
    got = text.topic_mixture(df, "text", ["id", "n"], 2, iterations=3).collect()
    assert len(got) == 8 and all(r.n == 2 for r in got)
    assert [r.share for r in got if r.id in (2, 3)] == [0.5] * 4
    assert text.topics(df.where("id < 3"), "text", 2, iterations=2).count() == 0


def test_half_a_million_terms(spark):
    """No bound on terms: all count, and the driver sees totals only."""
    df = planted(spark, 26_000, 190_000, 3, 60)
    model = text.fit_topics(df, "text", 3, iterations=1)
    assert model.terms > 500_000 and model.words.count() == model.terms
    assert sum(model.totals) == pytest.approx(26_000 * 60, rel=1e-9)


def test_terms_of_arrays_and_columns(spark):
    """Arrays of texts have the terms that SQL columns have, whatever the characters."""
    texts = ["", " ", "Don't  stop-me NOW", "a bb\u00a0cc\u3000dd\u2028ee\u1680ff\u0085gg", "\ud55c\uad6d\uc5b4 \ub9d0x \u3131\u314f \uac00 \ud7a3\ud7a3",
             "\u212aelvin \u0130stanbul \u00c5ngstr\u00f6m \u212bx \u03a3\u03a3", "x\x1cyy\x1fzz\x0bww", "\U0001f600emoji\U0001f600 caf\u00e9s 12 3",
             "the end", "\u200bzero\u200bwidth \u202fnarrow\u205fmath", "last\n", "\tfirst"]
    texts += [chr(c) + "a" + chr(c) + "bc d" + chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = [r.t for r in df.select("id", words.terms(F.col("text")).alias("t")).orderBy("id").collect()]
    got = [[] for _ in texts]
    first = 0
    for n, number, word in words.split_words(pa.array(texts)):
        place, names = words.coded_terms(pa.chunked_array([word]))
        for i, p in zip(number, place):
            if p >= 0:
                got[first + i].append(names[int(p)].as_py())
        first += n
    assert got == want


def test_postings_travel_once_a_step(spark):
    """A step's postings are arrays in groups: what it shuffles is some rows, not one for each posting."""
    df = planted(spark, 2_000, 400)
    model = text.fit_topics(df, "text", 3, iterations=1)
    assert model.packed.count() < 100
    assert [len(blocks._from_planes(r.b)) == len(blocks._from_planes(r.c)) > 0 for r in model.packed.where("kind = 0").collect()]


def shuffle_files(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in top for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_shuffles_of_kept_tables_go(spark):
    before = shuffle_files(spark)
    kept = Scratch(spark).keep(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    deadline = time.time() + 20
    while shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert kept.count() == 7


def test_old_counts_go_before_blocks_add_up(spark, monkeypatch):
    """While the blocks' answers are written, the counts of the step before and the shuffles they went through are gone."""
    seen, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, by=(): seen.append((name, sorted(self.paths))) or keep(self, df, name, by))
    model = text.fit_topics(planted(spark, 100, 30), "text", 3, iterations=2)
    assert model.totals and [at for name, at in seen if name == "state"] == [["given", "groups", "linked"]] * 2


def test_first_counts_go(spark):
    model = text.fit_topics(planted(spark, 100, 30), "text", 3, iterations=1)
    left = {d for d in os.listdir(model.scratch.paths["linked"].removeprefix("file://")) if d.startswith("kind=")}
    assert left == {f"kind={k}" for k in (blocks.LINK, blocks.TERMS, blocks.TOTALS)}
    assert model.words.count() == model.terms == 90
