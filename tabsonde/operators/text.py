"""Text: cleaning, keywords, sentiment and topics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsonde.functions import topicblocks as blocks
from tabsonde.functions.text import NEGATIVE, POSITIVE, STOP_WORDS, clean, is_term, listed_words, occurrences, words
from tabsonde.plans.parallel import widen
from tabsonde.plans.storage import Scratch


def clean_text(df: DataFrame, text: str) -> DataFrame:
    return widen(df).withColumn(text, clean(F.col(text)))


def term_counts(df: DataFrame, text: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(term, n) over all texts; frequent terms are combined on the map side.

    explode_outer, because explode would have the texts split again to test for empty arrays.
    """
    texts = widen(df.select(text).where(F.col(text).isNotNull()))
    return (texts.select(F.explode_outer(words(F.col(text))).alias("term"))
            .where(F.col("term").isNotNull() & is_term(F.col("term"), list(stop_words)))
            .groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def keywords_by_frequency(df: DataFrame, text: str, n: int = 10,
                          stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    return term_counts(df, text, stop_words).orderBy(F.desc("n"), "term").limit(n)


def keywords_by_tfidf(df: DataFrame, text: str, n: int = 10,
                      stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(term, score): the n most frequent terms by their mean TF-IDF over all texts.

    idf = ln((1 + texts) / (1 + texts with the term)) + 1, and the weights of a text are
    scaled to length one. Counts stay on the row of their text, so nothing is shuffled per
    text and long texts need no regrouping.
    """
    vocabulary = [r["term"] for r in keywords_by_frequency(df, text, n, stop_words).collect()]  # n rows
    if not vocabulary:
        return df.sparkSession.createDataFrame([], "term string, score double")
    rows = widen(df.select(text).where(F.col(text).isNotNull())).select(listed_words(F.col(text), vocabulary).alias("terms"))

    def times(term: str):
        return (F.size("terms") - F.size(F.array_remove("terms", F.lit(term)))).cast("double")

    size = range(len(vocabulary))
    # n numbers per text are kept between the two passes, not the texts.
    counted = rows.select(*[times(v).alias(f"c{i}") for i, v in enumerate(vocabulary)])
    scratch = Scratch(df.sparkSession)
    counted = scratch.keep(counted, "counted")
    seen = counted.agg(F.count(F.lit(1)).alias("texts"), *[F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in size]).first()
    idf = [math.log((1 + seen["texts"]) / (1 + seen[f"d{i}"])) + 1 for i in size]
    weighed = counted.select(*[(F.col(f"c{i}") * F.lit(idf[i])).alias(f"w{i}") for i in size])
    norm = F.sqrt(sum((F.col(f"w{i}") ** 2 for i in size), F.lit(0.0)))
    scores = weighed.withColumn("norm", norm).agg(*[
        F.avg(F.coalesce(F.try_divide(f"w{i}", "norm"), F.lit(0.0))).alias(f"s{i}") for i in size]).first()
    scratch.drop("counted")
    return (df.sparkSession.createDataFrame([(v, scores[f"s{i}"]) for i, v in enumerate(vocabulary)], "term string, score double")
            .orderBy(F.desc("score"), "term"))


def word_weights(df: DataFrame, text: str, n: int = 200, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(term, n, weight): the n most frequent terms relative to the most frequent one."""
    top = keywords_by_frequency(df, text, n, stop_words)
    best = F.broadcast(top.agg(F.max("n").alias("best")))  # one row
    return top.crossJoin(best).select("term", "n", (F.col("n") / F.col("best")).alias("weight"))


def sentiment(df: DataFrame, text: str, positive: Sequence[str] = POSITIVE,
              negative: Sequence[str] = NEGATIVE) -> DataFrame:
    """Add positive_words, negative_words, sentiment and score in [-1, 1]."""
    out = (widen(df).withColumn("positive_words", occurrences(F.col(text), list(positive)))
           .withColumn("negative_words", occurrences(F.col(text), list(negative))))
    p, n = F.col("positive_words"), F.col("negative_words")
    return (out.withColumn("sentiment", F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral"))
            .withColumn("score", F.when(p > n, p / (p + n)).when(n > p, -n / (p + n)).otherwise(0.0)))


def sentiment_summary(df: DataFrame, text: str, **lexicon: Sequence[str]) -> DataFrame:
    """(sentiment, n, mean_score) per label and the mean over all texts on every row."""
    rows = sentiment(df.where(F.col(text).isNotNull()), text, **lexicon)
    by_label = rows.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    total = by_label.agg((F.sum("s") / F.sum("n")).alias("average_score"))  # at most three rows in
    return by_label.crossJoin(F.broadcast(total)).select("sentiment", "n", (F.col("s") / F.col("n")).alias("mean_score"),
                                                         "average_score")


ALPHA, ETA = 0.1, 0.01  # what every topic has in every text, and every term in every topic, to begin with


class Topics:
    """A topic model as tables: `words` (term, n, texts, w0 ..) and `texts` (_text, t0 .., kept columns) with the counts of
    every topic in them, the totals of the topics and the number of terms.

    Texts lie in groups of some two million terms, packed as arrays; `packed` has them and their links with blocks of
    terms, `state` the counts of the last step (see functions.topicblocks)."""

    def __init__(self, packed: DataFrame, state: DataFrame, names: DataFrame, kept: DataFrame | None, k: int, scratch: Scratch):
        self.packed, self.state, self.names, self.kept, self.k, self.scratch = packed, state, names, kept, k, scratch
        self.totals: list[float] = []
        self.terms = 0
        self.measure()

    def measure(self) -> None:
        rows = self.state.where(F.col("kind") == blocks.TOTALS)
        row = rows.agg(*[F.sum(F.col("v")[i]) for i in range(self.k + 1)]).first()  # k + 1 numbers
        self.terms, self.totals = int(row[0] or 0), [float(v or 0.0) for v in row[1:]]

    def weight(self, i: int) -> Column:
        """Share of a term in topic i."""
        return (F.col(f"w{i}") + ETA) / (self.totals[i] + self.terms * ETA)

    def shares(self, i: int) -> Column:
        """Share of topic i in a text."""
        total = sum((F.col(f"t{j}") for j in range(1, self.k)), F.col("t0"))
        return (F.col(f"t{i}") + ALPHA) / (total + self.k * ALPHA)

    def grouped(self):
        """Everything a group's texts need, by group."""
        state = self.state.where(F.col("kind").isin(blocks.STATE, blocks.WEIGHTS))
        return self.packed.unionByName(state).groupBy("to")

    def step(self, last: bool) -> None:
        """Each posting is shared out among the topics, by the weight of its term times the count in its text; the
        shares make the new counts of texts and terms."""
        given = self.grouped().applyInArrow(blocks.share_out(self.k, self.totals, self.terms, ALPHA, ETA), blocks.SCHEMA)
        given = self.scratch.keep(given, "given")  # what the groups read can go before the blocks add up
        if "state" in self.scratch.paths:
            self.scratch.drop("state")
        state = given.groupBy("kind", "to").applyInArrow(blocks.add_up(self.k, last), blocks.SCHEMA)
        self.state = self.scratch.keep(state, "state", ["kind"])
        self.scratch.drop("given")
        self.measure()

    @property
    def words(self) -> DataFrame:
        counts = self.names.unionByName(self.state.where(F.col("kind") == blocks.COUNTS))
        schema = ", ".join(["term string, n double, texts bigint", *(f"w{i} double" for i in range(self.k))])
        return counts.groupBy("to").applyInArrow(blocks.spelled(self.k), schema)

    @property
    def texts(self) -> DataFrame:
        schema = ", ".join(["_text bigint", *(f"t{i} double" for i in range(self.k))])
        counts = self.state.where(F.col("kind") == blocks.STATE).select("a", "b").mapInArrow(blocks.listed(self.k), schema)
        return counts if self.kept is None else self.kept.join(counts.hint("merge"), "_text")

    def perplexity(self) -> float:
        fit = blocks.likelihood(self.k, self.totals, self.terms, ALPHA, ETA)
        row = self.grouped().applyInArrow(fit, "s double, n double").agg(F.sum("s"), F.sum("n")).first()
        return math.exp(-row[0] / row[1]) if row[1] else math.nan


#: Pairs of a group and a term of it that one block of terms takes in, as a rule.
PAIRS_PER_BLOCK = 1 << 20


def fit_topics(df: DataFrame, text: str, n_topics: int = 5, iterations: int = 20,
               stop_words: Sequence[str] = STOP_WORDS, keep: Sequence[str] = ()) -> Topics:
    """A topic model of all terms of all texts, by expectation and maximisation on tables.

    Texts are packed into groups with a dictionary of their own, terms are dealt to blocks by hash. In a step the
    groups share out their postings and send each block the sums of its terms; the blocks add them up and answer. So
    the vocabulary has no bound, what travels is the postings as arrays of small numbers and n_topics numbers for each
    term of each group, and only the topics' totals are known to the driver. Steps begin from fractions of MD5 digests
    of the terms, so the model depends on neither partitions nor the order of rows.
    """
    scratch = Scratch(df.sparkSession)
    names = [f"_k{i}" for i in range(len(keep))]
    rows = widen(df.where(F.col(text).isNotNull()).select(F.col(text).alias("_of"), *[F.col(c).alias(n) for c, n in zip(keep, names)]))
    rows = rows.select(F.monotonically_increasing_id().alias("_text"), "_of", *names)
    if names:  # two tables are made of these
        rows = scratch.keep(rows, "rows")
    groups = scratch.keep(rows.select("_text", "_of").mapInArrow(blocks.gather(n_topics, stop_words), blocks.GATHERED), "groups")
    kept = None
    if names:
        kept = scratch.keep(rows.select("_text", *names), "texts")
        scratch.drop("rows")

    pairs = groups.agg(F.sum(F.size("terms"))).first()[0] or 0
    count = max(-(-pairs // PAIRS_PER_BLOCK), min(16, -(-pairs // (PAIRS_PER_BLOCK >> 4))), 1)
    each = (groups.select(F.col("to").alias("_group"), F.posexplode(F.arrays_zip("terms", "n", "texts")).alias("_at", "_r"))
            .select("_group", F.col("_at").cast("bigint").alias("_at"), F.col("_r.terms").alias("term"), "_r.n", "_r.texts"))
    linked = (each.groupBy(F.pmod(F.xxhash64("term"), F.lit(count)).alias("_block"))
              .applyInArrow(blocks.found(n_topics), blocks.SCHEMA))
    linked = scratch.keep(linked, "linked", ["kind"])
    nothing = F.lit(None).cast("array<double>").alias("v")
    static = groups.select("to", F.lit(blocks.TEXTS).alias("kind"), F.lit(0).cast("bigint").alias("source"), "a", "b", "c", nothing)
    start = groups.select("to", F.lit(blocks.STATE).alias("kind"), F.lit(0).cast("bigint").alias("source"), F.col("counts").alias("a"),
                          F.col("ids").alias("b"), F.lit(None).cast("binary").alias("c"), nothing)
    of_kind = lambda *kinds: linked.where(F.col("kind").isin(*kinds))
    model = Topics(static.unionByName(of_kind(blocks.LINK)),
                   start.unionByName(of_kind(blocks.WEIGHTS, blocks.COUNTS, blocks.TOTALS)), of_kind(blocks.TERMS), kept, n_topics, scratch)
    for i in range(iterations if model.terms else 0):
        model.step(i == iterations - 1)
        if i == 0:
            for kind in (blocks.WEIGHTS, blocks.COUNTS):  # the first counts are not needed any more
                scratch.drop_part("linked", f"kind={kind}")
    return model


def topics(df: DataFrame, text: str, n_topics: int = 5, n_words: int = 10, **kw) -> DataFrame:
    """(topic, rank, term, weight, perplexity): the leading terms of each topic."""
    model = fit_topics(df, text, n_topics, **kw)
    perplexity = F.lit(model.perplexity())
    words = model.scratch.keep(model.words, "words")
    parts = [words.select(F.lit(i).alias("topic"), "term", model.weight(i).alias("weight"))
             .orderBy(F.desc("weight"), "term").limit(n_words) for i in range(n_topics)]
    best = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))  # n_words rows each
    return best.select("topic", rank.alias("rank"), "term", "weight", perplexity.alias("perplexity"))


def topic_mixture(df: DataFrame, text: str, keep: Sequence[str], n_topics: int = 5, **kw) -> DataFrame:
    """(keep, topic, share): the topic mixture of each text; equal shares where it has no terms."""
    model = fit_topics(df, text, n_topics, keep=keep, **kw)
    shares = F.array(*[model.shares(i) for i in range(n_topics)])
    return model.texts.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.posexplode(shares).alias("topic", "share"))
