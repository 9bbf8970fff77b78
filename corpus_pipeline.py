"""Documents to training sequences.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of `documents` for the rows
that stay; run() writes each stage's rows and reads them again for the next.

1. quality: documents that fail the base rules or lie outside the tokenizer bands of their language go.
2. exact_dedup: of equal texts the row with the smallest doc_id stays.
3. ngram_jaccard: of documents linked by five-word shingle sets of similarity 0.8 or more one stays.
4. substring_dedup: words covered by a passage of 50 words that starts anywhere else go; other text keeps its
   layout. Documents of which nothing remains go.
5. best_fit_packing: sequences of at most 4096 tokens; the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsonde.llm import cover, fertility, packing, setjoin, streamdedup
from tabsonde.llm.exchange import KEY, keyed, release, scratch, stored
from tabsonde.llm.queries import vocabulary

PASSAGE = 50  # words


def _whole(docs: DataFrame, **more) -> DataFrame:
    """KEY, doc_id, text, and the whole row as one column, so that no name of docs can clash with another."""
    return keyed(docs, _row=F.struct(*(f"`{c}`" for c in docs.columns)), **more)


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows whose key is among those kept, by a sorted join at every size: the keys grow with the corpus."""
    return rows.join(kept.select(KEY).hint("merge"), KEY, "left_semi").select("_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = _whole(docs, lang=lang)
    judged = fertility.quality(rows, vocabulary("piece_bpe_32k.model"), carry=[KEY])
    return _only(rows, judged.filter("kept"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _whole(docs)
    return _only(rows, streamdedup.exact_dedup(rows, key=KEY).filter("kept"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _whole(docs)
    return _only(rows, setjoin.jaccard_classes(rows, n=5, percent=80, key=KEY).filter("kept"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *(f"`{c}`" for c in others)).alias("_row"))
    cut = cover.substring_dedup(rows, window=PASSAGE, period=31, carry=["_row"], layout=True)
    cut = cut.filter("n_removed = 0 OR n_removed < n_words")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in others:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("ngram_jaccard", ngram_jaccard),
          ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]
ORACLE_SQL = None  # tokenizers cannot be said in SQL; tests hold every stage against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        mark = scratch()
        rows = stage(spark, rows, sf_dir)
        if i < len(STAGES) - 1:
            rows = stored(rows, name)
            release(spark, mark, rows)  # what the stage wrote on its way
    return rows
