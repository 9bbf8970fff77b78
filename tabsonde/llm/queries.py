"""Registered queries of the operators, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsonde.llm import (chat, cover, extract, fertility, language, packing, pieces, setjoin, streamdedup, suffixes,
                          tokencounts, variants, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_token_fertility")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def jaccard_sql(n: int, percent: int) -> str:
    """Components over pairs of documents whose sets of word n-grams are similar."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {n - 1}], ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - {n - 1}, 1))) AS i FROM w WHERE len(ws) > 0)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id
      GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b
         WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
reach AS (SELECT doc_id, doc_id AS seen FROM w UNION SELECT r.doc_id, b FROM reach r JOIN link ON a = r.seen)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(seen) AS component_id
FROM reach LEFT JOIN c USING (doc_id) GROUP BY doc_id"""


@query("op2_ngram_jaccard", jaccard_sql(4, 85))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_classes(table(spark, sf_dir, "documents"), n=4, percent=85).drop("kept", "_row_key")


@query("op3_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT win FROM s GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM s JOIN r USING (win), generate_series(0, 34) AS t(k)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS txt, count(*) AS n
         FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.substring_dedup(table(spark, sf_dir, "documents"), window=35).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_exact_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamdedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False)


@query("op6_chat_format")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    return chat.digests(chat.format_turns(turns.unionByName(extra)))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.learn(docs.filter(~out).select("text", "lang"))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents"), size=200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.vocabulary_of(table(spark, sf_dir, "documents")))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=8).withColumn(
        "deviation", F.expr("try_cast(deviation AS BIGINT)"))
