"""Quality rules from the fertility of a public tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsonde.llm import arrays
from tabsonde.llm.exchange import carried, stored, with_fields
from tabsonde.plans.ordering import attach

CACHED_WORDS = 300_000
CHUNK = 1 << 18  # bytes of text measured at once; they take some 200 times that in arrays
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
# Scripts by the first byte of a UTF-8 character; ASCII letters and Latin supplements are one script.
SCRIPTS = ["latin", "greek", "cyrillic", "other_two_byte", "three_byte", "four_byte"]
LEAD = np.full(256, -1, np.int8)
LEAD[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCC)]] = 0
LEAD[[0xCE, 0xCF]] = 1
LEAD[0xD0:0xD4] = 2
LEAD[[0xCD, *range(0xD4, 0xE0)]] = 3
LEAD[0xE0:0xF0] = 4
LEAD[0xF0:0xF8] = 5
MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
            "n_byte_tokens long, chars_per_token double, byte_share double, token_entropy double, script string")


class Pieces(dict):
    """Ids of a word under a SentencePiece model, packed as 2-byte integers."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece
        self.path, self.model = path, sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        if n > 1 << 16:
            raise ValueError("vocabularies above 65,536 pieces are not supported")
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])

    def __missing__(self, word: bytes) -> bytes:
        ids = np.array(self.model.encode(word.decode(), num_threads=1), np.uint16).tobytes()
        if len(word) < 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    @staticmethod
    def of(path: str) -> Pieces:
        return arrays.kept_by_worker(Pieces, path)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _measure(data: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> dict[str, np.ndarray]:
    """All measures of a chunk's texts."""
    n = len(offsets) - 1
    words = arrays.Words(data, offsets)
    inside = ~arrays.SPACE[data]
    points = inside & ((data & 0xC0) != 0x80)
    # repeated words: windows of 8 whose hash occurs again in the same row
    starts, h = words.windows(8, words.hashes())
    row = words.row[starts]
    order = np.lexsort((h, row))
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    again = np.zeros(len(starts), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    repeated = arrays.covered(starts[again], 8, len(words.row))
    # repeated lines: lines with a word, by the bytes between line feeds
    feeds = np.flatnonzero(data == 0x0A)
    begin = np.union1d(offsets[:-1], feeds + 1)
    begin = begin[begin < len(data)]
    end = np.minimum(np.append(begin[1:], len(data)), np.append(feeds, len(data))[np.searchsorted(feeds, begin)])
    filled = np.concatenate([[0], np.cumsum(inside)])
    some = filled[end] > filled[begin]
    begin, end = begin[some], end[some]
    line = arrays.mix(arrays.between(arrays.running(data, arrays.BASE[0]), begin, end,
                                     arrays.BASE[0]) + (end - begin).astype(np.uint64))
    line_row = np.searchsorted(offsets, begin, "right") - 1
    order = np.lexsort((line, line_row))
    same = (line[order][1:] == line[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    dup_lines = np.bincount(line_row[order[1:][same]], minlength=n)
    # tokens
    whole = data.tobytes()
    packed = [b"".join(map(pieces.__getitem__, whole[a:b].split())) for a, b in zip(offsets[:-1], offsets[1:])]
    n_tokens = np.array([len(p) // 2 for p in packed], np.int64)
    ids = np.frombuffer(b"".join(packed), np.uint16)
    edges = np.concatenate([[0], np.cumsum(n_tokens)])
    pair = np.sort((np.repeat(np.arange(n, dtype=np.uint64), n_tokens) << np.uint64(16)) | ids)
    cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    times = np.diff(np.append(cut, len(pair))).astype(float)
    weight = np.bincount((pair[cut] >> np.uint64(16)).astype(np.int64), times * np.log2(times), minlength=n)
    some = np.maximum(n_tokens, 1)
    kinds = np.stack([_sums(LEAD[data] == k, offsets) for k in range(len(SCRIPTS))])
    word_chars = _sums(points, offsets)
    byte_tokens = _sums(pieces.is_byte[ids], edges)
    return {
        "n_words": np.diff(words.first), "word_chars": word_chars, "n_symbols": _sums(SYMBOLS[data], offsets),
        "n_dup_lines": dup_lines, "n_repeat_words": _sums(repeated, words.first), "n_tokens": n_tokens,
        "n_byte_tokens": byte_tokens, "chars_per_token": word_chars / some, "byte_share": byte_tokens / some,
        "token_entropy": np.maximum(np.where(n_tokens > 0, np.log2(some) - weight / some, 0.0), 0.0),
        "script": np.array([*SCRIPTS, "none"])[np.where(kinds.sum(0) > 0, kinds.argmax(0), len(SCRIPTS))],
    }


def measures(docs: DataFrame, tokenizer: str, carry: list[str] | None = None) -> DataFrame:
    """Base counts and fertility of every text, one pass, no shuffle. Columns named like results cannot be carried."""
    names = [f.split()[0] for f in MEASURES.split(", ")]
    carry, more = carried(docs, carry, names)
    frame, extra = docs.select("doc_id", "text", *(c.alias(n) for n, c in more.items())), list(more)

    def run(batches):
        pieces = Pieces.of(tokenizer)
        for batch in batches:
            for first, last, data, offsets in arrays.chunks(batch.column("text"), CHUNK):
                got = _measure(data, offsets, pieces)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), *(pa.array(got[c]) for c in names),
                     *(batch.column(c).slice(first, last - first) for c in extra)], names=["doc_id", *names, *carry])

    return frame.mapInArrow(run, with_fields(MEASURES, frame, dict(zip(more, carry))))


#: A band's half-width grows for short texts, whose means scatter more, by sqrt(1 + SHORT / tokens).
SHORT = 1000
SPREAD = 3.5  # interquartile ranges that a band reaches beyond the quartiles
ENTROPY_TOKENS = 256  # entropy is taken relative to log2 of the tokens, this many at most


LEAST = 100  # texts a band is fitted on, whatever the size of the corpus
BANDED = {"chars": "chars_per_token", "entropy": "_ratio", "bytes": "byte_share"}
FLOOR = {"bytes": 0.05}  # what a band reaches beyond the quartiles at least: most texts have no byte token at all


def _deviations(df: DataFrame) -> DataFrame:
    scale = F.sqrt(1 + F.lit(float(SHORT)) / F.greatest("n_tokens", F.lit(1)))
    for name, c in BANDED.items():
        df = df.withColumn(f"_{name}", F.round((F.col(c) - F.col(f"mid_{name}")) / scale, 4))
    return df


def _beside(rows: DataFrame, table: DataFrame, group: str) -> DataFrame:
    """Rows with the columns that `table` has for their group. Scripts are seven, so they are broadcast; languages
    may be as many as there are, so only those with more than 1/2000 of all rows are."""
    if group == "script":
        return rows.join(F.broadcast(table.drop("n")), group, "left")
    return attach(rows, table.drop("n"), [group], table.select(group, "n"), unmatched=True)


def bands(found: DataFrame, group: str, spread: float = SPREAD) -> DataFrame:
    """Rejection bands per value of `group`: medians, and limits of the scaled deviations from them.

    Fitted on all rows that pass the base rules. Each value has a row with its number `n` of rows; the rest is null
    for the null value and for those with fewer than LEAST rows to fit. Values are rounded before their exact
    quantiles are taken, so the state of a group is bounded.
    """
    passed = ~F.col("base_failed")
    mids = found.groupBy(group).agg(
        F.count("*").alias("n"), F.count(F.when(passed, 1)).alias("_rows"),
        *(F.percentile(F.when(passed, F.round(c, 4)), 0.5).alias(f"mid_{name}") for name, c in BANDED.items()))
    fit = F.col(group).isNotNull() & (F.col("_rows") >= LEAST)
    mids = stored(mids.select(group, "n", *(F.when(fit, F.col(f"mid_{name}")).alias(f"mid_{name}") for name in BANDED)),
                  "middles")
    around = _deviations(_beside(found.filter(passed), mids, group))
    out = around.groupBy(group).agg(*(F.percentile(f"_{name}", F.array(F.lit(0.25), F.lit(0.75))).alias(f"_{name}")
                                      for name in BANDED))
    for name in BANDED:
        c = f"_{name}"
        wide = F.greatest((F.col(c)[1] - F.col(c)[0]) * spread, F.lit(FLOOR.get(name, 0.0)))
        out = out.withColumn(f"low{c}", F.col(c)[0] - wide).withColumn(f"high{c}", F.col(c)[1] + wide)
    return stored(mids.join(out.drop(*(f"_{name}" for name in BANDED)), group, "left"), "bands")


def quality(docs: DataFrame, tokenizer: str, language: str | None = "lang", most_bytes: float = 0.5,
            spread: float = SPREAD, carry: list[str] | None = None) -> DataFrame:
    """Base counts, tokenizer fertility and the verdict `kept` for every document.

    docs has doc_id, text and, if named, a language column. Each word is encoded by itself with a public
    SentencePiece vocabulary; a text's fertility is its characters per token, the share of byte-fallback tokens and
    the entropy of its tokens. Returns doc_id, the columns of MEASURES, base_failed, and kept.

    base_failed: fewer than 20 words, or more than 30 % of the words in 8-word windows that occur twice or more.
    Other texts are rejected if byte tokens exceed `most_bytes` in a script of letters that the vocabulary covers
    (latin, greek, cyrillic), or if characters per token, relative entropy or the share of byte tokens lie outside
    the band of their language; languages with under 100 texts use the band of their script, and scripts with under 100 texts have
    none. Both limits count texts that pass the base rules and hold at every size of the corpus.

    A null or empty text has no words: all counts 0, base_failed. Rows that repeat are judged each on its own. Other
    columns are not read; one named like a result cannot be carried (ValueError).
    """
    group = F.col(language).cast("string") if language in docs.columns else F.lit(None).cast("string")
    carry, more = carried(docs, carry, [*(f.split()[0] for f in MEASURES.split(", ")), "base_failed", "kept"])
    rows = docs.withColumns({"_language": group, **more})  # measures() takes from it what it needs
    found = stored(measures(rows, tokenizer, ["_language", *more]), "measures")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = (found.withColumn("base_failed", failed).withColumn("_ratio", F.col("token_entropy") / F.log2(
                 F.greatest(F.least("n_tokens", F.lit(ENTROPY_TOKENS)), F.lit(2)).cast("double"))))
    both = found
    for c, name in (("_language", "_own"), ("script", "_script")):
        table = bands(found, c, spread)
        limits = [x for x in table.columns if x not in (c, "n")]
        both = _beside(both, table.select(c, "n", F.when(F.col("mid_chars").isNotNull(), F.struct(*limits)).alias(name)), c)
    both = both.withColumn("_band", F.coalesce("_own", "_script")).select("*", *(F.col(f"_band.{c}") for c in limits))
    judged = _deviations(both)
    inside = F.lit(True)
    for name in BANDED:
        inside &= F.coalesce(F.col(f"_{name}").between(F.col(f"low_{name}"), F.col(f"high_{name}")), F.lit(True))
    bytes_fit = (F.col("byte_share") <= most_bytes) | ~F.col("script").isin("latin", "greek", "cyrillic")
    names = [f.split()[0] for f in MEASURES.split(", ")]
    return judged.withColumn("kept", ~F.col("base_failed") & bytes_fit & inside).select(
        "doc_id", *names, "base_failed", "kept", *(F.col(n).alias(c) for n, c in zip(more, carry)))
