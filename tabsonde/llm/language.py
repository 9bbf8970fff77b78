"""Language identification with bit-sliced Bloom filters of byte n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsonde.llm import arrays

SIZES = (3, 4)  # bytes in an n-gram
LEAST = 1e-5  # least share of an n-gram among all of its language, so a language has 100,000 at most
HASHES = 3
BITS_PER_GRAM = 16

_fold = np.arange(256, dtype=np.uint8)
_fold[0x41:0x5B] += 0x20
_fold[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and rows of all n-grams of SIZES bytes: lower-case ASCII letters and bytes of other characters. A
    space, which stands for all else and for the ends of a text, may only be an n-gram's first or last byte."""
    n = len(offsets) - 1
    framed = np.full(len(data) + n + 1, 0x20, np.uint8)  # a space before each text and after the last
    row = np.repeat(np.arange(n), np.diff(offsets))
    framed[np.arange(len(data)) + row + 1] = _fold[data]
    rows = np.zeros(len(framed), np.int64)
    rows[np.arange(len(data)) + row + 1] = row
    space = framed == 0x20
    codes, owners = [], []
    for size in SIZES:
        if len(framed) < size:
            continue
        m = len(framed) - size + 1
        ok = np.ones(m, bool)
        code = np.full(m, size, np.uint64)
        for i in range(size):
            code = (code << np.uint64(8)) | framed[i:i + m]
            if 0 < i < size - 1:
                ok &= ~space[i:i + m]
        codes.append(code[ok])
        owners.append(rows[1:1 + m][ok])
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(owners)


def learn(docs: DataFrame, label: str = "lang", least: float = LEAST) -> list[tuple[str, list[int]]]:
    """For each label all n-grams with at least the share `least` of its n-grams, counted over all rows of docs
    (text, label); labels with most text come first. A label has 1 / least n-grams at most, which bounds what
    reaches the driver: 0.8 MB a label, whatever the corpus."""
    docs = docs.filter(F.col("text").isNotNull() & F.col(label).isNotNull()).select("text", F.col(label).alias("label"))

    def count(batches):
        pending: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def merged(parts):
            codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def rows():
            for name, parts in pending.items():
                codes, times = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()),
                                                  pa.array(codes.view(np.int64)), pa.array(times)],
                                                 names=["label", "gram", "times"])

        for batch in batches:
            names, which = np.unique(batch.column("label").to_numpy(zero_copy_only=False), return_inverse=True)
            for first, last, data, offsets in arrays.chunks(batch.column("text"), 1 << 20):
                codes, row = ngrams(data, offsets)
                pair = (which[first:last][row].astype(np.uint64) << np.uint64(40)) | codes
                pair, times = np.unique(pair, return_counts=True)
                label_of = pair >> np.uint64(40)
                for i in np.unique(label_of):
                    mine = label_of == i
                    pending.setdefault(names[int(i)], []).append(
                        (pair[mine] & np.uint64((1 << 40) - 1), times[mine]))
                    held += int(mine.sum())
                if held > 4_000_000:
                    pending = {k: [merged(v)] for k, v in pending.items()}
                    held = sum(len(v[0][0]) for v in pending.values())
                    if held > 2_000_000:
                        yield from rows()
                        pending, held = {}, 0
        yield from rows()

    counts = (docs.mapInArrow(count, "label string, gram long, times long").groupBy("label", "gram")
              .agg(F.sum("times").alias("times")))
    totals = counts.groupBy("label").agg(F.sum("times").alias("all"))
    often = counts.join(F.broadcast(totals), "label").filter(F.col("times") >= least * F.col("all"))
    rows = often.groupBy("label", "all").agg(F.collect_list("gram").alias("grams")).orderBy(F.desc("all"), "label")
    return [(r["label"], sorted(r["grams"])) for r in rows.collect()]


class SlicedBloom:
    """One Bloom filter per language, stored across: word h of the table holds bit h of up to 64 languages, so one
    look-up per hash answers for all of them."""

    def __init__(self, grams: list[list[int]]):
        most = max((len(g) for g in grams), default=1)
        self.size = 1 << max(10, int(most * BITS_PER_GRAM - 1).bit_length())
        self.languages = len(grams)
        self.table = np.zeros((-(-max(len(grams), 1) // 64), self.size), np.uint64)
        for i, g in enumerate(grams):
            for at in self._places(np.array(g, np.int64).view(np.uint64)):
                np.bitwise_or.at(self.table[i // 64], at, np.uint64(1) << np.uint64(i % 64))
        fill = [((self.table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(grams))]
        self.false_rate = np.array(fill, float) ** HASHES

    def _places(self, codes: np.ndarray):
        h = arrays.mix(codes)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(k) * step) & np.uint64(self.size - 1)).astype(np.int64) for k in range(HASHES)]

    def containing(self, codes: np.ndarray) -> np.ndarray:
        """Bit masks (words of 64 languages x codes) of the languages whose filter holds each code."""
        places = self._places(codes)
        out = self.table[:, places[0]]
        for at in places[1:]:
            out = out & self.table[:, at]
        return out

    def shares(self, codes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Share of each row's codes that each language holds, freed of the expected false positives."""
        masks = self.containing(codes)
        total = np.bincount(rows, minlength=n)
        out = np.zeros((n, self.languages))
        for i in range(self.languages):
            hits = np.bincount(rows, (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1), minlength=n)
            out[:, i] = (hits - total * self.false_rate[i]) / (1 - self.false_rate[i])
        return np.clip(out / np.maximum(total, 1)[:, None], 0, 1)


def predict(docs: DataFrame, model: list[tuple[str, list[int]]], carry: list[str] | None = None) -> DataFrame:
    """lang_pred and score (the winner's corrected share of n-grams) of every text, from the text alone.

    docs has doc_id and text; columns named in `carry` come along. A null text, one without any letter, or an
    empty model gives `und` with score 0. Ties go to the label learnt from most text.
    """
    carry = [c for c in carry or [] if c not in ("doc_id", "text")]
    kept = ["doc_id", *carry]
    names = [name for name, _ in model]
    shared = docs.sparkSession.sparkContext.broadcast(SlicedBloom([g for _, g in model]))

    def run(batches):
        bloom = shared.value
        for batch in batches:
            for first, last, data, offsets in arrays.chunks(batch.column("text"), 1 << 20):
                n = last - first
                codes, rows = ngrams(data, offsets)
                best, score = np.zeros(n, np.int64), np.zeros(n)
                if names:
                    share = bloom.shares(codes, rows, n)
                    best = share.argmax(1)
                    score = share[np.arange(n), best]
                edges = np.concatenate([[0], np.cumsum(LETTER[data])])
                letters = edges[offsets[1:]] > edges[offsets[:-1]]
                for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
                    letters[i] = any(map(str.isalpha, data[offsets[i]:offsets[i + 1]].tobytes().decode()))
                if not names:
                    letters[:] = False
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, n) for c in kept),
                     pa.array([names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())]),
                     pa.array(np.where(letters, score, 0.0))], names=[*kept, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select("doc_id", "text", *carry).mapInArrow(run, f"{kinds}, lang_pred string, score double")
