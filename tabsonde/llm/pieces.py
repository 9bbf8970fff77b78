"""Unigram encoding and decoding with a SentencePiece vocabulary: Viterbi over batches of equal-length words."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabsonde.llm import arrays

SPACE = "\u2581"
UNKNOWN_PENALTY = 10.0  # an unknown character scores this much below the worst piece
CACHED_WORDS = 600_000
CELLS = 400_000  # word positions handled at once
_BASE = 0xD6E8FEB86659FD93


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, raw[i:i + size]
            i += size


class Vocabulary:
    """Pieces of a SentencePiece model file (identity normalisation, byte fallback) and a cache of encoded words."""

    NORMAL, UNKNOWN, BYTE = 1, 2, 6  # kinds of pieces in the file format

    def __init__(self, path: str):
        self.path, self.known = path, {}
        pieces, scores, kinds = [], [], []
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    pieces.append(piece[1].decode())
                    scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                    kinds.append(piece.get(3, self.NORMAL))
        kinds = np.array(kinds)
        normal = np.flatnonzero(kinds == self.NORMAL)
        for i in normal:
            if SPACE in pieces[i].lstrip(SPACE) or "\n" in pieces[i]:
                raise ValueError("pieces that reach over a word's start or hold a line feed are not supported")
        self.byte_id = np.full(256, -1, np.int64)
        for i in np.flatnonzero(kinds == self.BYTE):
            self.byte_id[int(pieces[i][3:5], 16)] = i
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte fallback")
        self.is_byte = kinds == self.BYTE
        self.longest = max(len(pieces[i]) for i in normal)
        self.unknown = min(scores[i] for i in normal) - UNKNOWN_PENALTY
        keys = np.array([self._key(np.array([[ord(c) for c in pieces[i]]], np.uint32))[0][0, 0, len(pieces[i])]
                         for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], normal[order]
        if len(np.unique(self.keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.scores = np.array(scores)[self.ids]
        self.maybe = np.zeros(1 << 20, bool)  # whether any key has these low bits
        self.maybe[self.keys & np.uint64((1 << 20) - 1)] = True
        self.bytes = [bytes([int(p[3:5], 16)]) if k == self.BYTE else p.replace(SPACE, " ").encode()
                      if k == self.NORMAL else b"" for p, k in zip(pieces, kinds)]

    @staticmethod
    def of(path: str) -> Vocabulary:
        return arrays.kept_by_worker(Vocabulary, path)

    def _key(self, points: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, int]:
        """Hashes [word, start, length] of the substrings that start from `first` to `last`; 0 where they would
        pass the end."""
        k, n = points.shape
        last = n if last is None else last
        longest = min(getattr(self, "longest", n), n)
        sums = np.zeros((k, n + 1), np.uint64)
        np.cumsum(arrays.mix(points.astype(np.uint64) + np.uint64(1)) * arrays.powers(_BASE, n + 1)[0][:n], axis=1,
                  out=sums[:, 1:])
        back = arrays.powers(_BASE, n + 1)[1]
        out = np.zeros((k, last - first, longest + 1), np.uint64)
        for length in range(1, longest + 1):
            stop = min(last, n - length + 1)
            if stop > first:
                out[:, :stop - first, length] = arrays.mix(
                    (sums[:, first + length:stop + length] - sums[:, first:stop]) * back[first:stop]
                    + np.uint64(length))
        return out, longest

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Packed ids of the best segmentation of words of one length; of equal scores the longer piece wins.

        The words advance together, one position at a time: each position offers its score plus that of every
        piece starting there to the piece's end, and vectorised maxima keep the best offer and its length.
        """
        n = len(words[0])
        k = len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(k, n)
        best = np.full((k, n + 1 + self.longest), -np.inf)
        best[:, 0] = 0
        back = np.zeros(best.shape, np.int8 if self.longest < 128 else np.int32)
        piece = np.full(best.shape, -1, np.int64)
        step = max(1, CELLS // k)
        for first in range(0, n, step):
            last = min(n, first + step)
            # substrings of this stretch only; they may end behind it
            stretch = points[:, first:min(n, last + self.longest)]
            keys, longest = self._key(stretch, 0, last - first)
            hit = self.maybe[keys & np.uint64((1 << 20) - 1)] & (keys != 0)
            at = np.minimum(np.searchsorted(self.keys, keys[hit]), len(self.keys) - 1)
            true = self.keys[at] == keys[hit]
            score = np.full(keys.shape, -np.inf)
            ids = np.full(keys.shape, -1, np.int64)
            score[hit] = np.where(true, self.scores[at], -np.inf)
            ids[hit] = np.where(true, self.ids[at], -1)
            alone = ids[:, :, 1] < 0
            score[:, :, 1][alone] = self.unknown
            lengths = np.arange(longest + 1, dtype=back.dtype)
            for s in range(first, last):
                offer = best[:, s, None] + score[:, s - first]
                ends = slice(s, s + longest + 1)
                better = offer > best[:, ends]
                best[:, ends] = np.where(better, offer, best[:, ends])
                back[:, ends] = np.where(better, lengths, back[:, ends])
                piece[:, ends] = np.where(better, ids[:, s - first], piece[:, ends])
        place = np.full(k, n)
        rows = np.arange(k)
        steps = []
        while (place > 0).any():
            live = place > 0
            steps.append((np.where(live, piece[rows, place], -2), place - 1))
            place = place - np.where(live, back[rows, place], 0)
        chosen = np.stack([s[0] for s in steps[::-1]], axis=1) if steps else np.zeros((k, 0), np.int64)
        where = np.stack([s[1] for s in steps[::-1]], axis=1) if steps else chosen
        real = chosen != -2
        raw = chosen[real].astype("<u4").tobytes()
        edges = [0, *(4 * np.cumsum(real.sum(1))).tolist()]
        out = [raw[a:b] for a, b in zip(edges, edges[1:])]
        for i in np.flatnonzero((chosen == -1).any(1)).tolist():  # unknown characters, as bytes
            out[i] = np.concatenate([[x] if x >= 0 else self.byte_id[list(words[i][p].encode())]
                                     for x, p in zip(chosen[i][real[i]], where[i][real[i]])]).astype("<u4").tobytes()
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = list(words)
        by_length: dict[int, list[str]] = {}
        for w in new:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            most = max(1, CELLS // (4 * n))
            for at in range(0, len(group), most):
                part = group[at:at + most]
                self.known.update(zip(part, self.viterbi(part)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as 4-byte little-endian integers."""
        split = []
        for text in texts:
            words = text.replace(" ", SPACE)
            # the text gets one space in front
            split.append(_words(SPACE + words) if text else [])
        self.learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        found = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return found[1:].decode("utf-8", "replace") if found[:1] == b" " else found.decode("utf-8", "replace")


#: Spaces and what follows them up to a line feed. No piece holds a line feed, so it always stands alone.
_words = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall


def encode(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """Encode every text and decode it again.

    docs has doc_id and text; model is the path of a SentencePiece file on every executor. Returns doc_id, n_tokens,
    n_byte_tokens, ids_crc32, round_trip (decoding gives the text back; U+2581 counts as a space) and, unless
    with_ids is false, ids (4-byte little-endian). One pass, no shuffle. A null or empty text has no tokens and
    round_trip true. Rows that repeat are encoded each.
    """
    def run(batches):
        vocabulary = Vocabulary.of(model)
        for batch in batches:
            for first, last, data, offsets in arrays.chunks(batch.column("text"), 1 << 20):
                whole = data.tobytes()
                texts = [whole[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
                ids = vocabulary.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first),
                     pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array([int(vocabulary.is_byte[np.frombuffer(i, "<u4")].sum()) for i in ids], pa.int64()),
                     pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                     pa.array([vocabulary.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts)], pa.bool_()),
                     pa.array(ids if with_ids else [None] * len(ids), pa.binary())],
                    names=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean, ids binary")
    return out if with_ids else out.drop("ids")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """Texts of encoded rows: doc_id and ids give doc_id and text; null ids give a null text."""
    def run(batches):
        vocabulary = Vocabulary.of(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([None if i is None else vocabulary.decode(i)
                                                   for i in batch.column("ids").to_pylist()], pa.string())],
                names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
