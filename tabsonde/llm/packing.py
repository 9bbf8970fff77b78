"""Best-fit decreasing packing of token sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsonde.llm import arrays
from tabsonde.llm.exchange import stored

CACHED_WORDS = 600_000  # words a Python worker remembers


class WordIds(dict):
    """Token ids of a word, packed as 4-byte integers. White space never joins or crosses tokens of this kind of
    vocabulary, so a text's ids are its words' ids in order."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    @staticmethod
    def of(path: str) -> WordIds:
        return arrays.kept_by_worker(WordIds, path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: set[bytes]) -> None:
        """Have the ids of all these words. Words of letters are encoded many at a time and told apart by the
        tokens that end a word; a full stop or comma after an ASCII letter or digit is a token of its own."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
            new = list(words)
        stopped = [w for w in new if w[-1] in b".," and w[-2:-1].isalnum()]
        plain = {w[:-1] for w in stopped}.union(w for w in new if not (w[-1] in b".," and w[-2:-1].isalnum()))
        plain |= {b".", b","}
        plain = [w for w in plain if w not in self]
        letters = [w for w in plain if w.decode().isalpha()]
        for at in range(0, len(letters), 1000):
            part = letters[at:at + 1000]
            ids = self.ids(b" ".join(part).decode())
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                raw, edge = ids.tobytes(), 0
                for word, cut in zip(part, (4 * cuts).tolist()):
                    self[word] = raw[edge:cut]
                    edge = cut
        for word in plain:
            if word not in self:
                self[word] = self.ids(word.decode()).tobytes()
        for word in stopped:
            self[word] = self[word[:-1]] + self[word[-1:]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = []
        for text in texts:
            # Below U+0300 there are no combining marks, so ASCII letters can be lowered before normalisation.
            if text and b"<|" not in text and (text.isascii() or np.frombuffer(text, np.uint8).max() < 0xCC):
                text = text.lower()
            split.append(text.split())
        self.learn(set().union(*split))
        return [b"".join(map(self.__getitem__, words)) for words in split]


class FirstOpen:
    """Segment tree over remaining capacities 0..n: which have open bins; the least one not below a size."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.full = [False] * (2 * self.size)

    def set(self, r: int, on: bool) -> None:
        i = r + self.size
        self.full[i] = on
        while i > 1:
            i >>= 1
            self.full[i] = self.full[2 * i] or self.full[2 * i + 1]

    def first(self, least: int) -> int | None:
        i = least + self.size
        if self.full[i]:
            return least
        while i > 1:  # climb until a right sibling has an open bin, then go down its leftmost path
            if not i & 1 and self.full[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.full[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Place counts[length] items of each length, longest first, each into the fullest bin that takes it.

    Returns runs (length, first rank, items, first bin, items per bin, offset): the items of this length with
    ranks from `first rank` fill consecutive bins from `first bin`. Bins in equal state are one run, so the work
    depends on the number of different lengths, not of items: a run that is used up leaves less than half of its
    free space, hence moves at most log2(capacity) times, and a length splits at most two runs. For 4096 that is
    below 200,000 runs whatever the corpus.
    """
    tree, open_runs, next_bin, out = FirstOpen(capacity), {}, 0, []

    def add(first: int, n: int, room: int) -> None:
        if room:
            if not open_runs.setdefault(room, []):
                tree.set(room, True)
            open_runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.first(length)
            if room is None:
                room, per = capacity, capacity // length
                first, n = next_bin, -(-left // per)
                next_bin += n
            else:
                first, n = open_runs[room].pop()
                if not open_runs[room]:
                    tree.set(room, False)
                per = room // length
            whole = min(n, left // per)
            if whole:
                out.append((length, rank, whole * per, first, per, capacity - room))
                add(first, whole, room - per * length)
                rank, left = rank + whole * per, left - whole * per
            if whole < n and left:  # fewer than `per` are left: they go to one more bin
                out.append((length, rank, left, first + whole, left, capacity - room))
                add(first + whole, 1, room - left * length)
                whole, left = whole + 1, 0
            if whole < n:
                add(first + whole, n - whole, room)
    return out


PIECES = "piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Token ids of each text plus end_id, cut into pieces of `capacity` ids; ids only if asked for."""
    kind = docs.schema["doc_id"].dataType
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        vocabulary = WordIds.of(tokenizer)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for first, last, data, offsets in arrays.chunks(batch.column("text")):
                whole = data.tobytes()
                row, start, length, crc, ids = [], [], [], [], []
                texts = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                for i, tokens in enumerate(vocabulary.encode(texts)):
                    tokens += end
                    for at in range(0, len(tokens), 4 * capacity):
                        part = tokens[at:at + 4 * capacity]
                        row.append(first + i)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        ids.append(part if with_ids else None)
                starts = np.array(start, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(row, pa.int64())), pa.array((starts // capacity).astype(np.int32)),
                     pa.array(starts), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    out = docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind.simpleString()}, {PIECES}")
    return out if with_ids else out.drop("ids")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False,
         group: int = 200_000) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens by best-fit decreasing.

    docs has doc_id and text. Returns one row per piece: doc_id, piece (from 0), start, length, ids_crc32,
    sequence_id (0, 1, ...), offset in the sequence (no gaps), and with with_ids also ids, 4-byte little-endian.
    Only documents longer than a sequence are cut.

    The lengths' histogram, at most `capacity` numbers however large the corpus, is all that the driver sees. It
    plans bins there for all items of a length at once; each piece finds its place from its rank among the pieces
    of its length. Ranks are numbered within hash groups of about `group` pieces, so no length is gathered.

    A null or empty text is one piece with just end_id. Rows that repeat a doc_id, or lack one, are packed each on
    its own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = best_fit_decreasing(counts, capacity)
    plan = np.array(runs, np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast(plan)
    groups = max(1, -(-sum(counts.values()) // group))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = (rows.groupBy("length", "_group").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_group")) - F.col("_n")))
    own = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (rows.join(before.drop("_n"), ["length", "_group"])
              .withColumn("_rank", F.col("_before") + F.row_number().over(own) - 1).drop("_group", "_before"))
    names = [c for c in ranked.columns if c != "_rank"]

    def place(batches):
        runs = shared.value
        shift = np.int64(1) << np.int64(44)
        keys = runs[:, 0] * shift + runs[:, 1]
        for batch in batches:
            rank, length = batch.column("_rank").to_numpy(), batch.column("length").to_numpy()
            run = runs[np.searchsorted(keys, length * shift + rank, "right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(run[:, 3] + nth // run[:, 4]),
                 pa.array(run[:, 5] + nth % run[:, 4] * length)], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*(ranked.schema[c] for c in names), T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    out = ranked.mapInArrow(place, schema)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                      *(["ids"] if with_ids else []))
