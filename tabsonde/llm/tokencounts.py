"""Token counts of byte-level BPE by merging arrays of symbols in step with the ranks of pairs."""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabsonde.llm import arrays

NONE = np.int32(2**31 - 1)  # rank of a pair that never merges
LETTER, NUMBER, SPACE, OTHER = range(4)
DEPTH = 1 << 18  # symbols merged at once; a longer pre-token comes alone


def _classes(path: str) -> np.ndarray:
    """Class of every code point, as the library's own version of Unicode has it: all code points in order fall into
    runs of one class, and a letter or number before the first character of a run tells which it is."""
    from tokenizers import Tokenizer
    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for _, (a, b) in cut(every):
        c = every[b - 1]  # the first may be a blank that goes with the run
        kind = (LETTER if len(cut("a" + c)) == 1 else NUMBER if len(cut("1" + c)) == 1 else
                OTHER if len(cut("!" + c)) == 1 else SPACE)
        first, last = ord(every[a]), ord(c)
        out[first:last + 1] = kind
    out[0x20] = SPACE
    return out


class ByteBpe:
    """A byte-level BPE vocabulary as arrays: ranks and results of pairs, classes of characters, special strings."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or \
                not pre.get("use_regex", True) or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take white space along are not supported")
        # Bytes are written as printable characters: themselves where printable, else from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in shown}
        letter |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letter)}
        vocabulary = model["vocab"]
        self.byte_symbol = np.array([vocabulary[letter[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = np.int64(max(vocabulary.values()) + 1)
        keys = np.array([vocabulary[a] * int(self.size) + vocabulary[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        first = np.arange(256)
        self.byte_rank = self._search(np.repeat(self.byte_symbol[first], 256), np.tile(self.byte_symbol[first], 256)
                                      ).reshape(256, 256)
        self.kind = _classes(path)

    def _search(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    # --- pre-tokens

    def cut_special(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the special strings, left to right, each inside one text."""
        whole = data.tobytes()
        if not any(s in whole for s in self.special):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        import regex
        pattern = regex.compile(b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        spans = [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for m in pattern.finditer(whole, a, b)]
        spans = np.array(spans, np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]

    def pre_tokens(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Byte positions at which pre-tokens start; none crosses an edge.

        They are: 's 't 're 've 'm 'll 'd; runs of letters, of numbers, or of other characters, each with one blank
        before; white space, of which the last character before other text stands alone.
        """
        if not len(data):
            return np.zeros(0, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
        width = np.diff(np.append(lead, len(data)))
        point = data[lead].astype(np.int32)
        for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            at = np.flatnonzero(width == n)
            p = point[at] & mask
            for i in range(1, n):
                p = (p << 6) | (data[lead[at] + i] & 0x3F)
            point[at] = p
        kind = self.kind[point]
        n = len(lead)
        edge = np.zeros(n + 1, bool)  # a text or a part of it starts here
        edge[np.searchsorted(lead, edges)] = True
        edge[n] = True
        fresh = edge[:n].copy()
        fresh[1:] |= kind[1:] != kind[:-1]
        begin = np.flatnonzero(fresh)
        start = np.zeros(n + 1, bool)
        start[begin] = True
        # white space before other text: its last character goes with that text if it is a blank, else stands alone
        space = kind[begin] == SPACE
        end = np.append(begin[1:], n)
        runs = np.flatnonzero(space & ~edge[end])
        last = end[runs] - 1
        start[last] = True
        blank = point[last] == 0x20
        start[end[runs][blank]] = False
        # contractions: an apostrophe that starts its run and follows no blank, then fixed letters
        mark = begin[(point[begin] == 0x27)]
        mark = mark[start[mark]]
        if len(mark):
            room = np.searchsorted(np.flatnonzero(edge), mark, "right")
            room = np.flatnonzero(edge)[room] - mark  # characters up to the end of the part
            padded = np.concatenate([point, [0, 0]])
            one, two = padded[mark + 1], padded[mark + 2]
            single = (room > 1) & np.isin(one, [ord(c) for c in "stmd"])
            double = (room > 2) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
                                   | ((one == ord("l")) & (two == ord("l"))))
            for hit, length in ((single, 2), (double & ~single, 3)):
                at = mark[hit]
                start[at + 1] = False
                after = at + length
                # what follows starts a pre-token: the rest of the letters, or whatever comes
                start[after] = True
        return lead[np.flatnonzero(start[:n])]

    # --- merging

    def symbols(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many symbols are left of each byte sequence once no pair of it merges any more."""
        out = np.zeros(len(starts), np.int64)
        length = ends - starts
        out[length == 1] = 1
        todo = np.flatnonzero(length > 1)
        todo = todo[np.argsort(length[todo], kind="stable")]  # sequences of a batch end at about the same time
        filled = np.cumsum(length[todo])
        first = 0
        while first < len(todo):
            before = filled[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(filled, before + DEPTH, "right")))
            part = todo[first:last]
            out[part] = self._merge(data, starts[part], length[part])
            first = last
        return out

    def _merge(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        count = length.copy()
        at = arrays.ranges(starts, length)
        value = data[at]
        symbol = self.byte_symbol[value]
        first = np.cumsum(length) - length
        size = len(at)
        rank = np.full(size, NONE, np.int32)  # of the pair that starts here; NONE at ends and where symbols went
        rank[:-1] = self.byte_rank[value[:-1], value[1:]]
        rank[first + length - 1] = NONE
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        owner = np.repeat(np.arange(len(starts)), length)  # sequence, by its number in the batch
        alive = np.arange(len(starts))  # numbers of the sequences still held
        while len(first):
            low = np.minimum.reduceat(rank, first)
            open_ = low < NONE
            if not open_.any():
                break
            if open_.mean() < 0.7:  # let finished sequences go
                stay = np.repeat(open_, np.diff(np.append(first, size)))
                held = np.cumsum(stay)
                new_after = np.append(held - stay, held[-1])  # of what went: the next that stays
                symbol, rank, owner = symbol[stay], rank[stay], owner[stay]
                back = before[stay]
                after, before = new_after[after[stay]], np.where(back < 0, -1, held[back] - 1)
                kept = np.diff(np.append(first, size))[open_]
                first, size, low = np.cumsum(kept) - kept, int(stay.sum()), low[open_]
                alive = alive[open_]
                where = np.zeros(len(starts), np.int64)
                where[alive] = np.arange(len(alive))
                floor = low[where[owner]]
            else:
                floor = np.repeat(low, np.diff(np.append(first, size)))
            hit = np.flatnonzero((rank == floor) & (rank < NONE))
            # Where the same symbol repeats, hits overlap: every other one of such a run merges, from the left.
            chained = np.zeros(len(hit), bool)
            chained[1:] = after[hit[:-1]] == hit[1:]
            if chained.any():
                head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(hit))))
                hit = hit[(np.arange(len(hit)) - head) % 2 == 0]
            gone = after[hit]
            symbol[hit] = self.merged[rank[hit]]
            rank[gone] = NONE
            count -= np.bincount(owner[hit], minlength=len(count))
            follow = after[gone]
            after[hit] = follow
            inside = follow < size
            before[follow[inside]] = hit[inside]
            # ranks of the pairs on both sides of what merged
            right = inside.copy()
            right[inside] = owner[follow[inside]] == owner[hit[inside]]
            rank[hit] = NONE
            rank[hit[right]] = self._search(symbol[hit[right]], symbol[follow[right]])
            back = before[hit]
            left = back >= 0
            left[left] = owner[back[left]] == owner[hit[left]]
            rank[back[left]] = self._search(symbol[back[left]], symbol[hit[left]])
        return count

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a chunk."""
        n = len(offsets) - 1
        cut, cut_end = self.cut_special(data, offsets)
        starts = self.pre_tokens(data, np.unique(np.concatenate([offsets, cut, cut_end])))
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(offsets, starts, "right") - 1
        total = np.bincount(np.searchsorted(offsets, cut, "right") - 1, minlength=n)
        if len(cut):
            inside = np.searchsorted(cut, starts, "right") - 1
            plain = (inside < 0) | (starts >= cut_end[inside])
            starts, ends, row = starts[plain], ends[plain], row[plain]
        if len(starts):
            which, first = _distinct(data, starts, ends)
            total = total + np.bincount(row, self.symbols(data, starts[first], ends[first])[which], minlength=n
                                        ).astype(np.int64)
        return total


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal byte sequences, and where each is first. Up to 16 bytes are compared as two whole numbers
    and the length; longer sequences all count as different."""
    length = ends - starts
    short = np.flatnonzero(length <= 16)
    which, first = np.zeros(len(starts), np.int64), [np.zeros(0, np.int64)]
    n = 0
    if len(short):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        words = np.lib.stride_tricks.sliding_window_view(padded, 16)[starts[short]].copy()
        words[np.arange(16) >= length[short][:, None]] = 0
        a, b = words.view(np.uint64).T
        order = np.lexsort((a, b, length[short]))
        new = np.ones(len(order), bool)
        for c in (a, b, length[short]):
            new[1:] &= c[order][1:] == c[order][:-1]
        new[1:] = ~new[1:]
        number = np.cumsum(new) - 1
        which[short[order]] = number
        first.append(short[order[new]])
        n = int(number[-1]) + 1
    long = np.flatnonzero(length > 16)
    which[long] = n + np.arange(len(long))
    return which, np.concatenate([*first, long])


@functools.lru_cache(maxsize=2)
def _model(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row of docs (doc_id, text).

    tokenizer is the path of a plain byte-level BPE file of the tokenizers library; counts equal that library's for
    encode(text, add_special_tokens=False) without truncation: special strings inside a text are one token each.

    Texts of an Arrow batch are one byte array. Pre-tokens are found by array operations on classes of characters,
    equal short ones are merged once. All are held as ragged arrays of symbols; in each round every sequence merges
    all occurrences of its pair of lowest rank, and what is left at the end is counted. One pass, no shuffle; a
    text is never cut. A null or empty text has no bytes and no tokens. Repeated rows are counted each on its own;
    other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tables = docs.sparkSession.sparkContext.broadcast(_model(tokenizer))  # some 3 MB, by the vocabulary alone

    def run(batches):
        model = tables.value
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, data, offsets in arrays.chunks(batch.column("text"), 1 << 21):
                tokens = model.count(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(np.diff(offsets)), pa.array(tokens),
                     pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
