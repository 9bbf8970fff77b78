"""Steps of a topic model on arrays: texts in groups, terms in blocks, and messages between them.

A group holds some texts with their postings and a dictionary of its own; a block holds some terms of the whole table.
Every message is a row (to, kind, source, a, b, c, v): kinds below 10 go to a group, others to a block.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabsonde.functions.text import coded_terms, split_words

#: Words at which a group of texts ends.
GROUP_TERMS = 3 << 20
#: Postings that are shared out at a time.
CHUNK = 1 << 17

SCHEMA = "to bigint, kind int, source bigint, a binary, b binary, c binary, v array<double>"
ROWS = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("source", pa.int64()), ("a", pa.binary()), ("b", pa.binary()),
                  ("c", pa.binary()), ("v", pa.list_(pa.float64()))])
# To a group. TEXTS: a postings of each text, b places of their terms in the group's dictionary, c their counts. STATE: a counts
# of topics per text, b the texts' ids. LINK: of a block's terms, a places in the dictionary, b places in the block. WEIGHTS: a
# counts of topics per term, in the order of the link.
TEXTS, STATE, LINK, WEIGHTS = 0, 1, 2, 3
# To a block. SUMS: a places in the block, b what a group adds to them. TERMS: a the terms by line, b their counts, c in how many
# texts they are. COUNTS: a counts of topics per term. TOTALS: v the number of terms and the sum of each topic.
SUMS, TERMS, COUNTS, TOTALS = 10, 11, 12, 13

GATHERED = "to bigint, a binary, b binary, c binary, counts binary, ids binary, terms array<string>, n array<double>, texts array<bigint>"


def give_back() -> None:
    """Return freed memory to the system; otherwise it stays with the worker from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def _table(rows: list[tuple]) -> pa.Table:
    give_back()
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ROWS)], schema=ROWS)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as differences, their lowest bytes first, then the next: mostly zeros, which compress."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def gather(k: int, stop_words: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (_text, text) to groups; each text has its terms in equal parts in all topics."""
    def run(batches):
        from pyspark import TaskContext
        group, ids, texts, words, count, size = TaskContext.get().partitionId() << 32, [], [], [], 0, 0
        for batch in batches:
            all_ids, first = batch.column(0).to_numpy().copy(), 0
            for n, text, word in split_words(batch.column(1)):
                ids.append(all_ids[first:first + n])
                texts.append(text + np.int32(count))
                words.append(word)
                first, count, size = first + n, count + n, size + len(word)
                if size >= GROUP_TERMS:
                    yield packed(group, ids, texts, words)
                    group, ids, texts, words, count, size = group + 1, [], [], [], 0, 0
                    give_back()
        if ids:
            yield packed(group, ids, texts, words)
            give_back()

    def packed(group: int, ids: list, texts: list, words: list) -> pa.RecordBatch:
        ids = np.concatenate(ids).astype(np.int64)
        codes, names = coded_terms(pa.chunked_array(words, pa.string()), stop_words)
        words.clear()
        text = np.concatenate([np.zeros(0, np.int32), *texts])[codes >= 0]
        texts.clear()
        codes, width = codes[codes >= 0], max(len(names), 1)
        sizes = np.bincount(text, minlength=len(ids))
        cells = text.astype(np.int64)
        cells *= width
        cells += codes
        cells.sort()
        first = np.flatnonzero(np.diff(cells, prepend=-1))
        n = np.diff(first, append=len(cells))
        cells = cells[first]
        text, code = cells // width, cells % width
        row = {"to": group, "a": np.bincount(text, minlength=len(ids)).astype(np.int64).tobytes(), "b": _planes(code), "c": _planes(n),
               "counts": np.repeat(sizes / k, k).tobytes(), "ids": ids.tobytes(), "terms": names,
               "n": np.bincount(code, n, len(names)), "texts": np.bincount(code, minlength=len(names))}
        one = lambda v, t: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t))
        kinds = {"to": pa.int64(), "n": pa.float64(), "texts": pa.int64()}
        return pa.RecordBatch.from_arrays(
            [one(v, kinds.get(c, pa.string())) if c in ("terms", "n", "texts") else pa.array([v], kinds.get(c, pa.binary()))
             for c, v in row.items()], names=list(row))

    return run


def _fractions(terms: list[str], k: int) -> np.ndarray:
    """What each topic has of each term to begin with: the first 32 bits of an MD5 digest."""
    whole = [int.from_bytes(hashlib.md5(f"{t}:{i}".encode()).digest()[:4]) for t in terms for i in range(k)]
    return np.array(whole, float).reshape(-1, k) / 2.0 ** 32


def _totals(block: int, counts: np.ndarray) -> tuple:
    return block, TOTALS, block, None, None, None, [float(len(counts)), *counts.sum(0).tolist()]


def found(k: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """From a block's rows (_group, _at, term, n, texts) to its terms, its links with the groups and the first counts."""
    def run(key, table):
        block = key[0].as_py()
        coded = table.column("term").combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        terms = coded.dictionary.take(order).to_pylist()
        place = np.empty(len(terms), np.int64)
        place[order.to_numpy()] = np.arange(len(terms))
        at = place[coded.indices.to_numpy()]
        group, code, n, texts = (table.column(c).to_numpy() for c in ("_group", "_at", "n", "texts"))
        n, texts = np.bincount(at, n, len(terms)), np.bincount(at, texts, len(terms)).astype(np.int64)
        counts = n[:, None] * _fractions(terms, k)
        rows = [(block, TERMS, block, "\n".join(terms).encode(), n.tobytes(), texts.tobytes(), None),
                (block, COUNTS, block, counts.tobytes(), None, None, None), _totals(block, counts)]
        order = np.lexsort((at, group))
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        for own in np.split(order, first[1:]):
            to, here = int(group[own[0]]), at[own].astype(np.int32)
            rows += [(to, LINK, block, code[own].astype(np.int32).tobytes(), here.tobytes(), None, None),
                     (to, WEIGHTS, block, counts[here].tobytes(), None, None, None)]
        return _table(rows)

    return run


class Group:
    """What a group's rows say: `n` and `code` of its postings, `per` text, counts of its topics, weights of its terms."""

    def __init__(self, table: pa.Table, k: int, totals: list[float], terms: int, eta: float):
        kinds = table.column("kind").to_numpy()
        a, b, c = (table.column(x) for x in "abc")
        sources = table.column("source").to_numpy()
        row = {int(kinds[i]): i for i in range(len(kinds))}
        per, code, n = (x[row[TEXTS]].as_buffer() for x in (a, b, c))
        self.per = np.frombuffer(per, np.int64)
        self.code, self.n = _from_planes(code), _from_planes(n)
        self.topics = np.frombuffer(a[row[STATE]].as_buffer()).reshape(-1, k)
        self.ids = b[row[STATE]].as_py()
        given = {int(sources[i]): i for i in np.flatnonzero(kinds == WEIGHTS)}
        self.links = [(int(sources[i]), np.frombuffer(a[int(i)].as_buffer(), np.int32), b[int(i)].as_py())
                      for i in np.flatnonzero(kinds == LINK)]
        self.weights = np.empty((k, sum(len(at) for _, at, _ in self.links)))
        for block, at, _ in self.links:
            self.weights[:, at] = ((np.frombuffer(a[given[block]].as_buffer()).reshape(-1, k) + eta) / (np.array(totals) + terms * eta)).T

    def chunks(self) -> Iterator[tuple]:
        """(text, code, n) of some postings at a time."""
        text = np.repeat(np.arange(len(self.per)), self.per)
        for i in range(0, len(text), CHUNK):
            yield text[i:i + CHUNK], self.code[i:i + CHUNK].astype(np.int64), self.n[i:i + CHUNK].astype(float)


def share_out(k: int, totals: list[float], terms: int, alpha: float, eta: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """Each posting of a group is shared out among the topics, by the weight of its term times the count in its text; the
    shares are the texts' new counts and what the blocks get."""
    def run(key, table):
        to = key[0].as_py()
        own = Group(table, k, totals, terms, eta)
        prior = own.topics.T + alpha
        topics, words = np.zeros(own.topics.T.shape), np.zeros(own.weights.shape)
        for text, code, n in own.chunks():
            parts = [own.weights[i][code] * prior[i][text] for i in range(k)]
            n = n / sum(parts)
            low = text[0]
            for i in range(k):
                parts[i] *= n
                more = np.bincount(text - low, parts[i])
                topics[i, low:low + len(more)] += more
                words[i] += np.bincount(code, parts[i], words.shape[1])
        rows = [(to, STATE, to, np.ascontiguousarray(topics.T).tobytes(), own.ids, None, None)]
        rows += [(block, SUMS, to, places, np.ascontiguousarray(words[:, at].T).tobytes(), None, None) for block, at, places in own.links]
        return _table(rows)

    return run


def add_up(k: int, last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """A block's new counts from what the groups give, and the groups' answers; states of groups pass."""
    def run(key, table):
        if key[0].as_py() != SUMS:
            return table.select(ROWS.names)
        block = key[1].as_py()
        table = table.sort_by("source")
        sources = table.column("source").to_pylist()
        places = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column("a")]
        counts = np.zeros((1 + max(int(p.max()) for p in places), k))
        for place, given in zip(places, table.column("b")):
            counts[place] += np.frombuffer(given.as_buffer()).reshape(-1, k)  # a group names a place once
        rows = [_totals(block, counts)]
        if last:
            rows.append((block, COUNTS, block, counts.tobytes(), None, None, None))
        rows += [(to, WEIGHTS, block, counts[p].tobytes(), None, None, None) for to, p in zip(sources, places)]
        return _table(rows)

    return run


def likelihood(k: int, totals: list[float], terms: int, alpha: float, eta: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """(log likelihood, n) of a group's postings."""
    def run(key, table):
        own = Group(table, k, totals, terms, eta)
        shares = own.topics + alpha
        shares = (shares / shares.sum(1, keepdims=True)).T
        found, size = 0.0, 0.0
        for text, code, n in own.chunks():
            found += float(n @ np.log(sum(own.weights[i][code] * shares[i][text] for i in range(k))))
            size += float(n.sum())
        return pa.table({"s": [found], "n": [size]})

    return run


def spelled(k: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """(term, n, texts, w0 ..) of a block."""
    def run(key, table):
        kinds = table.column("kind").to_pylist()
        names, counts = kinds.index(TERMS), kinds.index(COUNTS)
        n, texts = np.frombuffer(table.column("b")[names].as_buffer()), np.frombuffer(table.column("c")[names].as_buffer(), np.int64)
        w = np.frombuffer(table.column("a")[counts].as_buffer()).reshape(-1, k)
        return pa.table({"term": table.column("a")[names].as_py().decode().split("\n"), "n": n, "texts": texts, **{f"w{i}": w[:, i].copy() for i in range(k)}})

    return run


def listed(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_text, t0 ..) from states."""
    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):
                t = np.frombuffer(a.as_buffer()).reshape(-1, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b.as_buffer(), np.int64)), *(pa.array(t[:, i].copy()) for i in range(k))],
                                                 names=["_text", *(f"t{i}" for i in range(k))])

    return run
