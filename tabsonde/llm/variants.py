"""Groups of spelling variants: words one edit apart, by composing a vocabulary acceptor with a one-edit transducer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsonde.llm.arrays import ranges
from tabsonde.llm.exchange import blocks_for, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST = 20_000  # words of a partition; larger ones are cut at the middle of their free part
WIDEST = 64  # code points of a partition's free part
LABEL = np.int64(1) << np.int64(21)  # above every code point
NEAR = "id long, n_near long, best struct<n:long,back:long>"


class Acceptor:
    """Minimal deterministic acceptor of strings that come in blocks, each block with an initial state of its own.

    strings: one array of code points (rows x length) for each length; blocks: the block of each row. Rows are
    sorted by block and string here; `order` has, for every length, the rows in that order, and words are numbered
    through all lengths in it. A state is fixed by the strings that lead from it to the end, so equal tails of all
    blocks and lengths share states. The edges of a state ascend by label; an edge's offset is the number of
    strings under the edges before it, so the numbers of two words come from the sums along their paths.
    """

    def __init__(self, strings: list[np.ndarray], blocks: list[np.ndarray]):
        self.order, depths = [], []
        for text, block in zip(strings, blocks):
            order = np.lexsort((*text.T[::-1], block))
            self.order.append(order)
            text, block = text[order], block[order]
            new = np.ones(len(order), bool)
            new[1:] = block[1:] != block[:-1]
            node = np.cumsum(new) - 1
            levels = []  # of every depth: parents and labels of its nodes
            self_blocks = block[new]
            for d in range(text.shape[1]):
                new = new.copy()
                new[1:] |= text[1:, d] != text[:-1, d]
                first = np.flatnonzero(new)
                levels.append((node[first], text[first, d].astype(np.int64)))
                node = np.cumsum(new) - 1
            depths.append({"levels": levels, "blocks": self_blocks, "class": np.zeros(len(order), np.int64)})
        self._minimise(depths)
        self.roots, before = [], 0  # blocks, their initial states, and the numbers of their first words
        for d, order in zip(depths, self.order):
            size = self.words[d["class"]]
            self.roots.append((d["blocks"], d["class"], before + np.cumsum(size) - size))
            before += len(order)

    def _minimise(self, depths: list[dict]) -> None:
        """From the ends of all strings backwards: nodes with the same edges to the same states are one state."""
        words, fan = [np.ones(1, np.int64)], [np.zeros(1, np.int64)]  # state 0 accepts
        labels, targets, states = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
        known_words = np.ones(1, np.int64)
        for left in range(1, 1 + max((len(d["levels"]) for d in depths), default=0)):
            here = [d for d in depths if len(d["levels"]) >= left]
            parent, label, target, nodes = [], [], [], 0
            for d in here:
                p, lab = d["levels"][len(d["levels"]) - left]
                parent.append(p + nodes)
                label.append(lab)
                target.append(d["class"])
                d["nodes"] = (nodes, nodes + int(p[-1]) + 1 if len(p) else nodes)
                nodes = d["nodes"][1]
            parent, label, target = map(np.concatenate, (parent, label, target))
            count = np.bincount(parent, minlength=nodes)
            start = np.cumsum(count) - count
            state_of = np.zeros(nodes, np.int64)
            for k in np.unique(count):
                these = np.flatnonzero(count == k)
                at = start[these][:, None] + np.arange(k)
                code = np.ascontiguousarray(target[at] * LABEL + label[at])
                if k == 1:
                    _, first, which = np.unique(code[:, 0], return_index=True, return_inverse=True)
                else:
                    _, first, which = np.unique(code.view(np.dtype((np.void, 8 * int(k))))[:, 0],
                                                return_index=True, return_inverse=True)
                state_of[these] = states + which
                picked = at[first]
                labels.append(label[picked].ravel())
                targets.append(target[picked].ravel())
                fan.append(np.full(len(first), k))
                words.append(known_words[target[picked]].sum(1))
                states += len(first)
            known_words = np.concatenate(words)
            words = [known_words]
            for d in here:
                d["class"] = state_of[d["nodes"][0]:d["nodes"][1]]
        self.words, self.fan = known_words, np.concatenate(fan)
        self.start = np.cumsum(self.fan) - self.fan
        self.label, self.target = np.concatenate(labels), np.concatenate(targets)
        under = self.words[self.target]
        run = np.cumsum(under) - under
        self.offset = run - np.repeat(run[self.start[self.fan > 0]], self.fan[self.fan > 0]) if len(run) else run
        self.key = np.repeat(np.arange(len(self.fan)), self.fan) * LABEL + self.label

    def edges(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges of the states, and for each which of the states it leaves."""
        fan = self.fan[state]
        return ranges(self.start[state], fan), np.repeat(np.arange(len(state)), fan)

    def both(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges of p and q with the same label, and for each which pair it leaves."""
        if not len(self.key):
            none = np.zeros(0, np.int64)
            return none, none, none
        e, which = self.edges(p)
        wanted = q[which] * LABEL + self.label[e]
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        hit = self.key[at] == wanted
        return e[hit], at[hit], which[hit]

    def common(self, p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that end alike from the states p and q on, reached as words i and j so far."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(p):
            done = p == 0
            out.append((i[done], j[done]))
            p, q, i, j = p[~done], q[~done], i[~done], j[~done]
            a, b, which = self.both(p, q)
            p, q = self.target[a], self.target[b]
            i, j = i[which] + self.offset[a], j[which] + self.offset[b]
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    def replaced(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of words under the states that differ in one code point: the transducer's replacing edge is taken
        at every state once, to two different labels, and both sides go on alike."""
        out = []
        while len(state):
            e, which = self.edges(state)
            later = self.start[state[which]] + self.fan[state[which]] - 1 - e
            a, b = np.repeat(e, later), ranges(e + 1, later)
            base = np.repeat(word[which], later)
            out.append(self.common(self.target[a], self.target[b], base + self.offset[a], base + self.offset[b]))
            state, word = self.target[e], word[which] + self.offset[e]
        return _joined(out)

    def inserted(self, p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray, to_end: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word under p and a word under q that has one code point more. Where several places give the
        same pair, the last counts: after the insertion the shorter word does not go on with the inserted label.
        Insertions behind the last code point count where to_end (by number of the shorter word) says so."""
        out = []
        while len(p):
            e, which = self.edges(q)
            short, long, at, end = p[which], self.target[e], i[which], j[which] + self.offset[e]
            label = self.label[e]
            done = (short == 0) & (long == 0)
            last = done & to_end[at]
            out.append((at[last], end[last]))
            short, long, at, end, label = (x[~done] for x in (short, long, at, end, label))
            a, b, which = self.both(short, long)
            other = self.label[a] != label[which]
            a, b, which = a[other], b[other], which[other]
            out.append(self.common(self.target[a], self.target[b], at[which] + self.offset[a],
                                   end[which] + self.offset[b]))
            a, b, which = self.both(p, q)
            p, q, i, j = self.target[a], self.target[b], i[which] + self.offset[a], j[which] + self.offset[b]
        return _joined(out)


def _joined(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(x for x, _ in pairs)]), np.concatenate([none, *(y for _, y in pairs)])


def near_in_partitions(part: np.ndarray, longer: np.ndarray, window: list[np.ndarray], rows: list[np.ndarray],
                       to_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, each in one partition, whose windows are one edit apart. window: code points by length, with
    the rows they belong to; rows with `longer` are only the longer word of a pair."""
    block = part * 2 + longer
    acceptor = Acceptor(window, [block[r] for r in rows])
    number = np.concatenate([r[o] for r, o in zip(rows, acceptor.order)])  # of words, to rows
    blocks, state, word = (np.concatenate(x) for x in zip(*acceptor.roots))
    is_short = blocks % 2 == 0
    pairs = [acceptor.replaced(state[is_short], word[is_short])]
    order = np.argsort(blocks)
    blocks, state, word = blocks[order], state[order], word[order]
    met = np.flatnonzero((blocks[1:] == blocks[:-1] + 1) & (blocks[:-1] % 2 == 0))
    if len(met):
        pairs.append(acceptor.inserted(state[met], state[met + 1], word[met], word[met + 1], to_end[number]))
    i, j = _joined(pairs)
    return number[i], number[j]


def _windows(words: DataFrame) -> DataFrame:
    """Two partitions for each word as the one of m code points, and two for it as the longer one of a pair: the
    edit lies before place m // 2 and all behind it is alike, or it lies behind and all before is alike."""
    m = F.length("word") - F.col("longer")
    half = F.floor(m / 2).cast("int")
    both = words.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("half", half).withColumn(
        "m", m)
    head, tail = F.expr("substring(word, 1, half)"), F.expr("substring(word, half + 1)")
    long_head, long_tail = F.expr("substring(word, 1, half + longer)"), F.expr("substring(word, half + 1 + longer)")
    choices = F.array(
        F.struct(F.concat(F.lit("<"), head).alias("key"), tail.alias("window"), (F.col("m") - F.col("half")).alias("width"),
                 F.lit(True).alias("to_end")),
        F.struct(F.concat(F.lit(">"), long_tail).alias("key"), long_head.alias("window"), F.col("half").alias("width"),
                 F.lit(False).alias("to_end")))
    return both.withColumn("c", F.explode(choices)).select(
        "id", "n", "longer", _short_key(F.concat(F.col("m").cast("string"), F.col("c.key"))).alias("key"), "c.window",
        "c.width", "c.to_end")


def _short_key(key):
    """Long contexts by their SHA-256."""
    return F.when(F.length(key) > 64, F.concat(F.lit("#"), F.sha2(key.cast("binary"), 256))).otherwise(key)


def _halves(rows: DataFrame) -> DataFrame:
    """Partitions cut again: the free part's first half is free and the second alike, or the other way round."""
    rows = rows.withColumn("half", F.floor(F.col("width") / 2).cast("int"))
    choices = F.array(
        F.struct(F.concat("key", F.lit("<"), F.expr("substring(window, 1, half)")).alias("key"),
                 F.expr("substring(window, half + 1)").alias("window"), (F.col("width") - F.col("half")).alias("width"),
                 F.col("to_end")),
        F.struct(F.concat("key", F.lit(">"), F.expr("substring(window, half + 1 + longer)")).alias("key"),
                 F.expr("substring(window, 1, half + longer)").alias("window"), F.col("half").alias("width"),
                 F.lit(False).alias("to_end")))
    return rows.withColumn("c", F.explode(choices)).select(
        "id", "n", "longer", _short_key(F.col("c.key")).alias("key"), "c.window", "c.width", "c.to_end")


def _partitions(words: DataFrame) -> DataFrame:
    """All windows, cut until no partition has more than MOST rows or a free part above WIDEST code points."""
    rows, out = stored(_windows(words), "windows"), None
    while True:
        large = rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum("longer").alias("_long"),
                                        F.max("width").alias("width"))
        large = stored(large.filter((F.col("rows") > 1) & (F.col("rows") > F.col("_long")) & (F.col("width") > 1)
                                    & ((F.col("rows") > MOST) | (F.col("width") > WIDEST))).select("key"), "large")
        if large.isEmpty():
            return rows if out is None else out.unionByName(rows)
        small = rows.join(large, "key", "left_anti")
        out = small if out is None else out.unionByName(small)
        rows = stored(_halves(rows.join(large, "key", "left_semi")), "windows")


def _meet(table: pa.Table) -> pa.Table:
    """Near words among the rows of some partitions: for each row their number and the best of them."""
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    longer = table.column("longer").to_numpy().astype(np.int64)
    part = pc.dictionary_encode(table.column("key").combine_chunks()).indices.to_numpy().astype(np.int64)
    # partitions without a pair of rows go at once
    rows, short = np.bincount(part), np.bincount(part, 1 - longer).astype(np.int64)
    stay = np.flatnonzero((rows > 1)[part] & (short > 0)[part])
    empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()),
                      pa.array([], pa.struct([("n", pa.int64()), ("back", pa.int64())]))], names=["id", "n_near", "best"])
    if not len(stay):
        return empty
    stay = stay[np.argsort(part[stay], kind="stable")]
    window = table.column("window").combine_chunks().take(pa.array(stay))
    length = pc.utf8_length(window).to_numpy()
    to_end = table.column("to_end").to_numpy()[stay]
    part, longer, ids, n = part[stay], longer[stay], ids[stay], n[stay]
    near, best = np.zeros(len(stay), np.int64), np.full(len(stay), len(stay), np.int64)
    order = np.lexsort((ids, -n))  # best first
    place = np.empty(len(stay), np.int64)
    place[order] = np.arange(len(stay))
    first, cuts = 0, np.append(np.flatnonzero(np.diff(part)) + 1, len(stay))
    while first < len(stay):
        last = int(cuts[max(np.searchsorted(cuts, first + MOST) - 1, np.searchsorted(cuts, first, "right"))])
        size = length[first:last]
        texts, which = [], []
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            flat = "".join(window.take(pa.array(first + at)).to_pylist()).encode("utf-32-le")
            texts.append(np.frombuffer(flat, np.uint32).reshape(len(at), s))
            which.append(at)
        a, b = near_in_partitions(part[first:last] - part[first], longer[first:last], texts, which, to_end[first:last])
        a, b = a + first, b + first
        near += np.bincount(a, minlength=len(near)) + np.bincount(b, minlength=len(near))
        np.minimum.at(best, a, place[b])
        np.minimum.at(best, b, place[a])
        first = last
    some = np.flatnonzero(near > 0)
    top = order[best[some]]
    return pa.table([pa.array(ids[some]), pa.array(near[some]),
                     pa.StructArray.from_arrays([pa.array(n[top]), pa.array(-ids[top])], names=["n", "back"])],
                    names=["id", "n_near", "best"])


def vocabulary_of(docs: DataFrame, slip: int = 97, least_length: int = 5, least: int = 3) -> DataFrame:
    """(word, n): letter runs of all texts, A-Z lower-cased; where `slip` divides the crc32 of "doc_id:run" one code
    point, at the crc modulo the run's length, goes. Words of at least least_length code points and least occurrences."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.expr(
        r"regexp_extract_all(text, '[A-Za-z\\u00C0-\\u00FF]+', 0)")).alias("run"))
    runs = runs.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = F.expr("CAST(h % length(run) AS INT)")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word"))
    return (words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= least))


def near_words(words: DataFrame) -> DataFrame:
    """For words (id, word, n) with ids that ascend with the words: id, n_near, and best, the near word of largest n
    (of smallest id among equals) as struct(n, -id); only words that have a near word."""
    rows = stored(_partitions(words.select("id", "word", F.col("n").cast("long").alias("n"))), "partitions")
    buckets = blocks_for(rows, 2)
    # a partition is one group of bounded size; a bucket holds some thousands of them
    found = (rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
             .select("bucket", "id", "n", "longer", "key", "window", "to_end")
             .groupBy("bucket").applyInArrow(lambda t: _meet(t.drop_columns(["bucket"])), NEAR))
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def spelling_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words (word, n).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its
    near word of largest n (ties: the smallest in code-point order) if that n >= times * the word's n, else null;
    root follows forms to the last, and is the word itself without a form.

    1. Words are sorted and numbered. Of a pair with m code points in the shorter word, the edit lies before or
       behind place m // 2 and the rest is alike: that rest names the partition, whose words start in an initial
       state of their own. Partitions above MOST words, or with a free part above WIDEST code points, are cut in
       the same way again, at most until one code point is free, so no partition grows with the vocabulary.
    2. Within some partitions at a time the minimal acceptor of the free parts is built, composed with a one-edit
       transducer and with itself, and the accepted pairs are enumerated. A pair is accepted in one partition only:
       the one that holds the last place at which the edit can be made.
    3. Numbers and best near words are added up by word. As n grows at least `times` fold with every step, forms
       are chains of logarithmic length; root is found by doubling steps.

    A null or empty word is no word. An empty table gives none. Words may be of any length.
    """
    if times < 2:
        raise ValueError("forms must at least double the count, else chains may be long")
    words = words.filter("word IS NOT NULL AND word <> '' AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n"))
    ids = stored(stored(words, "words").orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "ids")
    found = near_words(ids)
    # sorted joins: the tables grow with the vocabulary
    rows = ids.join(found.hint("merge"), "id", "left")
    formed = F.col("best.n") >= times * F.col("n")
    rows = stored(rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                              F.when(formed, -F.col("best.back")).alias("form_id"),
                              F.when(formed, F.col("best.n")).alias("form_n")), "formed")
    up = stored(rows.filter("form_id IS NOT NULL").select("id", F.col("form_id").alias("top")), "up")
    while True:  # each round doubles the steps made
        onward = up.select(F.col("id").alias("top"), F.col("top").alias("next"))
        further = stored(up.join(onward, "top", "left").select("id", F.coalesce("next", "top").alias("top"),
                                                               F.col("next").isNotNull().alias("moved")), "up")
        up = further.select("id", "top")
        if further.filter("moved").isEmpty():
            break
    names = ids.select(F.col("id").alias("name_id"), F.col("word").alias("name"))
    out = rows.join(up, "id", "left")
    out = out.join(names, F.col("form_id") == F.col("name_id"), "left").withColumnRenamed("name", "form").drop("name_id")
    out = out.join(names, F.col("top") == F.col("name_id"), "left")
    return out.select("word", "form", F.coalesce("name", "word").alias("root"), "n", "n_near", "form_n")
