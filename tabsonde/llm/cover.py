"""Substring deduplication over words with difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsonde.llm import arrays
from tabsonde.llm.exchange import block_of, blocks_for, carried, keyed, with_fields
from tabsonde.llm.repeats import CELL, cells, known, positions, repeated, rows_of, table

def difference_cover(period: int) -> np.ndarray:
    """A small set of residues such that any two positions, moved on by the same amount below the period, both
    reach it. Perfect sets for periods q*q+q+1 are listed; else the residue that adds most differences joins
    until all occur."""
    fixed = {7: [0, 1, 3], 13: [0, 1, 3, 9], 21: [3, 6, 7, 12, 14], 31: [1, 5, 11, 24, 25, 27]}  # fixed values
    chosen = list(fixed.get(period, [0]))
    have = {(a - b) % period for a in chosen for b in chosen}
    while len(have) < period:
        def gain(x: int) -> int:
            return len(({(x - c) % period for c in chosen} | {(c - x) % period for c in chosen}) - have)
        best = max((x for x in range(period) if x not in chosen), key=gain)
        chosen.append(best)
        have |= {(a - best) % period for a in chosen} | {(best - a) % period for a in chosen}
    return np.array(sorted(chosen))


def substring_dedup(docs: DataFrame, window: int = 35, period: int = 21, carry: list[str] | None = None,
                    buckets: int | None = None, layout: bool = False) -> DataFrame:
    """Remove every word covered by a window of `window` words whose sequence also starts anywhere else.

    docs has doc_id and text; words are runs of bytes other than ASCII white space. Returns doc_id, n_words,
    n_removed, kept_text (kept words joined by one space) and the columns named in `carry`. With `layout` kept_text
    has the white space of the text between words that stay together, and is the text itself if nothing goes.

    1. Windows of window - period + 1 words are hashed only where the word position modulo the period lies in a
       difference cover. Two equal windows of `window` words always share one such aligned anchor.
    2. Anchors meet by hash (32 bits within a bucket: a filter, never a verdict). Equal anchors of a chunk of
       texts travel once, so the commonest passage costs one entry per chunk.
    3. Around repeated anchors each full window is extended and compared by a 128-bit hash, in the same way.
    4. Repeated windows go back to their texts and cover words.

    A null or blank text has no words and comes back as an empty text. Texts shorter than a window stay whole.
    Rows that repeat a doc_id, or lack one, are separate documents. Windows never cross documents and are
    judged on the input. Other columns are not read; one named like a result cannot be carried (ValueError).
    """
    results = "n_words long, n_removed long, kept_text string"
    carry, more = carried(docs, carry, ["n_words", "n_removed", "kept_text"])
    anchor = window - period + 1
    if anchor < 1:
        raise ValueError("the period must not exceed the window")
    cover = np.zeros(period, bool)
    cover[difference_cover(period)] = True
    frame, extra = keyed(docs, **more), list(more)
    blocks = blocks_for(docs)
    buckets = buckets or blocks
    narrow = frame.select("_row_key", "text")

    def anchors(batches):
        for batch in batches:
            keys = batch.column("_row_key").to_numpy()
            for first, last, data, offsets in arrays.chunks(batch.column("text")):
                words = arrays.Words(data, offsets)
                starts = words.window_starts(anchor)
                at = starts - words.first[words.row[starts]]
                pick = cover[at % period]
                starts, at = starts[pick], at[pick]
                # an anchor can only matter in a text that has a whole window
                long = np.diff(words.first)[words.row[starts]] >= window
                starts, at = starts[long], at[long]
                if not len(starts):
                    continue
                h = arrays.window_hashes(words.hashes(), starts, anchor)
                own, rows = keys[first:last], words.row[starts]
                packed, later = cells(own, rows, at, h, [h], buckets)
                yield from table(packed + known(own[rows[later]], at[later], blocks), CELL).to_batches()

    def full_windows(texts: pa.Table, hits: pa.Table) -> pa.Table:
        out = []
        if not hits.num_rows:
            return table(out, CELL)
        key, at = positions(hits)
        keys = texts.column("_row_key").to_numpy()
        for first, last, data, offsets in arrays.chunks(texts.column("text")):
            own = keys[first:last]
            row, pos = rows_of(own, key, at)
            if not len(row):
                continue
            words = arrays.Words(data, offsets)
            # windows that hold the anchor: period - 1 words earlier up to the anchor itself
            low = np.maximum(pos - (period - 1), 0) + words.first[row]
            high = np.minimum(pos + words.first[row], words.first[row + 1] - window) + 1
            fits = high > low
            mark = arrays.covered(low[fits], (high - low)[fits], len(words.row) + 1)
            starts = np.flatnonzero(mark)
            if not len(starts):
                continue
            lanes = [arrays.window_hashes(words.hashes(lane), starts, window, lane) for lane in range(2)]
            rows = words.row[starts]
            place = starts - words.first[rows]
            packed, later = cells(own, rows, place, lanes[0], lanes, buckets)
            out += packed
            out += known(own[rows[later]], place[later], blocks)
        return table(out, CELL)

    def remove(texts: pa.Table, hits: pa.Table) -> pa.Table:
        key, at = positions(hits)
        keys = texts.column("_row_key").to_numpy()
        kept, total, gone = [], [], []
        for first, last, data, offsets in arrays.chunks(texts.column("text")):
            own = keys[first:last]
            row, pos = rows_of(own, key, at)
            whole = data.tobytes()
            if not len(row):
                for a, b in zip(offsets[:-1], offsets[1:]):
                    words = whole[a:b].split()
                    kept.append(whole[a:b] if layout else b" ".join(words))
                    total.append(len(words))
                    gone.append(0)
                continue
            words = arrays.Words(data, offsets)
            drop = arrays.covered(words.first[row] + pos, window, len(words.row))
            stay = np.flatnonzero(~drop)
            edge = np.searchsorted(stay, words.first)
            start, end = words.start[stay].tolist(), words.end[stay].tolist()
            ids, texts_of = stay.tolist(), offsets.tolist()
            for i, (a, b, f, g) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), words.first[:-1].tolist(),
                                                 words.first[1:].tolist())):
                if not layout:
                    kept.append(b" ".join([whole[s:e] for s, e in zip(start[a:b], end[a:b])]))
                elif b - a == g - f:
                    kept.append(whole[texts_of[i]:texts_of[i + 1]])
                else:
                    runs, k = [], a
                    while k < b:
                        j = k
                        while j + 1 < b and ids[j + 1] == ids[j] + 1:
                            j += 1
                        runs.append(whole[start[k]:end[j]])
                        k = j + 1
                    kept.append(b" ".join(runs))
                total.append(g - f)
                gone.append(g - f - (b - a))
        return pa.table([texts.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                         pa.array(kept, pa.binary()).cast(pa.string()), *[texts.column(c) for c in extra]],
                        names=["doc_id", "n_words", "n_removed", "kept_text", *carry])

    by_block = frame.withColumn("_block", block_of("_row_key", blocks)).groupBy("_block")

    hits = repeated(narrow.mapInArrow(anchors, CELL), blocks)
    packed = by_block.cogroup(hits.groupBy("block")).applyInArrow(full_windows, CELL)
    hits = repeated(packed, blocks)
    return by_block.cogroup(hits.groupBy("block")).applyInArrow(
        remove, with_fields(results, frame, dict(zip(more, carry))))
