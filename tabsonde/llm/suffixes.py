"""Removal of repeated byte strings with sorted suffixes: front-coded runs, merged by common prefixes."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsonde.llm import arrays
from tabsonde.llm.exchange import block_of, blocks_for, blocks_of, carried, keyed, with_fields
from tabsonde.llm.repeats import CELL, cells, known, positions, repeated, repeated_in, rows_of, table

LEAD = 4  # bytes before an anchor that belong to its suffix
HOT = 2000  # anchors above which a gram is hot: its windows are hashed one by one
STRETCH = 8 << 20  # longer texts are cut into overlapping stretches
BOTH = CELL + ", run binary, before binary, sizes binary, nearest binary, farthest binary, count binary"
SPAN = "block int, key binary, at binary, count binary"


#: Odd numbers for bytes; a gram is too short for the sequences that collide modulo 2**64, and windows are compared
#: modulo a prime.
_BYTE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM_BASE = 0x9E3779B97F4A7C15


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the `gram` bytes at every place, from running sums modulo 2**64."""
    power, back = arrays.powers(_GRAM_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:len(data)], out=sums[1:])
    return arrays.mix((sums[gram:] - sums[:-gram]) * back[:len(data) - gram + 1])


class Anchors:
    """Sampled positions of a chunk of texts. A window of `size` bytes samples, of its grams of `gram` bytes, the
    leftmost with the least hash, so equal windows sample at equal distances. An anchor serves the windows that
    start from `farthest` down to `nearest` bytes before it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int, gram: int):
        n = len(data)
        self.at = self.nearest = self.farthest = self.row = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        room = np.diff(offsets) - size + 1
        if n < size or room.max(initial=0) <= 0:
            return
        i = np.arange(n - gram + 1)
        h = _gram_hashes(data, gram)
        least = (h & ~np.uint64(0xFFFFFF)) | i.astype(np.uint64)  # equal hashes: the leftmost
        width, have = size - gram + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[:len(least) - (width - have)], least[width - have:])
        windows = arrays.ranges(offsets[:-1][room > 0], room[room > 0])
        row = np.repeat(np.flatnonzero(room > 0), room[room > 0])
        at = (least[windows] & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
        last = np.append(first[1:], len(at)) - 1
        self.at, self.row, self.hash = at[first], row[first], h[at[first]]
        self.farthest, self.nearest = at[first] - windows[first], at[first] - windows[last]


def stretches(column: pa.Array, size: int):
    """(first row, row after the last, byte within the row, bytes, offsets): chunks, and pieces of long rows that
    overlap so that every window of `size` bytes lies in exactly one."""
    for first, last, data, offsets in arrays.chunks(column):
        if last - first > 1 or len(data) <= STRETCH:
            yield first, last, 0, data, offsets
            continue
        for at in range(0, max(len(data) - size + 1, 1), STRETCH):
            part = data[at:at + STRETCH + size - 1]
            yield first, last, at, part, np.array([0, len(part)])


def front_code(items: list[bytes]) -> bytes:
    """A sorted list as lengths shared with the item before, own lengths, and own bytes."""
    shared, before = [], b""
    for item in items:
        shared.append(common(before, item, 0))
        before = item
    rest = [item[k:] for item, k in zip(items, shared)]
    return (np.array([len(items), *shared, *map(len, rest)], np.uint32).tobytes() + b"".join(rest))


def front_decode(run: bytes) -> tuple[list[int], list[bytes]]:
    """Shared lengths and whole items."""
    n = int(np.frombuffer(run, np.uint32, 1)[0])
    numbers = np.frombuffer(run, np.uint32, 2 * n, 4).tolist()
    shared, at, items, before = numbers[:n], 4 + 8 * n, [], b""
    for k, m in zip(shared, numbers[n:]):
        before = before[:k] + run[at:at + m]
        at += m
        items.append(before)
    return shared, items


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known to be equal."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n  # bisect: bytes before `low` are equal, those before `high` are not all
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def merge(runs: list[tuple[list[int], list[bytes]]]):
    """(run, index in the run, bytes shared with the item given before), in order of all items of sorted runs.

    A loser tree. Each run's head knows how many bytes it shares with the last item given out. Two heads that share
    different numbers of bytes with it are in order by those numbers alone; only if the numbers are equal are bytes
    compared, from there on. A loser keeps what it shares with the winner, which is the next item given out.
    """
    k = len(runs)
    size = 1 << max(k - 1, 0).bit_length()
    place = [0] * k
    head = [items[0] if items else None for _, items in runs] + [None] * (size - k)
    shared = [0] * size
    loser = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); a head that has run out loses."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        m, n = shared[a], shared[b]
        if m != n:  # the one that shares more with the last winner is smaller, and shares n or m with the other
            return (a, b) if m > n else (b, a)
        c = common(x, y, m)
        if x[c:c + 1] <= y[c:c + 1]:
            shared[b] = c
            return a, b
        shared[a] = c
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    if not k:
        return
    winner = build(1)
    while head[winner] is not None:
        yield winner, place[winner], shared[winner]
        own_shared, items = runs[winner]
        place[winner] += 1
        at = place[winner]
        head[winner] = items[at] if at < len(items) else None
        shared[winner] = own_shared[at] if at < len(items) else 0
        node = (winner + size) >> 1
        while node:
            winner, loser[node] = play(winner, loser[node])
            node >>= 1


def depths(backward: list[bytes]) -> list[set[int]]:
    """For each string of a group the lengths of the common prefixes it has with the others."""
    order = sorted(range(len(backward)), key=backward.__getitem__)
    between = [common(backward[a], backward[b], 0) for a, b in zip(order, order[1:])]
    out: list[set[int]] = [set() for _ in backward]
    for steps in (range(len(order)), range(len(order) - 1, -1, -1)):
        stack: list[int] = []  # strictly rising minima of what lies between an item and those before
        forward = steps.step > 0
        for i in steps:
            if forward and i or not forward and i < len(order) - 1:
                low = between[i - 1 if forward else i]
                while stack and stack[-1] >= low:
                    stack.pop()
                stack.append(low)
            out[order[i]].update(stack)
    return out


def judge_group(suffixes: list[bytes], before: list[bytes], nearest: list[int], farthest: list[int],
                size: int) -> list[list[tuple[int, int]]]:
    """For each anchor of a group (equal gram and lead) the ranges (from, to) of distances at which its window
    occurs again in the group.

    A window at distance d from anchor x occurs again if another anchor y shares d bytes before and size - d bytes
    from the anchor on. With l the bytes that x and y share before them, the suffixes that start l bytes before
    both share l + size - d at least. So for each l that x shares with anyone the suffixes there are sorted, and
    the longest prefix shared with a neighbour among those of the same l gives all d from l + size - prefix to l.
    """
    starts = []
    for i, lengths in enumerate(depths(before)):
        for length in lengths:
            starts.append((length, before[i][:length][::-1] + suffixes[i], i))
    starts.sort()
    out: list[list[tuple[int, int]]] = [[] for _ in suffixes]
    shared = [common(a[1], b[1], 0) if a[0] == b[0] else 0 for a, b in zip(starts, starts[1:])]
    for j, (length, _, i) in enumerate(starts):
        most = max(shared[j - 1] if j else 0, shared[j] if j < len(shared) else 0)
        # `length` counts bytes before the lead, distances count from the anchor
        low, high = max(length + size - most + LEAD, nearest[i], LEAD), min(length + LEAD, farthest[i])
        if low <= high:
            out[i].append((low, high))
    return out


def hot_grams(texts: DataFrame, size: int, gram: int, hot: int = HOT) -> list[int]:
    """Hashes of the grams with more than `hot` anchors (a share of 1 / hot of all anchors at most, so 8 bytes for
    every 170 KB of text come to the driver). A task leaves out grams that it has seen once; that only moves the
    border between hot and other grams, not a result."""
    def count(batches):
        def merged(parts):
            grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return grams, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def rows(part):
            grams, times = part
            return pa.RecordBatch.from_arrays([pa.array(grams[times > 1].view(np.int64)), pa.array(times[times > 1])],
                                              names=["gram", "times"])

        pending, held = [], 0
        for batch in batches:
            for _, _, _, data, offsets in stretches(batch.column("text"), size):
                pending.append(np.unique(Anchors(data, offsets, size, gram).hash, return_counts=True))
                held += len(pending[-1][0])
                if held > 1_000_000:
                    pending = [merged(pending)]
                    held = len(pending[0][0])
                    if held > 500_000:
                        yield rows(pending[0])
                        pending, held = [], 0
        if pending:
            yield rows(merged(pending))

    counts = texts.select("text").mapInArrow(count, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("n"))
    return [r["gram"] for r in counts.filter(F.col("n") > hot).select("gram").collect()]


def exchanged(frame: DataFrame, size: int, gram: int, blocks: int, hot: int = HOT) -> DataFrame:
    """Steps 1 and 2 of repeated_bytes up to the exchange: rows of BOTH by bucket."""
    buckets = blocks
    known_hot = frame.sparkSession.sparkContext.broadcast(
        np.sort(np.array(hot_grams(frame, size, gram, hot), np.int64).view(np.uint64)))

    def anchors(batches):
        for batch in batches:
            keys = batch.column("_row_key").to_numpy()
            for first, last, base, data, offsets in stretches(batch.column("text"), size):
                found = Anchors(data, offsets, size, gram)
                if len(found.at):
                    own, at = keys[first:last], found.at - offsets[found.row] + base
                    packed, later = cells(own, found.row, at, found.hash, [found.hash], buckets)
                    yield from table(packed + known(own[found.row[later]], at[later], blocks), CELL).to_batches()

    def send(texts: pa.Table, hits: pa.Table) -> pa.Table:
        """Cells of single windows, runs of suffixes, and spans that a chunk finds by itself (negative buckets)."""
        out: list[dict] = []
        if hits.num_rows:
            key, at = positions(hits)
            keys = texts.column("_row_key").to_numpy()
            for first, last, base, data, offsets in stretches(texts.column("text"), size):
                row, pos = rows_of(keys[first:last], key, at)
                pos = pos - base
                row, pos = row[(pos >= 0) & (pos < len(data))], pos[(pos >= 0) & (pos < len(data))]
                found = Anchors(data, offsets, size, gram) if len(row) else None
                if found is None or not len(found.at):
                    continue
                wanted = np.isin(found.at, offsets[row] + pos)
                often = np.isin(found.hash, known_hot.value)
                out += single(found, np.flatnonzero(wanted), often, data, offsets, keys[first:last], base)
                out += far(found, np.flatnonzero(wanted & ~often & (found.farthest >= LEAD)), data, offsets,
                           keys[first:last], base)
        return table(out, BOTH)

    def single(found, chosen, often, data, offsets, own, base) -> list[dict]:
        """Windows compared one by one: those that start fewer than LEAD bytes before their anchor, and all of hot
        grams."""
        farthest = np.where(often[chosen], found.farthest[chosen], np.minimum(found.farthest[chosen], LEAD - 1))
        count = np.maximum(farthest - found.nearest[chosen] + 1, 0)
        start, row = arrays.ranges(found.at[chosen] - farthest, count), np.repeat(found.row[chosen], count)
        if not len(start):
            return []
        lanes = [arrays.between(arrays.running(data, arrays.BASE[lane]), start, start + size,
                                arrays.BASE[lane]) for lane in range(2)]
        place = start - offsets[row] + base
        packed, later = cells(own, row, place, lanes[0], lanes, buckets)
        return packed + spans_known(own[row[later]], place[later], np.ones(len(later), np.int64))

    def far(found, chosen, data, offsets, own, base) -> list[dict]:
        """Suffixes around the other windows, as one front-coded run per bucket."""
        whole, items = data.tobytes(), []
        for a, n, f, r, e in zip(*(x.tolist() for x in (
                found.at[chosen], np.maximum(found.nearest[chosen], LEAD), found.farthest[chosen], found.row[chosen],
                offsets[found.row[chosen] + 1]))):
            items.append((whole[a - LEAD:min(a - LEAD + size, e)], whole[a - f:a - LEAD][::-1], n, f, r, a))
        items.sort()
        again, runs = [], {}
        for i, item in enumerate(items):
            if i and item[:4] == items[i - 1][:4]:  # the same bytes around: all windows of both occur twice
                again += [items[i - 1], item]
            else:
                runs.setdefault(zlib.crc32(item[0][:LEAD + gram]) % buckets, []).append(item)
        out = []
        for bucket, run in runs.items():
            suffixes, before, nearest, farthest, row, at = zip(*run)
            rows = np.array(row)
            out.append({
                "bucket": bucket, "base": 0, "run": pa.compress(front_code(suffixes), "zstd", asbytes=True),
                "before": pa.compress(b"".join(before), "zstd", asbytes=True),
                "sizes": np.array([len(b) for b in before], np.uint32).tobytes(), "row": own[rows].tobytes(),
                "at": (np.array(at) - offsets[rows] + base).astype(np.uint32).tobytes(),
                "nearest": np.array(nearest, np.uint32).tobytes(), "farthest": np.array(farthest, np.uint32).tobytes()})
        if again:
            _, _, n, f, row, at = (np.array(c) if i > 1 else c for i, c in enumerate(zip(*again)))
            out += spans_known(own[row], at - f - offsets[row] + base, f - n + 1)
        return out

    def spans_known(key, at, count) -> list[dict]:
        return [{"bucket": -1 - s["block"], "row": s["key"], "at": s["at"], "count": s["count"]}
                for s in spans_by_block(key, at, count, blocks)]

    by_block = frame.withColumn("_block", block_of("_row_key", blocks)).groupBy("_block")
    hits = repeated(frame.select("_row_key", "text").mapInArrow(anchors, CELL), blocks)
    return by_block.cogroup(hits.groupBy("block")).applyInArrow(send, BOTH)


def repeated_bytes(docs: DataFrame, size: int = 200, gram: int = 32, carry: list[str] | None = None,
                   hot: int = HOT) -> DataFrame:
    """Remove every byte covered by a string of `size` bytes that also starts anywhere else.

    docs has doc_id and text (string or binary). Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept (the remaining bytes, binary: cuts may split characters), spans (from, to) and the columns in `carry`.

    1. Sampled anchors (see Anchors), about one in 85 bytes, meet by hash; those seen once go.
    2. Suffixes that start LEAD bytes before the other anchors are sorted within a chunk, front-coded and exchanged
       by the hash of their first bytes. A bucket merges its runs with a loser tree that never compares known
       prefixes again, and gets the common prefixes of neighbours, so groups of equal gram and lead, for free.
    3. In a group, suffixes are sorted once more from where anchors' preceding bytes part (see judge_group); shared
       prefixes of neighbours tell which windows repeat.
    4. Windows that start fewer than LEAD bytes before their anchor are compared by 128-bit hash. So a group is
       split by LEAD bytes that vary where a common passage begins, and inside a passage equal suffixes of a chunk
       travel once.
    5. Grams with more than `hot` anchors (a line in many rows, shorter than a window) form no group: all windows of
       their anchors are compared as in 4, spread by their hash, equal ones of a chunk once.

    Null and empty texts have no bytes. Texts shorter than a window stay whole. Rows that repeat a doc_id, or lack
    one, are separate documents. Strings never cross documents and are judged on the input. Other columns are not
    read; one named like a result cannot be carried (ValueError).
    """
    results = "n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"
    carry, more = carried(docs, carry, ["n_bytes", "n_removed", "n_spans", "kept", "spans"])
    frame, extra = keyed(docs, **more), list(more)
    blocks = blocks_for(docs)

    def judge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        if rows[0]["bucket"] < 0:
            return table([{"block": -1 - r["bucket"], "key": r["row"], "at": r["at"], "count": r["count"]} for r in rows], SPAN)
        out = []
        windows = [r for r in rows if r["hash"] is not None]
        if windows:
            key, at = repeated_in(windows)
            out += spans_by_block(key, at.astype(np.int64), np.ones(len(key), np.int64), blocks)
        runs = [r for r in rows if r["run"] is not None]
        if runs:
            out += spans_by_block(*merged_spans(runs, size, LEAD + gram), blocks)
        return table(out, SPAN)

    def remove(texts: pa.Table, spans: pa.Table) -> pa.Table:
        key, at = positions(spans)
        count = np.frombuffer(b"".join(spans.column("count").to_pylist()), np.uint32).astype(np.int64)
        keys = texts.column("_row_key").to_numpy()
        out = []
        for first, last, data, offsets in arrays.chunks(texts.column("text")):
            n, rows = len(data), last - first
            edge = np.zeros(n + 1, np.int32)
            row, place = rows_of(keys[first:last], key, np.arange(len(key)))
            start = offsets[row] + at[place]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + count[place] - 1 + size, -1)
            drop = np.cumsum(edge[:n], dtype=np.int32) > 0
            stay = np.concatenate([[0], np.cumsum(~drop)])
            left = stay[offsets]
            opens, closes = drop.copy(), drop.copy()  # first and last bytes of removed runs
            opens[1:] &= ~drop[:-1]
            closes[:-1] &= ~drop[1:]
            inner = offsets[1:-1][offsets[1:-1] < n]
            opens[inner] |= drop[inner]
            closes[inner - 1] |= drop[inner - 1]
            opened, closed = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            of = np.searchsorted(opened, offsets)
            back = np.repeat(offsets[:-1], np.diff(of))
            spans_of = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(opened - back), pa.array(closed - back)], names=["start", "end"]))
            kept = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(left.astype(np.int64)),
                                                                   pa.py_buffer(np.ascontiguousarray(data[~drop]))])
            out.append(pa.table([texts.column("doc_id").slice(first, rows), pa.array(np.diff(offsets)),
                                 pa.array(np.diff(offsets) - np.diff(left)), pa.array(np.diff(of)), kept.cast(pa.binary()),
                                 spans_of, *[texts.column(c).slice(first, rows) for c in extra]],
                                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans", *carry]))
        return pa.concat_tables(out)

    by_block = frame.withColumn("_block", block_of("_row_key", blocks)).groupBy("_block")
    spans = exchanged(frame, size, gram, blocks, hot).groupBy("bucket").applyInArrow(judge, SPAN)
    return by_block.cogroup(spans.groupBy("block")).applyInArrow(
        remove, with_fields(results, frame, dict(zip(more, carry))))


def merged_spans(runs: list[dict], size: int, same: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows) of all repeated windows among the runs of a bucket. Neighbours that
    share `same` bytes belong to one group."""
    decoded, before, facts = [], [], []
    for r in runs:
        decoded.append(front_decode(pa.decompress(r["run"], _raw_size(r["run"]), "zstd", asbytes=True)))
        sizes = np.frombuffer(r["sizes"], np.uint32)
        raw = pa.decompress(r["before"], int(sizes.sum()), "zstd", asbytes=True) if sizes.any() else b""
        edges = [0, *np.cumsum(sizes, dtype=np.int64).tolist()]
        before.append([raw[a:b] for a, b in zip(edges, edges[1:])])
        facts.append([np.frombuffer(r["row"], np.int64).tolist(),
                      *(np.frombuffer(r[c], np.uint32).tolist() for c in ("at", "nearest", "farthest"))])
    out: list[tuple[int, int, int]] = []
    group: list[tuple[int, int]] = []

    def close() -> None:
        if len(group) < 2:
            return
        key, at, nearest, farthest = ([facts[r][c][i] for r, i in group] for c in range(4))
        found = judge_group([decoded[r][1][i] for r, i in group], [before[r][i] for r, i in group], nearest, farthest, size)
        for k, a, ranges in zip(key, at, found):
            out.extend((k, a - high, high - low + 1) for low, high in ranges)

    for run, i, shared in merge(decoded):
        if shared < same:
            close()
            group.clear()
        group.append((run, i))
    close()
    columns = np.array(out, np.int64).reshape(-1, 3)
    return columns[:, 0], columns[:, 1], columns[:, 2]


def _raw_size(run: bytes) -> int:
    import zstandard
    return zstandard.frame_content_size(run)


def spans_by_block(keys: np.ndarray, at: np.ndarray, count: np.ndarray, blocks: int) -> list[dict]:
    if not len(keys):
        return []
    distinct, inverse = np.unique(keys, return_inverse=True)
    block = np.array(blocks_of(distinct.tolist(), blocks))[inverse]
    order = np.argsort(block, kind="stable")
    return [{"block": int(block[p[0]]), "key": keys[p].tobytes(), "at": at[p].astype(np.uint32).tobytes(),
             "count": count[p].astype(np.uint32).tobytes()}
            for p in np.split(order, np.flatnonzero(np.diff(block[order])) + 1)]
