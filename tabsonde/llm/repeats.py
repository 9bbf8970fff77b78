"""Which occurrences of a hash repeat anywhere, found by one exchange of packed occurrences.

Occurrences (hash, row key, position) of a chunk of texts are dealt to buckets by hash, as one row of packed arrays
for each bucket. Equal hashes of a chunk travel once, so no hash brings more than one entry per chunk to a bucket.
Answers go back to blocks of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabsonde.llm.exchange import blocks_of

CELL = "bucket int, base long, hash binary, high binary, low binary, row binary, at binary, again binary"
HIT = "block int, key binary, at binary"


def cells(keys: np.ndarray, rows: np.ndarray, at: np.ndarray, filters: np.ndarray, exact: list[np.ndarray],
          buckets: int) -> tuple[list[dict], np.ndarray]:
    """Occurrences of a chunk as one row per bucket. Of equal ones only the first travels, marked as repeated;
    the others are known to be repeated and are returned."""
    order = np.lexsort(exact[::-1]) if len(exact) > 1 else np.argsort(exact[0], kind="stable")
    same = np.ones(len(order), bool)
    for e in exact:
        same[1:] &= e[order][1:] == e[order][:-1]
    same[:1] = False
    later = order[same]
    twice = np.zeros(len(order), bool)
    twice[order[:-1][same[1:]]] = True
    send = np.ones(len(order), bool)
    send[later] = False
    send = np.flatnonzero(send)
    bucket = (filters[send] >> np.uint64(33)) % np.uint64(buckets)
    send = send[np.argsort(bucket, kind="stable")]
    bucket = ((filters[send] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    base = int(keys.min()) if len(keys) else 0
    out = []
    for part in np.split(send, cuts):
        if len(part):
            out.append({
                "bucket": int((filters[part[0]] >> np.uint64(33)) % np.uint64(buckets)), "base": base,
                "hash": (filters[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                "high": exact[0][part].tobytes() if len(exact) > 1 else None,
                "low": exact[1][part].tobytes() if len(exact) > 1 else None,
                "row": (keys[rows[part]] - base).tobytes(), "at": at[part].astype(np.uint32).tobytes(),
                "again": np.packbits(twice[part]).tobytes()})
    return out, later


def hits_by_block(keys: np.ndarray, at: np.ndarray, blocks: int) -> list[dict]:
    """Positions of keys as one row per block."""
    if not len(keys):
        return []
    distinct, inverse = np.unique(keys, return_inverse=True)
    block = np.array(blocks_of(distinct.tolist(), blocks))[inverse]
    order = np.argsort(block, kind="stable")
    return [{"block": int(block[p[0]]), "key": keys[p].tobytes(), "at": at[p].astype(np.uint32).tobytes()}
            for p in np.split(order, np.flatnonzero(np.diff(block[order])) + 1)]


def table(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.Table.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))]))


def known(keys: np.ndarray, at: np.ndarray, blocks: int) -> list[dict]:
    """Occurrences already known to be repeated, as cells of negative buckets, one for each block."""
    return [{"bucket": -1 - h["block"], "base": 0, "hash": None, "high": None, "low": None, "row": h["key"],
             "at": h["at"], "again": None} for h in hits_by_block(keys, at, blocks)]


def repeated_in(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions among the cells of a bucket whose hash occurs again there, or that are marked."""
    key, at, again = [], [], []
    parts: dict[str, list[np.ndarray]] = {"hash": [], "high": [], "low": []}
    for r in rows:
        h = np.frombuffer(r["hash"], np.uint32)
        parts["hash"].append(h)
        for c in ("high", "low"):
            if r[c] is not None:
                parts[c].append(np.frombuffer(r[c], np.uint64))
        key.append(np.frombuffer(r["row"], np.int64) + r["base"])
        at.append(np.frombuffer(r["at"], np.uint32))
        again.append(np.unpackbits(np.frombuffer(r["again"], np.uint8), count=len(h)).astype(bool))
    columns = [np.concatenate(parts[c]) for c in ("high", "low", "hash") if parts[c]]
    columns = columns[:2] if len(columns) > 1 else columns
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    same = np.ones(max(len(order) - 1, 0), bool)
    for c in columns:
        s = c[order]
        same &= s[1:] == s[:-1]
    hit = np.concatenate(again)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return np.concatenate(key)[hit], np.concatenate(at)[hit]


def repeated(packed: DataFrame, blocks: int) -> DataFrame:
    """Hits (by block) among cells: occurrences whose hash occurs again in the bucket or is marked, and known ones."""
    def judge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        if rows[0]["bucket"] < 0:  # known to be repeated
            return table([{"block": -1 - r["bucket"], "key": r["row"], "at": r["at"]} for r in rows], HIT)
        return table(hits_by_block(*repeated_in(rows), blocks), HIT)

    return packed.groupBy("bucket").applyInArrow(judge, HIT)


def positions(hits: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key = np.frombuffer(b"".join(hits.column("key").to_pylist()), np.int64)
    at = np.frombuffer(b"".join(hits.column("at").to_pylist()), np.uint32).astype(np.int64)
    return key, at


def rows_of(own: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows among `own` and positions of the hits whose key is there."""
    if not len(own) or not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(own)
    place = np.searchsorted(own[order], key)
    ok = place < len(own)
    ok[ok] = own[order][place[ok]] == key[ok]
    return order[place[ok]], at[ok]
