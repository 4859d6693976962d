"""Byte-level BPE by a segment tree, over many pieces at once.

Every piece has a tree over its byte positions. A leaf holds the rank of the
pair that starts there, with the position in its low bits, so the root is the
leftmost pair of least rank. A merge changes the leaves of the live pair, of its
left neighbour and of the swallowed token, and the paths from these to the root.
Pieces of like size are worked on side by side in numpy arrays.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices

#: Bytes of position in a leaf's low bits; longer pieces than 2**40 can't be.
SHIFT = np.int64(40)
NONE = np.int64(1) << np.int64(62)
#: Pieces kept from batch to batch in a worker; the cache is emptied when full.
CACHE = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """Merges by the ranks of a tiktoken file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.width = np.int64(max(ranks.values()) + 1)
        pairs = {}
        for t, rank in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a * int(self.width) + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # An open-addressing table: one or two gathers a look-up instead of a binary search.
        self.mask = np.int64((1 << int(len(self.keys) * 4).bit_length()) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int64)
        self.slot_rank = np.full(int(self.mask) + 1, NONE, np.int64)
        left = np.arange(len(self.keys))
        at = self._slot(self.keys)
        while len(left):
            free = self.slots[at[left]] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(at[left], return_index=True)[1]] = True
            now = left[free & first]
            self.slots[at[now]] = self.keys[now]
            self.slot_rank[at[now]] = self.values[now]
            left = left[~(free & first)]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(0x2545F4914F6CDD1D) >> np.int64(20)) ^ key) & self.mask

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = self._slot(key)
        got = self.slots[at]
        out = np.where(got == key, self.slot_rank[at], NONE)
        open_ = np.nonzero((got != key) & (got >= 0))[0]
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            got = self.slots[at[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def merge_class(self, pieces: list[bytes], leaves: int) -> list[np.ndarray]:
        """Ids of pieces that have at most ``leaves`` bytes, a power of two."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        pad = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
        where = np.arange(leaves, dtype=np.int64)
        ids = np.where(where < size[:, None], self.byte_id[pad], -1)
        after = np.broadcast_to(where + 1, (n, leaves)).copy()  # start of the next live token
        before = np.broadcast_to(where - 1, (n, leaves)).copy()
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        if leaves > 1:
            live = where[:-1] + 1 < size[:, None]
            r = self.pair_rank(ids[:, :-1][live], ids[:, 1:][live])
            tree[:, leaves : 2 * leaves - 1][live] = np.where(r < NONE, (r << SHIFT) | np.broadcast_to(where[:-1], live.shape)[live], NONE)
            level = leaves
            while level > 1:
                np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
                level //= 2
        row = np.nonzero(tree[:, 1] < NONE)[0]
        low = (np.int64(1) << SHIFT) - 1
        while len(row):
            root = tree[row, 1]
            p = root & low
            q = after[row, p]
            new = root >> SHIFT
            ids[row, p] = new  # a merged token's id is its rank
            ids[row, q] = -1
            nxt = after[row, q]
            after[row, p] = nxt
            inner = nxt < size[row]
            before[row[inner], nxt[inner]] = p[inner]
            tree[row, leaves + q] = NONE
            # The pair that starts at p, and the one that ends in it.
            r = np.full(len(row), NONE, np.int64)
            r[inner] = self.pair_rank(new[inner], ids[row[inner], nxt[inner]])
            tree[row, leaves + p] = np.where(r < NONE, (r << SHIFT) | p, NONE)
            prev = before[row, p]
            has = prev >= 0
            hr, hp = row[has], prev[has]
            r = self.pair_rank(ids[hr, hp], new[has])
            tree[hr, leaves + hp] = np.where(r < NONE, (r << SHIFT) | hp, NONE)
            for rr, start in ((row, p), (row, q), (hr, hp)):
                node = (start + leaves) >> 1
                while node.size and node[0] >= 1:
                    tree[rr, node] = np.minimum(tree[rr, 2 * node], tree[rr, 2 * node + 1])
                    node = node >> 1
            row = row[tree[row, 1] < NONE]
        return [x[x >= 0] for x in ids]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:  # a piece that is a token stays whole
                out[i] = whole.to_bytes(4, "little")
            elif p:
                classes.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for leaves, members in classes.items():
            step = max(1, (1 << 19) // leaves)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self.merge_class([pieces[j] for j in part], leaves), strict=True):
                    out[i] = ids.astype("<u4").tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_texts(texts: list[str], merger: Merger, find, cache: dict[str, bytes]) -> list[bytes]:
    """Ids of whole texts. find: splits a text into the pieces that are merged separately."""
    split = [find(t) for t in texts]
    missing = list({p for pieces in split for p in pieces if p not in cache})
    if len(cache) + len(missing) > CACHE:
        cache.clear()
        missing = list({p for pieces in split for p in pieces})
    cache.update(zip(missing, merger.encode_pieces([p.encode() for p in missing]), strict=True))
    return [b"".join(map(cache.__getitem__, pieces)) for pieces in split]


_mergers: dict[str, tuple] = {}


def _worker(path: str, pattern: str):
    if (path, pattern) not in _mergers:
        import regex

        _mergers[path, pattern] = (Merger(load_ranks(path)), regex.compile(pattern).findall, {})
    return _mergers[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of each row's whole text.

    A null or empty text has no ids. Repeated rows and null doc_ids give a row
    each; other columns are left out. Long texts are one row like any other: a
    piece without a split costs n log n.
    """
    def run(batches):
        merger, find, cache = _worker(path, pattern)
        for batch in in_slices(batches, most_bytes=chunk_bytes):
            coded = encode_texts([t or "" for t in batch.column(1).to_pylist()], merger, find, cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.binary()), pa.array([merger.decode(c) for c in coded], pa.binary())], names=["doc_id", "ids", "decoded"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")

