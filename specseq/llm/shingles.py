"""Sets of five-word shingles as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

from .dealing import mixed

SHINGLE = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_TURN = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the number of words of each text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    a = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = _BLANK[a]
    inner = ~blank
    first = inner.copy()
    first[1:] &= blank[:-1]
    starts = np.nonzero(first)[0]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.nonzero(inner)[0]
    word = np.cumsum(first)[at] - 1
    place = at - starts[word]
    weight = mixed((np.arange(int(place.max()) + 1, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    cut = np.nonzero(np.append(True, word[1:] != word[:-1]))[0]
    h = mixed(np.add.reduceat(_BYTE[_LOWER[a[at]]] * weight[place], cut) + np.append(cut[1:], len(at)).astype(np.uint64) - cut.astype(np.uint64))
    upto = np.searchsorted(starts, np.cumsum(sizes))
    return h, np.diff(upto, prepend=0)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; one shingle of all words where there are fewer than five, none without words."""
    h, counts = word_hashes(texts)
    sets, at = [], 0
    whole = np.zeros(0, np.uint64)
    if len(h) >= SHINGLE:
        m = len(h) - SHINGLE + 1
        whole = np.zeros(m, np.uint64)
        for i in range(SHINGLE):
            whole += h[i : i + m] * _TURN[i]
        whole = mixed(whole)
    for n in counts.tolist():
        if n >= SHINGLE:
            sets.append(np.unique(whole[at : at + n - SHINGLE + 1]))
        elif n:
            sets.append(mixed(np.array([(h[at : at + n] * _TURN[:n]).sum() + np.uint64(n)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


def set_hash(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles."""
    return int(mixed(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].astype(np.int64)) if len(s) else 0
