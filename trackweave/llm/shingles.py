"""Sets of hashed word shingles, computed for many texts at a time with numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = x + np.uint64((salt + 1) * int(_MULT) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the index of each word's text. Words end at ASCII white space."""
    joined = b" ".join(texts)
    data = np.frombuffer(joined, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = np.empty(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = ends - starts
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(sizes.sum()) - np.repeat(firsts, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _MULT | np.uint64(1)), dtype=np.uint64)
    hashed = np.add.reduceat(_BYTE[data[solid[1:-1]]] * powers[place], firsts)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return mix(hashed ^ sizes.astype(np.uint64)), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts as hashes, sorted within each text, and the index of their texts.

    A-Z count as a-z. A text with fewer than ``n`` words has one shingle, its whole sequence; without words none.
    """
    words, owner = word_hashes([(t or "").encode("utf-8", "replace").lower() for t in texts])
    if not len(words):
        return words, owner
    per_text = np.bincount(owner, minlength=len(texts))
    whole = len(words) - n + 1
    hashes, owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if whole > 0:
        same = owner[:whole] == owner[n - 1 :]
        hashes = words[:whole].copy()
        for k in range(1, n):
            hashes = mix(hashes * _MULT + words[k : whole + k])
        hashes, owners = mix(hashes[same], n), owner[:whole][same]
    firsts = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    short = np.flatnonzero((per_text > 0) & (per_text < n))
    if len(short):
        extra = words[firsts[short]]
        for k in range(1, n - 1):
            more = per_text[short] > k
            extra[more] = mix(extra[more] * _MULT + words[firsts[short][more] + k])
        hashes, owners = np.concatenate([hashes, mix(extra + per_text[short].astype(np.uint64), n + 1)]), np.concatenate([owners, short])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[new], owners[new]


def chunks(texts: list[str | None], size: int = 1 << 18):
    """Ranges of texts of about ``size`` characters, so that work arrays stay small; a longer text is alone."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size or i == len(texts) - 1:
            yield begin, i + 1
            begin, total = i + 1, 0


def slices(batches, rows: int = 512):
    """Arrow batches in slices of at most ``rows`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
