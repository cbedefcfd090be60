"""Words and word shingles of UTF-8 texts as 64-bit hashes, vectorised over batches of texts.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 bits of the result."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; a sort takes less time than the table that np.unique builds."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def _block(raw: bytes, breaks: np.ndarray = _SPACE, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one stretch of bytes."""
    data = np.frombuffer(raw, np.uint8)
    inside = ~breaks[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    values = _BYTE[data[inside]] * powers(int(lengths.max()))[place]
    if prefix:
        values, lengths = np.where(place < prefix, values, np.uint64(0)), np.minimum(lengths, prefix)
    return starts, mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def _long(raw: bytes, breaks: np.ndarray, prefix: int | None) -> np.ndarray:
    """Word hashes of a text over the chunk size, cut between words only."""
    parts, at = [], 0
    while at < len(raw):
        to = min(at + CHUNK, len(raw))
        while to < len(raw) and not breaks[raw[to]]:
            to += 1
        parts.append(_block(raw[at:to], breaks, prefix)[1])
        at = to
    return np.concatenate(parts)


def word_hashes(texts: list[bytes], breaks: np.ndarray = _SPACE, prefix: int | None = None) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; short texts are hashed together. breaks: which bytes part words; line feed must.

    prefix: hash only so many first bytes of a word.
    """
    at = 0
    while at < len(texts):
        if len(texts[at]) > CHUNK:
            yield _long(texts[at], breaks, prefix)
            at += 1
            continue
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
            size += len(texts[to]) + 1
            to += 1
        starts, hashes = _block(b"\n".join(texts[at:to]), breaks, prefix)
        ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
        cuts = np.searchsorted(starts, ends)
        before = 0
        for cut in cuts:
            yield hashes[before:cut]
            before = cut
        at = to


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; a shorter text is one shingle as a whole; no words, no shingle."""
    n = len(hashes)
    if not n:
        return hashes
    take = min(size, n)
    out = np.full(n - take + 1, take if n < size else 0, np.uint64)
    for i in range(take):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : n - take + 1 + i]
    return mix(out)
