"""Vectorised word hashing of UTF-8 texts, for use inside Arrow tasks.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word's hash is a
polynomial of its bytes modulo 2**64, taken from one prefix sum over the whole
block, then mixed; no per-word Python work is done.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PIECE = 1 << 22
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, r in enumerate((_R, _R_INV)):
            steps = np.full(size, r, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def _pieces(blob: bytes) -> Iterator[tuple[int, bytes]]:
    """Parts of at most a few MB, cut at white space, with their offsets."""
    at = 0
    while len(blob) - at > _PIECE:
        cut = max(blob.rfind(c, at, at + _PIECE) for c in (b" ", b"\n", b"\t"))
        if cut <= at:
            ends = [x for c in (b" ", b"\n", b"\t") if (x := blob.find(c, at + _PIECE)) >= 0]
            cut = min(ends, default=len(blob) - 1)
        yield at, blob[at : cut + 1]
        at = cut + 1
    yield at, blob[at:]


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (uint64) and the byte at which it starts (int64)."""
    hashes, starts = [], []
    for offset, piece in _pieces(blob):
        a = np.frombuffer(piece.lower(), np.uint8)
        solid = np.zeros(len(a) + 2, np.int8)
        solid[1:-1] = ~_SPACE[a]
        step = np.diff(solid)
        first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if not len(first):
            continue
        power, inverse = _power_tables(len(a))
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=total[1:])
        h = (total[last] - total[first]) * inverse[first]
        hashes.append(mix(h + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        starts.append(first + offset)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def blocks(texts: Iterable[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as UTF-8 in blocks of about ``limit`` bytes, with the first one's index."""
    block: list[bytes] = []
    first = size = 0
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if block and size + len(data) > limit:
            yield first, block
            block, first, size = [], k, 0
        block.append(data)
        size += len(data) + 1
    if block:
        yield first, block


def block_words(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block's texts in order; text k has those from bounds[k] to bounds[k + 1]."""
    hashes, starts = word_hashes(b"\n".join(block))
    ends = np.cumsum([len(x) + 1 for x in block])
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


_C = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(64)]


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; of the whole sequence if it is shorter (none if empty)."""
    n = len(h)
    k = min(n, width)
    if not k:
        return np.empty(0, np.uint64)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += h[j : n - k + 1 + j] * _C[j]
    return mix(out + np.uint64(k))
