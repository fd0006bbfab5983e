"""Elias-Fano sequences in memory-mapped files, with vectorised successor search.

A strictly increasing sequence of n values is cut into low bits, packed, and high
bits, as a bit vector in which value i sets bit ``(value >> low) + i``. A count of
zeros before each word makes the start of a high part findable; a binary search of
the low bits of the values with that high part gives the successor.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np

_HEAD = 16  # numbers in a file's head: lengths of its parts


def write_parts(uri: str, parts: list[np.ndarray]) -> None:
    """One file: a head, then each array at a multiple of 8 bytes. Written aside and renamed, so a retried task replaces it."""
    head = np.zeros(_HEAD, np.int64)
    head[0] = len(parts)
    head[1 : 1 + len(parts)] = [p.nbytes for p in parts]
    data = [head.tobytes(), *(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)]
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        aside = f"{path}.{uuid.uuid4().hex}"
        with open(aside, "wb") as f:
            f.writelines(data)
        os.replace(aside, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    aside = f"{path}.{uuid.uuid4().hex}"
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(aside) as f:
        for d in data:
            f.write(d)
    store.move(aside, path)


def open_parts(uri: str, kinds: list[type]) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory. A file of a remote store is mapped from an unlinked copy."""
    path = _local(uri)
    if path is not None:
        raw = np.memmap(path, np.uint8, "r").view(np.ndarray)  # plain arrays are sliced faster
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with tempfile.TemporaryFile() as copy, store.open_input_stream(path) as f:
            while chunk := f.read(1 << 22):
                copy.write(chunk)
            copy.flush()
            raw = np.memmap(copy, np.uint8, "r").view(np.ndarray)
    head = raw[: _HEAD * 8].view(np.int64)
    out, at = [], _HEAD * 8
    for k, kind in enumerate(kinds):
        size = int(head[1 + k])
        out.append(raw[at : at + size].view(kind))
        at += size + -size % 8
    return out


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def encode(x: np.ndarray) -> list[np.ndarray]:
    """meta (n, low bits), packed low bits, high bits, zeros before each word of the high bits."""
    n = len(x)
    low = max(0, int(x[-1] // np.uint64(n)).bit_length() - 1) if n else 0
    rows = -(-n // 64)
    padded = np.zeros((rows, 64), np.uint64)
    padded.reshape(-1)[:n] = x & np.uint64((1 << low) - 1)
    packed = np.zeros((rows, low + 1), np.uint64)  # 64 values fill ``low`` words
    for j in range(64 if low else 0):
        word, bit = divmod(j * low, 64)
        packed[:, word] |= padded[:, j] << np.uint64(bit)
        if bit + low > 64:
            packed[:, word + 1] |= padded[:, j] >> np.uint64(64 - bit)
    packed = np.concatenate([packed[:, :low].reshape(-1), np.zeros(2, np.uint64)])
    at = (x >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = (int(at[-1]) if n else 0) + 2
    bits = np.zeros(-(-size // 64) * 64 + 128, np.uint8)
    bits[at] = 1
    high = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = np.bitwise_count(high).astype(np.int64)
    zeros = np.arange(len(high), dtype=np.int64) * 64 - (np.cumsum(ones) - ones)
    return [np.array([n, low], np.int64), packed, high, zeros]


def _places() -> np.ndarray:
    """By byte and rank: the place of the set bit of that rank."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.argsort(1 - bits, axis=1, kind="stable").astype(np.int64)


_IN_BYTE = _places()


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``rank`` in each word."""
    at = np.zeros(len(word), np.uint64)
    for width in (32, 16, 8):
        below = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        over = rank >= below
        rank = rank - below * over
        step = over * np.uint64(width)
        word = word >> step
        at += step
    return at.astype(np.int64) + _IN_BYTE[(word & np.uint64(255)).astype(np.int64), rank]


class Sequence:
    def __init__(self, meta: np.ndarray, packed: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low = int(meta[0]), int(meta[1])
        self.packed, self.high, self.zeros = packed, high, zeros
        self.highest = len(high) * 64 - self.n - 130  # a high part beyond this is beyond the last value

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + _select(~self.high[word], k - self.zeros[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i * self.low
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        spill = np.where(bit > 0, self.packed[word + 1] << (np.uint64(64) - np.maximum(bit, np.uint64(1))), np.uint64(0))
        return (self.packed[word] >> bit | spill) & np.uint64((1 << self.low) - 1)

    def successor(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value that is not less than each y (n if none), and whether it is equal."""
        if not self.n:
            return np.zeros(len(y), np.int64), np.zeros(len(y), bool)
        high = (y >> np.uint64(self.low)).astype(np.int64)
        beyond = high > self.highest + 64
        high = np.where(beyond, 0, high)
        begin = np.where(high > 0, self._select_zero(np.maximum(high - 1, 0)) + 1, 0)
        lo = begin - high
        word, bit = begin >> 6, (begin & 63).astype(np.uint64)
        window = self.high[word] >> bit
        nxt = self.high[np.minimum(word + 1, len(self.high) - 1)]
        window |= np.where(bit > 0, nxt << (np.uint64(64) - np.maximum(bit, np.uint64(1))), np.uint64(0))
        gap = ~window
        run = np.bitwise_count((gap & (~gap + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        far = np.flatnonzero(run >= 64)
        if len(far):
            run[far] = self._select_zero(high[far]) - begin[far]
        hi = np.minimum(lo + run, self.n)
        lo = np.minimum(lo, self.n)
        equal = np.zeros(len(y), bool)
        # binary search of the low bits; a value that is there is met on the way
        active = np.flatnonzero(lo < hi)
        begin, end, want = lo[active], hi[active], y[active] & np.uint64((1 << self.low) - 1)
        while len(active):
            middle = (begin + end) >> 1
            value = self._low(middle)
            less, same = value < want, value == want
            begin = np.where(less, middle + 1, begin)
            end = np.where(less, end, middle)
            done = same | (begin >= end)
            at = active[done]
            lo[at] = np.where(same[done], middle[done], begin[done])
            equal[at] = same[done]
            going = np.flatnonzero(~done)
            active, begin, end, want = active[going], begin[going], end[going], want[going]
        lo[beyond], equal[beyond] = self.n, False
        return lo, equal
