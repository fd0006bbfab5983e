"""Benchmark decontamination by spaced-seed hashing.

A run is a stretch of the training text laid over one of an item of equal length, in
which at least 80 % of the tokens agree. An item leaks when any run has ``min_tokens``
equal tokens, or 80 % of the item if that is less; the run with the most equal tokens
is given.

Seeds are tokens under fixed masks: of five tokens in a row, or of six in a row of
which a mask ignores one inner token. Wherever a run makes a leak, six tokens in a row
have at most one difference: were there two in every six, more than a fifth would
differ. So one of the five masks hits each leak. Short items, for which that does not
hold, take the most tokens for which every way to differ is hit (``seed_weight``).
Hashes of masked training tokens are joined with those of the items; on each hit's
diagonal the agreeing tokens are counted, and where they could suffice the longest run
is taken from prefix sums. Hits are expanded, verified and dropped in bounded pieces.

A seed that more than ``HELD`` places of items share, of a question's fixed wording say,
is left out for the items that do not need it: those of which every leak has a hit by another
seed too, whatever differs (``hidden`` tries every way). What is left of shared seeds belongs to
items that share almost a leak; where all of a seed's items are met one place before, or at the same
place under the first mask, it is not looked up again.

The benchmark is hashed in tasks and comes in blocks of a bounded number of tokens,
each broadcast to one pass over the whole training table; nothing is shuffled, so a
passage that is in every document costs no more than its hits.

Tokens are runs outside white space, A-Z in lower case. Null or empty texts are
clean, null or empty items are skipped, an empty benchmark finds nothing; an empty
table gives no rows. Repeated rows, and several items in one document, each get their
row; of equal runs the first is given. A null doc_id stays null. A very long text is
searched whole by one task. ``drop_leaks`` hands all columns on, whatever their names;
``find_leaks`` ignores extra ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import block_words, blocks, mix

#: Tokens of a seed. Six in a row could hold two differences in each.
WEIGHT = 5
BLOCK_TOKENS = 500_000
FILTER_BITS = 22
VERIFY_TOKENS = 1 << 20
#: Places of items that may share a seed before it counts as shared.
HELD = 16
SCHEMA = "doc_id long, item_id long, matched_tokens long, run_tokens long, item_tokens long, start_token long, end_token long"
_C = [np.uint64(pow(0x9FB21C651E98DF25, k + 1, 1 << 64)) for k in range(WEIGHT)]


def masks(weight: int) -> list[tuple[int, ...]]:
    """Places that count: ``weight`` in a row, or one more in a row less an inner one."""
    return [tuple(range(weight)), *(tuple(k for k in range(weight + 1) if k != gap) for gap in range(1, weight))]


class Index(NamedTuple):
    """Seeds of a block of items: for each weight, sorted hashes with their items and places; then what all items of a
    hash have one place before under the same mask, and at the same place under the first mask (0 if it is not one hash)."""

    ids: list
    tokens: list[np.ndarray]
    need: np.ndarray
    weights: list[int]
    seeds: list[tuple[np.ndarray, ...]]
    filters: list[np.ndarray]


def needed(n: int, min_tokens: int) -> int:
    """Equal tokens that make a leak of an item of ``n`` tokens."""
    return max(1, min(min_tokens, -(-4 * n // 5)))


@cache
def seed_weight(n: int, need: int) -> int:
    """The most tokens, up to ``WEIGHT``, of seeds that hit every run of an item of ``n`` tokens with ``need`` equal ones."""
    if need >= 12:
        return WEIGHT

    def hit(length: int, differ: set[int], weight: int) -> bool:
        return any(not any(at + k in differ for k in mask) for mask in masks(weight) for at in range(length - mask[-1]))

    runs = [(length, set(x)) for length in range(need, n + 1) for e in range(min(length - need, length // 5) + 1) for x in combinations(range(length), e)]
    return next((w for w in range(WEIGHT, 1, -1) if all(hit(length, x, w) for length, x in runs)), 1)


@cache
def subsets(length: int, e: int) -> np.ndarray:
    """Every way to choose ``e`` of ``length`` places, as bits."""
    if not e:
        return np.zeros(1, np.int64)
    return np.concatenate([subsets(k, e - 1) | np.int64(1 << k) for k in range(e - 1, length)] or [np.empty(0, np.int64)])


@cache
def covers(length: int, need: int, weight: int) -> np.ndarray:
    """The sets of places that the hits of a leak's run cover, as bits, for every way to differ in a run of that length."""
    out = []
    for e in range(min(length - need, length // 5) + 1):
        equal = subsets(length, e) ^ np.int64((1 << length) - 1)
        covered = np.zeros(len(equal), np.int64)
        for mask in masks(weight):
            hit = np.full(len(equal), -1, np.int64)
            for k in mask:
                hit &= equal >> np.int64(k)
            for k in mask:
                covered |= hit << np.int64(k)
        out.append(np.unique(covered))
    return np.unique(np.concatenate(out))


@cache
def hidden(spots: int, room: int, need: int, weight: int) -> bool:
    """Whether there is a leak's run from the first place on, within ``room`` places, all of whose hits are within ``spots`` (bits).

    Runs are tried up to twice the tokens that make a leak by themselves, less one: of a longer run, one half agrees as well
    and is long enough. More than 13 equal tokens hold 13.
    """
    need = min(need, 13)
    lengths = range(need, min(room, 2 * (5 * (need - 1) // 4) + 1) + 1)
    return any(bool(((covers(n, need, weight) & ~np.int64(spots)) == 0).any()) for n in lengths)


def needless(h: np.ndarray, item: np.ndarray, place: np.ndarray, mask: np.ndarray, items: list[tuple[int, np.ndarray]], need: list[int], weight: int) -> np.ndarray:
    """Which seeds (hash, item, place, number of the mask) are shared and belong to items of which every leak has another hit too."""
    _, at, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times[at] > HELD
    if not shared.any():
        return shared
    spots: dict[int, int] = {}
    for k, p, m in zip(item[shared].tolist(), place[shared].tolist(), mask[shared].tolist(), strict=True):
        spots[k] = spots.get(k, 0) | sum(1 << p + o for o in masks(weight)[m])
    free = np.zeros(len(items), bool)
    for k, bits in spots.items():
        n = len(items[k][1])
        free[k] = not any(hidden(bits >> first & 0x7FFFFFFF, min(n - first, 31), need[k], weight) for first in range(n - need[k] + 1))
    return shared & free[item]


def seed_hashes(h: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Hash of the tokens under a mask at each place where it fits; masks are told apart by their number."""
    n = len(h) - mask[-1]
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, number, np.uint64)
    for k, c in zip(mask, _C, strict=False):
        out += h[k : k + n] * c
    return mix(out)


def _in_common(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Values by group (which begins at each ``first``), 0 where a group has several."""
    if not len(x):
        return x
    one = np.minimum.reduceat(x, first) == np.maximum.reduceat(x, first)
    return np.where(np.repeat(one, np.diff(np.append(first, len(x)))), x, np.uint64(0))


def build_index(items: list[tuple[int, np.ndarray]], min_tokens: int = 13) -> Index:
    need = [needed(len(t), min_tokens) for _, t in items]
    weight_of = [seed_weight(len(t), m) for (_, t), m in zip(items, need, strict=True)]
    weights, seeds, filters = sorted(set(weight_of)), [], []
    for weight in weights:
        own = [(k, number, seed_hashes(t, mask, number)) for k, (_, t) in enumerate(items) if weight_of[k] == weight for number, mask in enumerate(masks(weight))]
        h = np.concatenate([x for *_, x in own])
        item, mask = (np.repeat([o[c] for o in own], [len(x) for *_, x in own]).astype(np.int64) for c in (0, 1))
        place = np.concatenate([np.arange(len(x)) for *_, x in own])
        kept = ~needless(h, item, place, mask, items, need, weight)
        h, item, place, mask = h[kept], item[kept], place[kept], mask[kept]
        before, beside = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
        follows = (item[1:] == item[:-1]) & (mask[1:] == mask[:-1]) & (place[1:] == place[:-1] + 1)
        before[1:][follows] = h[:-1][follows]
        plain = np.flatnonzero(mask == 0)
        spot = item * (1 + int(place.max(initial=0))) + place
        found = np.minimum(np.searchsorted(spot[plain], spot), max(0, len(plain) - 1)) if len(plain) else np.empty(0, np.int64)
        if len(plain):
            there = (spot[plain][found] == spot) & (mask > 0)
            beside[there] = h[plain][found][there]
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        seeds.append((h, item[order], place[order], *(_in_common(x[order], first) for x in (before, beside))))
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        filters.append(bits)
    return Index([i for i, _ in items], [t for _, t in items], np.array(need, np.int64), weights, seeds, filters)


def longest_run(equal: np.ndarray) -> tuple[int, int, int]:
    """(equal tokens, start, end) of the run with the most equal tokens, of which at least 80 % agree; of several, the shortest, then the first."""
    same = np.concatenate([[0], np.cumsum(equal)])
    total = 5 * same - 4 * np.arange(len(same))  # a run agrees enough if its sum of +1 and -4 is not negative
    least = np.minimum.accumulate(total)
    start = np.searchsorted(-least, -total)  # the first place from which the sum to here is not negative
    matched = same - same[start]
    most = int(matched.max())
    if not most:
        return 0, 0, 0
    places = np.flatnonzero(equal)
    ends = np.flatnonzero(matched == most)
    first, last = places[same[start[ends]]], places[same[ends] - 1] + 1  # without differing tokens at either side
    k = int((last - first).argmin())
    return most, int(first[k]), int(last[k])


def agreeing(h: np.ndarray, begin: np.ndarray, end: np.ndarray, diagonal: np.ndarray, item: np.ndarray, index: Index) -> np.ndarray:
    """Equal tokens on each diagonal from ``begin`` to ``end``."""
    flat = np.concatenate(index.tokens)
    size = np.array([len(t) for t in index.tokens])
    start = (np.cumsum(size) - size)[item]
    out = np.zeros(len(begin), np.int64)
    whole = end - begin == size[item]
    for n in np.unique(size[item[whole]]).tolist():  # items that are within their text, by length
        own = np.flatnonzero(whole & (size[item] == n))
        text, items = sliding_window_view(h, n), sliding_window_view(flat, n)
        for k in range(0, len(own), max(1, VERIFY_TOKENS // n)):
            part = own[k : k + max(1, VERIFY_TOKENS // n)]
            out[part] = np.count_nonzero(text[begin[part]] == items[start[part]], axis=1)
    cut = np.flatnonzero(~whole)
    n = (end - begin)[cut]
    piece = (np.cumsum(n) - n) // VERIFY_TOKENS
    for p in np.unique(piece):
        own, m = cut[piece == p], n[piece == p]
        at = np.repeat(begin[own] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        same = h[at] == flat[at + np.repeat(start[own] - diagonal[own], m)]
        out[own] = np.add.reduceat(same, np.cumsum(m) - m, dtype=np.int64)
    return out


def hits(h: np.ndarray, bounds: np.ndarray, index: Index) -> Iterator[np.ndarray]:
    """(text, item, diagonal) of windows that share a seed with an item, in pieces of about ``VERIFY_TOKENS`` hits."""
    for weight, (seeds, item, place, before, beside), bits in zip(index.weights, index.seeds, index.filters, strict=True):
        plain = seed_hashes(h, masks(weight)[0], 0)
        for number, mask in enumerate(masks(weight)):
            s = seed_hashes(h, mask, number)
            at = np.flatnonzero(bits[(s >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(seeds, s[at]), np.searchsorted(seeds, s[at], "right")
            text = np.searchsorted(bounds, at, "right") - 1
            real = (hi > lo) & (at + mask[-1] < bounds[text + 1])  # a window within one text
            # not where all of the seed's items are met one place before, or here by the first mask
            followed, same = np.append(before, np.uint64(0))[lo], np.append(beside, np.uint64(0))[lo]
            real &= ~((followed != 0) & (at > bounds[text]) & (s[np.maximum(at - 1, 0)] == followed))
            real &= ~((same != 0) & (plain[np.minimum(at, len(plain) - 1)] == same))
            at, lo, n, text = at[real], lo[real], (hi - lo)[real], text[real]
            piece = np.cumsum(n) // VERIFY_TOKENS
            for p in np.unique(piece):
                own = piece == p
                m = n[own]
                hit = np.repeat(lo[own], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                yield np.stack([np.repeat(text[own], m), item[hit], np.repeat(at[own], m) - place[hit]])


def leaks(h: np.ndarray, bounds: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(text, item, equal tokens, run, item's tokens, start, end) for the texts with words h[bounds[k]:bounds[k + 1]]."""
    size = np.array([len(t) for t in index.tokens])
    # a text, an item and a diagonal as one number; a diagonal begins no earlier than an item's length before its text
    wide = int(np.diff(bounds).max(initial=0)) + int(size.max()) + 1
    numbers = len(bounds) * len(size) * wide
    if numbers >= 1 << 63:
        raise OverflowError("a block of texts and items that is too large to number")
    best: dict[tuple[int, int], tuple] = {}
    for text, item, diagonal in hits(h, bounds, index):
        key = np.unique((text * len(size) + item) * wide + (diagonal - bounds[text] + size.max()))
        (text, item), diagonal = np.divmod(key // wide, len(size)), key % wide - size.max()
        diagonal += bounds[text]
        begin, end = np.maximum(diagonal, bounds[text]), np.minimum(diagonal + size[item], bounds[text + 1])
        enough = agreeing(h, begin, end, diagonal, item, index) >= index.need[item]
        for t, k, d, x, y in zip(*(c[enough].tolist() for c in (text, item, diagonal, begin, end)), strict=True):
            tokens = index.tokens[k]
            matched, a, b = longest_run(h[x:y] == tokens[x - d : y - d])
            first = x + a - int(bounds[t])
            # of equal runs the first, in whatever piece it is
            if matched >= index.need[k] and (-matched, d) < best.get((t, k), ((0, 0),))[0]:
                best[t, k] = ((-matched, d), matched, b - a, len(tokens), first, first + b - a)
    for (t, k), (_, *rest) in sorted(best.items()):
        yield t, index.ids[k], *rest


def benchmark_blocks(benchmark: DataFrame, min_tokens: int, block_tokens: int = BLOCK_TOKENS) -> Iterator[Index]:
    """The benchmark's items in bounded blocks, hashed in tasks, read one after the other."""

    def run(batches):
        for batch in batches:
            packed = []
            for _, block in blocks(batch.column(1).to_pylist()):
                h, bounds = block_words(block)
                packed += [h[bounds[k] : bounds[k + 1]].tobytes() for k in range(len(block))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["item_id", "tokens"])

    held, size = [], 0
    for row in benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, tokens binary").toLocalIterator():
        h = np.frombuffer(bytes(row[1]), np.uint64)
        if not len(h):
            continue
        held.append((row[0], h))
        size += len(h)
        if size >= block_tokens:
            yield build_index(held, min_tokens)
            held, size = [], 0
    if held:
        yield build_index(held, min_tokens)


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_tokens: int = 13, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each document and benchmark item that leaks into it, with the longest run."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for index in benchmark_blocks(benchmark, min_tokens, block_tokens):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                made = []
                for first, block in blocks(batch.column(1).to_pylist()):
                    h, bounds = block_words(block)
                    made += [(first + t, *rest) for t, *rest in leaks(h, bounds, shared.value)]
                ids = batch.column(0).take(pa.array([m[0] for m in made], pa.int64()))
                cols = list(zip(*made, strict=True))[1:] if made else [[]] * 6
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols)], [c.split(" ")[0] for c in SCHEMA.split(", ")])

        part = rows.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_tokens: int = 13, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` without the rows into which any item leaks; one pass for each block of the benchmark, without a shuffle."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for index in benchmark_blocks(benchmark, min_tokens, block_tokens):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, block in blocks(batch.column(at).to_pylist()):
                    h, bounds = block_words(block)
                    for t, *_ in leaks(h, bounds, shared.value):
                        keep[first + t] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
