"""Scoring by an n-gram language model in an Elias-Fano trie.

Level 1 is the vocabulary: word hashes in order, a word's number being its place.
Level k holds n-grams of k words as one increasing sequence of
``context * width + successor``: the context is the number of the first k - 1
words in level k - 1, the successor is relative to that context's last k - 2 words:
the place of the last word among what follows them (at level 2, the word's number).
A query finds a context's range and the successor in it by one successor search, and
the n-gram's number is the context of the next level.

Probabilities are interpolated by absolute discounting: each n-gram stores its
discounted share of the context, each context the weight left to the shorter one,
both in 16 bits on a logarithmic scale; level 1 is the add-0.1 estimate.

Each level is counted from all training texts: tasks count n-grams of a few million
tokens at a time and send them, packed, to shards of the level by context; shards
sum, encode and write memory-mapped files in the shared folder. Tasks that score map
the shards and look up the sorted distinct n-grams of about a million tokens at once.
Only shard sizes reach the driver.

A level keeps no pointer sequence of its own: since the context is the high part of
every key, the keys' Elias-Fano code answers where a context's successors begin.

Null or empty text is the end token alone. No training rows: every word is unknown.
Repeated rows are counted and scored as often as they occur. Null doc_id counts as
the empty text in the split. An empty table gives no rows. A very long text is scored
whole, in one block. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .elias_fano import Sequence, encode, open_parts, write_parts
from .words import block_words, blocks

END = np.uint64(0x5E17E0D0C5E17E0D)
DISCOUNT, ADD = 0.75, 0.1
#: Tokens that a task looks up at once, in bytes of text; n-grams that it counts before it sends them; shard size.
TEXT_BLOCK, FLUSH, SHARD = 8 << 20, 3_000_000, 2_000_000
_STEP, _LEAST = 30.0 / 65534, -30.0
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def quantise(p: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 to 65535 on a logarithmic scale from e**-30 to 1."""
    with np.errstate(divide="ignore"):
        code = np.rint((np.log(p) - _LEAST) / _STEP) + 1
    return np.where(p > 0, np.clip(code, 1, 65535), 0).astype(np.uint16)


_VALUES = np.concatenate([[0.0], np.exp(_LEAST + np.arange(65535) * _STEP)])


class Level(NamedTuple):
    """n: n-grams; contexts: of them; width: of a context's key range; firsts: number of each shard's first n-gram."""

    uri: str
    n: int
    contexts: int
    width: int
    firsts: np.ndarray


class Model(NamedTuple):
    levels: list[Level]
    tokens: int
    vocabulary: int


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts: differences by byte plane, compressed."""
    delta = np.diff(keys, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T), np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)]
    return pa.Codec("zstd", 1).compress(b"".join(p.tobytes() for p in planes), asbytes=True)


def unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, n * 16, asbytes=True), np.uint8)
    return (np.cumsum(np.ascontiguousarray(p.reshape(8, n).T).view(np.uint64).reshape(-1), dtype=np.uint64) if k == 0 else np.ascontiguousarray(p.reshape(8, n).T).view(np.uint64).reshape(-1) for k, p in enumerate((raw[: n * 8], raw[n * 8 :])))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def token_blocks(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, hashes with an end after each text, and the texts' bounds."""
    for first, block in blocks(texts, TEXT_BLOCK):
        h, bounds = block_words(block)
        yield first, np.insert(h, bounds[1:], END), bounds + np.arange(len(bounds))


_open: dict[str, list] = {}


def _shard(level: Level, k: int, probabilities: bool) -> list:
    """Mapped files of a shard: sequence, then counts (level 1) or shares and weights."""
    uri = f"{level.uri}/{k:06d}"
    if uri not in _open:
        kinds = [np.int64, np.uint64, np.uint64, np.int64, *([np.uint16, np.uint16] if probabilities else [np.int64])]
        parts = open_parts(uri, kinds)
        _open[uri] = [Sequence(*parts[:4]), *parts[4:]]
    return _open[uri]


def _fresh_model(uri: str) -> None:
    """Keeps the mapped files of one model only."""
    for old in [x for x in _open if not x.startswith(uri.rsplit("/", 1)[0])]:
        del _open[old]


def _routes(level: Level, shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal shard in a sorted array."""
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if len(level.firsts) and level.firsts[int(shard[a]) + 1] > level.firsts[int(shard[a])]:
            yield int(shard[a]), slice(int(a), int(b))


def find_words(level: Level, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (-1 if unknown) and counts of word hashes."""
    distinct, back = np.unique(h, return_inverse=True)
    number, count = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
    shards = len(level.firsts) - 1
    for k, at in _routes(level, shard_of_hash(distinct, shards)):
        words, counts = _shard(level, k, False)
        i, known = words.successor(distinct[at])
        number[at] = np.where(known, i + level.firsts[k], -1)
        count[at] = np.where(known, counts[np.minimum(i, words.n - 1)], 0)
    return number[back], count[back]


def shard_of_hash(h: np.ndarray, shards: int) -> np.ndarray:
    """shards is a power of two of at least 2."""
    return (h >> np.uint64(64 - (shards.bit_length() - 1))).astype(np.int64)


def shard_of_context(context: np.ndarray, level: Level) -> np.ndarray:
    """By ranges of contexts, of equal length."""
    return context // _per_shard(level.contexts, len(level.firsts) - 1)


def _per_shard(contexts: int, shards: int) -> int:
    return max(1, -(-contexts // shards))


def find_grams(level: Level, context: np.ndarray, successor: np.ndarray, firsts: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sorted contexts (with their successors): number (-1 if unknown) of the n-gram, number of the context's
    first n-gram (if ``firsts``), the n-gram's share and the context's weight for the shorter one (1 if it has no successors)."""
    n = len(context)
    number, first = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    share, weight = np.zeros(n), np.ones(n)
    per = _per_shard(level.contexts, len(level.firsts) - 1)
    for k, at in _routes(level, shard_of_context(context, level)):
        keys, shares, weights = _shard(level, k, True)
        c = (context[at] - k * per).astype(np.uint64)
        if firsts:
            new = np.concatenate([[True], c[1:] != c[:-1]])
            begin, _ = keys.successor(c[new] * np.uint64(level.width))
            first[at] = begin[np.cumsum(new) - 1] + level.firsts[k]
        code = weights[c.astype(np.int64)]
        weight[at] = np.where(code > 0, _VALUES[code], 1.0)
        s = successor[at]
        i, known = keys.successor(c * np.uint64(level.width) + np.maximum(s, 0).astype(np.uint64))
        known &= s >= 0
        number[at] = np.where(known, i + level.firsts[k], -1)
        share[at] = np.where(known, _VALUES[shares[np.minimum(i, keys.n - 1)]], 0.0)
    return number, first, share, weight


class Walk:
    """The n-grams that end at each token of a block, level by level."""

    def __init__(self, model: Model, h: np.ndarray, bounds: np.ndarray):
        self.model = model
        self.word, self.count = find_words(model.levels[0], h)
        self.place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))  # of a token in its text
        self.number, self.relative, self.k = self.word, self.word, 1  # of the k-gram that ends here

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens with a known context for the next level, the contexts and the relative successors (-1: unknown)."""
        at = np.flatnonzero(self.place >= self.k)
        at = at[self.number[at - 1] >= 0]
        return at, self.number[at - 1], self.relative[at]

    def step(self, level: Level, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Looks the next level up: tokens, shares and weights. After the ``last`` level there is no further step."""
        at, context, successor = self.keys()
        joint = context * np.int64(level.width + 1) + successor + 1
        order = np.argsort(joint)  # equal ones are alike
        new = np.concatenate([[True], np.diff(joint[order]) > 0]) if len(order) else np.zeros(0, bool)
        pick = order[new]
        number, first, share, weight = find_grams(level, context[pick], successor[pick], not last)
        each, at = np.cumsum(new) - 1, at[order]
        if last:
            return at, share[each], weight[each]
        self.k += 1
        self.number, self.relative = np.full(len(self.word), -1, np.int64), np.full(len(self.word), -1, np.int64)
        self.number[at] = number[each]
        self.relative[at] = np.where(number >= 0, number - first, -1)[each]
        return at, share[each], weight[each]


def _count_level(docs: DataFrame, model: Model, contexts: int, width: int, shards: int) -> DataFrame:
    """(shard, n, packed): n-grams of the level after the model's last one, counted by task and sent to their shards."""
    order, per = len(model.levels) + 1, _per_shard(contexts, shards)

    def run(batches):
        held: list[np.ndarray] = []
        size = 0
        if model.levels:
            _fresh_model(model.levels[0].uri)

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            shard = shard_of_hash(keys, shards) if order == 1 else (keys // np.uint64(width)).astype(np.int64) // per
            edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                row = [[int(shard[a])], [int(b - a)], [pack(keys[a:b], counts[a:b])]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), pa.array(row[2], pa.binary())], ["shard", "n", "packed"])

        for batch in batches:
            for _, h, bounds in token_blocks(batch.column(0).to_pylist()):
                if order == 1:
                    held.append(h)
                else:
                    walk = Walk(model, h, bounds)
                    for level in model.levels[1:]:
                        walk.step(level)
                    at, context, successor = walk.keys()
                    held.append(context.astype(np.uint64) * np.uint64(width) + successor.astype(np.uint64))
                size += len(held[-1])
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.select("text").mapInArrow(run, "shard int, n int, packed binary")


def _write_level(counted: DataFrame, uri: str, order: int, contexts: int, width: int, shards: int) -> DataFrame:
    """Sums and writes each shard; (shard, n, total, widest): n-grams, tokens, and most successors of one context."""
    per = _per_shard(contexts, shards)

    def write(shard: int, parts: list[tuple[bytes, int]]) -> tuple[int, int, int, int]:
        both = [tuple(unpack(*p)) for p in parts]
        keys, counts = summed(np.concatenate([k for k, _ in both]), np.concatenate([c for _, c in both]).astype(np.int64))
        widest = 0
        if order == 1:
            rest = [counts]
        else:
            context = (keys // np.uint64(width)).astype(np.int64) - shard * per
            total = np.bincount(context, counts, minlength=per)
            successors = np.bincount(context, minlength=per)
            rest = [quantise((counts - DISCOUNT) / total[context]), quantise(DISCOUNT * successors / np.maximum(total, 1))]
            keys, widest = keys - np.uint64(shard * per) * np.uint64(width), int(successors.max())
        write_parts(f"{uri}/{shard:06d}", [*encode(keys), *rest])
        return shard, len(keys), int(counts.sum()), widest

    def run(batches):
        shard, parts = None, []
        for batch in batches:
            for k, n, packed in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if k != shard and parts:
                    yield _row(write(shard, parts))
                    parts = []
                shard = k
                parts.append((packed, n))
        if parts:
            yield _row(write(shard, parts))

    def _row(r):
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in r], ["shard", "n", "total", "widest"])

    return counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard long, n long, total long, widest long")


def train(docs: DataFrame, order: int = 3) -> Model:
    """Model of all rows' texts, in files in the shared folder."""
    spark = docs.sparkSession
    root = scratch.fresh(spark, "language-model")
    root = root if "://" in root or root.startswith(("file:", "/")) else f"/{root}"
    levels: list[Level] = []
    tokens = vocabulary = 0
    contexts, width = 1, 1
    # a first guess of the size: characters of text, of which a token has about six
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    for k in range(1, order + 1):
        shards = 1 << max(1, (max(chars // 6, tokens) // SHARD).bit_length())
        if contexts * width >= 1 << 62:
            raise ValueError("n-grams of this order have no 63-bit keys; use a lower order")
        counted = _count_level(docs, Model(levels, tokens, vocabulary), contexts, width, shards)
        sizes = _write_level(counted, f"{root}/{k}", k, contexts, width, shards).toPandas()
        n = np.zeros(shards, np.int64)
        n[sizes["shard"].to_numpy()] = sizes["n"].to_numpy()
        levels.append(Level(f"{root}/{k}", int(n.sum()), contexts, width, np.concatenate([[0], np.cumsum(n)])))
        if k == 1:
            tokens, vocabulary = int(sizes["total"].sum()), int(n.sum())
            width = vocabulary
        else:
            width = int(sizes["widest"].max()) if len(sizes) else 0
        contexts = levels[-1].n
        if not contexts or not width:
            break
    return Model(levels, tokens, vocabulary)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Counts, add-0.1 unigram log10 score and model log10 score of each text; docs: doc_id, text, held_out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names and sizes of shards

    def run(batches):
        m = shared.value
        _fresh_model(m.levels[0].uri)
        for batch in batches:
            made = []
            for _, h, bounds in token_blocks(batch.column(1).to_pylist()):
                walk = Walk(m, h, bounds)
                base = np.log10((walk.count + ADD) / (m.tokens + ADD * (m.vocabulary + 1)))
                p = (walk.count + ADD) / (m.tokens + ADD * (m.vocabulary + 1))
                for level in m.levels[1:]:
                    if level.n:
                        at, share, weight = walk.step(level, level is m.levels[-1])
                        p[at] = share + weight * p[at]
                start = bounds[:-1]
                made.append((np.diff(bounds), np.add.reduceat(walk.count > 0, start, dtype=np.int64), np.add.reduceat(base, start), np.add.reduceat(np.log10(p), start)))
            cols = [np.concatenate(c) for c in zip(*made, strict=True)] if made else [np.empty(0, np.int64)] * 2 + [np.empty(0)] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(cols[0].astype(np.int64)), pa.array(cols[1]), pa.array(np.full(len(cols[0]), m.tokens)), pa.array(cols[2]), pa.array(cols[3])],
                [c.split(" ")[0] for c in SCHEMA.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(run, SCHEMA)


def held_out(modulus: int = 10):
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == 0).alias("held_out")


def train_and_score(docs: DataFrame, order: int = 3, modulus: int = 10) -> DataFrame:
    """Learns from rows that are not held out and scores all."""
    rows = docs.select("doc_id", "text", held_out(modulus))
    return score(rows, train(rows.where("not held_out"), order))
