"""How two tokenizers cut the same texts, and which of their tokens go together, by cogrouped postings.

1. Texts are encoded in blocks of bounded size. Where tokens of A and of B end at one byte, a
   group ends and the two tokens that end there are linked. A block's links are counted at
   once: for each pair of ids one posting row, with the block's documents and how often each
   has the pair, packed in four bytes a document.
2. Posting rows give each pair's count over the corpus, and each B id's highest count. Both are
   as many as there are pairs of ids, not of documents.
3. Postings and counts are shuffled by B id and sorted by pair; counts come first, so one pass
   over a sorted stream that Spark spills holds one pair's count at a time. A B id with many
   posting rows is dealt out over as many shares of ``SHARE`` rows, by block, each with its
   own copy of the id's counts: what one task reads has a bound, whatever the id.
4. Contributions are summed by document in bounded buffers and leave a task packed by block,
   in fewer rows than it has read. They are shuffled by block, where one pass adds them up.

Encoding: no special tokens are added, and their strings inside texts are plain text. A gets
a space and the text, B the text (it adds the space itself). A's bytes are its vocabulary's;
B's are its pieces in UTF-8 with U+2581 as a space and ``<0xHH>`` as that byte.

Null or empty texts, and texts that B's or A's tokens do not spell, have no tokens: zeros and an
empty digest. Repeated rows each count and each get their row; a null doc_id stays null. Ties
for a B id's highest count are all best. An empty table gives no rows. A very long text is
encoded whole by one task, and is a block of its own; a document that has a pair more than
65,535 times has it in several entries. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import blocks

#: Bytes of texts and number of documents of a block.
BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 1 << 14
#: Documents of a posting row; a pair of more has several rows.
ENTRIES = 1024
#: Posting rows of one B id that one task may read together.
SHARE = 4096
#: Postings whose contributions are summed before they leave a task.
BUFFER = 1 << 21
_DOC = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTING = "a int, b int, block long, times long, postings binary"
_DIGITS = 6


class Vocabulary:
    """Encodes texts and knows each token's bytes."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)

    def spelled(self, text: bytes) -> np.ndarray | None:
        """Ids of a text's tokens if they spell a space and the text."""
        ids = self.encode(text)
        return np.array(ids, np.int64) if b"".join(map(self.tokens.__getitem__, ids)) == b" " + text else None


@cache
def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary file of JSON form, with a space put before each text."""
    from tokenizers import Tokenizer

    from .bpe_count import byte_symbols

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    size = tokenizer.get_vocab_size()
    special = {i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    names = [tokenizer.id_to_token(i) for i in range(size)]
    tokens = [n.encode() if i in special else bytes(byte_of[c] for c in n) for i, n in enumerate(names)]
    return Vocabulary(lambda text: tokenizer.encode(" " + text.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, tokens)


@cache
def byte_ranks(path: str, pattern: str) -> Vocabulary:
    """The same in the form of ranks, whose library is faster."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    return Vocabulary(lambda text: encoding.encode_ordinary(" " + text.decode("utf-8", "surrogatepass")), tokens)


@cache
def pieces(path: str) -> Vocabulary:
    """A file of pieces; the library puts the space before each text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x([0-9A-F]{2})>", n)) else n.replace("▁", " ").encode() for n in names]
    return Vocabulary(lambda text: model.encode(text.decode("utf-8", "surrogatepass"), num_threads=1), tokens)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id's decimal digits with room for a separator, and which places of them count."""
    table = np.zeros((n, _DIGITS + 1), np.uint8)
    ids = np.arange(n)
    for k in range(_DIGITS):
        table[:, _DIGITS - 1 - k] = 48 + ids // 10**k % 10
    width = np.maximum(1, np.searchsorted(10 ** np.arange(1, _DIGITS), ids, "right") + 1)
    shown = np.arange(_DIGITS + 1)[None, :] >= _DIGITS - width[:, None]
    return table, shown


def listed(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, digits: tuple[np.ndarray, np.ndarray]) -> bytes:
    """``a1,a2|b1;a3|b2,b3`` of tokens a and b, whose groups end at the places last_a and last_b."""
    in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    # a token's place: those of its own side before it, and those of the other side in groups that come before its own list
    at_a = np.arange(len(a)) + np.repeat(last_b + 1 - in_b, in_a)
    at_b = np.arange(len(b)) + np.repeat(last_a + 1, in_b)
    ids = np.empty(len(a) + len(b), np.int64)
    ids[at_a], ids[at_b] = a, b
    table, shown = digits
    out, shown = table[ids], shown[ids]
    out[:, _DIGITS] = 44  # ,
    out[at_a[last_a], _DIGITS] = 124  # |
    out[at_b[last_b], _DIGITS] = 59  # ;
    return out[shown].tobytes()[:-1]


def _posting_rows(pairs: np.ndarray, docs: np.ndarray, block: int, entries: int = ENTRIES) -> pa.RecordBatch:
    """Rows for each pair of a block's links (pair, document)."""
    key, times = np.unique(pairs << np.int64(16) | docs, return_counts=True)
    extra = (times - 1) // 0xFFFF  # entries that a document has besides its first
    if extra.any():
        parts = np.repeat(key, extra + 1), np.full(len(key) + extra.sum(), 0xFFFF, np.int64)
        parts[1][np.cumsum(extra + 1) - 1] = times - extra * 0xFFFF
        key, times = parts
    pair = key >> np.int64(16)
    new = np.diff(pair, prepend=-1) != 0
    starts = np.flatnonzero(new)
    place = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    first = np.flatnonzero(place % entries == 0)
    packed = (key & 0xFFFF | times << 16).astype(np.uint32)
    offsets = (np.append(first, len(key)) * 4).astype(np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    total = np.add.reduceat(times, first)
    return pa.RecordBatch.from_arrays(
        [pa.array((pair[first] & 0xFFFFFF).astype(np.int32)), pa.array((pair[first] >> 24).astype(np.int32)), pa.array(np.full(len(first), block)), pa.array(total.astype(np.int64)), lists], ["a", "b", "block", "times", "postings"]
    )


class _Block:
    """Documents and links that are gathered until there are enough of them."""

    def __init__(self, number: int):
        self.number, self.rows, self.pairs, self.docs = number, [], [], []

    def add(self, doc_id, text: bytes, left: Vocabulary, right: Vocabulary, digits) -> None:
        row = self.number << 16 | len(self.rows)
        a = left.spelled(text) if text else None
        b = right.spelled(text) if a is not None else None
        if b is None:
            self.rows.append((row, doc_id, 0, 0, 0, 0, ""))
            return
        end_a, end_b = np.cumsum(left.sizes[a]), np.cumsum(right.sizes[b])
        # of tokens without bytes, the ones that end where the last one did: every pair is a link, the last ones end the group
        ends, last_a = np.unique(end_a[::-1], return_index=True)
        other, last_b = np.unique(end_b[::-1], return_index=True)
        _, i, j = np.intersect1d(ends, other, assume_unique=True, return_indices=True)
        last_a, last_b = len(a) - 1 - last_a[i], len(b) - 1 - last_b[j]
        if len(ends) == len(a) and len(other) == len(b):
            link_a, link_b = a[last_a], b[last_b]
        else:
            both = [(x, y) for e in ends[i] for x in a[end_a == e] for y in b[end_b == e]]
            link_a, link_b = np.array(both, np.int64).reshape(-1, 2).T
        self.pairs.append(link_b << np.int64(24) | link_a)
        self.docs.append(np.full(len(link_a), len(self.rows), np.int64))
        self.rows.append((row, doc_id, len(a), len(b), len(last_a), len(link_a), hashlib.sha256(listed(a, b, last_a, last_b, digits)).hexdigest()))

    def batches(self, entries: int) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in _DOC.split(", ")]
        docs = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "groups_sha256" else pa.int64()) for n, c in zip(names, zip(*self.rows, strict=True), strict=True)], names)
        yield _widened(docs)
        if self.pairs:
            rows = _posting_rows(np.concatenate(self.pairs), np.concatenate(self.docs), self.number, entries)
            for at in range(0, rows.num_rows, 1 << 14):
                yield _widened(rows.slice(at, 1 << 14))


_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _widened(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with all columns of documents and postings, null where it has none."""
    fields = [c.split(" ") for c in f"{_DOC}, {_POSTING}".split(", ")]
    arrays = [batch.column(n) if n in batch.schema.names else pa.nulls(batch.num_rows, _TYPES[t]) for n, t in fields]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def encoded(docs: DataFrame, left, right) -> DataFrame:
    """Rows of documents (b is null) and posting rows; left and right make the vocabularies in each task."""

    most_bytes, most_docs, entries = BLOCK_BYTES, BLOCK_DOCS, ENTRIES

    def run(batches):
        a, b = left(), right()
        digits = _digits(max(len(a.tokens), len(b.tokens)))
        part = TaskContext.get().partitionId()
        number, size = 0, 0
        block = _Block(part << 24)
        for batch in batches:
            at = 0
            for _, texts in blocks(batch.column(1).to_pylist()):
                for text in texts:
                    if block.rows and (size + len(text) > most_bytes or len(block.rows) >= most_docs):
                        yield from block.batches(entries)
                        number, size = number + 1, 0
                        block = _Block(part << 24 | number)
                    block.add(batch.column(0)[at].as_py(), text, a, b, digits)
                    size += len(text)
                    at += 1
        if block.rows:
            yield from block.batches(entries)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"{_DOC}, {_POSTING}")


def unpacked(block: pa.Array, postings: pa.Array, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' rows and times of the postings of some rows, and how many each row has."""
    lists = postings.take(pa.array(own))
    offsets = np.frombuffer(lists.buffers()[1], np.int32)[: len(own) + 1] // 4
    packed = np.frombuffer(lists.buffers()[2], np.uint32)[offsets[0] : offsets[-1]]
    n = np.diff(offsets)
    return np.repeat(block.take(pa.array(own)).to_numpy() << 16, n) | (packed & 0xFFFF).astype(np.int64), (packed >> 16).astype(np.int64), n


def summed(parts: DataFrame) -> DataFrame:
    """row, n_best and count_sum of documents, of packed contributions (block, docs, best, total)."""

    def run(batches):
        block, best, total, held = None, None, None, None

        def out():
            own = np.flatnonzero(held)
            return pa.RecordBatch.from_arrays([pa.array(block << 16 | own), pa.array(best[own]), pa.array(total[own])], ["row", "n_best", "count_sum"])

        for batch in batches:
            for k, number in enumerate(batch.column(0).to_pylist()):
                if number != block:
                    if block is not None:
                        yield out()
                    block, best, total, held = number, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)
                docs, more_best, more = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((1, np.uint16), (2, np.int64), (3, np.int64)))
                held[docs] = True
                best[docs] += more_best
                total[docs] += more
        if block is not None:
            yield out()

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, "row long, n_best long, count_sum long")


def contributions(postings: DataFrame) -> DataFrame:
    """Packed sums of documents (block, docs, best, total), in parts; postings: posting rows (b, a, block, times, postings)."""
    counts = written(postings.groupBy("b", "a").agg(F.sum("times").alias("count"), F.count(F.lit(1)).alias("rows")), "pair-counts")
    # a row for each id of the vocabulary at most
    of_b = counts.groupBy("b").agg(F.max("count").alias("most"), F.expr(f"int((sum(rows) + {SHARE - 1}) div {SHARE})").alias("shares"))
    share = F.expr("int(pmod(xxhash64(block), shares))")
    told = counts.join(of_b, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "a", "count", (F.col("count") == F.col("most")).alias("best"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("postings"))
    held = postings.join(F.broadcast(of_b), "b").select("b", share.alias("share"), "a", F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("best"), "block", "postings")
    stream = told.unionByName(held).repartition("b", "share").sortWithinPartitions("b", "share", "a", F.col("count").isNull())

    most, entries = BUFFER, ENTRIES

    def run(batches):
        rows, weights, best, size = [], [], [], 0
        now = (0, False)

        def out():
            row, at = np.unique(np.concatenate(rows), return_inverse=True)
            total, top = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            np.add.at(total, at, np.concatenate(weights))
            np.add.at(top, at, np.concatenate(best))
            starts = np.flatnonzero(np.diff(row >> 16, prepend=-1))
            cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(row)], strict=True))
            packed = [[x[i:j].tobytes() for i, j in cuts] for x in ((row & 0xFFFF).astype(np.uint16), top, total)]
            for k in range(0, len(cuts), 256):
                yield pa.RecordBatch.from_arrays([pa.array((row >> 16)[starts[k : k + 256]]), *(pa.array(x[k : k + 256], pa.binary()) for x in packed)], ["block", "docs", "best", "total"])

        for batch in batches:
            count, told_best = batch.column(0), batch.column(1)
            is_count = count.is_valid().to_numpy(zero_copy_only=False)
            # each posting row takes the last count before it; the first ones that of the batch before
            at = np.maximum.accumulate(np.where(is_count, np.arange(len(is_count)), -1))
            values, flags = count.fill_null(0).to_numpy(), told_best.fill_null(False).to_numpy(zero_copy_only=False)
            value = np.where(at >= 0, values[at], now[0])
            flag = np.where(at >= 0, flags[at], now[1])
            now = (int(value[-1]), bool(flag[-1])) if len(at) else now
            every = np.flatnonzero(~is_count)
            for k in range(0, len(every), entries):
                own = every[k : k + entries]
                doc, times, n = unpacked(batch.column(2), batch.column(3), own)
                rows.append(doc)
                weights.append(np.repeat(value[own], n) * times)
                best.append(np.repeat(flag[own], n) * times)
                size += len(doc)
                if size >= most:
                    yield from out()
                    rows, weights, best, size = [], [], [], 0
        if rows:
            yield from out()

    return stream.select("count", "best", "block", "postings").mapInArrow(run, "block long, docs binary, best binary, total binary")


def align(docs: DataFrame, left, right) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs``.

    left and right: functions that make the two vocabularies.
    """
    both = written(encoded(docs, left, right), "alignment")
    each = both.where("row IS NOT NULL").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    postings = both.where("b IS NOT NULL").select("b", "a", "block", "times", "postings")
    sums = summed(contributions(postings))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return each.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
