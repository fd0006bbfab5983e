"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a doubly linked list; a heap holds its adjacent pairs by
merge rank, then position. The lowest is popped and merged until none is left.
The count is the initial symbols less the merges: no identifiers are made.
Words repeat, so each Python worker keeps a bounded memory of counts.

Null or empty text: 0 bytes, 0 tokens. Repeated rows each get their row, a null
doc_id stays null, an empty table gives no rows. A very long text is taken word by
word; a very long word is merged in time that is its length times a logarithm. Extra
columns are ignored. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
# Capital letters of Unicode 16 and 17 that an older table does not lower, and the final sigma's ordinary form.
_LOWER = {0x03A3: 0x03C3, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
_LOWER |= {0x10D50 + k: 0x10D70 + k for k in range(22)} | {0x16EA0 + k: 0x16EBB + k for k in range(25)}
# Letters and numbers of later Unicode versions than the vocabularies' library knows (16); it takes them for neither.
_LATER = (
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Strings that str.split() takes for white space and Unicode does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def count_after_merges(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """Symbols left when the lowest-rank adjacent pair has been merged again and again.

    ranks: by left symbol << 20 | right symbol; made: the merged symbol by rank.
    Heap entries are rank * n + position, so equal ranks go from left to right.
    """
    n = len(symbols)
    heap = [ranks[p] * n + k for k in range(n - 1) if (p := symbols[k] << 20 | symbols[k + 1]) in ranks]
    if not heap:
        return n
    heapq.heapify(heap)
    push, pop, rank_of = heapq.heappush, heapq.heappop, ranks.get
    ids = [*symbols, -1]
    after, before = [*range(1, n + 1)], [*range(-1, n)]
    merges = 0
    while heap:
        rank, k = divmod(pop(heap), n)
        left, nxt = ids[k], after[k]
        if left < 0 or nxt >= n or rank_of(left << 20 | ids[nxt]) != rank:
            continue
        merges += 1
        ids[k] = new = made[rank]
        ids[nxt] = -1
        after[k] = far = after[nxt]
        before[far] = k
        if far < n and (r := rank_of(new << 20 | ids[far])) is not None:
            push(heap, r * n + k)
        prev = before[k]
        if prev >= 0 and (r := rank_of(ids[prev] << 20 | new)) is not None:
            push(heap, r * n + prev)
    return n - merges


class _Memo(dict):
    """Counts by string, computed when missing, forgotten when there are too many."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key: str) -> int:
        n = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = n
        return n


class TokenCounter:
    """Counts of the vocabulary file's own library for texts, without added special tokens.

    Reads word-end byte-pair vocabularies whose normaliser composes, folds white
    space and lower-cases, and whose pre-tokeniser keeps a pattern's matches.
    """

    def __init__(self, path: str, memory: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.inner = [vocab[s] for s in byte_symbols()]
        self.final = [vocab[s + suffix] for s in byte_symbols()]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.later = re.compile(f"[{''.join(f'{chr(a)}-{chr(b)}' for a, b in _LATER)}]")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.by_part = _Memo(self._part, memory)
        self.by_chunk = _Memo(self._chunk, memory)

    def _part(self, part: str) -> int:
        data = part.encode("utf-8", "replace")
        return count_after_merges([*(self.inner[b] for b in data[:-1]), self.final[data[-1]]], self.ranks, self.made)

    def _chunk(self, chunk: str) -> int:
        # lower-casing is by character: a final capital sigma is an ordinary one
        if chunk.isascii():
            low = chunk.lower()
        else:
            low = unicodedata.normalize("NFC", chunk).translate(_LOWER).lower()
            if self.later.search(low):  # a private character, which is no letter either, stands for each
                at = self.pattern.finditer(self.later.sub("\ue000", low))
                return sum(self.by_part[low[slice(*m.span())]] for m in at)
        return sum(map(self.by_part.__getitem__, self.pattern.findall(low)))

    def _segment(self, text: str) -> int:
        if _ODD_SPACE.search(text):
            return sum(map(self.by_chunk.__getitem__, regex.findall(r"\S+", text)))
        return sum(map(self.by_chunk.__getitem__, text.split()))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self._segment(text)
        segments = self.special.split(text)
        return len(segments) - 1 + sum(map(self._segment, segments))


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``) of each row of ``docs``."""

    def run(batches):
        counter = _counters.get(vocabulary) or _counters.setdefault(vocabulary, TokenCounter(vocabulary))
        for batch in batches:
            texts = batch.column(1)
            counts = [counter.count(t.as_py()) for t in texts]
            n_bytes = [0 if (b := t.as_buffer()) is None else b.size for t in texts.cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
