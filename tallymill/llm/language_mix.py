"""Language identification by multilingual mixture inference.

Training counts letter n-grams (1 to 3 letters within words, lower case) of all
training documents per language, in a fixed number of hash buckets; smoothed
bucket likelihoods are the model, whose size is bounded by buckets x languages.
For each document, expectation-maximisation estimates the proportions of a set
of languages; the set grows from the best single language while the gain in
log-likelihood beats a penalty for one more proportion. The prediction is the
language with the largest proportion, which is the score.

Null text, or text without letters: ``und`` with score 0. No training rows: all
``und``. Ties go to the language that sorts first. A null doc_id counts as the empty
text in the split and stays null. Rows are independent, so repeated rows give equal
answers; a very long text is counted whole in one pass, then only its counts are
used. An empty table gives no rows. Extra columns are ignored. More than
``MAX_LANGUAGES`` values of lang are an error: the model would have no bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = 3
MAX_LANGUAGES = 500
SCHEMA = "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>"
_A, _B, _SHIFT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(17)


def _letters() -> np.ndarray:
    """By code point of the basic plane: its lower-case form if it is a letter, else 0."""
    table = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_table: list[np.ndarray] = []


def letter_codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, other characters as 0; letters beyond the basic plane stay as they are."""
    if not _table:
        _table.append(_letters())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() > 0xFFFF:
        high = codes > 0xFFFF
        kept = np.array([c if chr(c).isalpha() else 0 for c in codes[high].tolist()], np.uint32)
        out = _table[0][np.where(high, 0, codes)]
        out[high] = kept
        return out
    return _table[0][codes]


def gram_buckets(text: str) -> np.ndarray:
    """Bucket of each n-gram of the text; words are padded with one space."""
    codes = letter_codes(text)
    if not codes.any():
        return np.empty(0, np.int64)
    edge = np.zeros(1, np.uint32)
    codes = np.concatenate([edge, codes, edge])
    solid = codes > 0
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # runs of other characters count once
    c = codes[keep]
    solid = c > 0
    parts = [(c[solid] * _B) >> _SHIFT]
    h, inner = c, np.ones(len(c), bool)
    for n in range(2, ORDERS + 1):
        h = h[:-1] * _A + c[n - 1 :]
        inner = inner[:-1]
        if n > 2:
            inner = inner & solid[n - 2 : n - 2 + len(inner)]  # a space only at either end
        parts.append((h[inner] * _B) >> _SHIFT)
    return np.concatenate(parts).astype(np.int64)


def train(docs: DataFrame, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages, and log-likelihoods of buckets by language, from all rows with text and lang."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = gram_buckets(text)
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                if len(b):
                    counts[lang] += np.bincount(b, minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    docs = docs.where("text is not null and lang is not null")
    if docs.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = docs.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    # at most one row for each language and bucket
    total = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(total["lang"].unique())
    counts = np.full((len(langs), BUCKETS), alpha)
    for k, lang in enumerate(langs):
        own = total[total["lang"] == lang]
        counts[k, own["bucket"]] += own["n"]
    return langs, np.log(counts / counts.sum(1, keepdims=True)) if langs else counts


def em(like: np.ndarray, n: np.ndarray, rounds: int = 25, enough: float = 0.02) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``like`` (grams x languages) for counts ``n``, and the log-likelihood."""
    share = np.full(like.shape[1], 1 / like.shape[1])
    size, last = n.sum(), -math.inf
    for _ in range(rounds):
        total = like @ share
        now = float(n @ np.log(total))
        if now - last < enough:
            break
        share, last = share * ((n / total) @ like) / size, now
    return share, now


def infer(buckets: np.ndarray, loglike: np.ndarray, penalty: float) -> tuple[list[int], np.ndarray]:
    """Selected languages and their proportions. loglike: languages x buckets."""
    n = np.bincount(buckets, minlength=loglike.shape[1])
    at = np.flatnonzero(n)
    n = n[at] / ORDERS  # each letter is in one n-gram of each order
    rows = loglike[:, at]
    rows = rows - rows.max(0)
    like = np.exp(rows).T
    cost = penalty * math.log(max(2.0, n.sum()))
    single = rows @ n
    chosen = [int(single.argmax())]
    share, best = np.ones(1), float(single.max())
    while len(chosen) < like.shape[1]:
        # the log-likelihood is concave in the proportions: its slope bounds what a newcomer can gain
        slope = (n / (like[:, chosen] @ share)) @ like - n.sum()
        able = [int(k) for k in np.argsort(-slope, kind="stable") if int(k) not in chosen and slope[k] > cost]
        tries = [(*em(like[:, [*chosen, k]], n), k) for k in able]
        if not tries:
            break
        new_share, value, k = max(tries, key=lambda t: t[1])
        if value - best <= cost:
            break
        chosen, share, best = [*chosen, k], new_share, value
    return chosen, share


def identify(docs: DataFrame, langs: list[str], loglike: np.ndarray, penalty: float = 2.0, keep: Sequence[str] = ()) -> DataFrame:
    """lang_pred, score and the selected languages with their proportions, by doc_id; ``keep``: more columns to hand on."""
    model = docs.sparkSession.sparkContext.broadcast(loglike.astype(np.float32))

    def run(batches):
        table = model.value.astype(np.float64)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                b = gram_buckets(text or "")
                if not len(b) or not langs:
                    out.append(("und", 0.0, [], []))
                    continue
                chosen, share = infer(b, table, penalty)
                order = sorted(range(len(chosen)), key=lambda k: (-share[k], chosen[k]))
                out.append((langs[chosen[order[0]]], float(min(1.0, share[order[0]])), [langs[chosen[k]] for k in order], [float(share[k]) for k in order]))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            made = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.list_(pa.float64()))]
            names = ["doc_id", "lang_pred", "score", "languages", "proportions", *keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *made, *batch.columns[2:]], names)

    rows = docs.select("doc_id", "text", *keep)
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, SCHEMA + extra)


def remainder(n: int) -> Column:
    """crc32 of doc_id as text (empty if null), modulo ``n``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n
