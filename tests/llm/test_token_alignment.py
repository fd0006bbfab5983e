"""Token alignment against a plain version, and the two forms of the byte vocabulary."""

import hashlib
import random
from functools import partial

import brute
import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymill.llm import queries, token_alignment

SF = "/root/testdata/sf0.001"
RANKS, PIECES, JSON = (str(public.path(n)) for n in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json"))


left = partial(token_alignment.byte_ranks, RANKS, public.PATTERN)
right = partial(token_alignment.pieces, PIECES)


def plain(texts):
    """By the libraries, token by token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=PIECES)
    letters = {c: k for k, c in alphabet().items()}
    of_a = lambda t: [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
    of_b = lambda t: [(i, bytes([int(p[3:5], 16)]) if (p := b.id_to_piece(i)).startswith("<0x") else p.replace("▁", " ").encode()) for i in b.encode(t)]
    return brute.alignment(texts, of_a, of_b)


def alphabet():
    """The byte-level alphabet, made as its description says."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return out


def row(r):
    return (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])


def told(x):
    return (*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[0] else "")


HARD = ["a", " a", "  two  spaces ", "new\nline\t tab", "<|endoftext|> <s> </s> <unk>", "é ü ﬁ ½ 🙂🙂 ▁ x", "\x00\x01 ​", "日本語のテキスト", "0123456789 " * 20, "  nbsp", "ａｂｃ wide", "é combined", "a\r\nb", "﻿bom", "x" * 3000, "<0x41> <0x0A>"]


def test_query_against_plain_version(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    want = dict(zip([d["doc_id"] for d in docs], map(told, plain([d["text"] for d in docs])), strict=True))
    assert {r["doc_id"]: row(r) for r in queries.op13_token_alignment(spark, SF).collect()} == want


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts_hot_pairs_and_small_blocks(docs, monkeypatch, small):
    if small:  # many blocks, rows and shares
        for name, n in (("BLOCK_BYTES", 60), ("BLOCK_DOCS", 3), ("SHARE", 2), ("ENTRIES", 2), ("BUFFER", 5)):
            monkeypatch.setattr(token_alignment, name, n)
    rng = random.Random(3)
    texts = HARD + [None, "", "the same"] + ["the same words again"] * 40 + [" ".join(rng.choice(["the", "there", "then,", "Ünder", "9"]) for _ in range(rng.randrange(1, 30))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(None, "the same"), (19, "the same")]
    got = token_alignment.align(docs(rows).repartition(5).withColumn("row", F.lit(1)).withColumn("b", F.lit("x")), left, right).collect()
    want = sorted(zip([-1 if d is None else d for d, _ in rows], map(told, plain([t for _, t in rows])), strict=True))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], row(r)) for r in got) == want


def test_empty_table(empty, docs):
    assert token_alignment.align(empty, left, right).count() == 0
    assert [row(r) for r in token_alignment.align(docs([(1, None), (2, "")]), left, right).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_both_forms_of_the_vocabulary(spark):
    a, b = left(), token_alignment.byte_level(JSON)
    for t in [r["text"] for r in queries.table(spark, SF, "documents").select("text").collect()] + HARD:
        assert np.array_equal(a.spelled(t.encode()), b.spelled(t.encode()))
    assert a.tokens == b.tokens[: len(a.tokens)]


def test_a_pair_of_very_many_times():
    pairs, docs = np.full(200_000, 5 << 24 | 7), np.zeros(200_000, np.int64)
    rows = token_alignment._posting_rows(np.append(pairs, 6 << 24 | 7), np.append(docs, 1), 3)
    assert rows.column(0).to_pylist() == [7, 7] and rows.column(1).to_pylist() == [5, 6] and rows.column(3).to_pylist() == [200_000, 1]
    doc, times, n = token_alignment.unpacked(rows.column(2), rows.column(4), np.arange(2))
    assert doc.tolist() == [3 << 16] * 4 + [3 << 16 | 1] and times.sum() == 200_001 and n.tolist() == [4, 1]
    assert isinstance(rows, pa.RecordBatch)
