"""Fingerprints over lexicon subsets against a plain version."""

import hashlib

import brute
import pytest
from pyspark.sql import functions as F

from tallymill.llm import lexicon_match as lm
from tallymill.llm import queries

SF = "/root/testdata/sf0.001"


def plain(rows, band=lm.BAND):
    """The whole result for rows (doc_id, text), in the order of doc_id."""
    rows = sorted(rows)
    texts = [t or "" for _, t in rows]
    edited = []
    for k, t in enumerate(texts):
        q = len(t) // 4
        edited.append(t[: len(t) - q] + texts[(k + 1) % len(rows)][:q])
    prints, likeness = brute.lexicon_fingerprints(texts + edited, texts, band, lm.DENSITIES, lm.OF_EACH, lm.SEEN)
    n = len(rows)
    return [(rows[k][0], len(texts[k]), hashlib.sha256(edited[k].encode()).hexdigest(), prints[k], prints[n + k], pytest.approx(likeness(k, n + k)), pytest.approx(likeness(k, (k + 1) % n))) for k in range(n)]


def test_query_against_plain_version(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    out = sorted(tuple(r) for r in queries.op12_lexicon_match(spark, SF).collect())
    assert out == plain(rows)
    assert sum(r[5] > r[6] for r in out) > 0.9 * len(out)


def test_odd_texts(docs):
    rows = [(k, t) for k, t in enumerate([None, "", " \n ", "word", "Word WORD word", "ÀÉ 🙂 zß\n\nÀÉ 🙂 zß", "x" * 20_000, "a b c d e f " * 2000, "word", "new text " * 9, *[f"p{k % 7} q{k % 5} r{k % 3}" for k in range(60)], *["a hot copy of one text"] * 40])]
    made = docs(rows).withColumns({c: F.lit(1) for c in ("id", "row_key", "no_id", "next", "hashes0", "term", "code", "range")})
    assert sorted(tuple(r) for r in lm.fingerprint_edits(made).collect()) == plain(rows)


def test_equal_texts_and_likeness(docs):
    rows = [(1, "one two three"), (2, "one two three"), (3, "four five six"), (9, "seven")]
    out = {r["doc_id"]: r for r in lm.fingerprint_edits(docs(rows), band=(0.0, 7.0)).collect()}
    assert out[1]["fingerprint"] == out[2]["fingerprint"] != out[3]["fingerprint"]
    assert out[1]["near_next"] == 1.0 and out[2]["near_next"] == 0.0


def test_null_ids_repeated_rows_single_and_empty(docs, empty):
    assert lm.fingerprint_edits(empty).count() == 0
    (one,) = lm.fingerprint_edits(docs([(5, "abcdefgh")])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0
    # a null id comes first; its next is 3, whose repeated row is one document; the last one's next is the null id
    out = lm.fingerprint_edits(docs([(3, "aaaabbbb"), (3, "aaaabbbb"), (None, "xxxxyyyy"), (0, "0000")])).collect()
    want = {None: b"xxxxyy00", 0: b"000a", 3: b"aaaabbxx"}
    assert sorted(str(r["doc_id"]) for r in out) == ["0", "3", "3", "None"]
    assert all(r["edited_sha256"] == hashlib.sha256(want[r["doc_id"]]).hexdigest() for r in out)


def test_order_over_many_ranges(spark, docs):
    rows = [(k * 37 % 1009 - 300, f"text {k} " * (k % 9)) for k in range(1000)]
    order = lm.in_order(lm.keyed(docs(rows).repartition(13))).select("id", "prev.id", "next.id").toDF("id", "prev", "next").collect()
    ids = sorted(d for d, _ in rows)
    want = {d: (ids[k - 1], ids[(k + 1) % 1000]) for k, d in enumerate(ids)}
    assert {r["id"]: (r["prev"], r["next"]) for r in order} == want


def test_wide_lexicon_is_joined_by_shuffle(docs, monkeypatch):
    rows = [(k, f"a{k % 9} b{k % 4} c{k} d") for k in range(100)]
    want = sorted(map(tuple, lm.fingerprint_edits(docs(rows)).collect()))
    monkeypatch.setattr(lm, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, lm.fingerprint_edits(docs(rows)).collect())) == want


def test_native(spark):
    plan = queries.op12_lexicon_match(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
