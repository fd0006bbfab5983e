"""Leaks against every run of every diagonal."""

import random

import numpy as np
import pytest

from tallymill.llm import decontamination
from tallymill.llm import words as w


def most_equal(text, item, min_tokens=13):
    """Equal tokens of the best run that makes a leak, 0 if none does."""
    best = 0
    for diagonal in range(1 - len(item), len(text)):
        pairs = [(text[k], item[k - diagonal]) for k in range(max(0, diagonal), min(len(text), diagonal + len(item)))]
        for i in range(len(pairs)):
            equal = 0
            for j in range(i, len(pairs)):
                equal += pairs[j][0] == pairs[j][1]
                if 5 * equal >= 4 * (j + 1 - i):
                    best = max(best, equal)
    return best if best >= min(min_tokens, -(-4 * len(item) // 5)) else 0


def found(text, item):
    words = w.block_words([" ".join(item).encode()])[0]
    got = list(decontamination.leaks(*w.block_words([" ".join(text).encode()]), decontamination.build_index([(0, words)])))
    for _, _, matched, run, tokens, start, end in got:
        assert 5 * matched >= 4 * run and end - start == run <= tokens == len(item)
    return got[0][2] if got else 0


@pytest.mark.parametrize("n", range(5, 21))
def test_one_substitution_at_every_place(n):
    item = [f"t{k}" for k in range(n)]
    for k in range(n):
        text = ["before", *item[:k], "changed", *item[k + 1 :], "after"]
        assert found(text, item) == most_equal(text, item) >= min(13, -(-4 * n // 5))


def test_broken_runs():
    item = [f"t{k}" for k in range(60)]
    assert found([*item[:10], "x", "x", "x", *item[13:18]], item[:18]) == 15
    assert found([x if k % 5 < 4 else "x" for k, x in enumerate(item)], item) == 48
    assert found([x if k % 4 < 3 else "x" for k, x in enumerate(item)], item) == 0


def test_random_texts_against_brute_force():
    rng = random.Random(21)
    leaks = 0
    for _ in range(1500):
        item = [f"t{rng.randrange(rng.choice((4, 200)))}" for _ in range(rng.randrange(1, 26))]
        rate = rng.choice((0.0, 0.1, 0.2, 0.3))
        a, b = sorted(rng.randrange(len(item) + 1) for _ in range(2))
        text = [f"t{rng.randrange(200)}", *(f"z{rng.randrange(9)}" if rng.random() < rate else x for x in rng.choice((item, item[a:b]))), f"t{rng.randrange(200)}"]
        expected = most_equal(text, item)
        assert found(text, item) == expected, (text, item)
        leaks += expected > 0
    assert 300 < leaks < 1400


def test_texts_of_a_block_stay_apart():
    item = [f"t{k}" for k in range(20)]
    index = decontamination.build_index([(7, w.block_words([" ".join(item).encode()])[0])])
    halves = [" ".join(item[:10]).encode(), " ".join(item[10:]).encode(), b"", " ".join(item).encode()]
    assert list(decontamination.leaks(*w.block_words(halves), index)) == [(3, 7, 20, 20, 20, 0, 20)]
    assert not list(decontamination.leaks(np.empty(0, np.uint64), np.zeros(2, np.int64), index))


def test_substitutions_are_found_in_tables(spark, docs):
    items = {n: [f"t{n}x{k}" for k in range(n)] for n in range(5, 21)}
    rows = [(100 * n + k, " ".join(["before", *item[:k], "changed", *item[k + 1 :], "after"])) for n, item in items.items() for k in range(n)]
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs(rows), bench).collect()) == [(d, d // 100) for d, _ in rows]
    assert decontamination.drop_leaks(docs(rows), bench).count() == 0
