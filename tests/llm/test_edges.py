"""Hot groups, very long rows, ties and clashing names, against plain versions."""

import random
import resource
import time

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymill.llm import decontamination, graph, jaccard_join, language_mix, line_dedup, mixing, personal_data, quality, transport_stream
from tallymill.llm import words as w


def clashing(df, *names):
    """Columns with the names that an operator might use inside."""
    return df.withColumns({n: F.lit(k) for k, n in enumerate(names)})


# 1


def test_many_items_share_a_seed(monkeypatch):
    monkeypatch.setattr(decontamination, "VERIFY_TOKENS", 50)
    rng = random.Random(31)
    prompt = [f"p{k}" for k in range(8)]
    items = [[*prompt, *(f"i{k}x{j}" for j in range(14))] for k in range(60)]
    index = decontamination.build_index([(k, w.block_words([" ".join(x).encode()])[0]) for k, x in enumerate(items)])
    texts = [" ".join(["z", *(("?" if rng.random() < 0.1 else t) for t in items[k]), "z"]) for k in (3, 40)] + [" ".join(prompt)]
    assert {(t, i) for t, i, *_ in decontamination.leaks(*w.block_words([t.encode() for t in texts]), index)} == {(0, 3), (1, 40)}


@pytest.mark.parametrize("shared", [6, 8, 12])
def test_a_question_template_that_a_corpus_quotes(shared):
    """A thousand items begin with the same words, which one text repeats 1,500 times; two items do leak."""
    prompt = [f"p{k}" for k in range(shared)]
    items = [[*prompt, *(f"i{k}x{j}" for j in range(14))] for k in range(1000)]
    index = decontamination.build_index([(k, w.block_words([" ".join(x).encode()])[0]) for k, x in enumerate(items)])
    leak = [items[k][j] if j % 6 else "?" for k in (17, 400) for j in range(len(items[0]))]
    h, bounds = w.block_words([" ".join([*prompt * 1500, "z", *leak]).encode(), " ".join(prompt * 3).encode()])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    found = {(t, i) for t, i, *_ in decontamination.leaks(h, bounds, index)}
    assert found == {(0, 17), (0, 400)} and time.process_time() - began < 4
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10  # in KB


def test_shared_seeds_hide_no_leak(monkeypatch):
    """With every seed shared, those that are left out are needed by no leak: all ways to differ, against the count on the diagonal."""
    monkeypatch.setattr(decontamination, "HELD", 1)
    rng = random.Random(41)
    for shared in range(3, 13):
        prompt = [f"p{k}" for k in range(shared)]
        where = rng.randrange(0, 8)
        items = [[*(f"a{k}x{j}" for j in range(where)), *prompt, *(f"i{k}x{j}" for j in range(22 - where - shared))] for k in range(4)]
        index = decontamination.build_index([(k, w.block_words([" ".join(x).encode()])[0]) for k, x in enumerate(items)])
        texts, want = [], set()
        for t in range(300):
            k = rng.randrange(4)
            equal = [rng.random() < 0.8 for _ in items[k]]
            texts.append(" ".join(["z", *(x if e else "?" for x, e in zip(items[k], equal, strict=True)), "z"]).encode())
            if decontamination.longest_run(np.array([False, *equal, False]))[0] >= 13:
                want.add((t, k))
        assert {(t, k) for t, k, *_ in decontamination.leaks(*w.block_words(texts), index)} == want


@pytest.mark.parametrize("n", range(4, 61))
def test_every_allowed_number_of_substitutions(n):
    rng = random.Random(n)
    item = [f"t{k}" for k in range(n)]
    index = decontamination.build_index([(0, w.block_words([" ".join(item).encode()])[0])])
    for changed in range(n // 5 + 1):
        texts = []
        for _ in range(20):
            places = set(rng.sample(range(n), changed))
            texts.append(" ".join(["a", *("x" if k in places else t for k, t in enumerate(item)), "b"]).encode())
        assert {t for t, *_ in decontamination.leaks(*w.block_words(texts), index)} == set(range(20))


def test_leaks_names(spark, docs):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    out = decontamination.drop_leaks(clashing(docs([(1, "zero one two three four five six"), (2, "clean")]), "item_id", "tokens"), bench)
    assert [r["doc_id"] for r in out.collect()] == [2] and {"item_id", "tokens"} <= set(out.columns)


# 2


def test_mix_names_and_ties(docs):
    rows = clashing(docs([(5, "a b c", "en", "src0")] * 3 + [(6, "a b c", "en", "src0")]), "domain", "range", "order_key", "epochs")
    out = mixing.mix_sources(rows, budget=(1, 2), max_epochs=1).collect()
    assert sum(r["taken_tokens"] for r in out) == 6


# 3


def test_lines_names(docs):
    rows = clashing(docs([(1, "one two three four five\nkeep"), (2, "one two three four FIVE\nother")]), "__gone", "__left", "__key", "__id", "__text", "__lines", "gone", "left", "row", "row_key", "lines", "line_no", "h1")
    out = line_dedup.dedup_lines(rows)
    assert out.columns == rows.columns and {r["doc_id"]: r["text"] for r in out.collect()} == {1: "one two three four five\nkeep", 2: "other"}


def test_very_long_lines(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG", 9)  # both ways of hashing, and lengths where they meet
    rng = random.Random(33)
    bases = [[f"w{rng.randrange(5)}" for _ in range(n)] for n in (7, 8, 9, 10, 10, 11, 12, 30)]

    def edited(x):
        k = rng.randrange(len(x))
        return rng.choice([x[:k] + x[k + 1 :], x[:k] + ["n"] + x[k:], x[:k] + ["n"] + x[k + 1 :]])

    rows = [(d, " ".join(edited(edited(rng.choice(bases))) if rng.random() < 0.3 else edited(rng.choice(bases)))) for d in range(250)]
    assert {r["doc_id"]: r["text"] for r in line_dedup.report(docs(rows)).collect()} == brute.kept_lines(rows)


def test_one_line_of_many_words(docs):
    long = [f"w{k}" for k in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:30_000], "changed", *long[30_001:]])), (3, " ".join(long[1:])), (4, " ".join(long[2:]))]
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.report(docs(rows)).collect()} == {1: 0, 2: 1, 3: 1, 4: 1}


# 4


def test_quality_ties(spark, docs):
    rows = [(k, ("good plain words here " if k % 2 else "BAD!! ") * 20, "en", "src0") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(4, 1), (4, 0)], "doc_id long, quality int")
    out = {r["doc_id"]: r["score"] for r in quality.score(docs(rows + rows[:5]), labels).collect()}
    assert len({round(out[k], 9) for k in range(0, 60, 2)}) == 1 and len({round(out[k], 9) for k in range(1, 60, 2)}) == 1 and out[1] > out[0]


def test_view_models_follow_plain_newton():
    rng = np.random.default_rng(34)
    x, y = rng.normal(size=(200, 3)), rng.integers(0, 2, 200)
    model = quality.Logistic(ridge=1.0).fit(x, y)
    z = np.hstack([np.ones((200, 1)), (x - x.mean(0)) / (x.std(0) + 1e-6)])
    beta = np.zeros(4)
    for _ in range(20_000):  # plain gradient ascent on the same penalised likelihood
        p = 1 / (1 + np.exp(-z @ beta))
        beta += 0.005 * (z.T @ (y - p) - np.array([0, 1, 1, 1]) * beta)
    assert model.logit(x) == pytest.approx(z @ beta, abs=1e-3)


# 5


def test_slices_by_bytes(monkeypatch):
    monkeypatch.setattr(transport_stream, "SLICE", 1000)
    sizes = [10, 2000, 990, 10, 1, None, 5000, 300]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([None if n is None else "x" * n for n in sizes])], ["k", "t"])
    parts = [p.column(0).to_pylist() for p in transport_stream.slices(batch, 1)]
    assert sum(parts, []) == list(range(8)) and parts == [[0], [1], [2, 3], [4, 5], [6], [7]]


def test_round_trip_in_one_pass(odd, empty):
    steps = transport_stream.digest(transport_stream.demux(transport_stream.mux(odd)))
    assert sorted(map(str, transport_stream.round_trip(odd).collect())) == sorted(map(str, steps.collect()))
    assert transport_stream.round_trip(empty).count() == 0


# 6


def test_large_near_group_and_shared_paragraph(docs):
    rng = random.Random(35)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for d in range(5000):  # copies that differ from the first by nothing to three words, at any place
        x = list(base)
        for _ in range(rng.randrange(4)):
            x[rng.randrange(40)] = f"e{rng.randrange(3000)}"
        rows.append((d, " ".join(x)))
    licence = " ".join(f"l{k}" for k in range(60))
    rows += [(10_000 + d, f"{licence} " + " ".join(f"d{d}x{k}" for k in range(rng.randrange(1, 30)))) for d in range(300)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(docs(rows), 4, 85).collect()}
    # the plain version, on distinct texts only
    first = {}
    for d, t in rows:
        first.setdefault(t, d)
    sets = {d: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for t, d in first.items()}
    ids = sorted(sets)
    vocabulary = {s: k for k, s in enumerate(sorted({s for x in sets.values() for s in x}))}
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    lists = {}
    for d in ids:
        for s in sets[d]:
            lists.setdefault(vocabulary[s], []).append(d)
    place = {d: k for k, d in enumerate(ids)}
    size = np.array([len(sets[d]) for d in ids])
    for d in ids:
        both = np.zeros(len(ids), np.int64)
        for s in sets[d]:
            both[[place[o] for o in lists[vocabulary[s]]]] += 1
        for k in np.flatnonzero(100 * both >= 85 * (size + len(sets[d]) - both)):
            a, b = root(d), root(ids[k])
            parent[max(a, b)] = min(a, b)
    assert got == {d: (len(sets[first[t]]), root(first[t])) for d, t in rows}


def test_keep_one_names(docs):
    rows = clashing(docs([(1, "a b c d e f"), (2, "A b c d e f"), (3, "")]), "_id", "component_id", "n_shingles", "cid")
    out = jaccard_join.keep_one(rows)
    assert out.columns == rows.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_contraction():
    a, b = graph.contracted(np.array([5, 3, 9, 8]), np.array([3, 1, 8, 7]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(3, 1), (5, 1), (8, 7), (9, 7)]


# 7


def test_words_near_are_whole():
    vote = lambda t: personal_data.votes(t, 1, t.index("10."), t.index("10.") + 10, False)
    assert vote("a trip to the hotel 10.0.0.300")[4] == "-" and vote("the ip is 10.0.0.300")[4] == "y"


def test_reliabilities_find_planted_labelers():
    rng = np.random.default_rng(36)
    truth = rng.random(20_000) < 0.3
    right = [0.95, 0.9, 0.8, 0.7, 0.6]
    cells = [np.where(rng.random(len(truth)) < p, truth, ~truth) for p in right]
    patterns, n = np.unique(["1" + "".join("ny"[int(c[k])] for c in cells) + "000" for k in range(len(truth))], return_counts=True)
    post = dict(zip(patterns, personal_data.reliabilities(list(patterns), n), strict=True))
    # the posterior by the planted rates
    for p, got in post.items():
        like = [np.prod([r if (v == "y") == side else 1 - r for v, r in zip(p[1:6], right, strict=True)]) * (0.3 if side else 0.7) for side in (False, True)]
        assert got == pytest.approx(like[1] / sum(like), abs=0.08)


# 10


def test_mixture_against_plain_em():
    rng = np.random.default_rng(37)
    like = rng.dirichlet(np.ones(40), size=3)  # three languages over 40 n-grams
    n = rng.multinomial(5000, 0.6 * like[0] + 0.4 * like[1]).astype(float)
    share, value = language_mix.em(like.T[:, :2], n, rounds=2000, enough=1e-9)
    grid = np.linspace(0, 1, 10_001)[1:-1]
    plain = (n * np.log(grid[:, None] * like[0] + (1 - grid[:, None]) * like[1])).sum(1)
    assert share[0] == pytest.approx(grid[plain.argmax()], abs=2e-3) and value == pytest.approx(plain.max(), abs=1e-2)
    chosen, got = language_mix.infer(np.repeat(np.arange(40), n.astype(int)), np.log(like), 2.0)
    best = max(((s, *language_mix.em(like.T[:, list(s)], n / language_mix.ORDERS, 2000, 1e-9)) for s in [(0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]), key=lambda x: x[2] - 2.0 * np.log(n.sum() / language_mix.ORDERS) * (len(x[0]) - 1))
    assert sorted(chosen) == sorted(best[0])


def test_mixture_ties_and_null_ids(docs):
    langs, loglike = language_mix.train(docs([(1, "aba bab", "xx"), (2, "aba bab", "yy")]))
    out = language_mix.identify(clashing(docs([(None, "aba"), (3, "aba")]), "score"), langs, loglike).collect()
    assert [r["lang_pred"] for r in out] == ["xx", "xx"]
    held = docs([(None, "x")]).select((language_mix.remainder(4) == 2).alias("held_out")).first()
    assert held["held_out"] is not None
    with pytest.raises(ValueError, match="languages"):
        language_mix.train(docs([(k, "a", f"l{k}") for k in range(language_mix.MAX_LANGUAGES + 1)]))
