"""Each operator against a plain version or a round trip, and on odd input."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymill.llm import bpe_count, decontamination, elias_fano, graph, jaccard_join, language_mix, language_model, line_dedup, mixing, personal_data, quality, transport_stream
from tallymill.llm import words as w

VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# words and files


@given(st.lists(st.text(alphabet="aAbB \n\tcé🙂", max_size=40), max_size=8))
def test_word_hashes_follow_words(texts):
    h, bounds = w.block_words([t.encode() for t in texts])
    assert list(np.diff(bounds)) == [len(brute.words(t)) for t in texts]
    flat = [x for t in texts for x in brute.words(t)]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


@given(st.sets(st.integers(0, (1 << 44) - 1), min_size=1, max_size=300), st.lists(st.integers(0, (1 << 45) - 1), max_size=50))
def test_successor_search(values, queries):
    x = np.array(sorted(values), np.uint64)
    y = np.array([*queries, *values, 0], np.uint64)
    i, known = elias_fano.Sequence(*elias_fano.encode(x)).successor(y)
    assert (i == np.searchsorted(x, y)).all() and known.tolist() == [int(v) in values for v in y]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: root(k) for k in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_leaks_tolerate_substitutions(spark, docs):
    rng = random.Random(2)
    item = text(rng, 40, 10**6).split()
    changed = [("zz" if k in (9, 22, 33) else x) for k, x in enumerate(item)]
    rows = [(1, text(rng, 300)), (2, f"{text(rng, 50)} {' '.join(item)} {text(rng, 50)}"), (3, f"{text(rng, 9)} {' '.join(changed)}"), (4, " ".join(item[:8])), (5, " ".join(item[10:30]).upper()), (6, None), (7, "")]
    bench = spark.createDataFrame([(10, " ".join(item), "x"), (11, None, "x"), (12, "tiny test item", "x"), (13, "", "x")], "item_id long, text string, doc_id string")
    rows.append((8, "here is a tiny test item inside"))
    got = rows_of(decontamination.find_leaks(docs(rows), bench), "doc_id", "item_id", "matched_tokens")
    assert got == [(2, 10, 40), (3, 10, 37), (5, 10, 20), (8, 12, 3)]
    blocks = decontamination.find_leaks(docs(rows), bench, block_tokens=5)
    assert rows_of(blocks, "doc_id", "item_id", "matched_tokens") == got
    assert rows_of(decontamination.drop_leaks(docs(rows), bench, block_tokens=5), "doc_id") == [(1,), (4,), (6,), (7,)]


def test_leaks_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, "a b c d e f " * 3)], "item_id long, text string")
    assert rows_of(decontamination.find_leaks(odd, bench), "doc_id", "matched_tokens") == [(5, 18)]
    assert decontamination.find_leaks(empty, bench).count() == 0 and decontamination.find_leaks(odd, bench.limit(0)).count() == 0
    assert decontamination.drop_leaks(odd, bench).count() == odd.count() - 1


# 2


def test_mix_is_whole_and_within_caps(docs):
    rng = random.Random(3)
    rows = [(k, text(rng, rng.randrange(0, 60)), rng.choice(["en", "fr", None]), rng.choice(["src0"] * 5 + ["src1", "src6", "odd", None])) for k in range(600)]
    out = mixing.mix_sources(docs(rows)).toPandas()
    n = {d: len(brute.words(t)) for d, t, *_ in rows}
    total = sum(n.values())
    assert (out.taken_tokens == out.epochs * out.n_tokens + out.prefix_tokens).all() and (out.taken_tokens <= 2 * out.n_tokens).all()
    assert (out.n_tokens == out.doc_id.map(n)).all()
    assert 0.6 * total - 60 <= out.taken_tokens.sum() <= 0.6 * total
    partial = out[(out.prefix_tokens > 0) & (out.prefix_tokens < out.n_tokens)]
    assert partial.groupby(["domain", "lang", "source"]).size().max() <= 1  # a prefix ends in one document
    again = mixing.mix_sources(docs(rows[::-1])).toPandas()
    assert again.sort_values("doc_id").reset_index(drop=True).equals(out.sort_values("doc_id").reset_index(drop=True))


def test_shortage_goes_to_siblings_first(docs):
    rows = [(k, "a " * 10, "en", "src0") for k in range(100)] + [(100 + k, "a " * 10, "fr", "src0") for k in range(2)] + [(200 + k, "a " * 10, "en", "src1") for k in range(100)]
    out = mixing.mix_sources(docs(rows), budget=(1, 2), max_epochs=1, weights={"domain": {"web": 50, "books": 50}, "lang": {"en": 50, "fr": 50}})
    got = {tuple(r[:2]): r[2] for r in out.groupBy("domain", "lang").agg(F.sum("taken_tokens")).collect()}
    assert got == {("web", "fr"): 20, ("web", "en"): 485, ("books", "en"): 505}


def test_mix_odd(odd, empty):
    assert mixing.mix_sources(empty).count() == 0
    got = mixing.mix_sources(odd, budget=(1, 1), max_epochs=1)
    assert got.agg(F.sum("taken_tokens")).first()[0] == sum(len(brute.words(r["text"])) for r in odd.collect())


# 3


def test_lines_against_brute_force(docs):
    rng = random.Random(4)
    lines = [text(rng, rng.randrange(1, 12), 30) for _ in range(60)]

    def edited(line):
        x = line.split()
        k = rng.randrange(len(x))
        return " ".join(rng.choice([x[:k] + x[k + 1 :], x[:k] + ["new"] + x[k:], x[:k] + ["new"] + x[k + 1 :], x]))

    rows = [(d, "\n".join(rng.choice([rng.choice(lines), edited(rng.choice(lines)), "", text(rng, 8, 10**6)]) for _ in range(rng.randrange(1, 9)))) for d in range(80)] + [(90, None), (91, ""), (92, " \n ")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.report(docs(rows)).collect()}
    assert got == brute.kept_lines(rows)
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert kept == {d: (t, None if t is None else len(t)) for d, t in brute.kept_lines(rows).items() if t is not None or d == 90}


def test_lines_by_shuffle_join(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    rows = [(2, "one two three four five six\nkeep me"), (1, "one two three four five SIX"), (3, "one two three four five")]
    assert {r["doc_id"]: r["text"] for r in line_dedup.report(docs(rows)).collect()} == {1: "one two three four five SIX", 2: "keep me", 3: None}


def test_lines_odd(odd, empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert (7, "ÀÉ 🙂 zß\n") in got and (1, None) in got and (2, "") in got and sum(d == 4 for d, _ in got) == 2 and len(got) == odd.count()


# 4


def test_quality(spark, docs):
    rng = random.Random(5)
    good = [(k, "\n".join(text(rng, 30) for _ in range(3)) + ".", "en", f"src{k % 20}") for k in range(300)]
    bad = [(1000 + k, text(rng, 40).upper().replace(" ", "!! ") if k % 2 else "spam " * 60, "en", f"src{k % 20}") for k in range(80)]
    labels = spark.createDataFrame([(d, int(d < 1000), 0) for d, *_ in good[:150] + bad[:40]] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, f"https://www.host{k % 3}.org/en/{k}", "") for k in range(50)], "page_id long, url string, html string")
    out = {r["doc_id"]: r for r in quality.score(docs(good + bad), labels, pages).collect()}
    assert all(out[d]["keep"] for d, *_ in good) and not any(out[d]["keep"] for d, *_ in bad)
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert sorted(r["doc_id"] for r in quality.keep_good(docs(good + bad), labels, pages).collect()) == [d for d, *_ in good]


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 1)], "doc_id long, quality int")
    assert [r["keep"] for r in quality.score(odd, labels).collect()] == [True] * odd.count()
    assert quality.score(odd, labels.limit(0)).count() == odd.count() and quality.score(empty, labels).count() == 0
    both = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (7, 0), (8, 1), (2, 0)], "doc_id long, quality int")
    assert quality.score(odd, both).count() == odd.count()
    assert quality.keep_good(odd, both).where("doc_id is null").count() == 1


# 5


@settings(max_examples=40)
@given(st.binary(max_size=30_000))
def test_transport_stream_round_trip(data):
    got = transport_stream.demux_bytes(transport_stream.mux_bytes(transport_stream.padded(data)))
    assert got["payload"] == transport_stream.padded(data) and got["continuity_errors"] == 0
    assert len(got["timestamps"]) == -(-len(got["payload"]) // transport_stream.UNIT) and got["random_access"][0] == {"packet": 2, "pts": 0}


def test_transport_stream_faults():
    media = transport_stream.mux_bytes(b"x" * 40_000)
    lost = media[: 188 * 20] + media[188 * 21 :]
    assert transport_stream.demux_bytes(lost)["continuity_errors"] == 1
    for broken in (b"", media[:-1], b"\0" * 188, media[188:], media[:8] + b"?" + media[9:], None):
        assert transport_stream.demux_row(broken)["error"]


def test_transport_stream_digest(odd, empty):
    out = transport_stream.digest(transport_stream.demux(transport_stream.mux(odd))).collect()
    assert transport_stream.digest(transport_stream.demux(transport_stream.mux(empty))).count() == 0
    texts = [r["text"] for r in odd.collect()]
    for t, r in zip(texts, out, strict=True):
        p = (t or "").encode()
        p += b"\xff" * (-len(p) % 576 if p else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


# 6


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_against_brute_force(docs, width, percent):
    rng = random.Random(width)
    bases = [text(rng, rng.randrange(1, 120), 2000) for _ in range(12)]
    passage = text(rng, 60, 10**6)

    def copy(t):
        x = t.split()
        for _ in range(rng.randrange(4)):
            x[rng.randrange(len(x))] = f"z{rng.randrange(50)}"
        return " ".join(x)

    rows = [(k, copy(rng.choice(bases))) for k in range(150)] + [(200 + k, f"{text(rng, 80, 10**6)} {passage}") for k in range(20)]
    rows += [(300 + k, copy(bases[0])) for k in range(60)] + [(400, None), (401, ""), (402, "a b"), (403, "A\tb"), (404, passage)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(docs(rows), width, percent).collect()}
    assert got == brute.jaccard(rows, width, percent)


def test_divide_skip():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 60, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(150, 200), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 30), dtype=np.uint64)])) for _ in range(80)]
    parent = list(range(80))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in jaccard_join.divide_skip(sets, sets, 80, True):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
        parent[root(a)] = root(b)
    for a in range(80):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert root(a) == root(b)


def test_jaccard_odd(odd, empty, docs):
    got = rows_of(jaccard_join.link(odd, 4, 85), "doc_id", "n_shingles", "component_id")
    assert len(got) == odd.count() and (None, 5, None) in got and (1, 0, 1) in got and got.count((4, 1, 4)) == 2 and (5, 6, 5) in got
    assert jaccard_join.link(empty, 4, 85).count() == 0
    kept = jaccard_join.keep_one(docs([(1, "a b c d e f"), (2, "A b c d e f"), (3, ""), (4, None), (5, "z")]))
    assert rows_of(kept, "doc_id") == [(1,), (3,), (4,), (5,)] and "key" in kept.columns


# 7


@settings(max_examples=300)
@given(st.text(alphabet="aZ0123459.@+- ()%é", max_size=60))
def test_base_spans(t):
    assert personal_data.spans_text(personal_data.base_spans(t)[0]) == brute.personal(t)


def test_personal_data(docs, odd, empty):
    rows = [(1, "mail joe.x@site.example.com or 10.0.0.300, card 4532 0151 1283 0366 call +49 (30) 1234-5678"), (2, "api token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" ssn 123-45-6789"), (3, "1" * 5000), (4, "@" * 3000), (5, "a." * 4000 + "@b")]
    got = {r["doc_id"]: r for r in personal_data.find(docs(rows)).collect()}
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (1, 0, 1, 1)
    for d, t in rows:
        base = brute.personal(t)
        assert got[d]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[d]["spans"].split(","))
    assert personal_data.find(odd).count() == odd.count() and personal_data.find(empty).count() == 0


def test_reliabilities_follow_agreement():
    patterns = ["0yyyy-1", "0yy-y-1", "0nn--n1", "0nn-yn1"]
    post = personal_data.reliabilities(patterns, np.array([50, 30, 40, 5]))
    assert post[0] > 0.9 and post[1] > 0.9 and post[2] < 0.1


# 8


def test_token_counts_match_the_library(docs, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(VOCABULARY))
    odd_texts = ["ΑΣ ΣΑΣ Σ", "a\x1cb\x1d c", "x<|endoftext|>y <|startoftext|>", "é ́a İstanbul", "don't I'LL we've", "12345 ½ ²", "\u0085a\xa0b c​d", "🙂🙂 a🙂b", "a" * 3000, "ﬁ ẞ ǅ", "\x00a", "'S 's'T"]
    rows = [(k, t) for k, t in enumerate(odd_texts)]
    for df in (docs(rows), odd):
        texts = [r["text"] or "" for r in df.collect()]
        got = [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in bpe_count.count_tokens(df, str(VOCABULARY)).collect()]
        n = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert got == [(len(t.encode()), k, k > 2048) for t, k in zip(texts, n, strict=True)]
    assert bpe_count.count_tokens(empty, str(VOCABULARY)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_token_counts_of_any_text(t):
    from tokenizers import Tokenizer

    cache = test_token_counts_of_any_text.__dict__
    if "both" not in cache:
        cache["both"] = Tokenizer.from_file(str(VOCABULARY)), bpe_count.TokenCounter(str(VOCABULARY))
    library, own = cache["both"]
    assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_token_counts_of_every_code_point():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(str(VOCABULARY)), bpe_count.TokenCounter(str(VOCABULARY), memory=1000)
    points = [c for c in [*range(0x34000), *range(0x3C000, 0x40000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4000):
        texts = [f"â{chr(c)}b {chr(c)}{chr(c)}1 !{chr(c)}" for c in points[at : at + 4000]]
        assert [own.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


# 9


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model_against_brute_force(docs, order):
    rng = random.Random(order)
    rows = [(k, text(rng, rng.randrange(0, 40), 15)) for k in range(120)] + [(500, None), (501, ""), (502, "unseen words w1 w2")]
    out = {r["doc_id"]: r for r in language_model.train_and_score(docs(rows), order).collect()}
    trained = [[*brute.words(t), None] for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    known = {x for t in trained for x in t}
    assert {r["train_tokens"] for r in out.values()} == {sum(map(len, trained))}
    assert all(out[d]["n_known"] == sum(x in known for x in [*brute.words(t), None]) for d, t in rows)
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    expected = brute.language_model([t for d, t in rows if not held[d]], [t for _, t in rows], order)
    for (d, _), (n, base, score) in zip(rows, expected, strict=True):
        assert (out[d]["held_out"], out[d]["n_tokens"]) == (held[d], n)
        assert out[d]["base_score"] == pytest.approx(base, rel=1e-9) and out[d]["score"] == pytest.approx(score, rel=1e-3, abs=1e-3)


def test_language_model_odd(odd, empty):
    assert language_model.train_and_score(odd).count() == odd.count()
    assert language_model.train_and_score(empty).count() == 0
    assert language_model.score(odd.selectExpr("doc_id", "text", "true AS held_out"), language_model.train(empty)).where("n_known > 0").count() == 0


# 10


def test_language_mixture(docs, odd, empty):
    rng = random.Random(7)
    syllables = {"aa": "ka ko ku ta to".split(), "bb": "fri gro sche bli".split(), "cc": "ção ñez éir ùlu".split()}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    train = docs([(k, make(lang, 40), lang) for k, lang in enumerate(list(syllables) * 20)])
    langs, loglike = language_mix.train(train)
    tests = [(k, make(lang, 15), lang) for k, lang in enumerate(list(syllables) * 20)]
    got = {r["doc_id"]: r for r in language_mix.identify(docs(tests), langs, loglike).collect()}
    assert all(got[k]["lang_pred"] == lang and got[k]["languages"] == [lang] for k, _, lang in tests)
    mixed = language_mix.identify(docs([(1, f"{make('aa', 60)} {make('bb', 30)}"), (2, "123 !?"), (3, None)]), langs, loglike).collect()
    assert mixed[0]["languages"] == ["aa", "bb"] and 0.5 < mixed[0]["score"] < 0.9
    assert [(r["lang_pred"], r["score"]) for r in mixed[1:]] == [("und", 0.0)] * 2
    assert language_mix.identify(odd, langs, loglike).count() == odd.count() and language_mix.identify(empty, langs, loglike).count() == 0
    none, table = language_mix.train(empty)
    assert none == [] and {r["lang_pred"] for r in language_mix.identify(odd, none, table).collect()} == {"und"}
