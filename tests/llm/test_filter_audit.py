"""The filter audit against its definition, on odd input too."""

import re
from itertools import permutations

from pyspark.sql import functions as F

from tallymill.llm import filter_audit


def plain(rows, labels):
    """By the definition: each order is applied, document by document."""
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    docs = []
    for d, t, _, source in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        docs.append((source or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(removed)
                redundant = sum(f in x[1] for x in own) - len(removed)
                out[part, "".join(order), k + 1] = [len(left), len(removed), redundant, sum(x[1] == {f} for x in own), sum(x[2] for x in removed), sum(x[3] for x in removed)]
        for (p, order, k), x in out.items():
            if p == part:
                x.append(shapley[order[k - 1]])
    return out


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_odd_documents(spark, docs):
    many = " ".join(f"w{k}" for k in range(60))
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, "", None, ""), (4, many, "en", "a"), (5, many, "en", "b"), (5, many, "en", "b"), (6, many + " #", "en", "a"), (7, "THE END " * 40, "en", "a"), (8, "x " * 50_000, "en", "a"),
            (9, "same\tsame\x0bother " * 30, "en", "b"), (None, many, "en", "a"), (None, many, "en", "a"), (-3, many, "en", "hot"), (10, "É" * 200 + " Ü", "en", "c"), *[(20 + k, f"copy {many}", "en", "hot") for k in range(50)]]
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, None), (7, None, 1), (8, 0, 0), (99, 1, 1), (None, 1, 1), (21, 1, 1)]
    made = docs(rows).repartition(6).withColumns({c: F.lit(2) for c in ("part", "id", "row_key", "word", "digest", "C", "words", "failing")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("source", F.lit("z"))
    assert got(filter_audit.audit(made, marks)) == plain(rows, labels)


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, none).count() == 0
    out = got(filter_audit.audit(docs([(1, "a b", "en", "s")]), none))
    assert len(out) == 600 and out["s", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


def test_only_texts_are_shuffled_for_the_words(docs):
    plan = filter_audit.word_totals(filter_audit.keyed(docs([(1, "a b", "en", "s")])))._jdf.queryExecution().executedPlan().toString()
    words = plan[: plan.index("Generate")]
    assert words.count("Exchange") == 1  # by document, after the totals; none has a row for each word
