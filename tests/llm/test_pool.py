"""Co-training on a pool in Spark against the same steps on arrays."""

import numpy as np
from pyspark.sql import functions as F

from tallymill.llm import quality


def plain(views, y, pool, place, rounds=5, share=0.02):
    given = [{}, {}]

    def fit(v):
        own = sorted(given[v])
        x = np.vstack([views[v], pool[v][own]])
        return quality.Logistic().fit(x, np.concatenate([y, [given[v][k] for k in own]]), np.concatenate([np.ones(len(y)), np.full(len(own), 0.5)]))

    models = [fit(0), fit(1)]
    for _ in range(rounds):
        for v in (0, 1):
            logit = models[v].logit(pool[v])
            for label in (0, 1):
                sure = [k for k in np.lexsort([place, -np.abs(logit)]) if abs(logit[k]) > 3 and (logit[k] > 3) == bool(label) and k not in given[1 - v]]
                given[1 - v].update(dict.fromkeys(sure[: max(1, int(share * len(logit) * (y == label).mean()))], label))
        models = [fit(0), fit(1)]
    return models, given


def test_every_unlabelled_row_can_get_a_label(spark):
    rng = np.random.default_rng(4)
    n = 24_000
    kind = rng.integers(0, 2, n + 300)
    text = rng.normal(0, 1, (n + 300, 12)) + 1.5 * kind[:, None]
    meta = np.stack([rng.normal(0, 1, n + 300) + 2 * kind, rng.integers(0, 30, n + 300) + 30 * kind, rng.integers(0, 9, n + 300), rng.integers(0, 9, n + 300)], 1)
    rows = [(t.tolist(), float(m[0]), *map(int, m[1:]), k) for k, (t, m) in enumerate(zip(text[:n], meta[:n], strict=True))]
    pool = spark.createDataFrame(rows, "measures array<double>, log_chars double, source_bucket int, lang_bucket int, host_bucket int, k long").withColumn("place", F.xxhash64("k")).cache()
    place = np.array([r[0] for r in pool.orderBy("k").select("place").collect()], np.int64).view(np.uint64)
    y, hot = kind[n:], quality.one_hot(meta)
    expected, given = plain([text[n:], hot[n:]], y, [text[:n], hot[:n]], place)
    assert min(map(len, given)) > 1000
    for got, model in zip(quality.co_train([text[n:], hot[n:]], y, pool), expected, strict=True):
        assert np.allclose(got.slope, model.slope, atol=1e-4) and abs(got.intercept - model.intercept) < 1e-3


def test_classes_that_can_be_told_apart():
    """Whole Newton steps run away here; damped ones end at the penalised maximum, whatever they start from."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    x[:, 0] += 4 * y
    model = quality.Logistic().fit(x, y)
    z = np.hstack([np.ones((400, 1)), (x - x.mean(0)) / (x.std(0) + 1e-6)])
    for start in (np.zeros(6), np.full(6, 40.0), np.array([-300.0, 0, 9, 0, 0, 1])):
        ascent = quality.Ascent(start, 1.0)
        for _ in range(100):
            ascent.tell(quality.log_likelihood(z, y, 1.0, ascent.beta))
        assert ascent.done and np.allclose(z @ ascent.kept, model.logit(x), atol=1e-3)
    gradient = quality.log_likelihood(z, y, 1.0, ascent.kept)[1:7] - ascent.penalty * ascent.kept
    assert np.abs(gradient).max() < 1e-4 and ((model.logit(x) > 0) == y).all()
