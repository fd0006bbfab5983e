"""Document quality by co-training two views.

The text view sees measures of the content; the metadata view sees source,
language, length and what the pages' addresses say of a document. Both begin from
the same labelled rows. In each round, each labels the pool's documents of which it
is surest for the other one. Then both are calibrated on labelled rows that
neither was trained on, and a last logistic model on the two calibrated log-odds
scores every document.

Labelled documents are a bounded sample, at most ``max_labelled`` in the order of a
hash of doc_id. The pool is every unlabelled document: the surest are picked by
exact cut-offs from counts, and Newton's sums are made where the rows are, so only
counts and sums reach the driver. Which labels a row was given follows from the
models and cut-offs of the rounds before; copies of a row are given the same. A
round passes over the pool for its cut-offs and once more to write the rows that have
labels as a table of their own, which is all that its fit reads.

Null or empty text has measures of zero; null metadata is a value of its own. With
no labels, or one class only, every score is the share of good labels (1 without
any). A doc_id with several labels takes their mean, good if it is at least a
half. Repeated rows get equal scores; ties in confidence are taken in the order of a
hash of doc_id. A very long text is measured whole. An empty table gives no rows.
Extra columns are ignored or, in ``keep_good``, stay, whatever their names.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

MEASURES = ("log_words", "word_length", "upper", "digit", "mark", "symbol", "bar", "other", "distinct", "repeated", "line_words", "repeated_lines")
#: One-hot buckets of the metadata view, and their seeds: the view's size does not depend on the data.
BUCKETS = {"source": 64, "lang": 16, "host": 64}
MAX_LABELLED, ROUNDS, SHARE = 20_000, 5, 0.02


def _class_table() -> np.ndarray:
    t = np.full(256, 6, np.int64)
    t[[*range(97, 123), *range(128, 256), 32, 10, 13, 9, 46, 44]] = 0
    t[65:91], t[48:58], t[33] = 1, 2, 3
    for c in b"#$%&*@^~<>=_+\\/{}[]":
        t[c] = 4
    t[124] = 5
    return t


_CLASS = _class_table()


def measures_of(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(MEASURES)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    share = np.bincount(_CLASS, np.bincount(data, minlength=256), 7) / len(data)
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    m = max(1, len(lines))
    return [
        float(np.log1p(len(words))), min(40.0, len(text) / n), *map(float, share[1:7]), len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        float(np.log1p(n / m)), 1 - len(set(lines)) / m,
    ]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_chars and the measures of each row's text."""
    names = ["doc_id", "lang", "source", "n_chars", "measures"]

    def run(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            values = np.array([measures_of(t) for t in texts], np.float64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(MEASURES)), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(t or "") for t in texts], pa.int64()), lists], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    return rows.mapInArrow(run, "doc_id long, lang string, source string, n_chars long, measures array<double>")


def page_hosts(pages: DataFrame) -> DataFrame:
    """doc_id and host: the last number in a page's path names its document; of several pages, the least host."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/[a-z]+/([0-9]{1,18})", 1)
    host = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1), r"^(www|m|blog)\.", "")
    rows = pages.select(F.when(path != "", path).cast("long").alias("doc_id"), host.alias("host")).where("doc_id is not null and host <> ''")
    return rows.groupBy("doc_id").agg(F.min("host").alias("host"))


def bucket(column: str) -> Column:
    return F.when(F.col(column).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(column), F.lit(BUCKETS[column] - 1))).cast("int").alias(f"{column}_bucket")


def features(docs: DataFrame, pages: DataFrame | None) -> DataFrame:
    rows = measure(docs)
    rows = rows.withColumn("host", F.lit(None).cast("string")) if pages is None else rows.join(page_hosts(pages), "doc_id", "left")
    return rows.select("doc_id", "measures", F.log1p("n_chars").alias("log_chars"), *map(bucket, BUCKETS))


def text_matrix(rows) -> np.ndarray:
    return np.array(rows["measures"].tolist(), float).reshape(-1, len(MEASURES))


def meta_matrix(rows) -> np.ndarray:
    parts = [rows["log_chars"].to_numpy(float)[:, None]]
    parts += [np.eye(size)[rows[f"{name}_bucket"].to_numpy(int)] for name, size in BUCKETS.items()]
    return np.hstack(parts)


class Ascent:
    """The maximum of a concave log-likelihood less a ridge (none to speak of on the intercept), by Newton's steps.

    A step goes no further than ``FAR`` in any direction and is halved until it climbs: where the classes can be told
    apart without a fault, whole steps overshoot and never come back.
    """

    FAR, ENOUGH = 4.0, 1e-6

    def __init__(self, beta: np.ndarray, ridge: float):
        self.beta, self.penalty = beta, np.concatenate([[1e-6], np.full(len(beta) - 1, ridge)])
        self.kept, self.value, self.step, self.move = beta, -np.inf, np.zeros(len(beta)), np.inf

    def tell(self, sums: np.ndarray) -> None:
        """Takes log-likelihood, gradient and curvature at ``beta`` and moves it."""
        n = len(self.beta)
        value = sums[0] - (self.penalty * self.beta**2).sum() / 2
        if value < self.value - 1e-12 * abs(self.value):
            self.step = self.step / 2
        else:
            self.kept, self.value = self.beta, value
            self.step = np.linalg.solve(sums[n + 1 :].reshape(n, n) + np.diag(self.penalty), sums[1 : n + 1] - self.penalty * self.beta)
            self.step = self.step * min(1.0, self.FAR / max(self.FAR, np.abs(self.step).max()))
        self.move = np.abs(self.step).max()
        self.beta = self.kept + self.step

    @property
    def done(self) -> bool:
        return self.move < self.ENOUGH


def log_likelihood(z: np.ndarray, y: np.ndarray, weight, beta: np.ndarray) -> np.ndarray:
    """Its value, gradient and curvature, one after the other."""
    at = z @ beta
    p = 1 / (1 + np.exp(-np.clip(at, -500, 500)))
    return np.concatenate([[(weight * (y * at - np.logaddexp(0, at))).sum()], z.T @ (weight * (y - p)), ((z.T * (weight * p * (1 - p))) @ z).reshape(-1)])


class Logistic:
    """Logistic regression on standardised columns, by Newton's method with a ridge."""

    def __init__(self, ridge: float = 1.0):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])
        ascent = Ascent(np.zeros(z.shape[1]), self.ridge)
        for _ in range(100):
            ascent.tell(log_likelihood(z, y, 1.0 if weight is None else weight, ascent.beta))
            if ascent.done:
                break
        return self.set(ascent.kept)

    def set(self, beta: np.ndarray) -> Logistic:
        self.slope = beta[1:] / self.scale
        self.intercept = float(beta[0] - self.mean @ self.slope)
        return self

    @classmethod
    def of(cls, mean: np.ndarray, scale: np.ndarray, beta: np.ndarray) -> Logistic:
        self = cls()
        self.mean, self.scale = mean, scale
        return self.set(beta)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.slope + self.intercept


#: Vectors that the driver adds up itself; those of more tasks are added in tasks first.
DIRECT = 64


def summed(rows: DataFrame, f, size: int, parts: int) -> np.ndarray:
    """Sum of f's vectors over the batches of all rows (in ``parts`` tasks), added up in a fixed order."""
    schema = "part int, total binary"

    def row(part, total):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def by_task(batches):
        yield row(TaskContext.get().partitionId(), sum((f(b) for b in batches), np.zeros(size)))

    def together(batches):
        got = sorted((p, t) for b in batches for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if got:
            yield row(got[0][0], sum((np.frombuffer(t) for _, t in got), np.zeros(size)))

    out = rows.mapInArrow(by_task, schema)
    if parts > DIRECT:
        out = out.repartition(DIRECT, "part").mapInArrow(together, schema)
    return sum((np.frombuffer(r["total"]) for r in sorted(out.collect())), np.zeros(size))


def pool_views(batch) -> list[np.ndarray]:
    """Measures, and log_chars with the buckets, of a batch."""
    names = ("log_chars", *(f"{name}_bucket" for name in BUCKETS))
    text = batch.column("measures").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))
    return [text, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1)]


def one_hot(meta: np.ndarray) -> np.ndarray:
    return np.hstack([meta[:, :1], *(np.eye(size)[meta[:, k].astype(int)] for k, size in enumerate(BUCKETS.values(), 1))])


def pool_logits(models: list[Logistic], views: list[np.ndarray]) -> list[np.ndarray]:
    """Row by row, so that a row's value does not depend on its batch."""
    (text, meta), slope, at = views, models[1].slope, 1
    other = models[1].intercept + meta[:, 0] * slope[0]
    for k, size in enumerate(BUCKETS.values(), 1):
        other = other + slope[at : at + size][meta[:, k].astype(int)]
        at += size
    return [(text * models[0].slope).sum(1) + models[0].intercept, other]


def surest(batch, views, models, given):
    """For each view and label: rows that may get it, and their keys, the surest first."""
    low = batch.column("place").to_numpy(zero_copy_only=False).view(np.uint64)
    for v, logit in enumerate(pool_logits(models, views)):
        high = ~np.abs(logit).view(np.uint64)
        for label in (0, 1):
            yield v, label, (np.abs(logit) > 3) & ((logit > 3) == bool(label)) & (given[1 - v] < 0), high, low


def labels_given(batch, history) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Views of a batch, and the pseudo-label of each row for each view, -1 without one."""
    views, given = pool_views(batch), [np.full(batch.num_rows, -1, np.int8) for _ in range(2)]
    for models, cuts in history:
        for (v, label, may, high, low), (h, m) in zip(list(surest(batch, views, models, given)), cuts, strict=True):
            given[1 - v][may & ((high < h) | ((high == h) & (low <= m)))] = label
    return views, given


#: Bits of a key that one pass counts by.
DIGIT = 12


def cut_offs(pool: DataFrame, history: list, models: list[Logistic], most: list[int], parts: int) -> list[tuple[np.uint64, np.uint64]]:
    """The last key to take for each view and label, so that the ``most`` surest rows are taken; digit by digit from counts."""
    size, places = 1 << DIGIT, [*range(64 - DIGIT, -1, -DIGIT), 0]  # shifts of a word's digits; the last one may overlap the one before
    known, left, done = [[] for _ in most], list(most), [False] * len(most)

    def digits(word: np.ndarray) -> list[np.ndarray]:
        return [(word >> np.uint64(p) & np.uint64(size - 1)).astype(np.int64) for p in places]

    for k in range(2 * len(places)):

        def count(batch, known=tuple(map(tuple, known)), k=k):
            views, given = labels_given(batch, history)
            out = []
            for (_, _, may, high, low), prefix in zip(surest(batch, views, models, given), known, strict=True):
                if len(prefix) == k and may.any():
                    high, low = high[may], low[may]
                    key = [*digits(high), *(digits(low) if k >= len(places) else [])]
                    same = np.ones(len(high), bool)
                    for d, p in zip(key, prefix, strict=False):
                        same &= d == p
                    out.append(np.bincount(key[k][same], minlength=size))
                else:
                    out.append(np.zeros(size, np.int64))
            return np.concatenate(out).astype(float)

        counts = summed(pool, count, size * len(most), parts).reshape(len(most), size).astype(int)
        for j in range(len(most)):
            total = counts[j].cumsum()
            if done[j]:
                continue
            at = int(np.searchsorted(total, left[j]))
            if at >= size:  # fewer than wanted: all of them
                done[j] = True
                continue
            known[j].append(at)
            done[j] = bool(total[at] == left[j])
            left[j] -= int(total[at] - counts[j][at])
        if all(done):
            break

    def end(prefix: list[int]) -> tuple[np.uint64, np.uint64]:
        """The largest key with these digits."""
        words = []
        for part in (prefix[: len(places)], prefix[len(places) :]):
            word, free = 0, (1 << 64) - 1
            for p, d in zip(places, part, strict=False):
                word |= d << p
                free &= (1 << p) - 1
            words.append(np.uint64(word | free))
        return words[0], words[1]

    return [end(p) for p in known]


def with_labels(pool: DataFrame, history: list) -> DataFrame:
    """The rows that have a pseudo-label for any view, with both (-1 for none), as a table: a few of all rows, which every pass of a fit reads."""

    def run(batches):
        for batch in batches:
            _, given = labels_given(batch, history)
            has = pa.array((given[0] >= 0) | (given[1] >= 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(g, pa.int8()) for g in given)], [*batch.schema.names, "given0", "given1"]).filter(has)

    rows = pool.mapInArrow(run, T.StructType([*pool.schema.fields, T.StructField("given0", T.ByteType()), T.StructField("given1", T.ByteType())]))
    return written(rows, "pseudo-labels")


def fit_all(views: list[np.ndarray], y: np.ndarray, taken: DataFrame, before: list[Logistic], parts: int) -> list[Logistic]:
    """Both views' models on the labelled rows and, at half weight, all rows with pseudo-labels (``taken``); as ``Logistic.fit``."""
    width = [v.shape[1] for v in views]

    def own(batch):
        values, given = pool_views(batch), [batch.column(c).to_numpy(zero_copy_only=False) for c in ("given0", "given1")]
        for v in (0, 1):
            has = given[v] >= 0
            yield v, (one_hot(values[1][has]) if v else values[0][has]), given[v][has].astype(float)

    def moments(batch):
        return np.concatenate([np.concatenate([[len(x)], (x - before[v].mean).sum(0), ((x - before[v].mean) ** 2).sum(0)]) for v, x, _ in own(batch)])

    total = np.split(summed(taken, moments, sum(2 * w + 1 for w in width), parts), [2 * width[0] + 1])
    mean, scale, ascents = [], [], []
    for v, w in enumerate(width):
        d = views[v] - before[v].mean
        n = total[v][0] + len(d)
        m = (total[v][1 : w + 1] + d.sum(0)) / n
        mean.append(before[v].mean + m)
        scale.append(np.sqrt(np.maximum(0, (total[v][w + 1 :] + (d**2).sum(0)) / n - m**2)) + 1e-6)
        ascents.append(Ascent(np.concatenate([[before[v].intercept + mean[v] @ before[v].slope], before[v].slope * scale[v]]), before[v].ridge))

    def sums_of(v, x, y, weight, beta):
        return log_likelihood(np.hstack([np.ones((len(x), 1)), (x - mean[v]) / scale[v]]), y, weight, beta)

    size = [1 + (w + 1) * (w + 2) for w in width]
    for _ in range(100):
        betas = [a.beta for a in ascents]
        sums = np.split(summed(taken, lambda batch, betas=betas: np.concatenate([sums_of(v, x, t, 0.5, betas[v]) for v, x, t in own(batch)]), sum(size), parts), [size[0]])
        for v, ascent in enumerate(ascents):
            if not ascent.done:
                ascent.tell(sums[v] + sums_of(v, views[v], y, 1.0, betas[v]))
        if all(a.done for a in ascents):
            break
    return [Logistic.of(m, s, a.kept) for m, s, a in zip(mean, scale, ascents, strict=True)]


def co_train(views: list[np.ndarray], y: np.ndarray, pool: DataFrame, rounds: int = ROUNDS, share: float = SHARE) -> list[Logistic]:
    """A model of each view, after each has labelled the pool's surest documents for the other in every round."""
    models, history, n, parts = [Logistic().fit(v, y) for v in views], [], pool.count(), pool.rdd.getNumPartitions()
    most = [max(1, int(share * n * (y == label).mean())) for _ in (0, 1) for label in (0, 1)]
    for _ in range(rounds if n else 0):
        history = [*history, (models, cut_offs(pool, history, models, most, parts))]
        taken = with_labels(pool, history)
        models = fit_all(views, y, taken, models, taken.rdd.getNumPartitions())
    return models


def sampled(rows: DataFrame, most: int):
    """The ``most`` rows (or all) that come first by a hash of doc_id, as pandas.

    Rows beyond twice the share that is wanted are filtered out before they are
    ordered, so tasks together send about twice ``most`` rows.
    """
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col("doc_id")), 33)
    share = min(1.0, 2 * most / max(1, rows.count()))
    return rows.where(place <= int(share * (1 << 31))).orderBy(place, "doc_id").limit(most).toPandas()


def score(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, max_labelled: int = MAX_LABELLED, threshold: float = 0.25) -> DataFrame:
    """doc_id, text_score, meta_score (calibrated), score and keep of every row of ``docs``."""
    rows = written(features(docs, pages), "quality")
    truth = labels.where("quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    labelled = sampled(rows.dropDuplicates(["doc_id"]).join(truth, "doc_id"), max_labelled)
    y = labelled["quality"].to_numpy(int)
    if len(set(y)) < 2:
        p = F.lit(float(y.mean()) if len(y) else 1.0)
        return rows.select("doc_id", p.alias("text_score"), p.alias("meta_score"), p.alias("score"), (p >= threshold).alias("keep"))
    place = F.xxhash64(F.lit("pool"), F.col("doc_id")).alias("place")
    pool = written(rows.join(truth, "doc_id", "left_anti").select("measures", "log_chars", *(f"{name}_bucket" for name in BUCKETS), place), "quality-pool")
    test = np.arange(len(y)) % 3 == 2
    if len(set(y[test])) < 2 or len(set(y[~test])) < 2:
        test[:] = True
    train = ~test if not test.all() else test
    views = [text_matrix(labelled), meta_matrix(labelled)]
    models = co_train([v[train] for v in views], y[train], pool)
    logits = [m.logit(v[test])[:, None] for m, v in zip(models, views, strict=True)]
    platt = [Logistic().fit(z, y[test]) for z in logits]
    last = Logistic().fit(np.hstack([p.logit(z)[:, None] for p, z in zip(platt, logits, strict=True)]), y[test])

    slope = list(map(float, models[0].slope))
    text = F.aggregate(F.zip_with("measures", F.array(*map(F.lit, slope)), lambda a, b: a * b), F.lit(models[0].intercept), lambda a, b: a + b)
    weights, at = models[1].slope, 1
    meta = F.lit(models[1].intercept) + F.col("log_chars") * float(weights[0])
    for name, size in BUCKETS.items():
        meta = meta + F.get(F.array(*map(F.lit, map(float, weights[at : at + size]))), F.col(f"{name}_bucket"))
        at += size
    calibrated = [logit * float(p.slope[0]) + p.intercept for logit, p in zip((text, meta), platt, strict=True)]
    both = calibrated[0] * float(last.slope[0]) + calibrated[1] * float(last.slope[1]) + last.intercept
    chance = lambda z: 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))))
    out = rows.select("doc_id", chance(calibrated[0]).alias("text_score"), chance(calibrated[1]).alias("meta_score"), chance(both).alias("score"))
    return out.withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, **parameters) -> DataFrame:
    """``docs`` without the rows whose doc_id is rejected; a null doc_id stays."""
    bad = score(docs, labels, pages, **parameters).where("not keep and doc_id is not null").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")
