"""Near-duplicate components by an exact n-gram Jaccard join with T-occurrence search.

1. Texts are hashed to shingle sets where they are needed: once for two fingerprints and
   counts, once for prefixes, and a third time only those that may have links. So no
   copy of all sets, which are larger than the texts, is stored. Texts with equal sets
   form a class; one document stands for it.
2. Shingles get one global order, rare before frequent. Frequent ones are known
   from counts over all texts, kept in bitmaps of fixed size; a mistaken bit moves a
   shingle in the order and never changes the result.
3. A class's prefix in that order is indexed. Short lists (at most ``SHORT`` classes)
   are merged, and a pair is tied when it occurs often enough in them for the overlap
   that its sizes require, less what long lists could add. Only classes whose
   prefix has more long lists than that, those with about ``percent`` of their
   shingles frequent, are tied to the long list's pivot instead.
4. Ties give clusters; each class's set travels to its cluster in blocks of bounded
   size. In a block pair, every class is a query of DivideSkip: the longest lists of
   its shingles are put aside, the short ones heap-merged, and classes that reach the
   required count less the number of long lists are probed in the long lists by
   binary search. What reaches the overlap is a link.
5. A large cluster is not searched in all block pairs. Each block is searched in itself
   and against the cluster's first block, which stands for it; then only blocks of
   classes outside the largest component so far are searched against all others. So
   a group of near copies costs in proportion to its size, and classes that no
   representative connects are still held against everything.
6. Links give components.

Every step is exact: a link between two texts is in one prefix pair, hence in one
cluster; at the end both are connected or their blocks were searched. Links within
what is already connected are not sought, so their number is not known.

Null, empty or blank text: no shingles, no links, its own component. Null doc_id: a
row with a null component. Rows with one doc_id are one document for links. Equal
texts are one class; ties in size or frequency are ordered by hash. A very long text
is one set, held whole by one task at a time. An empty table gives no rows. Extra
columns are ignored (``keep_one`` hands them on, whatever their names).
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bitmap
from .graph import components
from .scratch import written
from .words import block_words, blocks, mix, shingles

#: Longest inverted list that is merged over all classes.
SHORT = 12
#: A prefix is longer than it must be by this fraction of the set, so that many long lists can be skipped.
EXTRA = 0.05
#: Frequencies from which a shingle belongs to the next later part of the order.
LEVELS = (SHORT + 1, 100, 1_000, 10_000)
BLOCK = 256
#: DivideSkip's weight of a binary search against a merged entry.
MU = 0.0085
_WINDOW = 2_000_000
_PROFILE = "doc_id long, n long, f1 long, f2 long, c long"


def _text_sets(batches, width):
    """(batch, row, set) of each text in column 1, block by block; a set's shingle hashes are sorted."""
    for batch in batches:
        at = 0
        for _, block in blocks(batch.column(1).to_pylist()):
            h, bounds = block_words(block)
            for k in range(len(block)):
                yield batch, at + k, np.unique(shingles(h[bounds[k] : bounds[k + 1]], width))
            at += len(block)


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def profile(docs: DataFrame, width: int) -> DataFrame:
    """n and two fingerprints of each document's set; rows with a count c are of shingle f1 within a task."""
    names = [c.split(" ")[0] for c in _PROFILE.split(", ")]

    def run(batches):
        seen, held, size, rows = set(), [], 0, []

        def out(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        def counts():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            none = [None] * int((c > 1).sum())
            return out(none, none, h[c > 1].view(np.int64), none, c[c > 1])

        for batch, k, s in _text_sets(batches, width):
            f1, f2 = int(s.sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
            rows.append((batch.column(0)[k].as_py(), len(s), _signed(f1), _signed(f2), None))
            if (f1, f2) not in seen:
                seen.add((f1, f2))
                held.append(s)
                size += len(s)
            if len(rows) >= 8192:
                yield out(*zip(*rows, strict=True))
                rows = []
            if size >= _WINDOW:
                yield counts()
                held, size = [], 0
                seen.clear()
        if rows:
            yield out(*zip(*rows, strict=True))
        if size:
            yield counts()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PROFILE)


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set it can link with."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - needed(n, percent) + 1 + int(EXTRA * n))


def prefixes(docs: DataFrame, width: int, percent: int, levels: list[np.ndarray]) -> DataFrame:
    """cid, n, and the set's prefix in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        ids, ns, keys, size = [], [], [], 0

        def out():
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys).view(np.int64)))], ["cid", "n", "keys"])

        for batch, k, s in _text_sets(batches, width):
            doc_id = batch.column(0)[k].as_py()
            if not len(s) or doc_id is None:
                continue
            level = np.zeros(len(s), np.uint8)
            for m in shared.value:
                level += bitmap.test(m, s)
            ids.append(doc_id)
            ns.append(len(s))
            keys.append(s[np.argsort(level, kind="stable")[: prefix_length(len(s), percent)]])
            size += len(keys[-1])
            if size >= 200_000:
                yield out()
                ids, ns, keys, size = [], [], [], 0
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "cid long, n long, keys array<long>")


def sets_of(docs: DataFrame, width: int, wanted: np.ndarray) -> DataFrame:
    """cid, n and the sorted set (packed) of documents whose id's bit is in ``wanted``."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        def keep():
            for batch in batches:
                ok = pa.array(bitmap.test(shared.value, mix(batch.column(0).to_numpy().view(np.uint64))))
                yield batch.filter(ok)

        ids, ns, packed, size = [], [], [], 0
        for batch, k, s in _text_sets(keep(), width):
            if not len(s):
                continue
            ids.append(batch.column(0)[k].as_py())
            ns.append(len(s))
            packed.append(s.tobytes())
            size += len(s)
            if size >= 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(packed, pa.binary())], ["cid", "n", "set"])
                ids, ns, packed, size = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(packed, pa.binary())], ["cid", "n", "set"])

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "cid long, n long, set binary")


def overlap_needed(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


def divide_skip(queries: list[np.ndarray], index: list[np.ndarray], percent: int, same: bool, labels: list[list[int]] | None = None) -> list[tuple[int, int]]:
    """Links (query, indexed) by T-occurrence search; if ``same``, index is queries and each pair comes once.

    Sets with equal labels (of queries, of index) are connected already. A set that
    is connected with the query drops out of its lists: only enough links to connect
    what is linked come out.
    """
    if labels is None:
        labels = [list(range(len(queries))), list(range(0 if same else len(queries), len(index) + (0 if same else len(queries))))]
    _, label = np.unique(np.concatenate([labels[0], [] if same else labels[1]]), return_inverse=True)
    shift = 0 if same else len(queries)

    # inverted lists: for each distinct shingle, the ascending indexed sets that have it
    every = np.concatenate(index)
    owner = np.repeat(np.arange(len(index)), [len(s) for s in index])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    words, start = np.unique(every, return_index=True)
    stop = np.append(start[1:], len(every))
    place = np.repeat(np.arange(len(words)), stop - start) * len(index) + owner  # ascending: lists one after the other
    sizes = [len(s) for s in index]
    links = []
    for q, s in enumerate(queries):
        at = np.searchsorted(words, s)
        at = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == s)]
        t = needed(len(s), percent)
        if len(at) < t:
            continue
        at = at[np.argsort(stop[at] - start[at], kind="stable")]
        # the longest lists are put aside, fewer than the required count
        n_long = min(t - 1, int(t / (MU * np.log2(max(2, stop[at[-1]] - start[at[-1]])) + 1)))
        short, long = at[: len(at) - n_long], np.sort(at[len(at) - n_long :])
        last = -1
        while True:
            open_ = label[shift:] != label[q]
            open_[: last + 1] = False
            if same:
                open_[q:] = False
            lists = [x for x in (owner[start[w] : stop[w]][open_[owner[start[w] : stop[w]]]].tolist() for w in short) if x] if open_.any() else []
            linked = False
            for k, entries in groupby(heapq.merge(*lists)):
                count = sum(1 for _ in entries)
                need = overlap_needed(len(s), sizes[k], percent)
                if count + n_long < need:
                    continue
                probe = long * len(index) + k
                found = np.minimum(np.searchsorted(place, probe), len(place) - 1)
                if count + int((place[found] == probe).sum()) >= need:
                    links.append((q, k))
                    label[label == label[k + shift]] = label[q]
                    last, linked = k, True
                    break  # what is connected now drops out of the lists
            if not linked:
                break
    return links


def _link_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each block pair (cluster, g1, s1, g2, s2), whose rows are together and in order."""
    keys = ["cluster", "g1", "s1", "g2", "s2"]

    def run(batches):
        key, group = None, []

        def out():
            left = [(c, x, s) for side, c, x, s in group if side == 0]
            right = [(c, x, s) for side, c, x, s in group if side == 1]
            same = key[1:3] == key[3:]
            if left and (right or same):
                other = left if same else right
                found = divide_skip([x[2] for x in left], [x[2] for x in other], percent, same, [[x[1] for x in left], [x[1] for x in other]])
                ends = [left[q][0] for q, _ in found], [other[k][0] for _, k in found]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(5)]
            side, cid, comp, packed = (batch.column(c).to_pylist() for c in (5, 6, 7, 8))
            for k, new in enumerate(zip(*cols, strict=True)):
                if new != key:
                    if group:
                        yield from out()
                    key, group = new, []
                group.append((side[k], cid[k], comp[k], np.frombuffer(packed[k], np.uint64)))
        if group:
            yield from out()

    return rows.repartition(*keys).sortWithinPartitions(*keys, "side", "n", "cid").select(*keys, "side", "cid", "comp", "set").mapInArrow(run, "a long, b long")


def _block_rows(members: DataFrame) -> DataFrame:
    """Members (cluster, cid, n, set, comp, g, rest) once for each block pair that they are in.

    With ``rest`` false everywhere (first search): own block, and the first block of
    equal or adjacent size. Otherwise: members with ``rest`` against all blocks of equal
    or adjacent size, others against the blocks of members with ``rest``. Blocks of
    the others have numbers below 0.
    """
    tally = members.groupBy("cluster", "g").agg(F.count_if("rest").alias("rest"), F.count_if(~F.col("rest")).alias("other"))
    held = lambda c: F.expr(f"({c} + {BLOCK - 1}) div {BLOCK}")
    tally = tally.select("cluster", F.struct("g", held("rest").alias("rest"), held("other").alias("other")).alias("t"))
    tally = tally.groupBy("cluster").agg(F.collect_list("t").alias("tally"))  # one for each size class of a cluster: the logarithm of a size
    rows = members.join(tally, "cluster")
    of = lambda g, c: F.coalesce(F.get(F.filter("tally", lambda t: t["g"] == g), 0)[c], F.lit(0).cast("long"))
    g, one, zero = F.col("g"), F.lit(1).cast("long"), F.lit(0).cast("long")
    hashed = F.xxhash64("cid")
    own = F.when(F.col("rest"), F.pmod(hashed, of(g, "rest"))).otherwise(-1 - F.pmod(hashed, of(g, "other")))
    rows = rows.withColumn("s", own).withColumn("first", F.expr("aggregate(tally, 0L, (m, t) -> m + t.rest) = 0"))
    s = F.col("s")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    def targets(h: Column) -> Column:
        every, lowest = span(-of(h, "other"), of(h, "rest") - 1), -of(h, "other")
        leading = F.when(of(h, "other") > 0, F.array(-one)).otherwise(F.array().cast("array<bigint>"))
        first = F.when(s == -1, span(lowest, -one)).otherwise(leading)
        return F.when(F.col("first"), first).when(F.col("rest"), every).otherwise(span(zero, of(h, "rest") - 1))

    def pair(g1, s1, g2, s2, side):
        return F.struct(g1.alias("g1"), s1.alias("s1"), g2.alias("g2"), s2.alias("s2"), side.cast("int").alias("side"))

    same = F.array_distinct(F.concat(targets(g), F.when(F.col("first") | F.col("rest"), F.array(s)).otherwise(F.array().cast("array<bigint>"))))
    own = F.transform(same, lambda o: pair(g, F.least(s, o), g, F.greatest(s, o), (s > o).cast("int")))
    up = F.transform(targets(g + 1), lambda o: pair(g, s, g + 1, o, F.lit(0)))
    down = F.transform(targets(g - 1), lambda o: pair(g - 1, o, g, s, F.lit(1)))
    return rows.select("cluster", "cid", "n", "set", "comp", F.explode(F.concat(own, up, down)).alias("p")).select("cluster", "p.*", "cid", "n", "comp", "set")


def candidate_ties(entries: DataFrame, percent: int) -> DataFrame:
    """Ties (a, b) such that every link is within a cluster of ties. entries: cid, n, keys."""
    flat = written(entries, "prefixes", "none").select("cid", "n", F.explode("keys").alias("key"))
    lists = flat.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = written(flat.join(lists, "key"), "shared-keys")

    member = F.struct("cid", "n")
    short = shared.where(F.col("held") <= SHORT).groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("members"))  # at most SHORT
    pairs = F.flatten(F.transform("members", lambda x, i: F.transform(F.slice("members", i + 2, SHORT), lambda y: F.struct(x["cid"].alias("a"), x["n"].alias("na"), y["cid"].alias("b"), y["n"].alias("nb")))))
    pairs = short.select(F.explode(pairs).alias("p")).select("p.*")
    pairs = pairs.where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
    rest = lambda n: F.expr(f"{n} - least({n}, {n} - ({percent} * {n} + 99) div 100 + 1 + int({EXTRA}D * {n}))")
    extra = lambda n: F.expr(f"int({EXTRA}D * {n})")
    overlap = F.expr(f"({percent} * (na + nb) + {100 + percent - 1}) div {100 + percent}")
    least = F.greatest(F.lit(1), overlap - F.greatest(rest("na"), rest("nb")) - F.greatest(extra("na"), extra("nb")))
    merged = pairs.groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= least).select("a", "b")

    # classes whose prefix has more long lists than the merge may skip
    longs = F.count(F.lit(1)).over(Window.partitionBy("cid"))
    tied = shared.where(F.col("held") > SHORT).withColumn("longs", longs).where(F.col("longs") > extra("n")).select("cid", "key")
    pivots = tied.groupBy("key").agg(F.min("cid").alias("pivot"))
    stars = tied.join(pivots, "key").select(F.col("cid").alias("a"), F.col("pivot").alias("b")).where("a <> b")
    return merged.unionByName(stars)


def size_class(percent: int):
    """Sets that can link are in equal or adjacent classes."""
    return F.floor(F.log(F.col("n").cast("double")) / (F.log(F.lit(100.0 / percent)) * 1.0001)).cast("long")


def _linked(docs: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, component) of classes with links; clusters: cid, cluster."""
    members = sets_of(docs, width, _id_bitmap(clusters)).join(clusters, "cid").withColumn("g", size_class(percent))
    members = written(members, "members", "none")
    first = members.withColumn("comp", F.col("cid")).withColumn("rest", F.lit(False))
    links = written(_link_blocks(_block_rows(first), percent), "links")
    found = components(links, "linked")

    # the components of each cluster are counted before anything is dealt out by cluster
    large = members.groupBy("cluster", "g").count().where(F.col("count") > BLOCK).select("cluster").distinct()
    comp = F.coalesce("component", "cid").alias("comp")
    found_of = found.withColumnRenamed("id", "cid")
    parts = members.select("cluster", "cid").join(found_of, "cid", "left").groupBy("cluster", comp).count()
    tally = parts.join(large, "cluster", "left_semi").groupBy("cluster").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count(F.lit(1)).alias("parts"))
    tally = written(tally.where("parts > 1").select("cluster", "main"), "split-clusters")
    if tally.isEmpty():
        return found
    rest = members.join(tally, "cluster").join(found_of, "cid", "left").withColumn("comp", comp)
    rest = rest.select("cluster", "cid", "n", "set", "comp", "g", (F.col("comp") != F.col("main")).alias("rest"))
    more = _link_blocks(_block_rows(written(rest, "rest", "none")), percent)
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), "all-linked")


def link(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id and n_copies (documents with the same set) of each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    seen = written(profile(docs, width), "profile")
    each = seen.where("c IS NULL").select("doc_id", "n", "f1", "f2")
    frequent = seen.where("c IS NOT NULL").groupBy(F.col("f1").alias("h")).agg(F.sum("c").alias("c")).where(F.col("c") >= LEVELS[0])
    levels = bitmap.build(frequent, F.col("h"), [F.col("c") >= least for least in LEVELS])

    classes = each.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("n_copies"))
    classes = written(classes, "classes")
    entries = prefixes(docs, width, percent, levels).join(classes.select("cid"), "cid", "left_semi")
    clusters = components(candidate_ties(entries, percent), "clusters").select(F.col("id").alias("cid"), F.col("component").alias("cluster"))
    found = _linked(docs, written(clusters, "clusters"), width, percent).select(F.col("id").alias("cid"), F.col("component").alias("linked"))

    named = classes.join(found, "cid", "left").select("f1", "f2", "n", F.coalesce("linked", "cid").alias("component"), "n_copies")
    out = each.join(named, ["f1", "f2", "n"], "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id")).alias("component_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies")
    )


def _id_bitmap(df: DataFrame) -> np.ndarray:
    """Bitmap of mixed ids; the mixing is done in tasks, as in ``sets_of``."""

    def run(batches):
        for batch in batches:
            h = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return bitmap.build(df.select("cid").mapInArrow(run, "h long"), F.col("h"))[0]


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` that stand for their group: the smallest doc_id of each component. Null ids and texts without words stay."""
    result = link(docs, width, percent)
    gone = result.where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
