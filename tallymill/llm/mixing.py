"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree of domains, languages and sources in proportion
to weights. A child gets no more than its subtree can give (its tokens times
``max_epochs``); what it cannot take goes to its siblings by their weights, and
only what all siblings cannot take is left to the level above, because a parent
never asks more of a subtree than it holds. Allotments are whole tokens, rounded
down. Each leaf then takes a prefix of its tokens in the order of seeded epochs:
whole epochs first, then documents of the next epoch by ``md5(seed:epoch:doc_id)``
up to the token at which the allotment ends.

The prefix is found without one task holding a leaf: tokens are summed in 4096
ranges of the order (``16 ** buckets_hex``), one range of each leaf holds the end, and
only that range's documents are summed one by one. The sources of one language of a
domain are shared out in one window: they are rows of a table of leaves, not of
documents.

A very long text is only counted. Null text has no tokens; null lang and source are the leaf ``und`` and ``none``.
Rows with no token taken are left out, so an empty table gives no rows. Repeated
rows are rows of their own; among equal order keys the smaller row comes first.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

WORD = r"[^\x20\x09-\x0D]+"
LEAF = ["domain", "lang", "source"]
#: Weights of the production mix; what is not named has weight 5 (sources: 1).
DOMAIN_WEIGHTS = {"web": 40, "books": 30, "news": 20, "code": 10}
LANG_WEIGHTS = {"en": 50, "fr": 20, "de": 20, "es": 10}


def domain_of_source() -> Column:
    """web, books, news or code by the number in the source's name; other without one."""
    number = F.regexp_extract("source", "([0-9]{1,9})", 1)
    names = F.array(*map(F.lit, ("web", "books", "news", "code")))
    return F.when(number == "", F.lit("other")).otherwise(F.coalesce(F.get(names, number.try_cast("int") % 4), F.lit("other")))


def _weight(column: str, weights: Mapping[str, int], other: int) -> Column:
    w = F.lit(other)
    for name, value in weights.items():
        w = F.when(F.col(column) == name, value).otherwise(w)
    return w.cast("long")


def split_budget(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``allot`` to children (weight, cap, budget of the parent).

    In the order of cap / weight, children are full as long as their cap is at most
    their share of what the full ones before them leave; the others share the rest.
    """
    group = [F.col(c) for c in parent] or [F.lit(0)]
    order = Window.partitionBy(*group).orderBy(F.col("cap") / F.col("weight"), name)
    whole = Window.partitionBy(*group)
    full = F.col("cap") * F.col("rest_weight") <= (F.col("budget") - F.col("cap_before")) * F.col("weight")
    return (
        children.withColumn("cap_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", full)
        .withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
        .withColumn("sharing", F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole))
        .withColumn("allot", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("left * weight div sharing")))
        .drop("cap_before", "rest_weight", "full", "left", "sharing", "budget", "weight", "cap")
    )


def leaf_budgets(leaves: DataFrame, budget: tuple[int, int], max_epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """domain, lang, source, tokens and allot of each leaf. budget: a fraction of all tokens."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    other = {"domain": 5, "lang": 5, "source": 1}
    given = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {budget[0]} div {budget[1]}").alias("budget"))
    level = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(given))  # one row
    level = split_budget(level.withColumn("weight", _weight("domain", weights.get("domain", {}), other["domain"])), [], "domain")
    for depth in (2, 3):
        keys, name = LEAF[:depth], LEAF[depth - 1]
        parents = level.withColumnRenamed("allot", "budget")
        caps = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(name, weights.get(name, {}), other[name]))
        level = split_budget(caps.join(parents, keys[:-1]), keys[:-1], name)
    return leaves.select(*LEAF, "tokens").join(level, LEAF)


def mix_sources(
    docs: DataFrame,
    budget: tuple[int, int] = (3, 5),
    max_epochs: int = 2,
    seed: int = 17,
    weights: Mapping[str, Mapping[str, int]] | None = None,
    domain: Column | None = None,
    buckets_hex: int = 3,
) -> DataFrame:
    """doc_id, leaf, n_tokens, whole epochs, prefix_tokens of the next and taken_tokens of each chosen document."""
    weights = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS} if weights is None else weights
    meta = docs.select(
        "doc_id",
        (domain_of_source() if domain is None else domain).alias("domain"),
        F.coalesce("lang", F.lit("und")).alias("lang"),
        F.coalesce("source", F.lit("none")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    meta = written(meta.where("n_tokens > 0"), "mix")
    leaves = meta.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    leaves = written(leaf_budgets(leaves, budget, max_epochs, weights).selectExpr(*LEAF, "allot div tokens AS epochs", "allot % tokens AS rest"), "mix-leaves")

    # a document's place in its leaf's order is hashed for the leaf's own number of whole epochs
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = meta.join(leaves, LEAF).withColumn("order_key", key).withColumn("range", F.conv(F.substring("order_key", 1, buckets_hex), 16, 10).cast("int"))
    ranges = rows.groupBy(*LEAF, "range").agg(F.sum("n_tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = rows.withColumnRenamed("rest", "leaf_rest").join(ranges.withColumn("before", before), [*LEAF, "range"])
    state = F.when(F.col("before") + F.col("tokens") <= F.col("leaf_rest"), "in").when(F.col("before") >= F.col("leaf_rest"), "out").otherwise("end")
    chosen = chosen.withColumn("state", state)
    w = Window.partitionBy(*LEAF).orderBy("order_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        chosen.where("state = 'end'")
        .withColumn("here", F.col("before") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
        .withColumn("prefix_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("leaf_rest") - F.col("here"))))
    )
    out = ["doc_id", *LEAF, "n_tokens", "epochs", "prefix_tokens"]
    sure = chosen.where("state <> 'end'").withColumn("prefix_tokens", F.when(F.col("state") == "in", F.col("n_tokens")).otherwise(F.lit(0)))
    both = sure.select(*out).unionByName(ends.select(*out))
    return both.withColumn("taken_tokens", F.col("epochs") * F.col("n_tokens") + F.col("prefix_tokens")).where("taken_tokens > 0")
