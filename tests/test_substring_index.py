"""Substring search by grams against a scan, and how little of the table it reads."""

import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators import substring_index as si


@pytest.fixture
def names(spark, monkeypatch):
    monkeypatch.setattr(si, "BLOCK_ROWS", 20)
    rng = random.Random(2)
    words = ["Report", "annual", "Ünïcode", "50% off", "a_b", "back\\slash", "İstanbul", "x", "日本語テキスト", "the", "THE", "tab\tbed"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))), k % 3) for k in range(2000)] + [(5, "a second row of one id", 1), (None, "no id", 1), (2001, None, 1), (2002, "", 1), (2003, "needle in Haystack", 1)]
    return spark.createDataFrame(rows, "id long, name string, kind int").withColumns({"gram": F.lit("g"), "n": F.lit(1)})


def ids(df):
    return sorted((r["id"], r["name"]) for r in df.collect())


def read_rows(df, of):
    """Rows that the scans of a table have put out, by the metrics of the executed plan."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if kind.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in kind:
            todo.append(node.plan())
        elif kind.startswith("Scan") and of in node.toString():
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


def test_same_rows_as_a_scan(spark, names, tmp_path):
    index = si.build(names, f"{tmp_path}/index")
    usable = names.where("id IS NOT NULL")
    for pattern in ["report", "REPORT", "ort ann", "50% off", "50\\% off", "a_b", "a\\_b", "ünï", "the%report", "x", "", "%", "日本", "本語テ", "nowhere at all", "b\tbed", "i̇st", "second ROW", "back\\\\slash", "ab"]:
        got = si.search(spark, index, pattern)
        assert got.columns == names.columns
        assert ids(got) == ids(usable.where(F.col("name").ilike(f"%{pattern}%"))), pattern


def test_reads_little(spark, names, tmp_path):
    index = si.build(names, f"{tmp_path}/index")
    assert index.blocks > 90
    found = si.candidates(spark, index, "needle in hay")
    assert ids(found) == [(2003, "needle in Haystack")]
    assert read_rows(found, "/rows") < 200 and read_rows(si.stored(spark, index), "/rows") == 2003
    assert read_rows(found, "/postings") <= 8 * si.PAGE_ROWS < 0.5 * spark.read.parquet(f"{index.path}/postings").count()
    assert si.rarest(spark, index, "ab") is None and si.rarest(spark, index, "zzzq") == [] and si.candidates(spark, index, "zzzq").count() == 0


def test_empty_table(spark, names, tmp_path):
    index = si.build(names.limit(0), f"{tmp_path}/index")
    assert si.search(spark, index, "report").count() == 0 and si.search(spark, index, "x").count() == 0
