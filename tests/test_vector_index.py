"""The inverted file against exact search: equal with all lists, and recall with few."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.operators import vector_index as vi
from tallymill.operators import vectors as vc
from tallymill.plans import retrieval

@pytest.fixture
def points(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    rows = [(k, int(k % 4), f"d{k % 50}", v.tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, tenant_id long, document_id string, embedding array<double>")


def exact(points, queries, k):
    return vc.top_k_each(points.withColumn("all", F.lit(0)), queries, k, "all").select("query_id", "id", "score")


def test_recall_and_pruning(spark, points, tmp_path):
    index = vi.build(points, f"{tmp_path}/index")
    assert len(index.centroids) == 55 and vi.points_of(spark, index, points.schema).count() == 3000
    queries = points.where("id % 20 = 0").select("id", "embedding")
    truth = exact(points, queries, 10).cache()
    shares = {}
    for probes in (1, 8, 55):
        found = vi.search_each(spark, index, points.schema, queries, 10, probes)
        r = vi.recall(found, truth).agg(F.sum("n_found") / F.sum("n_exact")).first()[0]
        shares[probes] = r
    assert shares[8] >= 0.9 and shares[55] == 1.0 and shares[1] < shares[8]
    assert index.probes < 20 and vi.recall(vi.search_each(spark, index, points.schema, queries, 10), truth).agg(F.sum("n_found") / F.sum("n_exact")).first()[0] >= 0.9
    # a search of one query reads only its lists
    query = points.where("id = 20").first()["embedding"]
    out = vi.search(spark, index, points.schema, query, 5, probes=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "vector_list" in plan.split("PartitionFilters")[1][:200]
    assert [r["id"] for r in out.collect()][0] == 20


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_recall(spark, sf):
    """The vectors of the test tables have no clusters, so most lists are read."""
    r = retrieval.index_recall(spark, f"/root/testdata/{sf}").agg(F.sum("n_found").alias("f"), F.sum("n_exact").alias("n"), F.count("*").alias("q")).first()
    assert r["q"] in (25, 100) and r["n"] == 10 * r["q"] and r["f"] >= 0.9 * r["n"]


def test_a_filter_makes_the_search_wider(spark, points, tmp_path):
    index = vi.build(points, f"{tmp_path}/index", lists=30)
    query = [1.0] * 16
    for probes in (1, 30):
        got = vi.search(spark, index, points.schema, query, 40, probes, tenant_id=2, document_ids=["d2", "d6"])
        assert got.count() == 40
    want = vc.top_k(vc.payload_filter(points, 2, ["d2", "d6"]), query, 40)
    assert [(r["id"], r["score"]) for r in got.collect()] == [(r["id"], r["score"]) for r in want.collect()]


def test_odd_vectors(spark, tmp_path):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [0.0, 0.0]), (3, 1, None), (4, 1, [1.0]), (5, 1, [1.0, None]), (6, 1, [2.0, 0.0]), (6, 1, [2.0, 0.0]), (7, 1, [0.0, 1.0]), (8, 1, [])]
    points = spark.createDataFrame(rows, "id long, tenant_id long, embedding array<double>").withColumn("matrix", F.lit("x"))
    index = vi.build(points, f"{tmp_path}/odd", lists=3)
    assert [r["id"] for r in vi.search(spark, index, points.schema, [1.0, 0.0], 9, 3).collect()] == [1, 6, 6, 2, 7]
    queries = points.where("id IN (1, 3, 4)").select("id", "embedding")
    assert [r["id"] for r in vi.search_each(spark, index, points.schema, queries, 2, 3).orderBy("rank").collect()] == [6, 6]
    assert [(r["query_id"], r["id"]) for r in vc.top_k_each(points, queries, 1, "tenant_id").collect()] == [(1, 6)]
    empty = vi.build(points.limit(0), f"{tmp_path}/empty")
    assert vi.search(spark, empty, points.schema, [1.0], 3).count() == 0


def test_patch_of_clashing_names(spark):
    points = spark.createDataFrame([(1, 1, "d", "n", "kept"), (2, 1, "e", "m", "kept")], "id long, tenant_id long, document_id string, document_name string, _document_name string").withColumn("point", F.lit(1))
    changes = spark.createDataFrame([(1, "d", "new", "other")], "tenant_id long, document_id string, document_name string, _document_name string")
    out = vc.patch(points, changes, ["document_name"])
    assert out.columns == points.columns and sorted((r["document_name"], r["_document_name"]) for r in out.collect()) == [("m", "kept"), ("new", "kept")]
