import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotmark.operators import buckets, search
from plotmark.plans import fixtures


def test_cosine_distance(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])]
    got = [r.d for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select(search.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got[0] == 1 and abs(got[1]) < 1e-9 and math.isnan(got[2])


def test_vector_topk_ranks_within_the_address(spark):
    e = spark.createDataFrame([("c1", "a", [1.0, 0.0]), ("c2", "a", [1.0, 0.1]), ("c3", "a", [0.0, 0.0]), ("c4", "b", [1.0, 0.0]), ("c0", "a", [1.0, 0.0])], "chunk_id string, address_id string, embedding array<float>")
    q = spark.createDataFrame([("q", "a", 1, [1.0, 0.0])], "query_id string, address_id string, k int, vector array<float>")
    got = search.vector_topk(q, e).orderBy("vector_rank").collect()
    assert [r.chunk_id for r in got] == ["c0", "c1", "c2", "c3"] and math.isnan(got[-1].distance)
    assert search.vector_topk(q, e, depth=2).count() == 2
    joined = search.vector_topk(q, e, per_slice=1, per_part=2).orderBy("vector_rank").collect()
    assert [r.chunk_id for r in joined] == [r.chunk_id for r in got] and joined[:3] == got[:3]
    more = q.union(spark.createDataFrame([(f"q{i}", "b", 1, [0.5, float(i)]) for i in range(5)] + [("long", "a", 1, [1.0, 2.0, 3.0])], q.schema))
    rows = e.union(spark.createDataFrame([("c9", "b", None), ("c8", "b", [1.0])], e.schema))
    at_once, sliced = (sorted(map(str, search.vector_topk(more, rows, per_slice=n, per_part=n).collect())) for n in (10_000, 2))
    assert at_once == sliced and len(sliced) == 9


def test_fusion_sums_reciprocal_ranks(spark):
    v = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, chunk_id string, vector_rank int")
    t = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "query_id string, chunk_id string, rank int")
    assert {r.chunk_id: r.score for r in search.fuse(v, t).collect()} == {"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62}


def bucket_index(spark, e, tmp_path, **kinds):
    buckets.write_bucket_index(e, f"file://{tmp_path}/index", "hash:feature-64", **kinds)
    return buckets.read_bucket_index(spark, f"file://{tmp_path}/index", "hash:feature-64")


def test_buckets_of_clustered_vectors_spare_most_comparisons(spark, tmp_path):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(20, 32)) * 3
    x = centres[np.arange(600) % 20] + draw.normal(size=(600, 32)) * 0.5
    e = spark.createDataFrame([(f"c{i}", "a", v.tolist()) for i, v in enumerate(x)], "chunk_id string, address_id string, embedding array<float>")
    q = spark.createDataFrame([(f"q{i}", "a", 2, x[i].tolist()) for i in range(20)] + [("none", "a", 2, None), ("other", "b", 2, x[0].tolist())], "query_id string, address_id string, k int, vector array<float>")
    exact = {(r.query_id, r.chunk_id) for r in search.vector_topk(q, e).collect()}
    index = bucket_index(spark, e, tmp_path)
    found = buckets.hyperplane_topk(q, index, per_slice=4, per_part=50)
    near = {(r.query_id, r.chunk_id) for r in found.collect()}
    assert len(exact & near) >= 0.9 * len(exact) and index.tables == buckets.TABLES
    assert 0 < buckets.compared_share(q, index).first().share < 0.7
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "buckets" in plan and any("Join" in line and "bucket#" in line and "table_no#" in line for line in plan.splitlines())
    with pytest.raises(ValueError):
        buckets.read_bucket_index(spark, f"file://{tmp_path}/index", "another")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_buckets_find_most_neighbours_on_the_given_vectors(spark, sf, tmp_path):
    """These are nearly uniform, so the index may fall back on all buckets of one table; and as many rows as exact search gives."""
    q, e = fixtures.vector_queries(spark, f"/root/testdata/{sf}"), fixtures.vectors(spark, f"/root/testdata/{sf}")
    index = bucket_index(spark, e, tmp_path)
    exact, near = search.vector_topk(q, e).collect(), buckets.hyperplane_topk(q, index)
    assert near.count() == len(exact) and search.recall_of(near, spark.createDataFrame(exact)).first().recall >= 0.9
    assert buckets.compared_share(q, index).first().share <= 1


def test_another_model_and_a_second_write_leave_the_index_whole(spark, tmp_path):
    e = spark.createDataFrame([("c1", "a", [1.0, 0.0]), ("c2", "a", [0.0, 1.0])], "chunk_id string, address_id string, embedding array<float>")
    path = f"file://{tmp_path}/index"
    for model, rows in (("m:1", e), ("m:2", e.filter("chunk_id = 'c1'")), ("m:1", e)):
        buckets.write_bucket_index(rows, path, model)
    for model, n in (("m:1", 2), ("m:2", 1)):
        assert buckets.read_bucket_index(spark, path, model).table.select("chunk_id").distinct().count() == n


def test_no_vector_goes_through_the_driver(spark):
    """Thousands of queries of one address against as many vectors are one scan and one plan."""
    rows = spark.range(3000).select(F.col("id").cast("string").alias("chunk_id"), F.lit("a").alias("address_id"), F.array(F.sin("id"), F.cos(F.col("id") * 3), F.sin(F.col("id") * 7)).cast("array<float>").alias("embedding"))
    q = rows.select(F.col("chunk_id").alias("query_id"), "address_id", F.lit(1).alias("k"), F.col("embedding").alias("vector"))
    got = search.vector_topk(q, rows, depth=2, per_slice=300, per_part=1000)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2
    x = np.array([r.embedding for r in rows.orderBy(F.col("chunk_id").cast("int")).collect()], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names, distance = np.arange(3000).astype(str), np.round(1 - x @ x.T, 9) + 0.0
    near = np.stack([np.lexsort((names, d))[:2] for d in distance])
    found = {(int(r.query_id), r.vector_rank): int(r.chunk_id) for r in got.collect()}
    assert len(found) == 6000 and np.mean([found[i, j + 1] == near[i, j] for i in range(3000) for j in range(2)]) > 0.99


def test_only_live_versions(spark):
    chunks = spark.createDataFrame([("c1", "d", 1), ("c2", "d", 2), ("c3", "e", 0), ("c4", "x", 1)], "chunk_id string, document_id string, doc_version int")
    docs = spark.createDataFrame([("d", 2), ("e", 0)], "document_id string, live_version int")
    assert [r.chunk_id for r in search.live_chunks(chunks, docs).collect()] == ["c2"]


def test_search_skips_past_versions_and_orphans_without_dealing_out_vectors(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d" if i < 4 else "e", "a", 1 + (i == 3), i, 1, 0, "tall house") for i in range(6)], "chunk_id string, document_id string, address_id string, doc_version int, ordinal int, page_number int, paragraph_index int, text string")
    docs = spark.createDataFrame([("d", 1, "d.txt", "s"), ("e", 1, "e.txt", "s")], "document_id string, live_version int, original_name string, storage_ref string")
    vectors = spark.createDataFrame([(f"c{i}", "a", "m", 1, [1.0, float(i)]) for i in (1, 2, 3, 4, 7)] + [("c5", "a", "m", 1, None), (None, "a", "m", 1, [1.0, 0.0])], "chunk_id string, address_id string, model_id string, dim int, embedding array<float>")
    alive = search.live_embeddings(vectors, chunks, docs)
    assert sorted(r.chunk_id for r in alive.collect()) == ["c1", "c2", "c4", "c5"]
    assert "Exchange hashpartitioning" not in alive._jdf.queryExecution().executedPlan().toString()
    postings = spark.createDataFrame([(f"c{i}", "a", x, [at]) for i in (0, 1, 3, 9) for x, at in (("tall", 1), ("house", 2))], "chunk_id string, address_id string, lexeme string, positions array<int>")
    asked = spark.createDataFrame([("q", "a", "tall house", 8, [1.0, 0.0])], "query_id string, address_id string, query_text string, k int, vector array<float>")
    got = search.hybrid_search(asked, chunks, docs, vectors, postings, "simple").orderBy("rank").collect()
    assert [(r.citation.chunk_id, r.model_id) for r in got] == [("c1", "m"), ("c0", ""), ("c2", "m"), ("c4", "m")]
    _, log, _ = search.query_job(asked.drop("vector"), chunks, docs, vectors, postings, lambda q: q.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vector")), "m", F.lit(None).cast("timestamp"), "simple")
    assert [(r.candidates_examined, r.chunks_returned) for r in log.collect()] == [(4, 4)]
