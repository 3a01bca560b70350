import numpy as np
import pytest
from pyspark.sql import functions as F

from plotmark.llm import ann
from plotmark.llm.ann import nearest_neighbours


def brute(vectors, queries, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], dtype=np.float64)
    out = {}
    for q in queries:
        s = (x * np.array(vectors[q])).sum(axis=1)
        order = np.lexsort((ids, -s))
        out[q] = [int(ids[i]) for i in order if ids[i] != q][:k]
    return out


def found(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_against_brute_force(spark, scaled):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(1500, 16))
    if scaled:
        x *= draw.uniform(0.2, 3, size=(1500, 1))
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    got = nearest_neighbours(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    want = brute(vectors, range(0, 1500, 20), 20)
    assert np.mean([len(set(found(got)[q]) & set(w)) / 20 for q, w in want.items()]) >= 0.9
    assert all(abs(r.score - float(np.dot(vectors[r.query_id], vectors[r.vec_id]))) < 1e-12 for r in got)


def test_copies_ties_and_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.5, 0.5]), (101, None), (102, [0.0, 0.0]), (103, [nan, 1.0]), (104, [None, 1.0]), (105, [inf, 1.0]), (106, [1.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0])]
    got = found(nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=5).collect())
    assert got == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4], 40: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4]}


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>, rank int"
    few = nearest_neighbours(spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1)], schema), F.col("vec_id") == 0)
    assert found(few.collect()) == {0: [1]}
    assert nearest_neighbours(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0


def test_probe_sets_come_in_order_and_cross_no_hash_twice():
    for m in (1, 2, 3, 4):
        sets = ann.probe_sets(m, 10_000)
        assert len(sets) == 3**m == len({tuple(s) for s in sets.tolist()}) and not sets[0].any()
        assert not (sets & sets[:, ::-1]).any()
    assert len(ann.probe_sets(40, 300)) == 300


def test_every_neighbouring_bucket_is_visited_once():
    draw = np.random.default_rng(2)
    h = ann.Hashes(draw.normal(size=(2, 3, 5)), draw.uniform(0, 1.5, size=(2, 3)), 1.5, ann.probe_sets(3, 27))
    x = draw.normal(size=(4, 5))
    cells = np.floor(h.cells(x))
    got = h.visits(x)
    assert (got[:, :, 0] == h.keys(cells)).all()
    for n in range(4):
        for t in range(2):
            want = {int(h.keys(np.broadcast_to(cells[n, t] + np.array(s) - 1, (1, 2, 3)))[0, t]) for s in np.ndindex(3, 3, 3)}
            assert set(got[n, t].tolist()) == want


def test_uneven_norms_and_split_shards_keep_the_recall(spark, monkeypatch):
    """One vector far longer than the others, small blocks, and so many hashes at first that their buckets don't do."""
    monkeypatch.setattr(ann, "SHARD", 100)
    monkeypatch.setattr(ann, "ASKED", 7)
    monkeypatch.setattr(ann, "HASHES", 9)
    monkeypatch.setattr(ann, "PROBES", 40)
    monkeypatch.setattr(ann, "SAMPLE", 16)
    draw = np.random.default_rng(3)
    x = draw.normal(size=(1200, 16))
    x[7] *= 10
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    got = found(nearest_neighbours(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect())
    want = brute(vectors, range(0, 1200, 20), 20)
    assert np.mean([len(set(got[q]) & set(w)) / 20 for q, w in want.items()]) >= 0.9


def test_recall_on_queries_that_did_not_set_the_probes(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 30)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in rows.select("vec_id", "embedding").collect() if r.embedding}
    asked = [i for i in vectors if i % 20 == 0]
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id"))
    drawn = ann.thinned(queries, "vec_id", 30).orderBy(F.xxhash64("vec_id"), "vec_id").limit(30).collect()
    rest = sorted(set(asked) - {r.vec_id for r in drawn})
    got, want = found(ann.op7_ann(spark, "/root/testdata/sf0.1").collect()), brute(vectors, rest, 20)
    assert len(rest) > 30 and np.mean([len(set(got[q]) & set(w)) / 20 for q, w in want.items()]) >= 0.9
