import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plotmark.llm import whitening as wh


def brute(rows):
    """By the definition, with exact integers: n, deviations, and the leading eigenvectors of the covariance."""
    sound = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in sound})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    scatter = [[sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit) for j in range(d)] for i in range(d)]
    v = np.array([[s / n**3 for s in row] for row in scatter])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    out = {}
    for i, x in sound:
        centred = [n * a - s for a, s in zip(x, sums, strict=True)]
        out[i] = (sum(c * c for c in centred), np.array([c / n for c in centred]) @ vectors / np.sqrt(values))
    return n, values / np.trace(v), out


def check(got, rows):
    n, explained, out = brute(rows)
    own = defaultdict(dict)
    for r in got:
        assert r.n == n and r.identity_error <= 1e-8
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        own[r.vec_id][r.component] = r
    assert set(own) == set(out)
    signs = None
    for i, (deviation, whitened) in out.items():
        w = np.array([own[i][c].whitened for c in sorted(own[i])])
        assert {own[i][c].deviation for c in own[i]} == {deviation if deviation < 2**63 else None}
        signs = np.where(np.abs(w - whitened) <= np.abs(w + whitened), 1, -1) if signs is None else signs
        assert np.allclose(w * signs, whitened, atol=1e-7)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4).flatmap(lambda d: st.lists(st.lists(st.one_of(st.integers(-300, 300), st.integers(-(2**63), 2**63 - 1)), min_size=d, max_size=d), min_size=1, max_size=140)))
def test_cross_products_are_exact(rows):
    x = np.array(rows, dtype=np.int64)
    sums, products = wh.cross_products(x)
    own = x.astype(object)
    assert (sums == own.sum(axis=0)).all() and (products == own.T @ own).all()


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = wh.op13_whitening(spark, sf).collect()
    assert len(got) == 4 * len(rows)
    check(got, rows)


def test_odd_vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(300)]
    rows += [(1000 + i, v) for i, (_, v) in enumerate(rows[:250])]  # copies
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 5), (2004, [float("inf")] * 5), (2005, [-0.0] * 5), (2006, [0.0] * 5), (2007, [-0.001] * 5)]
    docs = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, x string, n int, v int").repartition(5)
    check(wh.whiten(docs).collect(), rows)
    other = spark.createDataFrame([(9, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in wh.whiten(docs.select("vec_id", "embedding").union(other)).collect()} == {i for i, v in rows if i < 2000 or i > 2004}


def test_values_beyond_a_fast_sum(spark):
    rows = [(i, [2.0**40 * (i % 7 - 3), 2.0**38 * (i % 5), 2.0**36 * (i % 3)]) for i in range(50)]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check([r for r in got], rows)
    assert all(r.deviation is None for r in got)


def test_tables_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert wh.whiten(spark.createDataFrame([], kind)).collect() == []
    assert wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    one = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [3.0, 2.0])], kind)).collect()
    assert sorted((r.vec_id or 0, r.component, abs(round(r.whitened, 9))) for r in one) == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0)]
