"""Embedding whitening against floating-point eigenvectors, exact top-k search against all products; awkward rows."""
from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibspark.llm import queries, topk, whitening

INF, NAN = float("inf"), float("nan")


# --- whitening -------------------------------------------------------------------------------

def test_polynomial_against_determinants(spark):
    rng = random.Random(4)
    for d in (1, 2, 3, 6, 8):
        half = [[rng.randrange(-30, 30) for _ in range(d)] for _ in range(d)]
        matrix = [[sum(a * b for a, b in zip(r, s)) for s in half] for r in half]
        poly = whitening.characteristic_polynomial(spark, matrix)
        assert poly[-1] == 1 and poly[-2] == -sum(matrix[i][i] for i in range(d))
        # Faddeev-LeVerrier in whole numbers
        m, expected = np.zeros((d, d), object), [1]
        a = np.array(matrix, object)
        for k in range(1, d + 1):
            m = a.dot(m) + expected[-1] * np.eye(d, dtype=int).astype(object)
            expected.append(-sum(a.dot(m)[i, i] for i in range(d)) // k)
        assert poly == expected[::-1]


def test_roots_with_multiplicity():
    poly = [1]
    for root in (0, 0, 3, 5, 5, 5, 900):
        poly = [b - root * a for a, b in zip(poly + [0], [0] + poly)]
    assert [whitening.roots_above(poly, a) for a in (-1, 0, 2, 3, 4, 5, 899, 900)] == [7, 5, 5, 4, 4, 1, 1, 0]
    for bits in (0, 7):
        assert whitening.largest_roots(poly, 10, bits) == [(900 << bits, 1), (5 << bits, 3), (3 << bits, 1)]


def brute_whiten(x, k=4):
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return fit, values[::-1][:k], vectors[:, ::-1][:, :k]


def check_whitened(rows, x, ids):
    fit, values, vectors = brute_whiten(x)
    n, total = len(fit), fit.sum(0).astype(int)
    for c in range(min(4, x.shape[1])):
        got = {r.vec_id: r for r in rows if r.component == c + 1}
        assert len(got) == len(ids)
        expected = (x - fit.mean(0)) @ vectors[:, c] / math.sqrt(values[c])
        mine = np.array([got[i].whitened for i in ids])
        assert np.allclose(mine * np.sign(mine @ expected), expected, atol=1e-7)
        share = values[c] / np.trace(np.atleast_2d(np.cov(fit.T, bias=True)))
        for i, v in zip(ids, x.astype(int).tolist()):
            assert got[i].n == n and got[i].deviation == sum((n * a - s) ** 2 for a, s in zip(v, total.tolist()))
            assert math.isclose(got[i].explained, share, rel_tol=1e-9) and got[i].identity_error < 1e-9


def test_whitening_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.stack(table.embedding).astype(float))
    check_whitened(queries.op11_embedding_whitening(spark, sf).collect(), x, table.vec_id.tolist())


def test_whitening_counts_copies_once(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 3)) * [3, 1, .2]
    x = np.vstack([base, np.repeat(base[:1], 300, 0), base[:20], base[5:6] + 1e-6])
    df = spark.createDataFrame([(i, v, "k", 3) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, x string, n int").repartition(5)
    check_whitened(whitening.whiten(df).collect(), np.floor(256 * x), list(range(len(x))))


def test_equal_eigenvalues(spark):
    x = np.array([[s * a for a in row] for row in np.eye(4).tolist() for s in (1., -1.)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id int, embedding array<float>")
    rows = whitening.whiten(df).collect()
    w = np.zeros((8, 4))
    for r in rows:
        w[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == .25 and r.identity_error < 1e-12
    assert np.allclose(w.T @ w / 8, np.eye(4))


def test_whitening_awkward_rows(spark):
    schema = "vec_id long, embedding array<double>, component int, v string"
    make = lambda rows: spark.createDataFrame([(i, v, 1, "x") for i, v in rows], schema)
    bad = [(1, None), (2, []), (3, [1., None]), (4, [NAN, 1.]), (5, [INF, 1.]), (6, [1., 2., 3.])]
    assert whitening.whiten(make([])).collect() == whitening.whiten(make(bad[:5])).collect() == []
    # one vector, in copies: nothing varies
    rows = whitening.whiten(make([*bad, (None, [1., -.0]), (7, [1., 0.]), (7, [1., 0.])])).collect()
    assert sorted((r.vec_id or -1, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows) == sorted(
        (i, c, 1, 0, None, None, None) for i in (-1, 7, 7) for c in (1, 2))
    # rank one
    rows = whitening.whiten(make([(1, [1., 1.]), (2, [2., 2.]), (3, [3., 3.])])).collect()
    second = [r for r in rows if r.component == 2]
    assert all(r.whitened is None and r.explained == 0 and r.identity_error < 1e-12 for r in second)
    first = {r.vec_id: r.whitened for r in rows if r.component == 1}
    assert np.allclose([first[i] for i in (1, 2, 3)], [-math.sqrt(1.5), 0, math.sqrt(1.5)])
    # beyond what a long holds, and exact products beyond 53 and 63 bits
    rows = whitening.whiten(make([(1, [1e300, 0.]), (2, [-1e300, 0.]), (3, [2.0**50, 1.]), (4, [2.0**50, 1.5])])).collect()
    assert len(rows) == 8 and any(r.deviation is None for r in rows) and all(r.identity_error < 1e-9 for r in rows)


# --- top k -------------------------------------------------------------------------------------

def brute_top(ids, vectors, asking, k):
    out = []
    for q in sorted(set(asking)):
        query = min(v for i, v in zip(ids, vectors) if i == q)
        scores = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in zip(ids, vectors) if i != q and len(v) == len(query))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def whole(vectors, scale=1024):
    return [[math.floor(scale * c) for c in v] for v in vectors]


@pytest.mark.parametrize("kind", ["near isotropic", "clusters", "copies", "sparse"])
def test_topk_against_all_products(spark, kind):
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(3000, 16))
    if kind == "clusters":
        x = rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)] * 3 + x * .2
    if kind == "copies":
        x[rng.random(3000) < .4] = x[7]
    if kind == "sparse":
        x[rng.random(x.shape) < .8] = 0
    x /= np.linalg.norm(x, axis=1, keepdims=True).clip(1e-9)
    df = spark.createDataFrame([(i, v, "q", 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, q string, shard int").repartition(7)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, shard=500, query_block=8)
    assert sorted(map(tuple, got.collect())) == brute_top(range(3000), whole(x.tolist()), range(0, 3000, 100), 10)


def test_bounds_leave_no_member_out():
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(2000, 32)) * 1024)
    places, dimension, top, first = topk.segments(x)
    shard, counts = topk.Shard(np.arange(2000), x, places, dimension, top, first), [0, 0]
    for q in range(40):
        exact = x @ x[q]
        best = np.sort(exact)[-10]
        for threshold in (-np.inf, best, best - 1000):
            assert set(np.flatnonzero(exact >= best)) <= set(shard.possible(x[q], threshold, 10, counts))
    # proofs come before all postings are read
    assert counts[0] < 120 * len(places)


def test_topk_awkward_rows(spark):
    rows = [(0, [1., 0.]), (0, [1., 0.]), (1, [1., 0.]), (1, [1., 0.]), (2, None), (3, []), (4, [None, 1.]), (5, [NAN, 0.]), (6, [0., -INF]), (None, [1., 1.]),
            (7, [0., 0.]), (100, [0., 0.]), (200, [5.]), (201, [-.001]), (300, [1., 2., 3.]), (-100, [-1., .5])]
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], "vec_id long, embedding array<double>, dim int, v string, score long")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, k=3).collect()))
    good = [(i, v) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    ids, vectors = [i for i, _ in good], whole([v for _, v in good])
    assert got == brute_top(ids, vectors, [i for i in ids if i % 100 == 0], 3)
    assert (200, 1, 201, -5120 * 2) in got and not any(r[0] == 300 for r in got)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == topk.top_k(df, F.lit(False)).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.]), (1, [1e30, 0.]), (2, [-1e30, 5.]), (3, [2.0**40, 1.]), (4, [2.0**40, 2.])], "vec_id long, embedding array<double>")
    best = [tuple(r) for r in topk.top_k(huge, F.col("vec_id").isin(0, 3), k=4).orderBy("query_id", "rank").collect()]
    top = topk.LONG_MAX
    assert best[:4] == [(0, 1, 1, top), (0, 2, 3, top), (0, 3, 4, top), (0, 4, 2, -top - 1)] and best[4:6] == [(3, 1, 0, top), (3, 2, 1, top)]


def test_topk_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    got = sorted(map(tuple, queries.op13_exact_topk(spark, sf).collect()))
    ids = table.vec_id.tolist()
    assert got == brute_top(ids, whole([list(map(float, v)) for v in table.embedding]), [i for i in ids if i % 100 == 0], 10)
