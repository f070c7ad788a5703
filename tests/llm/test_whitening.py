"""Operator 13 against NumPy's eigenvectors and whole-number arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from airledger.llm import queries, whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("X", T.StringType())])


def brute(rows, k=4):
    """(id, component) -> n, deviation, whitened, explained by NumPy on all rows at once."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    centre = np.array([s / n for s in total])
    y = np.array(fit, float) - centre
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in kept:
        for c in range(k):
            out.append((i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, total)), float((np.array(x) - centre) @ u[:, c] / np.sqrt(e[c])), e[c] / e.sum()))
    return out


def compare(found, wanted):
    key = lambda r: (str(r[0]), r[1], r[3])
    found, wanted = sorted((tuple(r) for r in found), key=key), sorted(wanted, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    for c in {r[1] for r in found}:
        a, b = (np.array([r[4] for r in t if r[1] == c]) for t in (found, wanted))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
    assert max(abs(a[5] / b[5] - 1) for a, b in zip(found, wanted)) < 1e-10
    assert {r[6] for r in found} == {found[0][6]} and found[0][6] < 1e-10


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(queries.op13_embedding_whitening(spark, sf).collect(), brute(rows))


def test_odd_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, (r.standard_normal(6) * [5, 3, 2, 1, 1, 1]).tolist()) for i in range(200)]
    rows += [(900, None), (901, [1.0, None, 0, 0, 0, 0]), (902, [math.nan] * 6), (903, [1.0, math.inf, 0, 0, 0, 0]), (None, rows[3][1]), (7, rows[7][1]), (7, rows[7][1]), (904, [-0.0] * 6), (2**60 + 1, rows[0][1])]
    table = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x") for i, v in rows], SCHEMA).repartition(5)
    compare(whitening.whiten(table, "vec_id", "embedding").collect(), brute(rows))
    assert whitening.whiten(table.where("false"), "vec_id", "embedding").count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")], SCHEMA)
    assert whitening.whiten(same, "vec_id", "embedding").count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], "") for i in range(9)] + [(77, [1.0], ""), (78, [], "")], SCHEMA)
    found = whitening.whiten(line, "vec_id", "embedding").collect()  # one component has variance; other lengths are left out
    assert {r.component for r in found} == {1} and len(found) == 9 and abs(found[0].explained - 1) < 1e-12
    far = spark.createDataFrame([(1, [1e15, 0.0], ""), (2, [-1e15, 3.0], ""), (3, [0.0, 1.0], "")], SCHEMA)
    assert any(r.deviation is None for r in whitening.whiten(far, "vec_id", "embedding").collect())


@pytest.mark.parametrize("d", [1, 2, 7, 30])
def test_inertia_counts(d):
    r = np.random.default_rng(d)
    for _ in range(20):
        a = r.standard_normal((d, d))
        a = a + a.T
        for bound in r.standard_normal(5):
            assert whitening.above(a, bound) == (np.linalg.eigvalsh(a) > bound).sum()
    assert whitening.above(np.array([[0.0, 1], [1, 0]]), 0) == 1 and whitening.above(np.zeros((3, 3)), -1) == 3


def test_contours_find_clusters_and_ties():
    r = np.random.default_rng(3)
    q, _ = np.linalg.qr(r.standard_normal((40, 40)))
    values = np.concatenate([[100, 100 - 1e-6, 90, 90, 90, 50], np.linspace(10, 1, 34)])
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    for wanted in (1, 2, 3, 4, 6, 9, 40):
        parts = whitening.bounds(v, wanted, 2)
        assert sum(p[2] for p in parts) >= wanted
        e = np.concatenate([whitening.contour(v, *p)[0] for p in parts])
        assert np.abs(e - np.sort(values)[::-1][: len(e)]).max() < 1e-10 * 100
    low, high, count = whitening.bounds(v, 5)[0]
    with pytest.raises(ArithmeticError):
        whitening.contour(v, low, high, count + 1)
