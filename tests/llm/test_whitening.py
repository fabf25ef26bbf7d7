"""Whitening against the eigenvectors of the plainly summed covariance."""

import math
import random

import numpy as np

from podspark.llm import queries, whitening
from podspark.llm.common import stored

DATA = "/root/testdata/sf0.001"


def check(rows, found, components=4, scale=256):
    """``rows`` are (key, vector); holds every column of the result against numpy."""
    good = [(k, [math.floor(scale * float(c)) for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fitted = np.array(sorted({tuple(x) for _, x in good}), float)
    n, sums = len(fitted), [int(s) for s in fitted.sum(axis=0)]
    mean = fitted.mean(axis=0)
    values, axes = np.linalg.eigh((fitted - mean).T @ (fitted - mean) / n)
    values, axes = values[::-1], axes[:, ::-1]
    by = {}
    for r in found:
        by.setdefault(r[0], []).append(r)
    assert len(found) == len(good) * components
    sign = {}
    for k, x in good:
        for r in by[k]:
            c = r["component"] - 1
            want = (np.array(x) - mean) @ axes[:, c] / math.sqrt(values[c])
            sign.setdefault(c, 1 if want * r["whitened"] > 0 else -1)
            assert abs(want * sign[c] - r["whitened"]) < 1e-8
            assert r["n"] == n and int(r["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert abs(r["explained"] / (values[c] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_query_equals_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    found = queries.op11_whitening(spark, DATA)
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(rows, found.collect())


def test_recurrence_gives_a_bidiagonal_matrix_of_all_deviations(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-90, 90, (300, 7)) * np.array([1, 2, 3, 4, 5, 6, 0])
    rows = stored(whitening.integers(spark.createDataFrame([(k, (v / 256).tolist()) for k, v in enumerate(x)], "id int, v array<double>"), "id", "v"))
    model = whitening.fit(rows, components=7)
    b = np.diag(model.diagonal) + np.diag(model.above[:-1], 1)
    centred = np.unique(x, axis=0) - np.unique(x, axis=0).mean(axis=0)
    assert np.allclose(np.linalg.svd(b)[1][:6], np.linalg.svd(centred)[1][:6], rtol=1e-12)
    assert len(model.eigenvalues) == 6 and np.allclose(model.components.T @ model.components, np.eye(6), atol=1e-12)


def test_equal_eigenvalues_and_repeats_are_all_found(spark):
    eye = [[float(s * 4 * (a == b)) for b in range(5)] for a in range(5) for s in (-1, 1)]
    rows = [(k, eye[k % 10]) for k in range(40)]
    found = whitening.whiten(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v").collect()
    assert len(found) == 160 and all(r.n == 10 and abs(r.explained - 0.2) < 1e-12 and r.identity_error < 1e-12 for r in found)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(30)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    more = [(None, rows[0][1]), (200, [-0.0, 0.0, 1e-9]), (201, rows[1][1])]
    frame = spark.createDataFrame([(k, v, 1) for k, v in rows + odd + more], "key int, x array<double>, dim int")
    check(rows + more, whitening.whiten(frame, "key", "x", components=3).collect(), 3)
    assert whitening.whiten(spark.createDataFrame([], "vec_id int, embedding array<float>")).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<float>")).collect() == []
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 1.0])], "vec_id int, embedding array<double>")).collect()
    assert len(huge) == 3 * len({r.component for r in huge}) and all(r.deviation is not None for r in huge)
