import numpy as np
import pytest
from pyspark.sql import functions as F

from chromloom.operators import tall

SPARSE = "cell_ord long, f long, v double"


def sparse(spark, x, parts=5):
    i, j = np.nonzero(x)
    return spark.createDataFrame([(int(a), int(b), float(x[a, b])) for a, b in zip(i, j, strict=True)], SPARSE).repartition(parts)


def dense(frame, key, n, width):
    out = np.zeros((n, width))
    for r in frame.collect():
        out[r[key]] = r["vec"]
    return out


def decaying(r, n, m, values):
    u, v = np.linalg.qr(r.normal(size=(n, len(values))))[0], np.linalg.qr(r.normal(size=(m, len(values))))[0]
    return u, v, (u * values) @ v.T


@pytest.mark.parametrize("fan", [3])
def test_polar_of_a_matrix_with_a_condition_number_of_1e10(spark, monkeypatch, fan):
    monkeypatch.setattr(tall, "FAN", fan)
    r = np.random.default_rng(3)
    u, v, x = decaying(r, 400, 8, np.logspace(0, -10, 8))
    frame = spark.createDataFrame([(i, x[i].tolist()) for i in range(400)], "cell_ord long, vec array<double>").repartition(11)
    q, s = tall.polar_rows(frame)
    got = dense(q, "cell_ord", 400, 8)
    assert np.abs(got.T @ got - np.eye(8)).max() < 1e-10
    assert np.allclose(s, np.logspace(0, -10, 8), rtol=1e-4)
    assert np.abs(got - u @ v.T).max() < 1e-4  # the smallest direction is only known to 1e-16 * 1e10
    rr = tall.r_factor(frame)
    assert np.allclose(rr.T @ rr, x.T @ x)


def test_rank_deficient_and_empty_matrices(spark):
    x = np.outer(np.arange(1.0, 31), [1.0, 2.0, 0.0])
    frame = spark.createDataFrame([(i, x[i].tolist()) for i in range(30)], "cell_ord long, vec array<double>").repartition(4)
    got = dense(tall.polar_rows(frame)[0], "cell_ord", 30, 3)
    assert np.allclose(got @ got.T @ x, x) and np.linalg.matrix_rank(got, tol=1e-8) == 1
    assert tall.r_factor(frame.limit(0)) is None and tall.polar_rows(frame.limit(0))[0].count() == 0
    assert tall.truncated_svd(sparse(spark, np.zeros((2, 2))), 2)[0].count() == 0


@pytest.mark.parametrize(("cells", "features", "fan"), [(32, 64, 2)])
def test_truncated_svd_equals_numpy(spark, monkeypatch, cells, features, fan):
    """With small blocks, products meet many of them and sums go over several levels."""
    monkeypatch.setattr(tall, "FAN", fan)
    r = np.random.default_rng(6)
    x = decaying(r, 90, 230, np.logspace(2, -2, 12))[2]
    x[17], x[:, 5] = 0, 0
    scores, s, right = tall.truncated_svd(sparse(spark, x), 4, power=4, shape=(cells, features))
    u, want, vt = np.linalg.svd(x, full_matrices=False)
    sign = np.sign((vt[:4] ** 3).sum(axis=1))
    assert np.allclose(s, want[:4], rtol=1e-6)
    assert np.allclose(dense(scores, "cell_ord", 90, 4), u[:, :4] * want[:4] * sign, atol=1e-3 * want[0])
    assert np.allclose(dense(right, "f", 230, 4), (vt[:4].T * sign), atol=1e-3)
    assert {17}.isdisjoint(x["cell_ord"] for x in scores.collect())


def test_fewer_values_than_asked(spark):
    x = np.outer([1.0, 2.0, 3.0], [1.0, 1.0])
    scores, s, _ = tall.truncated_svd(sparse(spark, x), 5)
    assert np.allclose(s, [np.linalg.norm(x)]) and np.allclose(dense(scores, "cell_ord", 3, 1)[:, 0], np.linalg.norm(x, axis=1))


def test_wide_features_need_no_square_matrix(spark):
    """20,000 features: a features x features matrix would be 3.2 GB."""
    entries = spark.range(60 * 20_000).select((F.col("id") % 60).alias("cell_ord"), F.expr("id div 60").alias("f")).withColumn("v", F.sin(F.col("cell_ord") * 0.7) * F.cos(F.col("f") * 0.01) + F.cos(F.col("cell_ord") * 0.3) * F.sin(F.col("f") * 0.003) * 0.5)
    scores, s, right = tall.truncated_svd(entries, 2)
    i, j = np.arange(60), np.arange(20_000)
    x = np.outer(np.sin(i * 0.7), np.cos(j * 0.01)) + 0.5 * np.outer(np.cos(i * 0.3), np.sin(j * 0.003))
    u, want, _ = np.linalg.svd(x, full_matrices=False)
    got = dense(scores, "cell_ord", 60, 2)
    assert np.allclose(s, want[:2]) and np.allclose(np.abs(got), np.abs(u[:, :2] * want[:2]), atol=1e-6) and right.count() == 20_000
