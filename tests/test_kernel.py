"""Random Fourier features against the exact kernel; rings that a line cannot separate; one-pass factorize."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import encode, kernel, models


def rings(n=500, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    a, r = rng.uniform(0, 2 * np.pi, n), 1 + y + rng.normal(0, 0.12, n)
    return np.stack([r * np.cos(a), r * np.sin(a)], axis=1), y


def test_products_approximate_the_kernel():
    x = np.random.default_rng(1).normal(size=(500, 6))
    z = kernel.fourier(x, 0.2, 8192, 3)
    exact = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.08 and np.abs(z @ z.T - exact).mean() < 0.01


def test_separates_rings_and_agrees_with_the_exact_kernel(spark):
    x, y = rings()
    rows = [(i, float(c), [float(a) for a in v]) for i, (c, v) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "id long, y double, x array<double>")
    gamma = kernel.scale_gamma(df, "x")
    assert np.isclose(gamma, 1 / (2 * x.var()))
    m = models.linear_svc(kernel.as_features(df.where("id < 300"), "x", gamma), "y", reg_param=1e-3)
    got = {r.id: r.prediction for r in m.transform(kernel.as_features(df.where("id >= 300"), "x", gamma)).collect()}
    line = models.linear_svc(models.as_vector(df.where("id < 300"), "x"), "y").transform(models.as_vector(df.where("id >= 300"), "x"))
    hit = np.mean([got[i] == y[i] for i in got])
    assert len(got) == 200 and hit > 0.95 and line.where("prediction = y").count() < 160
    k = np.exp(-gamma * ((x[:, None] - x[None, :300]) ** 2).sum(axis=2))  # regularised least squares with the exact kernel
    exact = k[300:] @ np.linalg.solve(k[:300] + 0.1 * np.eye(300), 2.0 * y[:300] - 1) > 0
    assert np.mean([got[300 + i] == e for i, e in enumerate(exact)]) > 0.95


def test_odd_vectors(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, [], "b"), (3, [None, 1.0], "c"), (4, [float("nan"), 1.0], "d"), (5, [0.0, 1.0], "e")], "id long, x array<double>, fourier string")
    got = {r.id: r.fourier for r in kernel.fourier_features(df, "x", 0.5, 16).collect()}
    assert got[1] is None and got[2] is None and got[3] == got[4] == got[5] and len(got[5]) == 16
    assert kernel.scale_gamma(df.where("id < 3"), "x") == 1.0


def test_factorize_columns_equals_one_by_one(spark):
    rows = [(9 - i, ["b", None, "a", "c"][i % 4], [2.5, 1.0, None][i % 3]) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, s string, x double").repartition(3)
    got = sorted(encode.factorize_columns(df, {"s": "sc", "x": "xc"}, "k").collect())
    a = encode.factorize(encode.factorize(df, "s", "k", "sc"), "x", "k", "xc").select("k", "s", "x", "sc", "xc")
    assert got == sorted(a.collect()) and encode.factorize_columns(df.where(F.lit(False)), {"s": "c"}, "k").count() == 0
