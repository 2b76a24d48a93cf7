"""Gaussian-kernel models by random Fourier features.

exp(-gamma |x - y|^2) is the mean of cos(w x + b) cos(w y + b) * 2 over random w ~ N(0, 2 gamma) and b ~ U(0, 2 pi), so
a linear model on ``n`` such cosines is a kernel model; its cost is linear in the rows. The draws follow from the seed
and are made again in every task, so that all rows see the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scale_gamma(df: DataFrame, vec: str) -> float:
    """1 / (components * variance of all components); 1.0 where that is not defined."""
    x = df.select(F.explode(F.col(vec).cast("array<double>")).alias("x"), F.size(vec).alias("d")).where("x is not null and not isnan(x)")
    var, d = x.agg(F.var_pop("x"), F.max("d")).first()
    return 1.0 / (d * var) if d and var else 1.0


def fourier(x: np.ndarray, gamma: float, n: int, seed: int) -> np.ndarray:
    """Random Fourier features (rows x n) of the rows of ``x``; dot products approximate the kernel."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(x.shape[1], n)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, n)
    return np.sqrt(2.0 / n) * np.cos(x @ w + b)


def fourier_features(df: DataFrame, vec: str, gamma: float, n: int = 1024, out: str = "fourier", seed: int = 42) -> DataFrame:
    """Add ``out`` (array of n doubles) to every row; null for a null or empty array; a column of that name is replaced.

    Missing and NaN components count as 0."""
    names = [c for c in df.columns if c != out]
    keep, at = [df.columns.index(c) for c in names], df.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                rows, made = batch.column(at).to_pylist(), [None] * batch.num_rows
                for d in {len(r) for r in rows if r}:
                    mine = [k for k, r in enumerate(rows) if r and len(r) == d]
                    x = np.nan_to_num(np.array([[np.nan if v is None else v for v in rows[k]] for k in mine], np.float64), nan=0.0)
                    for k, z in zip(mine, fourier(x, gamma, n, seed)):
                        made[k] = z
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(made, pa.list_(pa.float64()))], names=[*names, out])

    return df.mapInArrow(run, df.select(*names, F.lit(None).cast("array<double>").alias(out)).schema)


def as_features(df: DataFrame, vec: str, gamma: float, n: int = 1024, seed: int = 42) -> DataFrame:
    """``df`` with the MLlib vector column ``features`` of random Fourier features; rows without a vector are left out."""
    from tidemark.operators.models import as_vector

    return as_vector(fourier_features(df, vec, gamma, n, "_fourier", seed).where(F.col("_fourier").isNotNull()), "_fourier").drop("_fourier")
