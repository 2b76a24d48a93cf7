"""Array (dense vector) expressions built from higher-order functions.

Vectors are ``array<float>`` / ``array<double>`` columns; these stay inside
whole-stage codegen (no Python).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def dot(a, b) -> Column:
    """Sum of element products, accumulated in double, left to right."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def sq_dist(a, b) -> Column:
    """Squared Euclidean distance."""
    def diff2(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d
    return F.aggregate(F.zip_with(_c(a), _c(b), diff2), F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def euclid(a, b) -> Column:
    return F.sqrt(sq_dist(a, b))


def relu(a) -> Column:
    return F.transform(_c(a), lambda x: F.greatest(x.cast("double"), F.lit(0.0)))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def vec_add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def vec_scale(a, s) -> Column:
    s = _c(s) if not isinstance(s, (int, float)) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


def lerp(a, b, u) -> Column:
    """``a + u * (b - a)`` element-wise (SMOTE interpolation), in double."""
    u = _c(u)
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") + u * (y.cast("double") - x.cast("double")))


def argmax(a) -> Column:
    """0-based index of the maximum; first position on ties."""
    return F.array_position(_c(a), F.array_max(_c(a))) - F.lit(1)


def one_hot_array(code, k: int) -> Column:
    """Width-k 0/1 vector with a 1 at ``code`` (no dropped level)."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == _c(code)).cast("int"))
