"""Linear lag regressors of many look-backs and series from one aggregate.

A row's regressors are the k values before it. For all look-backs of a grid the products of a row's regressors are
parts of those of the longest one, so one pass sums the products of [1, y, lag 1 .. lag k] per series, segment and
*band*: the longest look-back of the grid for which the row has all values. The normal equations of look-back k are the
sums of the bands from k on, cut to k lags; fits and errors of every look-back, per series and over all of them, come
from these sums. No window table is built.

Rows are worked on in chunks of a series (with the last values of the chunk before), so a long series is many tasks; a
chunk sends the upper triangle of its sums, which Spark adds up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import _list, with_halo

CHUNK_ROWS = 100_000


def chunk_products(values: np.ndarray, halo: np.ndarray, ks: Sequence[int]) -> list[tuple[int, np.ndarray]]:
    """(band, sums of products of [1, y, lag 1 .. lag band]) of the rows that are not ``halo``; NaN values and rows
    without ``min(ks)`` values before them belong to no band."""
    longest = max(ks)
    padded = np.concatenate([np.full(longest, np.nan), values])
    place = np.arange(len(padded))
    gap = np.maximum.accumulate(np.where(np.isnan(padded), place, -1))
    have = (place - 1 - np.concatenate([[-1], gap[:-1]]))[longest:]  # values in a row just before this one
    lagged = np.lib.stride_tricks.sliding_window_view(padded, longest + 1)[:, ::-1]  # y, lag 1, lag 2, ...
    use = ~halo & ~np.isnan(values)
    out = []
    for k, after in zip(sorted(ks), [*sorted(ks)[1:], None]):
        rows = np.flatnonzero(use & (have >= k) & ((have < after) if after else True))
        if len(rows):
            x = np.concatenate([np.ones((len(rows), 1)), lagged[rows, :k + 1]], axis=1)
            out.append((k, x.T @ x))
    return out


def lag_products(df: DataFrame, by, segment: str, pos: str, value: str, ks: Sequence[int], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(by, segment, _band, _i, _j, _sum): the summed products per series, segment and band, i <= j.

    ``pos`` is a 1-based position inside (by, segment); look-backs do not reach into another segment.
    """
    by = _list(by)
    keys = [*by, segment]
    rows = with_halo(df.select(*keys, F.col(pos).alias("_pos"), F.col(value).cast("double").alias("_v")), keys, "_pos", max(ks), chunk_rows)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("_pos")
        values = t.column("_v").to_numpy().astype(np.float64)  # nulls become NaN
        parts = {c: [] for c in ("_band", "_i", "_j", "_sum")}
        for band, sums in chunk_products(values, t.column("_halo").to_numpy(zero_copy_only=False).astype(bool), ks):
            i, j = np.triu_indices(len(sums))
            for c, x in zip(parts, (np.full(len(i), band), i, j, sums[i, j])):
                parts[c].append(x)
        n = sum(map(len, parts["_sum"]))
        cols = {c: pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in keys}
        cols |= {c: pa.array(np.concatenate(parts[c]) if n else [], pa.int32()) for c in ("_band", "_i", "_j")}
        return pa.table(cols | {"_sum": pa.array(np.concatenate(parts["_sum"]) if n else [], pa.float64())})

    sent = rows.groupBy(*keys, "_chunk").applyInArrow(run, f"{types}, _band int, _i int, _j int, _sum double")
    return sent.groupBy(*keys, "_band", "_i", "_j").agg(F.sum("_sum").alias("_sum"))


def normal_equations(bands: dict[int, np.ndarray], k: int) -> np.ndarray:
    """Sums of products of [1, y, lag 1 .. lag k] over all rows with k values before them."""
    parts = [m[:k + 2, :k + 2] for band, m in bands.items() if band >= k]
    return sum(parts) if parts else np.zeros((k + 2, k + 2))


def solve(sums: np.ndarray) -> np.ndarray:
    """Intercept and coefficients of lag 1 .. k by least squares (the shortest solution if there are many)."""
    at = [0, *range(2, len(sums))]
    return np.linalg.pinv(sums[np.ix_(at, at)], rcond=1e-13, hermitian=True) @ sums[at, 1]


def mean_square(sums: np.ndarray, beta: np.ndarray) -> float | None:
    """Mean squared error of ``beta`` on the rows behind ``sums``; None without rows."""
    if sums[0, 0] == 0:
        return None
    signed = np.concatenate([[-beta[0], 1.0], -beta[1:]])  # y minus its prediction
    return float(max(signed @ sums @ signed, 0.0) / sums[0, 0])


def sweep(products: DataFrame, by, segment: str, ks: Sequence[int], fit: str = "fit", val: str = "val") -> DataFrame:
    """(by, k, n_fit, n_val, fit_mse, val_mse, beta, selected) per series; ``by`` empty: one regressor over all series.

    Look-backs without a row to fit on are left out. Selected is the smallest validation error, the shorter look-back
    on ties; none if no look-back has a validation row.
    """
    by = _list(by)
    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in products.select(*by).schema.fields)
    summed = products.groupBy(*by, F.col(segment).alias("_seg"), "_band", "_i", "_j").agg(F.sum("_sum").alias("_sum"))
    summed = summed if by else summed.withColumn("_all", F.lit(0))

    def run(table: pa.Table) -> pa.Table:
        bands: dict[str, dict[int, np.ndarray]] = {fit: {}, val: {}}
        seg, band, i, j, s = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_seg", "_band", "_i", "_j", "_sum"))
        for name in bands:
            for b in np.unique(band[seg == name]):
                at = (seg == name) & (band == b)
                m = np.zeros((b + 2, b + 2))
                m[i[at], j[at]] = m[j[at], i[at]] = s[at]
                bands[name][int(b)] = m
        rows = []
        for k in sorted(ks):
            f, v = normal_equations(bands[fit], k), normal_equations(bands[val], k)
            if f[0, 0]:
                beta = solve(f)
                rows.append((k, int(round(f[0, 0])), int(round(v[0, 0])), mean_square(f, beta), mean_square(v, beta), beta.tolist()))
        best = min(((r[4], r[0]) for r in rows if r[4] is not None), default=(None, None))[1]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
        cols = {c: pa.array([table.column(c)[0].as_py()] * len(rows), table.schema.field(c).type) for c in by}
        cols |= {c: pa.array([r[x] for r in rows], t) for x, (c, t) in enumerate(zip(("k", "n_fit", "n_val", "fit_mse", "val_mse", "beta"), types))}
        return pa.table(cols | {"selected": pa.array([r[0] == best for r in rows], pa.bool_())})

    schema = f"{types}k int, n_fit bigint, n_val bigint, fit_mse double, val_mse double, beta array<double>, selected boolean"
    return summed.groupBy(*(by or ["_all"])).applyInArrow(run, schema)
