"""Lag regressors from summed products against least squares on written-out windows."""

import numpy as np
import pytest

from tidemark.operators import lagfit

SCHEMA = "s string, seg string, pos long, v double"


def rows_of(seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for name, n in (("a", 300), ("b", 90), ("c", 9)):
        v = np.cumsum(rng.normal(size=n)) * 0.1
        for i, x in enumerate(v):
            seg, pos = ("fit", i + 1) if i < n * 0.8 else ("val", i + 1 - int(np.ceil(n * 0.8)))
            out.append((name, seg, pos, None if rng.random() < 0.02 else float("nan") if rng.random() < 0.01 else float(x)))
    return out


def windows(rows, series, seg, k):
    x, y = [], []
    for s in series:
        v = [r[3] for r in sorted((r for r in rows if r[0] == s and r[1] == seg), key=lambda r: r[2])]
        for t in range(k, len(v)):
            part = v[t - k:t + 1]
            if all(a is not None and a == a for a in part):
                x.append([1, *part[:-1][::-1]])
                y.append(part[-1])
    return np.array(x), np.array(y)


@pytest.mark.parametrize("chunk", [7, 40, 1000])
def test_equals_least_squares(spark, chunk):
    rows, ks = rows_of(), [1, 3, 10]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    products = lagfit.lag_products(df, "s", "seg", "pos", "v", ks, chunk_rows=chunk).checkpoint()
    for by, groups in (("s", [["a"], ["b"], ["c"]]), (None, [["a", "b", "c"]])):
        got = {(r.s if by else None, r.k): r for r in lagfit.sweep(products, by, "seg", ks).collect()}
        seen = 0
        for series in groups:
            errors = []
            for k in ks:
                x, y = windows(rows, series, "fit", k)
                if not len(y):
                    continue
                seen += 1
                r = got[series[0] if by else None, k]
                beta = np.linalg.lstsq(x, y, rcond=None)[0]
                u, w = windows(rows, series, "val", k)
                assert (r.n_fit, r.n_val) == (len(y), len(w)) and np.isclose(r.fit_mse, ((y - x @ beta) ** 2).mean(), atol=1e-9)
                if len(y) > k + 1:
                    assert np.allclose(r.beta, beta, atol=1e-6)
                    assert (r.val_mse is None) == (not len(w)) and (not len(w) or np.isclose(r.val_mse, ((w - u @ beta) ** 2).mean(), atol=1e-9))
                if r.val_mse is not None:
                    errors.append((r.val_mse, k))
                assert r.selected is not None
            if errors:
                assert [k for k in ks if (series[0] if by else None, k) in got and got[series[0] if by else None, k].selected] == [min(errors)[1]]
        assert seen == len(got)


def test_constant_short_and_empty_series(spark):
    df = spark.createDataFrame([("a", "fit", i + 1, 2.0) for i in range(20)] + [("b", "fit", 1, 1.0)], SCHEMA)
    out = lagfit.sweep(lagfit.lag_products(df, "s", "seg", "pos", "v", [2, 5]), "s", "seg", [2, 5]).collect()
    assert [(r.s, r.k, r.n_fit, r.n_val, r.val_mse, r.selected) for r in out] == [("a", 2, 18, 0, None, False), ("a", 5, 15, 0, None, False)]
    assert all(r.fit_mse < 1e-12 for r in out)
    none = lagfit.lag_products(df.where("false"), "s", "seg", "pos", "v", [2])
    assert lagfit.sweep(none, "s", "seg", [2]).collect() == [] and lagfit.sweep(none, None, "seg", [2]).collect() == []
