"""Recurrent regressor: gradients against differences; a nonlinear series that the previous value cannot follow."""

import numpy as np
import pytest

from tidemark.operators import network, recurrent


@pytest.mark.parametrize("units", [[3], [3, 4]])
@pytest.mark.parametrize("dropped", [False, True])
def test_gradient_equals_differences(units, dropped):
    rng = np.random.default_rng(0)
    model = recurrent.start(units, 1)
    x, y = rng.normal(size=(5, 6)), rng.normal(size=5)
    masks = [(rng.random((6, 5, u)) > 0.3) / 0.7 for u in units] if dropped else None
    _, grad = model.loss_and_gradient(x, y, masks)
    flat = model.flat()
    for k in range(len(flat)):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        up, down = (model.shaped(flat + d * step).loss_and_gradient(x, y, masks)[0] for d in (1, -1))
        assert abs((up - down) / 2e-6 - grad[k]) < 1e-6


def logistic_map(n=700):
    v = [0.3]
    for _ in range(n):
        v.append(3.8 * v[-1] * (1 - v[-1]))
    return v


@pytest.mark.parametrize("block_rows", [10_000, 200])
def test_learns_a_nonlinear_series(spark, block_rows):
    v = logistic_map()
    rows = [(t, v[t - 4:t], v[t], "train" if t < 560 else "valid") for t in range(4, 700)]
    df = spark.createDataFrame(rows, "t long, x array<double>, y double, role string")
    blocks = network.make_blocks(df, "x", "y", "t", "role", "train", block_rows=block_rows)
    config = network.Config((12,), rate=0.02, batch=16, epochs=40, patience=15)
    (state,) = network.fit_models(blocks, [config], [recurrent.start([12], 3)])
    previous = np.mean([(r[1][-1] - r[2]) ** 2 for r in rows if r[3] == "valid"])
    mean = np.var([r[2] for r in rows if r[3] == "valid"])
    assert -state.best < 0.2 * min(previous, mean)
    out = recurrent.forecast(df.where("role = 'valid'"), recurrent.start([12], 3).shaped(state.best_flat)).collect()
    assert np.isclose(np.mean([(r.pred - r.y) ** 2 for r in out]), -state.best)


def test_odd_windows(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2], "a"), (2, None, "b"), (3, [], "c"), (4, [0.1, None], "d"), (5, [0.3] * 50, "e")], "id long, x array<double>, pred string")
    got = {r.id: r.pred for r in recurrent.forecast(df, recurrent.start([4], 0)).collect()}
    assert got[2] is None and got[3] is None and np.isnan(got[4]) and np.isfinite(got[1]) and np.isfinite(got[5])
