"""Recurrent lag regressor: stacked LSTM layers over the k values before a row, by backpropagation through time.

The model has the interface of ``network.Network``, so blocks of windows, mini-batch Adam, averaging over blocks and
early stopping (on the validation MSE) are those of ``network``. Gates stand side by side in the order input, forget,
cell, output; dropout acts on the outputs of every layer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Recurrent:
    """Per layer (input weights, state weights, biases); then the output weights and bias."""

    layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    out: tuple[np.ndarray, np.ndarray]

    def _all(self) -> list[np.ndarray]:
        return [*[x for layer in self.layers for x in layer], *self.out]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self._all()])

    def shaped(self, flat: np.ndarray) -> Recurrent:
        parts, at = [], 0
        for x in self._all():
            parts.append(flat[at:at + x.size].reshape(x.shape))
            at += x.size
        n = 3 * len(self.layers)
        return Recurrent([tuple(parts[k:k + 3]) for k in range(0, n, 3)], (parts[n], parts[n + 1]))

    def run(self, x: np.ndarray, masks: list[np.ndarray] | None = None):
        """Predictions of windows (rows x steps, oldest first) and, per layer, what the way back needs."""
        seq, kept = x.T[:, :, None], []  # steps x rows x inputs
        for k, (wx, wh, b) in enumerate(self.layers):
            units = len(wh)
            h = c = np.zeros((seq.shape[1], units))
            into, steps, hs = seq @ wx + b, [], []
            for t in range(len(seq)):
                z = into[t] + h @ wh
                i, f, o = _sigmoid(z[:, :units]), _sigmoid(z[:, units:2 * units]), _sigmoid(z[:, 3 * units:])
                g = np.tanh(z[:, 2 * units:3 * units])
                before, c = (h, c), f * c + i * g
                th = np.tanh(c)
                h = o * th
                steps.append((*before, i, f, g, o, th))
                hs.append(h)
            kept.append((seq, steps))
            seq = np.stack(hs) * (masks[k] if masks is not None else 1.0)
        return (seq[-1] @ self.out[0] + self.out[1])[:, 0], kept, seq[-1]

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, masks: list[np.ndarray] | None = None) -> tuple[float, np.ndarray]:
        """Mean squared error and its gradient in the order of ``flat``."""
        pred, kept, last = self.run(x, masks)
        d = 2 * (pred - y)[:, None] / len(y)
        grads = [d.sum(axis=0), last.T @ d]
        into = np.zeros((x.shape[1], len(y), len(self.layers[-1][1])))
        into[-1] = d @ self.out[0].T  # gradient by the last layer's outputs, step by step
        for k in range(len(self.layers) - 1, -1, -1):
            wx, wh, _ = self.layers[k]
            seq, steps = kept[k]
            if masks is not None:
                into = into * masks[k]
            dz = np.empty((len(seq), len(y), wh.shape[1]))
            dh = dc = np.zeros((len(y), len(wh)))
            dwh = np.zeros_like(wh)
            for t in range(len(seq) - 1, -1, -1):
                h0, c0, i, f, g, o, th = steps[t]
                dh = dh + into[t]
                dc = dc + dh * o * (1 - th * th)
                dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (1 - g * g), dh * th * o * (1 - o)], axis=1)
                dwh += h0.T @ dz[t]
                dh, dc = dz[t] @ wh.T, dc * f
            grads += [dz.sum(axis=(0, 1)), dwh, np.einsum("tni,tnj->ij", seq, dz)]
            into = dz @ wx.T
        return float(((pred - y) ** 2).mean()), np.concatenate([g.ravel() for g in reversed(grads)])

    def gradient(self, x: np.ndarray, y: np.ndarray, dropout: float, rng: np.random.Generator) -> tuple[float, np.ndarray]:
        masks = [(rng.random((x.shape[1], len(x), len(wh))) >= dropout) / (1 - dropout) for _, wh, _ in self.layers] if dropout > 0 else None
        return self.loss_and_gradient(x, y, masks)

    def judge(self, x: np.ndarray, y: np.ndarray) -> dict[tuple[int, int], float]:
        """Rows and sum of squared errors."""
        return {(0, 0): float(len(y)), (0, 1): float(((self.run(x)[0] - y) ** 2).sum()) if len(y) else 0.0}

    @staticmethod
    def score(seen: dict[tuple[int, int], float]) -> tuple[float, float]:
        """MSE, and its negative as the figure to raise."""
        n = seen.get((0, 0), 0.0)
        mse = seen.get((0, 1), 0.0) / n if n else float("inf")
        return mse, -mse


def start(units: Sequence[int], seed: int) -> Recurrent:
    """Uniform input weights and orthogonal state weights; forget gates start open."""
    rng, layers, width = np.random.default_rng(seed), [], 1
    for u in units:
        edge = np.sqrt(6 / (width + 4 * u))
        square = [np.linalg.qr(rng.normal(size=(u, u)))[0] for _ in range(4)]
        bias = np.zeros(4 * u)
        bias[u:2 * u] = 1.0
        layers.append((rng.uniform(-edge, edge, (width, 4 * u)), np.concatenate(square, axis=1), bias))
        width = u
    edge = np.sqrt(6 / (width + 1))
    return Recurrent(layers, (rng.uniform(-edge, edge, (width, 1)), np.zeros(1)))


def forecast(df: DataFrame, model: Recurrent, windows: str = "x", out: str = "pred") -> DataFrame:
    """Add ``out``, the next value after each window (null for a null window); a column of that name is replaced."""
    names = [c for c in df.columns if c != out]
    keep, at = [df.columns.index(c) for c in names], df.columns.index(windows)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(at).to_pylist()
            pred: list = [None] * len(rows)
            for size in {len(r) for r in rows if r}:
                mine = [k for k, r in enumerate(rows) if r and len(r) == size]
                values = shared.value.run(np.array([[np.nan if v is None else v for v in rows[k]] for k in mine], float))[0]
                for k, v in zip(mine, values.tolist()):
                    pred[k] = v
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(pred, pa.float64())], names=[*names, out])

    return df.mapInArrow(run, df.select(*names, F.lit(None).cast("double").alias(out)).schema)
