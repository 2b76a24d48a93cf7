"""Trained dense text encoder (I1, H2): truncated singular vectors of the hashed TF-IDF matrix.

The matrix has a row per text and ``features`` columns (token buckets); a row is term count x inverse document
frequency, L2-normalised. Its leading right singular vectors come from randomised subspace iteration: a pass over the
rows adds up A'(A Q) for the current basis Q of ``width + oversample`` columns. Tasks emit one partial sum each, Spark
adds them, and the driver holds ``features x (width + oversample)`` numbers, whatever the number of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.text import token_bucket, tokens

SLICE_ROWS = 256  # texts made dense at a time (256 x 4,096 doubles = 8 MB)


@dataclass
class TextSvd:
    idf: np.ndarray  # per bucket
    basis: np.ndarray  # buckets x width, orthonormal columns
    singular: np.ndarray  # descending


def _slots(text: str, features: int):
    return F.transform(F.coalesce(tokens(F.col(text).cast("string")), F.array().cast("array<string>")), lambda t: token_bucket(t, features))


def weigh(column: pa.Array, idf: np.ndarray):
    """Dense TF-IDF rows of a column of bucket lists, ``SLICE_ROWS`` texts at a time."""
    features, offsets, flat = len(idf), column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for a in range(0, len(column), SLICE_ROWS):
        cut = offsets[a:min(a + SLICE_ROWS, len(column)) + 1]
        row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        x = np.bincount(row * features + flat[cut[0]:cut[-1]], minlength=(len(cut) - 1) * features).reshape(-1, features) * idf
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        yield x / np.where(norm > 0, norm, 1)


def _gram_times(slots: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'(A q) in one pass over the rows."""
    names = [f"c{j}" for j in range(q.shape[1])]

    def run(batches):
        total = np.zeros(q.shape)
        for batch in batches:
            for x in weigh(batch.column(0), idf):
                total += x.T @ (x @ q)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(total[at, j]) for j in range(q.shape[1])]], names=["i", *names])

    parts = slots.select("_slots").mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros(q.shape)
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():  # at most ``features`` rows
        out[r[0]] = r[1:]
    return out


def fit_text_svd(df: DataFrame, text: str, width: int = 32, features: int = 4096, oversample: int = 8, rounds: int = 4, seed: int = 42) -> TextSvd:
    """Learn the encoder from all texts of ``df`` (null and empty texts are zero rows): ``rounds`` + 1 passes over the
    token buckets, which are written once to the checkpoint folder."""
    slots = df.select(_slots(text, features).alias("_slots")).checkpoint(eager=True)
    n, seen = slots.count(), np.zeros(features)
    for r in slots.select(F.explode(F.array_distinct("_slots")).alias("i")).groupBy("i").count().collect():  # at most ``features`` rows
        seen[r[0]] = r[1]
    idf = np.log((n + 1) / (seen + 1)) + 1
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width + oversample)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(_gram_times(slots, idf, q))[0]
    values, turn = np.linalg.eigh(q.T @ _gram_times(slots, idf, q))
    order = np.argsort(values)[::-1][:width]
    return TextSvd(idf, q @ turn[:, order], np.sqrt(np.maximum(values[order], 0)))


def encode_text(df: DataFrame, key: str, text: str, model: TextSvd, out: str = "embedding") -> DataFrame:
    """``(key, out)``: every text's coordinates on the singular vectors; a text without tokens is the zero vector."""
    idf, basis = model.idf, model.basis
    kind, width = df.schema[key].dataType.simpleString(), basis.shape[1]

    def run(batches):
        for batch in batches:
            x = np.concatenate([np.zeros((0, width)), *[w @ basis for w in weigh(batch.column(1), idf)]])
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vec], names=[key, out])

    return df.select(key, _slots(text, len(idf)).alias("_slots")).mapInArrow(run, f"`{key}` {kind}, `{out}` array<double>")
