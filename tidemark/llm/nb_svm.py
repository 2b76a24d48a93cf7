"""Quality classifier: naive Bayes support vectors over n-gram indicators.

* **Indicators.** A text's distinct byte 3-grams, words (case kept) and repetition n-grams (2, 4 and 8 equal words
  in a row) are the bins of a hash table of ``2 ** BITS`` bins that it switches on.
* **Log-count ratios.** Over *all* labelled training texts, r = ln of (share of class 1's indicators in the bin /
  share of class 0's), with ``ALPHA`` added to each count. Counted in the tasks, summed in Spark; the table of bins
  bounds what reaches the driver.
* **Support vectors.** Every indicator counts as its bin's r, a text's vector is scaled to length 1 and has a constant
  component, and a linear hinge-loss model is fitted by dual coordinate descent on at most ``FIT_ROWS`` labelled
  texts a class (lowest id hash). The rows lie in pieces of bounded size. In a round every piece descends its own
  dual coordinates from the shared weights, its own changes counted as many times as there are pieces, so that the
  changes of all pieces may simply be added; rounds go on until the duality gap is below ``GAP`` of the primal value.
* **Score.** A logistic curve, fitted to the margins of the fifth of those rows that the model does not learn from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import A1, held_out, lowest_per_group, mix, small, split_words, texts, with_batches

BITS = 18
ALPHA = 1.0
FIT_ROWS = 10_000
COST = 1.0
# Indicators in one piece at most (a single text has at most 2 ** BITS); pieces at least.
PIECE = 8_000_000
PIECES = 8
ROUNDS = 40
GAP = 0.01
CALIBRATE = 5  # one of so many rows fits the curve only
THRESHOLD = 0.3
_BIAS = 1 << BITS  # index of the constant component
_SHIFT = np.uint64(64 - BITS)
# Bins of the repetition n-grams: 2, 4 and 8 equal words in a row.
_RUNS = (mix(np.array([2, 4, 8], np.uint64) * A1) >> _SHIFT).astype(np.uint32)


@dataclass
class Model:
    ratio: np.ndarray  # r of every bin
    weights: np.ndarray  # of the scaled components; the last one is the constant's
    intercept: float = 0.0
    slope: float = 0.0


def indicators(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text the distinct bins it switches on (in no order). Null, empty and blank texts may have none."""
    seen = np.zeros(1 << BITS, np.int64)
    for _, _, buf, offs in texts(column):
        grams = np.empty(0, np.uint32)
        if len(buf) > 2:
            wide = buf.astype(np.uint32)
            grams = ((wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        words, _, woff = split_words(buf, offs, fold=False)
        word_bins = (words >> _SHIFT).astype(np.uint32)
        again = np.append(words[1:] == words[:-1], False)
        for i in range(len(offs) - 1):
            a, b = woff[i], woff[i + 1]
            parts = [grams[offs[i]:max(offs[i + 1] - 2, offs[i])], word_bins[a:b]]
            rep = again[a:max(b - 1, a)]
            if rep.any():
                four = rep[2:] & rep[1:-1] & rep[:-2]
                parts.append(_RUNS[[True, four.any(), (four[4:] & four[2:-2] & four[:-4]).any()]])
            bins = np.concatenate(parts)
            order = np.arange(len(bins))
            seen[bins] = order  # the last place of every bin stays
            yield bins[seen[bins] == order]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bin, texts of class 0, of class 1) of a task; bin -1 holds the indicators of the rows to fit on."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    fitted = 0
    for batch in batches:
        y, fit = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        for k, bins in enumerate(indicators(batch.column(0))):
            counts[y[k], bins] += 1
            fitted += len(bins) * bool(fit[k])
    bins = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(bins, -1).astype(np.int32)), pa.array(np.append(counts[0, bins], fitted)),
                                      pa.array(np.append(counts[1, bins], 0))], names=["bin", "n0", "n1"])


def log_count_ratio(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the bins' shares in class 1 over those in class 0; bins that no training text has weigh nothing."""
    p, q = n1 + ALPHA, n0 + ALPHA
    return np.where(n0 + n1 > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, alpha: np.ndarray, w: np.ndarray, cost: float, pieces: int,
            rng: np.random.Generator) -> np.ndarray:
    """One pass of dual coordinate descent over ``rows`` in random order; changes ``alpha``, returns the change of w.

    Rows have length sqrt(2): a unit vector and the constant. The own change counts ``pieces`` times in the gradient.
    """
    local, square = w.copy(), 2.0 * pieces
    for i in rng.permutation(len(rows)):
        at, x = rows[i], values[i]
        g = y[i] * (local[at] @ x + local[_BIAS]) - 1.0
        new = min(max(alpha[i] - g / square, 0.0), cost)
        step = (new - alpha[i]) * y[i]
        if step:
            alpha[i] = new
            local[at] += (pieces * step) * x
            local[_BIAS] += pieces * step
    return (local - w) / pieces


def scaled(bins: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """The ratios of ``bins`` scaled to length 1 (zeros stay zeros)."""
    x = ratio[bins]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def _pieces(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
    y, calibrate, rows, values = [], [], [], []
    for batch in batches:
        y += batch.column("y").to_pylist()
        calibrate += batch.column("calibrate").to_pylist()
        lists = batch.column("bins")
        flat, offs = lists.values.to_numpy(), lists.offsets.to_numpy()
        rows += [flat[a:b].copy() for a, b in zip(offs[:-1], offs[1:])]
    values = [scaled(r, ratio) for r in rows]
    return np.where(np.array(y, np.int64) == 1, 1.0, -1.0), np.array(calibrate, bool), rows, values


def solve(table: DataFrame, ratio: np.ndarray, cost: float = COST, rounds: int = ROUNDS, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, and margins and classes (+1, -1) of the rows kept back, from a checkpointed table of pieces.

    ``table`` (piece, id, y, calibrate, bins) has every piece whole in one partition, in the order of id.
    """
    spark = table.sparkSession
    pieces = max(table.select("piece").distinct().count(), 1)
    w, alphas = np.zeros(_BIAS + 1), {}
    schema = "piece int, alpha binary, at binary, change binary, loss double, dual double, margin binary, y binary"

    def one_round(state):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ratio, w, alphas, step = state.value
            found = [b for b in batches if b.num_rows]
            if not found:
                return
            ids = np.concatenate([b.column("piece").to_numpy() for b in found])
            y, calibrate, rows, values = _pieces(iter(found), ratio)
            for p in np.unique(ids):  # two pieces may share a partition
                mine = [i for i in np.flatnonzero(ids == p) if not calibrate[i]]
                back = [i for i in np.flatnonzero(ids == p) if calibrate[i]]
                alpha = np.frombuffer(alphas[p]).copy() if p in alphas else np.zeros(len(mine))
                margins = np.array([w[rows[i]] @ values[i] + w[_BIAS] for i in mine])
                loss, dual = float(np.maximum(0, 1 - y[mine] * margins).sum()), float(alpha.sum())
                change = descend([rows[i] for i in mine], [values[i] for i in mine], y[mine], alpha, w, cost, pieces, np.random.default_rng([int(p), step]))
                at = np.flatnonzero(change)
                kept = np.array([w[rows[i]] @ values[i] + w[_BIAS] for i in back])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (alpha, at, change[at])], pa.array([loss]), pa.array([dual]),
                     *[pa.array([v.tobytes()], pa.binary()) for v in (kept, y[back])]],
                    names=["piece", "alpha", "at", "change", "loss", "dual", "margin", "y"])
        return run

    for step in range(rounds):
        state = spark.sparkContext.broadcast((ratio, w, alphas, step))
        got = sorted(table.mapInArrow(one_round(state), schema).toArrow().to_pylist(), key=lambda r: r["piece"])
        state.unpersist()
        half = 0.5 * float(w @ w)
        primal, dual = half + cost * sum(r["loss"] for r in got), sum(r["dual"] for r in got) - half
        margins = np.concatenate([np.frombuffer(r["margin"]) for r in got] or [np.empty(0)])
        y = np.concatenate([np.frombuffer(r["y"]) for r in got] or [np.empty(0)])
        if step and primal - dual <= gap * primal:
            break
        for r in got:
            w[np.frombuffer(r["at"], np.int64)] += np.frombuffer(r["change"])
            alphas[r["piece"]] = r["alpha"]
    return w, margins, y


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and (non-negative) slope of a ridge-regularised logistic curve, by damped Newton steps."""
    a, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (p - y) + ridge * beta)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the documents of ``docs`` that ``labels`` marks 0 or 1; other labels, null keys and unknown keys are
    ignored, of a key labelled twice the higher label counts. With one class (or none) to learn from, every text
    scores that class (or one half)."""
    spark = docs.sparkSession
    marked = (labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k"))
              .agg(F.max(label).cast("int").alias("_y"))).checkpoint()
    picked = lowest_per_group(marked, "_y", fit_rows, [F.xxhash64("_k"), F.col("_k")]).select("_k", F.lit(True).alias("_fit"))
    marked = marked.join(F.broadcast(picked), "_k", "left").select("_k", "_y", F.coalesce("_fit", F.lit(False)).alias("_fit")).checkpoint()
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def labelled(marks: DataFrame) -> DataFrame:
        return rows.join(marks, F.col("_key") == F.col("_k"))

    every = labelled(small(marked, marked.count()))
    got = with_batches(every.select("_text", "_y", "_fit")).mapInArrow(_count, "bin int, n0 bigint, n1 bigint").groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    at, counts = got.column("bin").to_numpy(), np.zeros((2, 1 << BITS))
    real = at >= 0
    for y in (0, 1):
        counts[y, at[real]] = got.column(f"n{y}").to_numpy()[real]
    ratio, both = log_count_ratio(*counts), counts.any(axis=1)
    if not both.all():
        none = 30.0 if both[1] else -30.0 if both[0] else 0.0
        return Model(np.zeros(1 << BITS), np.zeros(_BIAS + 1), none, 0.0)
    pieces = max(PIECES, -(-int(got.column("n0").to_numpy()[~real].sum()) // PIECE))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.sort(b).astype(np.int32) for b in indicators(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.int32()))], names=["piece", "id", "y", "calibrate", "bins"])

    hashed = F.xxhash64(F.lit(12), "_k")
    chosen = labelled(F.broadcast(marked.filter("_fit"))).select(
        "_text", F.pmod(hashed, F.lit(pieces)).cast("int").alias("piece"), hashed.alias("id"), F.col("_y").alias("y"),
        (F.pmod(F.xxhash64(F.lit(13), "_k"), F.lit(CALIBRATE)) == 0).alias("calibrate"))
    table = (with_batches(chosen).mapInArrow(features, "piece int, id bigint, y int, calibrate boolean, bins array<int>")
             .repartition(pieces, "piece").sortWithinPartitions("piece", "id", F.xxhash64("bins"))).checkpoint()
    w, margins, y = solve(table, ratio)
    return Model(ratio, w, *logistic(margins, (y > 0).astype(float)))


def score_texts(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` to every row; columns of these names are replaced, others are kept.

    A null, empty or blank text has no indicators and scores what the constant alone says.
    """
    names = [c for c in df.columns if c not in ("score", "predicted")]
    keep, at = [df.columns.index(c) for c in names], df.columns.index(text)
    schema = df.select(*names, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    weight = np.stack([model.ratio * model.weights[:-1], model.ratio**2], axis=1)
    shared = df.sparkSession.sparkContext.broadcast((weight, float(model.weights[-1]), model.intercept, model.slope))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, intercept, slope = shared.value
        for batch in batches:
            sums = np.array([weight[b].sum(axis=0) for b in indicators(batch.column(at))]).reshape(-1, 2)
            margin = sums[:, 0] / np.maximum(np.sqrt(sums[:, 1]), 1e-12) + bias
            score = 1 / (1 + np.exp(-np.clip(intercept + slope * margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             names=[*names, "score", "predicted"])

    return with_batches(df).mapInArrow(run, schema)


def op12_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels.filter(~held_out("doc_id", 5, 0)))
    out = score_texts(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model)
    return out.select("doc_id", "held_out", "score", "predicted")
