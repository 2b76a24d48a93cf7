"""Toxic passages by maximum-scoring segments over token log-odds.

* **Learning.** Tokens of labelled documents are counted per class in ``2 ** BITS`` hash bins, once for words and
  once for word beginnings (``STEM`` bytes, for inflected forms). A token's score is its log-odds between the
  classes under Dirichlet priors (a share of the overall frequencies plus ``SMOOTH``), drawn towards zero by ``Z``
  standard deviations, minus ``DRIFT``, so that ordinary text runs downhill. The bins bound what reaches the
  driver and is broadcast; at most ``FIT_ROWS`` labelled documents per class (lowest id hash) are learned from.
* **Search.** All maximal scoring segments of a text come from one linear scan (a stack of left and right running
  sums); only positive tokens touch the stack.
* **Calibration.** The best segment of a clean text of n tokens follows an extreme-value law,
  P(S >= s) = 1 - exp(-K n exp(-lambda s)). lambda comes from the clean token distribution, K from clean training
  documents. The evidence of a document is the sum of -ln(expected number by chance) over its significant
  segments; a logistic curve fitted to the training documents maps it to 0..1. For K and the curve each training
  document is scored with weights learned from the other folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, lowest_per_group, split_stems, texts, with_batches

BITS = 20
STEM = 5
SMOOTH = 0.5
PRIOR = 100.0
Z = 1.0
DRIFT = 0.1
FIT_ROWS = 100_000
FOLDS = 4
THRESHOLD = 0.7


@dataclass
class Model:
    words: np.ndarray  # token score per word bin, drift included
    stems: np.ndarray
    rate: float = 1.0  # lambda
    k: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Shrunk log-odds of every bin from its token counts in toxic and in clean documents."""
    n1, n0 = toxic.sum(), clean.sum()
    prior = PRIOR * (toxic + clean) / max(n1 + n0, 1) + SMOOTH
    a, b = toxic + prior, clean + prior
    total1, total0 = n1 + prior.sum(), n0 + prior.sum()
    odds = np.log(a / (total1 - a)) - np.log(b / (total0 - b))
    sd = np.sqrt(1 / a + 1 / b)
    odds = np.sign(odds) * np.maximum(np.abs(odds) - Z * sd, 0)
    return np.where(toxic + clean > 0, odds, 0.0)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, token after the last, score), in order, in linear time.

    A segment is maximal if every proper part of it scores less and no segment that contains it is of that kind.
    """
    upto = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[list[float]] = []  # first, end, sum before, sum after
    for i in np.flatnonzero(scores > 0):
        first, left, right = int(i), upto[i], upto[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append([first, int(i) + 1, left, right])
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(int(a), int(b), float(r - l)) for a, b, l, r in stack]


def _token_scores(model: Model, words: np.ndarray, stems: np.ndarray) -> np.ndarray:
    shift = np.uint64(64 - BITS)
    w, s = model.words[words >> shift], model.stems[stems >> shift]
    return np.where(np.maximum(w, s) > 0, np.maximum(w, s), np.minimum(w, s)).astype(np.float64)


def _pick(rows: DataFrame, key: str, label: str, fit_rows: int) -> DataFrame:
    """(_k, y, fold): at most ``fit_rows`` labelled ids per class. Of ids labelled twice the higher label counts."""
    one = rows.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("y"))
    return (lowest_per_group(one, "y", fit_rows, [F.xxhash64("_k"), F.col("_k")])
            .select("_k", "y", F.pmod(F.xxhash64(F.lit(3), "_k"), F.lit(FOLDS)).cast("int").alias("fold")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of a task: (kind: 0 word, 1 stem; fold, bin, toxic, clean)."""
    counts = np.zeros((2, FOLDS, 2, 1 << BITS), np.int32)  # kind, fold, class, bin
    shift = np.uint64(64 - BITS)
    for batch in batches:
        y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for a, b, buf, offs in texts(batch.column(0)):
            words, stems, woff = split_stems(buf, offs, STEM)
            cell = np.repeat(fold[a:b] * 2 + y[a:b], np.diff(woff))
            for c in np.unique(cell):
                for kind, h in enumerate((words, stems)):
                    bins, n = np.unique(h[cell == c] >> shift, return_counts=True)
                    counts[kind, c // 2, c % 2, bins] += n.astype(np.int32)
    for kind in range(2):
        for fold in range(FOLDS):
            clean, toxic = counts[kind, fold]
            bins = np.flatnonzero(clean + toxic)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(bins), kind, np.int32)), pa.array(np.full(len(bins), fold, np.int32)), pa.array(bins.astype(np.int32)),
                 pa.array(toxic[bins].astype(np.int64)), pa.array(clean[bins].astype(np.int64))], names=["kind", "fold", "bin", "toxic", "clean"])


def _rate(p: np.ndarray, s: np.ndarray) -> float:
    """lambda > 0 with sum p * exp(lambda * s) = 1 for a score of negative mean."""
    if not (s[p > 0] > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    with np.errstate(over="ignore"):
        while (p * np.exp(high * s)).sum() < 1:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    return low or high


def _evidence(found: list[tuple[int, int, float]], n: int, rate: float, k: float) -> float:
    """Sum over segments of -ln of the number expected by chance in n tokens, where that is below one."""
    return float(sum(max(0.0, rate * s - np.log(max(k * n, 1e-9))) for _, _, s in found))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the labelled documents of ``docs``; without both classes the model scores every text alike."""
    spark = docs.sparkSession
    picked = _pick(labels, key, label, fit_rows)
    rows = with_batches(docs.filter(F.col(key).isNotNull()).select(key, text).join(F.broadcast(picked), F.col(key) == F.col("_k"))
                        .select(text, "y", "fold"))
    got = (rows.mapInArrow(_count, "kind int, fold int, bin int, toxic bigint, clean bigint")
           .groupBy("kind", "fold", "bin").agg(F.sum("toxic").cast("float").alias("toxic"), F.sum("clean").cast("float").alias("clean"))).checkpoint()
    counts = np.zeros((2, FOLDS, 2, 1 << BITS), np.float32)
    for kind in range(2):  # a fold's bins at a time: at most 2 ** BITS rows
        for fold in range(FOLDS):
            part = got.filter((F.col("kind") == kind) & (F.col("fold") == fold)).select("bin", "toxic", "clean").toArrow()
            at = part.column("bin").to_numpy()
            counts[kind, fold, 1, at] = part.column("toxic").to_numpy()
            counts[kind, fold, 0, at] = part.column("clean").to_numpy()

    def weights(c) -> Model:
        w, s = ((log_odds(c[kind, 1], c[kind, 0]) - DRIFT).astype(np.float32) for kind in range(2))
        clean = c[0, 0] + SMOOTH * (c[0].sum(axis=0) > 0)
        return Model(w, s, _rate(clean / max(clean.sum(), 1), w.astype(np.float64)))

    whole = weights(counts.sum(axis=1))
    if not (counts[0].sum(axis=(0, 2)) > 0).all():
        return whole
    folds = [weights(counts.sum(axis=1) - counts[:, f]) for f in range(FOLDS)]
    shared = spark.sparkContext.broadcast(folds)

    def best(batches):
        for batch in batches:
            fold, out = batch.column(2).to_numpy(), [[], []]
            for a, b, buf, offs in texts(batch.column(0)):
                words, stems, woff = split_stems(buf, offs, STEM)
                for i in range(b - a):
                    part = slice(woff[i], woff[i + 1])
                    found = segments(_token_scores(shared.value[fold[a + i]], words[part], stems[part]))
                    out[0].append(woff[i + 1] - woff[i])
                    out[1].append([s for _, _, s in found])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.float64()))],
                                             names=["y", "fold", "n", "s"])

    seen = rows.mapInArrow(best, "y int, fold int, n bigint, s array<double>").filter("n > 0")
    seen = seen.withColumn("rate", F.element_at(F.array(*[F.lit(float(f.rate)) for f in folds]), F.col("fold") + 1))
    seen = seen.withColumn("top", F.coalesce(F.array_max("s"), F.lit(0.0))).checkpoint()
    # K by maximum likelihood on the clean documents whose best segment is positive
    clean, chance = seen.filter("y = 0").agg(F.count_if(F.col("top") > 0), F.coalesce(F.sum(F.col("n") * F.exp(-F.col("rate") * F.col("top"))), F.lit(0.0))).first()
    whole.k = float(min(1.0, max(1, clean) / max(chance, 1.0)))
    least = F.log(F.greatest(F.lit(whole.k) * F.col("n"), F.lit(1e-9)))
    x = F.aggregate("s", F.lit(0.0), lambda a, s: a + F.greatest(F.lit(0.0), F.col("rate") * s - least))
    got = seen.select(x.alias("x"), "y").orderBy("x", "y").toArrow()  # two numbers for each of the bounded number of rows
    whole.intercept, whole.slope = _logistic(np.log1p(got.column("x").to_numpy()), got.column("y").to_numpy())
    return whole


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and (non-negative) slope of a ridge-regularised logistic curve, by Newton's method."""
    a = np.stack([np.ones_like(x), x], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (p - y) + ridge * beta
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


_SEGMENT = "array<struct<first:int,last:int,score:double>>"
_SEGMENT_PA = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))


def find_toxic(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``passages`` (significant segments as word positions and score), ``score`` and ``predicted`` to every row.

    A null, empty or blank text has no passages and the score of no evidence. Added names replace columns of ``df``.
    """
    names = [c for c in df.columns if c not in ("passages", "score", "predicted")]
    keep, at = [df.columns.index(c) for c in names], df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select(*names, F.lit(None).cast(_SEGMENT).alias("passages"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            passages, score = [], []
            for a, b, buf, offs in texts(batch.column(at)):
                words, stems, woff = split_stems(buf, offs, STEM)
                values = _token_scores(m, words, stems)
                for i in range(b - a):
                    n = int(woff[i + 1] - woff[i])
                    found = segments(values[woff[i]:woff[i + 1]])
                    x = np.log1p(_evidence(found, n, m.rate, m.k))
                    score.append(float(1 / (1 + np.exp(-(m.intercept + m.slope * x)))))
                    passages.append([{"first": f, "last": e - 1, "score": s} for f, e, s in found if m.rate * s > np.log(max(m.k * n, 1e-9))])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(passages, _SEGMENT_PA), pa.array(score, pa.float64()),
                                              pa.array([int(s >= threshold) for s in score], pa.int32())], names=[*names, "passages", "score", "predicted"])

    return with_batches(df).mapInArrow(run, schema)


def op10_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.filter(~held_out("doc_id", 3, 1)))
    out = find_toxic(docs.withColumn("held_out", held_out("doc_id", 3, 1)), model)
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))
