"""Trained operators (J1-J13) on MLlib, plus the vote and comparison tables around them.

Features enter MLlib as vectors only at the model boundary (``array_to_vector``);
everything before and after stays in DataFrame columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import numpy as np

    from tidemark.operators.boost import Forest


def two_level_vote(votes: DataFrame, key: str, family: str, pred: str, cut: float = 0.5) -> DataFrame:
    """Bagging vote (J10): per (row, family) the mean of replicate votes >= cut gives
    0/1; then the mean over families >= cut (a 2-2 tie gives 1).
    ``votes`` is long: one row per (row, family, replicate)."""
    fam = votes.groupBy(key, family).agg((F.avg(F.col(pred).cast("double")) >= F.lit(cut)).cast("int").alias("_fv"))
    return fam.groupBy(key).agg(F.sum("_fv").cast("long").alias("n_family_yes"),
                                (F.avg(F.col("_fv").cast("double")) >= F.lit(cut)).cast("int").alias("pred"))


# ---- feature vectors at the MLlib boundary ------------------------------------------------------

def as_vector(df: DataFrame, cols, out: str = "features") -> DataFrame:
    """Scalar columns or one array column -> an MLlib vector column."""
    from pyspark.ml.functions import array_to_vector

    if isinstance(cols, str):
        return df.withColumn(out, array_to_vector(F.col(cols).cast("array<double>")))
    arr = F.array(*[F.col(c).cast("double") for c in cols])
    return df.withColumn(out, array_to_vector(arr))


def predictions(model, df: DataFrame, key: str, label: str, out: str = "prediction") -> DataFrame:
    """``(key, label, prediction)`` from a fitted model; predictions stay on their rows."""
    return model.transform(df).select(key, label, F.col("prediction").alias(out))


# ---- J1: lag regressor -------------------------------------------------------------------------

def fit_lag_regressor(windows: DataFrame, x: str = "x", y: str = "y", reg_param: float = 0.0):
    """Next scaled value from the k previous ones: least squares over every series
    at once (normal equations: one distributed aggregation of k x k statistics)."""
    from pyspark.ml.regression import LinearRegression

    data = as_vector(windows, x)
    return LinearRegression(featuresCol="features", labelCol=y, solver="normal", regParam=reg_param).fit(data)


def forecast(model, windows: DataFrame, x: str = "x", out: str = "pred") -> DataFrame:
    return model.transform(as_vector(windows, x)).withColumnRenamed("prediction", out).drop("features")


# ---- J2-J8: classifiers ---------------------------------------------------------------------------

def random_forest(train: DataFrame, label: str, num_trees: int = 100, seed: int = 42, max_depth: int = 5, weight: str | None = None):
    from pyspark.ml.classification import RandomForestClassifier

    rf = RandomForestClassifier(labelCol=label, numTrees=num_trees, seed=seed, maxDepth=max_depth)
    return (rf.setWeightCol(weight) if weight else rf).fit(train)


# Bytes of binned rows (4 a feature) that the concurrent fits of ``boosted_ovr`` keep in memory together.
OVR_BYTES = 1 << 32


def fits_at_once(rows: int, features: int, most: int = 4) -> int:
    """How many boosting fits may run side by side: every one keeps binned rows of its own for all its rounds, and rows
    that do not stay in memory are read from disk again at every level of every tree."""
    return max(1, min(most, OVR_BYTES // max(1, rows * features * 4)))


def boosted_ovr(train: DataFrame, label: str, key: str, rounds: int = 100, seed: int = 42, depth: int = 5, rate: float = 0.1, features: str = "features"):
    """Multiclass boosting, one booster per class against the rest, by the rules of MLlib's ``OneVsRest(GBTClassifier)``:
    squared-error trees on 32 bins, the first on classes -1 and 1, the others on the negative gradients of the logistic loss.
    All classes grow together on one set of binned rows (``boost``). Returns a model whose ``transform`` adds ``prediction``."""
    from pyspark.ml.functions import vector_to_array

    from tidemark.operators import boost

    rows = train.select(key, label, vector_to_array(features).alias("_x")).checkpoint()
    edges = boost.half_edges(rows, "_x")
    classes = int(rows.agg(F.max(label)).first()[0] or 0) + 1
    blocks = boost.make_blocks(rows, edges, "_x", label, key)
    params = boost.Params(rounds=rounds, depth=depth, rate=rate, reg=0.0, apart=True)
    (forest,), _ = boost.fit_many(blocks, [boost.Fit(params, seed=seed)], len(edges), classes)
    return ForestModel(forest, edges, features)


@dataclass
class ForestModel:
    """A grown forest that reads a vector column, which comes out as an array."""

    forest: Forest
    edges: np.ndarray
    features: str

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        from tidemark.operators import boost

        return boost.predict(df.withColumn(self.features, vector_to_array(self.features)), self.forest, self.edges, self.features)


def logistic(train: DataFrame, label: str, reg_param: float = 0.0, weight: str | None = None, max_iter: int = 100):
    from pyspark.ml.classification import LogisticRegression

    lr = LogisticRegression(labelCol=label, regParam=reg_param, maxIter=max_iter)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(train)


def linear_svc(train: DataFrame, label: str, reg_param: float = 0.0, max_iter: int = 100, weight: str | None = None):
    from pyspark.ml.classification import LinearSVC

    svc = LinearSVC(labelCol=label, regParam=reg_param, maxIter=max_iter)
    return (svc.setWeightCol(weight) if weight else svc).fit(train)


def mlp(train: DataFrame, label: str, layers, seed: int = 42, max_iter: int = 100, block_size: int = 128):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(labelCol=label, layers=list(layers), seed=seed, maxIter=max_iter,
                                          blockSize=block_size).fit(train)


# ---- J4: MCC evaluator and random search ------------------------------------------------------------

def _mcc_value(df: DataFrame, label: str, pred: str) -> float:
    from tidemark.operators.metrics import mcc

    return float(mcc(df, label, pred, digits=12).first()["mcc"])


def mcc_evaluator(label: str = "label", pred: str = "prediction"):
    """An MLlib ``Evaluator`` scoring binary MCC (larger is better)."""
    from pyspark.ml.evaluation import Evaluator

    class MCCEvaluator(Evaluator):
        def _evaluate(self, dataset):
            return _mcc_value(dataset, label, pred)

        def isLargerBetter(self):
            return True

    return MCCEvaluator()


# The boosting search space.
BOOST_SPACE = {
    "rounds": [50, 100, 200, 300],
    "depth": [3, 4, 5, 6, 8],
    "rate": [0.01, 0.05, 0.1, 0.2],
    "subsample": [0.6, 0.8, 1.0],
    "colsample": [0.6, 0.8, 1.0],
    "min_child": [1, 3, 5],
    "gamma": [0.0, 0.1, 0.2],
}
# Classes are balanced by SMOTE if the smallest has less than this share of the largest's rows.
SMOTE_BELOW = 0.8


def smote_contexts(train: DataFrame, label: str, key: str, vec: str, fold: str, folds: int, k: int = 5, seed: int = 42) -> DataFrame:
    """Training rows (key, label, vec, fold, only) plus SMOTE rows for every set they are learned from: the rows outside
    fold f (``only`` = f) and all rows (``only`` = folds). Real rows have ``only`` null; a synthetic row is made from
    rows of its own set alone, so that no held-out row leaks into it."""
    from concurrent.futures import ThreadPoolExecutor

    from tidemark.operators.vectors import smote

    real = train.select(F.col(key).cast("long").alias(key), F.col(label).cast("int").alias(label), F.col(vec).cast("array<double>").alias(vec),
                        F.col(fold).cast("int").alias(fold)).checkpoint()

    def balanced(f: int) -> DataFrame | None:
        part = real.where(F.col(fold) != f)
        n = [r["count"] for r in part.groupBy(label).count().collect()]  # one row per class
        if len(n) < 2 or min(n) >= SMOTE_BELOW * max(n):
            return None
        new = smote(part, label, key, vec, k, seed + f)
        return new.select((-(F.col("syn_id") + 1)).alias(key), F.col(label).cast("int").alias(label), vec, F.lit(None).cast("int").alias(fold), F.lit(f).alias("only")).checkpoint()

    with ThreadPoolExecutor(max_workers=3) as pool:
        made = [m for m in pool.map(balanced, range(folds + 1)) if m is not None]
    out = real.withColumn("only", F.lit(None).cast("int"))
    for m in made:
        out = out.unionByName(m)
    return out


def boost_random_search(train: DataFrame, label: str, key: str, vec: str, fold: str, n_iter: int = 20, seed: int = 42,
                        space: dict | None = None, folds: int = 5):
    """Boosted trees: ``n_iter`` configurations drawn from the grid by md5 order, each scored by the mean MCC over
    ``folds`` folds with SMOTE in the training folds; the best one (the first drawn on ties) is fitted on all rows,
    balanced likewise (J4). All fits grow together. Trees split on quantile bins, which scaling a feature does not
    change, so there is no scaler. Returns ``(forest, edges, scores(config_id, parameters, cv_mcc))``."""
    from tidemark.operators import boost
    from tidemark.operators.sampling import param_grid, param_sample

    spark = train.sparkSession
    grid = param_grid(spark, space or BOOST_SPACE)
    picked = [r.asDict() for r in param_sample(grid, n_iter, seed).collect()]  # n_iter rows
    configs = [boost.Params(**{k: v for k, v in c.items() if k != "config_id"}) for c in picked]
    rows = smote_contexts(train, label, key, vec, fold, folds, seed=seed)
    edges = boost.bin_edges(rows.where(F.col("only").isNull()), vec)
    blocks = boost.make_blocks(rows, edges, vec, label, key, fold, "only")
    _, seen = boost.fit_many(blocks, [boost.Fit(p, f, seed) for p in configs for f in range(folds)], len(edges), 2, keep=False)
    means = [sum(boost.matthews(c) for c in seen[k * folds:(k + 1) * folds]) / folds for k in range(len(configs))]
    best = max(range(len(configs)), key=lambda k: (means[k], -k))
    (forest,), _ = boost.fit_many(blocks, [boost.Fit(configs[best], folds, seed)], len(edges), 2)
    scores = spark.createDataFrame([(c["config_id"], m) for c, m in zip(picked, means)], "config_id long, cv_mcc double").join(grid, "config_id")
    return forest, edges, scores


def boosted_softmax(train: DataFrame, label: str, key: str, features: str, n_classes: int, rounds: int = 100, depth: int = 3, rate: float = 0.1,
                    seed: int = 42):
    """One multiclass booster (softmax, one tree per class and round) on an array column (J3): ``(forest, edges)``."""
    from tidemark.operators import boost

    edges = boost.bin_edges(train, features)
    blocks = boost.make_blocks(train, edges, features, label, key)
    (forest,), _ = boost.fit_many(blocks, [boost.Fit(boost.Params(rounds=rounds, depth=depth, rate=rate), seed=seed)], len(edges), n_classes)
    return forest, edges


# ---- J9: network grid ---------------------------------------------------------------------------------

# The network search space.
NETWORK_SPACE = {
    "rate": [1e-4, 5e-4, 1e-3],
    "hidden": [(128, 64), (256, 128), (128, 64, 32)],
    "dropout": [0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "batch": [32, 64, 128],
}


def network_grid(df: DataFrame, label: str, key: str, vec: str, role: str, train: str, width: int, n_classes: int, space: dict | None = None,
                 epochs: int = 50, patience: int = 0, seed: int = 42):
    """Train a network for every combination of ``space`` (in enumeration order), judged on the rows whose ``role`` is
    not ``train``. Returns the states, without weights, and a table ``(config_id, rate, hidden, dropout, batch, epochs, val_accuracy, val_mcc)``."""
    from itertools import product

    from tidemark.operators import network

    space = space or NETWORK_SPACE
    configs = [network.Config(**dict(zip(space, c)), epochs=epochs, patience=patience, seed=seed) for c in product(*space.values())]
    states = network.fit_many(network.make_blocks(df, vec, label, key, role, train), configs, width, n_classes, keep=False)
    rows = []
    for k, s in enumerate(states):
        at = {e: (acc, mcc) for e, _, acc, mcc in s.history}.get(s.best_epoch, (None, None))
        rows.append((k, float(s.config.rate), "-".join(map(str, s.config.hidden)), float(s.config.dropout), s.config.batch, len(s.history), *at))
    schema = "config_id int, rate double, hidden string, dropout double, batch int, epochs int, val_accuracy double, val_mcc double"
    return states, df.sparkSession.createDataFrame(rows, schema)


# ---- J10: bagging -------------------------------------------------------------------------------------

def bagging_votes(train: DataFrame, score: DataFrame, key: str, label: str, replicates: int = 10, seed: int = 42,
                  knn_vec: str | None = None, families: tuple = ("lr", "svc", "rf", "knn"),
                  parallelism: int = 4) -> DataFrame:
    """Long vote table ``(key, family, replicate, pred)``: every family is fitted on
    each bootstrap replicate (seed + replicate) and predicts ``score``. The
    replicates are weights on one checkpointed copy of the training rows (a row drawn
    three times weighs three; for the neighbours it stands there three times). The
    replicate x family fits are independent Spark jobs submitted from a few
    driver threads, so they share the cluster instead of queueing; the neighbours of
    all replicates come from one pass over the distances."""
    from concurrent.futures import ThreadPoolExecutor

    from tidemark.operators.sampling import bootstrap_counts
    from tidemark.operators.vectors import knn_classify_drawn

    spark = train.sparkSession
    drawn = bootstrap_counts(train, key, replicates, seed, "_draws").checkpoint(eager=True)

    def one(task):
        r, fam = task
        if fam == "knn":  # of every replicate
            v = (knn_classify_drawn(score.select(key, knn_vec), drawn.select(key, knn_vec, label, "_draws"), 5, key, key, label, "_draws", knn_vec)
                 .select(key, F.col("pred").cast("int").alias("pred"), F.lit(fam).alias("family"), "replicate"))
            return v.checkpoint(eager=True)
        sample = drawn.withColumn("_w", F.col("_draws")[r].cast("double")).where(F.col("_w") > 0).drop("_draws")
        fit = {"lr": logistic, "svc": linear_svc,
               "rf": lambda d, lab, weight: random_forest(d, lab, 100, seed + r, weight=weight)}[fam]
        m = fit(sample, label, weight="_w")
        v = m.transform(score).select(key, F.col("prediction").cast("int").alias("pred"))
        v = v.withColumn("family", F.lit(fam)).withColumn("replicate", F.lit(r))
        return v.checkpoint(eager=True)  # small: one vote per scored row

    tasks = [(0, fam) for fam in families if fam == "knn" and knn_vec is not None and replicates > 0]
    tasks += [(r, fam) for r in range(replicates) for fam in families if fam != "knn"]
    if not tasks:
        return spark.createDataFrame([], f"{key} long, pred int, family string, replicate int")
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        parts = list(pool.map(one, tasks))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
