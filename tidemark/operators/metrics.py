"""Evaluation metrics (K1-K11) as aggregates over ``(label, prediction)`` columns.

Counts are summed as doubles so products in MCC cannot overflow. The
confusion table is built once in long form and every report is derived from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one(c: bool):
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def accuracy(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with label == prediction (K1)."""
    agg = F.avg(_one(F.col(y) == F.col(p))).alias("accuracy")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def confusion_long(df: DataFrame, y: str, p: str) -> DataFrame:
    """``(actual, predicted, count)`` for observed pairs (K2 long form)."""
    return df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(df: DataFrame, y: str, p: str, classes: Sequence | None = None, prefix: str = "p_") -> DataFrame:
    """Rows actual, columns predicted (sorted labels), zeros kept (K2)."""
    if classes is None:
        from tidemark.operators.profile import MAX_COLUMNS

        seen = df.select(F.col(y)).union(df.select(F.col(p))).distinct().limit(MAX_COLUMNS + 2).collect()
        classes = sorted(r[0] for r in seen if r[0] is not None)
        if len(classes) > MAX_COLUMNS:
            raise ValueError(f"more than {MAX_COLUMNS} classes; use confusion_long for the long form")
    out = df.groupBy(F.col(y).alias("actual")).pivot(p, list(classes)).count()
    names = [f"{prefix}{_name(c)}" for c in classes]
    return out.toDF("actual", *names).na.fill(0, subset=names)


def _name(v) -> str:
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """``label, tp, support, predicted`` for every class seen as label or prediction."""
    cm = confusion_long(df, y, p)
    actual = cm.groupBy(F.col("actual").alias("label")).agg(F.sum("count").cast("double").alias("support"))
    pred = cm.groupBy(F.col("predicted").alias("label")).agg(F.sum("count").cast("double").alias("predicted"))
    tp = (cm.where(F.col("actual") == F.col("predicted"))
          .groupBy(F.col("actual").alias("label")).agg(F.sum("count").cast("double").alias("tp")))
    j = actual.join(pred, "label", "full_outer").join(tp, "label", "left")
    return j.select("label", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("tp", "support", "predicted")])


def _prf(pc: DataFrame) -> DataFrame:
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    pc = pc.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return pc.withColumn("f1", f1)


def classification_report(df: DataFrame, y: str, p: str, digits: int = 6) -> DataFrame:
    """Per class precision / recall / F1 / support, then ``accuracy``, ``macro avg``
    and ``weighted avg`` rows (0/0 -> 0) (K3). ``label`` is text."""
    pc = _prf(per_class(df, y, p))
    rows = pc.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    tot = pc.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("k"),
                 F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                 (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                 (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                 (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    summary = tot.select(
        F.explode(F.array(
            F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                     F.col("n").alias("support")),
            _row("macro avg", "mp", "mr", "mf"),
            _row("weighted avg", "wp", "wr", "wf"),
        )).alias("r")).select("r.*")
    out = rows.unionByName(summary)
    return out.select("label", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def _row(label, p, r, f):
    return F.struct(F.lit(label).alias("label"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                    F.col(f).alias("f1"), F.col("n").alias("support"))


def weighted_f1(df: DataFrame, y: str, p: str, digits: int = 6) -> DataFrame:
    """Support-weighted mean F1 (K5)."""
    pc = _prf(per_class(df, y, p))
    return pc.agg(F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), digits).alias("weighted_f1"))


def mcc(df: DataFrame, y: str, p: str, digits: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """Binary Matthews correlation; 0 when the denominator is 0 (K4)."""
    yy, pp = F.col(y), F.col(p)
    sums = [F.sum(_one((yy == 1) & (pp == 1))).alias("tp"), F.sum(_one((yy == 0) & (pp == 0))).alias("tn"),
            F.sum(_one((yy == 0) & (pp == 1))).alias("fp"), F.sum(_one((yy == 1) & (pp == 0))).alias("fn")]
    s = df.groupBy(*by).agg(*sums) if by else df.agg(*sums)
    d = (F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn"))
    val = F.when(d == 0, F.lit(0.0)).otherwise((F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / F.sqrt(d))
    return s.select(*by, "tp", "tn", "fp", "fn", F.round(val, digits).alias("mcc"))


def mcc_multiclass(df: DataFrame, y: str, p: str, digits: int = 6) -> DataFrame:
    """Multiclass MCC (R_K): (c*s - sum p_k t_k) / sqrt((s^2 - sum p_k^2)(s^2 - sum t_k^2))."""
    pc = per_class(df, y, p)
    t = pc.agg(F.sum("tp").alias("c"), F.sum("support").alias("s"),
               F.sum(F.col("predicted") * F.col("support")).alias("pt"),
               F.sum(F.col("predicted") * F.col("predicted")).alias("pp"),
               F.sum(F.col("support") * F.col("support")).alias("tt"))
    d = (F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt"))
    val = F.when(d == 0, F.lit(0.0)).otherwise((F.col("c") * F.col("s") - F.col("pt")) / F.sqrt(d))
    return t.select(F.round(val, digits).alias("mcc"))


def regression_metrics(df: DataFrame, actual: str, pred: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """MSE and R^2 = 1 - SSE/SST (may be negative) per group (K6, K7)."""
    by = list(by)
    rows = df.where(F.col(actual).isNotNull() & F.col(pred).isNotNull())
    means = rows.groupBy(*by).agg(F.avg(actual).alias("_mean")) if by else None
    if by:
        from tidemark.operators.encode import _join_small

        j = _join_small(rows, means, by, how="inner")  # null groups included
    else:
        j = rows.withColumn("_mean", F.lit(rows.agg(F.avg(actual)).first()[0]))
    err = F.col(actual) - F.col(pred)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"),
            F.sum(err * err).alias("_sse"), F.sum((F.col(actual) - F.col("_mean")) ** 2).alias("_sst")]
    s = j.groupBy(*by).agg(*aggs) if by else j.agg(*aggs)
    r2 = F.when(F.col("_sst") == 0, F.lit(None).cast("double")).otherwise(1 - F.col("_sse") / F.col("_sst"))
    return s.select(*by, "n", F.round("mse", digits).alias("mse"), F.round(r2, digits).alias("r2"))


def bce_loss(df: DataFrame, y: str, prob: str, eps: float = 1e-7, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Mean of -[y log(p + eps) + (1 - y) log(1 - p + eps)] (K8)."""
    yy, pp = F.col(y).cast("double"), F.col(prob)
    loss = -(yy * F.log(pp + F.lit(eps)) + (1 - yy) * F.log(1 - pp + F.lit(eps)))
    agg = F.round(F.avg(loss), digits).alias("bce")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def row_bce(y: str, prob: str, eps: float = 1e-7):
    yy, pp = F.col(y).cast("double"), F.col(prob)
    return -(yy * F.log(pp + F.lit(eps)) + (1 - yy) * F.log(1 - pp + F.lit(eps)))


def avg_batch_loss(df: DataFrame, batch: str, loss: str, digits: int = 6) -> DataFrame:
    """Mean of per-batch mean losses (K9), not the per-row mean."""
    per = df.groupBy(batch).agg(F.avg(loss).alias("_b"))
    return per.agg(F.count(F.lit(1)).alias("n_batches"), F.round(F.avg("_b"), digits).alias("avg_batch_loss"))


def majority_baseline(train: DataFrame, test: DataFrame, y: str, digits: int = 6) -> DataFrame:
    """Accuracy of always predicting the most frequent training class (smallest on ties)."""
    top = train.groupBy(y).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), F.col(y)).first()
    cls = top[0] if top is not None else None
    return test.agg(F.lit(cls).alias("majority_class"),
                    F.round(F.avg(_one(F.col(y) == F.lit(cls))), digits).alias("accuracy"))
