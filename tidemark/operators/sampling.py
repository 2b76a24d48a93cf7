"""Splits and resampling (R1-R8), all keyed by md5 so they repeat exactly.

Per-class positions come from ``ordered_index`` (range shuffle), so a majority
class holding most rows is still spread over many tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import hash_key
from tidemark.operators.ordering import ordered_index, with_group_size


def stratified_split(df: DataFrame, label: str, key: str, test_frac: float = 0.25, seed: int = 42,
                     out: str = "part") -> DataFrame:
    """Each class split in the same proportion: inside a class, rows ordered by
    ``md5(seed:key)``; the first ``round(test_frac * n_class)`` are ``test`` (R1)."""
    idx = ordered_index(df, [label], [hash_key(seed, F.col(key)), F.col(key)], name="_rn")
    sized = with_group_size(idx, [label], "_n")
    cut = F.round(F.lit(float(test_frac)) * F.col("_n"))
    return sized.withColumn(out, F.when(F.col("_rn") <= cut, "test").otherwise("train")).drop("_rn", "_n")


def stratified_mark(df: DataFrame, label: str, key: str, row: str, test_frac: float = 0.25, seed: int = 42, out: str = "part") -> DataFrame:
    """``stratified_split`` of wide checkpointed rows, which are neither exchanged nor written again: only (label, key, ``row``)
    are ordered, and a class's last test row marks where its test rows end. ``row`` is unique; it tells equal keys apart."""
    order = [hash_key(seed, F.col(key)), F.col(key), F.col(row)]
    sized = with_group_size(ordered_index(df.select(label, key, row), [label], order, name="_rn"), [label], "_n")
    place = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    last = sized.where(F.col("_rn") == F.round(F.lit(float(test_frac)) * F.col("_n"))).select(label, place.alias("_last"))  # one row per class
    from tidemark.operators.encode import _join_small

    marked = _join_small(df, last, [label])
    return marked.withColumn(out, F.when(F.col("_last").isNotNull() & (place <= F.col("_last")), "test").otherwise("train")).drop("_last")


def kfold_assign(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Stratified k folds: fold = (position in class - 1) mod k (R2)."""
    idx = ordered_index(df, [label], [hash_key(seed, F.col(key)), F.col(key)], name="_rn")
    return idx.withColumn(out, ((F.col("_rn") - 1) % F.lit(k)).cast("int")).drop("_rn")


def _draws(spark: SparkSession, n: int, replicates: int, seed: int) -> DataFrame:
    """``(replicate, draw, _pick)``: draw j of replicate r picks dense index ``int(md5('<seed+r>:<j>')[0:15], 16) mod n + 1``."""
    draws = spark.range(n * replicates).select(
        (F.col("id") / F.lit(n)).cast("long").cast("int").alias("replicate"),
        (F.col("id") % F.lit(n)).alias("draw"))
    h = F.md5(F.concat((F.col("replicate") + F.lit(seed)).cast("string"), F.lit(":"), F.col("draw").cast("string")))
    return draws.withColumn("_pick", F.conv(F.substring(h, 1, 15), 16, 10).cast("long") % F.lit(n) + 1)


def bootstrap(df: DataFrame, key: str, replicates: int = 10, seed: int = 42) -> DataFrame:
    """``replicates`` samples with replacement of the same size as ``df``.

    Draw j of replicate r picks the row at dense index
    ``int(md5('<seed+r>:<j>')[0:15], 16) mod n``. Draws come from ``spark.range``
    (distributed) and are equi-joined to the indexed rows.
    Output: ``replicate, draw`` plus the columns of ``df``.
    """
    spark = df.sparkSession
    idx = ordered_index(df, None, [F.col(key)], name="_idx")
    n = df.count()
    if n == 0:
        return idx.drop("_idx").withColumn("replicate", F.lit(0)).withColumn("draw", F.lit(0).cast("long")).limit(0)
    draws = _draws(spark, n, replicates, seed)
    return draws.join(idx, draws["_pick"] == idx["_idx"]).drop("_pick", "_idx")


def bootstrap_counts(df: DataFrame, key: str, replicates: int = 10, seed: int = 42, out: str = "draws") -> DataFrame:
    """The samples of ``bootstrap`` as multiplicities: every row once, with an int array ``out`` of how often each
    replicate draws it (zeros included). Fits read one table by weight instead of ``replicates`` copies of the rows;
    only (replicate, index) pairs are exchanged."""
    idx = ordered_index(df, None, [F.col(key)], name="_idx")
    n = idx.count()
    none = F.array_repeat(F.lit(0), replicates)
    if n == 0:
        return idx.drop("_idx").withColumn(out, none)
    per_row = _draws(df.sparkSession, n, replicates, seed).groupBy("_pick").agg(
        F.array(*[F.count(F.when(F.col("replicate") == r, True)).cast("int") for r in range(replicates)]).alias("_drawn"))
    joined = idx.join(per_row, F.col("_idx") == F.col("_pick"), "left")
    return joined.withColumn(out, F.coalesce("_drawn", none)).drop("_idx", "_pick", "_drawn")


def class_weights(df: DataFrame, label: str, mode: str = "balanced", out: str = "weight") -> DataFrame:
    """Per-class loss weights (R5): ``balanced`` = n / (k * n_c); ``uniform`` = 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    if mode == "uniform":
        return counts.select(label, "n_c", F.lit(1.0).alias(out))
    tot = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return counts.select(label, "n_c", (F.lit(float(tot["n"])) / (F.lit(float(tot["k"])) * F.col("n_c"))).alias(out))


def tail_validation(df: DataFrame, order, val_frac: float = 0.2, by=None, out: str = "role") -> DataFrame:
    """Last ``val_frac`` of the rows (unshuffled) validate (R6, keras ``validation_split``)."""
    from tidemark.operators.series import chrono_split
    return chrono_split(df, by or [], order, 1.0 - val_frac, out=out, labels=("train", "val"), pos="_pos").drop("_pos")


def param_grid(spark: SparkSession, spec: Mapping[str, Sequence]) -> DataFrame:
    """Full product of parameter values (R7), ``config_id`` in enumeration order.
    The grid is defined by the caller, so its size is known before it is built."""
    names = list(spec)
    rows = [(i, *combo) for i, combo in enumerate(itertools.product(*[spec[n] for n in names]))]
    return spark.createDataFrame(rows, ["config_id", *names])


def param_sample(grid: DataFrame, n: int, seed: int = 42, key: str = "config_id") -> DataFrame:
    """``n`` configurations drawn without replacement (R8): smallest md5 keys."""
    return grid.orderBy(hash_key(seed, F.col(key)), F.col(key)).limit(n)
