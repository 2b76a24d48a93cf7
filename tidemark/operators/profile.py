"""Profiling aggregates (D1-D11): counts, shares, top-k, timelines, crosstabs,
describe, histograms.

All are one partial+final aggregation; hot values are absorbed by the map-side
partial aggregate. Quantiles are exact and distributed (``exact_quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Count per non-null value, most frequent first, then by value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.col(name).desc(), F.col(col).asc()))


def value_shares(df: DataFrame, col: str, name: str = "pct", digits: int = 2) -> DataFrame:
    """Percentage of non-null rows per value, rounded (D2). The total is a second
    (one-row) aggregate joined as a scalar, not a global window."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return (counts.select(col, F.round(F.col("_n") * F.lit(100.0) / F.lit(total), digits).alias(name))
            .orderBy(F.col(col)))


def top_values(df: DataFrame, col: str, k: int = 10, name: str = "count") -> DataFrame:
    """The k most frequent values (D3): TakeOrderedAndProject, no global sort."""
    return value_counts(df, col, name).limit(k)


def timeline(df: DataFrame, date_col: str, name: str = "count") -> DataFrame:
    """Rows per date in date order; dates without rows are absent."""
    return (df.where(F.col(date_col).isNotNull()).groupBy(date_col)
            .agg(F.count(F.lit(1)).alias(name)).orderBy(date_col))


def pair_counts(df: DataFrame, a: str, b: str, name: str = "count") -> DataFrame:
    """Long-form contingency counts for non-null pairs."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(a, b).agg(F.count(F.lit(1)).alias(name)))


MAX_COLUMNS = 1000


def crosstab(df: DataFrame, a: str, b: str, values: Sequence | None = None,
             names: Sequence[str] | None = None) -> DataFrame:
    """Wide contingency table, missing pairs 0, null pairs dropped.

    ``values`` are the column values of ``b``; when omitted they are read as a
    distinct list of at most ``MAX_COLUMNS`` values (more raise an error: use the
    long form ``pair_counts``). ``names`` renames the pivoted columns.
    """
    base = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if values is None:
        values = sorted(r[0] for r in base.select(b).distinct().limit(MAX_COLUMNS + 1).collect())
        if len(values) > MAX_COLUMNS:
            raise ValueError(f"{b} has more than {MAX_COLUMNS} values; use pair_counts for the long form")
    out = base.groupBy(a).pivot(b, list(values)).count()
    names = list(names) if names else [str(v) for v in values]
    out = out.toDF(a, *names)  # positional rename: pivot names such as "1.0" are not valid paths
    return out.na.fill(0, subset=names).orderBy(a)


# Values of one group that a task may sort for one quantile; sketches narrow the interval until it holds no more.
GATHER_ROWS = 65_536
_GRID, _ACCURACY = 1_000, 10_000


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas / DuckDB ``quantile_cont``) of all groups at once.

    The values are written once to the checkpoint folder and not exchanged, as long as the intervals (one per group
    and quantile) are few enough to be broadcast. An interval around each quantile's
    ranks starts as the whole line. While more than ``GATHER_ROWS`` values lie inside it, a mergeable sketch of the
    values inside gives a grid of 1,000 approximate quantiles, the interval shrinks to the few grid steps that must
    hold the ranks, and one aggregate counts the values below, at and between its ends exactly. A round leaves less
    than a hundredth of the values, so 10^12 need five; equal values sit on an end, however many they are. The rest
    is counted by value and read off. Result: one row per group with columns ``q_<i>``; without ``by`` one row, null
    if there is no value.
    """
    vals = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(*by, F.col(col).cast("double").alias("_v"))
    return _narrowed_quantiles(vals.checkpoint(eager=True), qs, list(by))


def _narrowed_quantiles(vals: DataFrame, qs: Sequence[float], by: list[str], gather: int = GATHER_ROWS) -> DataFrame:
    from tidemark.operators.encode import _join_small

    keys = by or ["_g"]
    if not by:
        vals = vals.withColumn("_g", F.lit(0))
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    first_in, first_hi = F.col("_below") + F.col("_at"), F.col("_below") + F.col("_at") + F.col("_in")
    counts = [F.count(F.when(v < lo, 1)).alias("_below"), F.count(F.when(v == lo, 1)).alias("_at"),
              F.count(F.when((v > lo) & (v < hi), 1)).alias("_in"), F.count(F.when(v == hi, 1)).alias("_top")]
    h = (F.col("_n") - 1) * F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("_q") + 1)
    ranks = [F.floor(h).alias("_r0"), F.ceil(h).alias("_r1"), (h - F.floor(h)).alias("_frac")]  # from 0
    sizes = (vals.withColumn("_lo", F.lit(float("-inf"))).withColumn("_hi", F.lit(float("inf")))
             .groupBy(*keys, "_lo", "_hi").agg(F.count(F.lit(1)).alias("_n"), *counts))
    bounds = (sizes.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(len(qs) - 1)))).select("*", *ranks).drop("_n")
              .checkpoint(eager=True))
    fixed = [*keys, "_q", "_r0", "_r1", "_frac"]
    inside = (F.col("_r1") >= first_in) & (F.col("_r0") < first_hi)  # a rank lies between the ends
    wide = inside & (F.col("_in") > gather)
    while not bounds.where(wide).isEmpty():
        todo = bounds.where(wide)
        within = _join_small(vals, todo, keys, how="inner").where((v > lo) & (v < hi))
        grid = within.groupBy(*keys, "_q").agg(F.percentile_approx("_v", [k / _GRID for k in range(_GRID + 1)], _ACCURACY).alias("_grid"))
        # 0-based ranks among the values inside; one grid step to either side is ten times the sketch's rank error
        r0, r1 = F.greatest(F.col("_r0") - first_in, F.lit(0)), F.least(F.col("_r1") - first_in, F.col("_in") - 1)
        left = F.floor(r0 * F.lit(float(_GRID)) / F.col("_in")).cast("int") - 1
        right = F.ceil((r1 + 1) * F.lit(float(_GRID)) / F.col("_in")).cast("int") + 1
        new_lo = F.when((left < 0) | (F.col("_r0") < first_in), lo).otherwise(F.get("_grid", left))
        new_hi = F.when((right > _GRID) | (F.col("_r1") >= first_hi), hi).otherwise(F.get("_grid", right))
        moved = _join_small(todo, grid, [*keys, "_q"], how="inner").select(*fixed, new_lo.alias("_lo"), new_hi.alias("_hi")).checkpoint(eager=True)
        counted = _join_small(vals, moved, keys, how="inner").groupBy(*fixed, "_lo", "_hi").agg(*counts)
        bounds = bounds.where(~wide).unionByName(counted).checkpoint(eager=True)
    left = _join_small(vals, bounds.where(inside), keys, how="inner").where((v > lo) & (v < hi))
    by_value = left.groupBy(*fixed, "_below", "_at", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = first_in + F.sum("_c").over(Window.partitionBy(*keys, "_q").orderBy("_v"))  # at most ``gather`` rows
    read = (by_value.withColumn("_upto", upto).groupBy(*keys, "_q")
            .agg(*[F.min(F.when(F.col("_upto") > F.col(k), v)).alias(f"{k}_v") for k in ("_r0", "_r1")]))
    both = _join_small(bounds, read, [*keys, "_q"], how="left")
    v0, v1 = [F.when(F.col(k) < first_in, lo).when(F.col(k) >= first_hi, hi).otherwise(F.col(f"{k}_v")) for k in ("_r0", "_r1")]
    missed = (F.col("_r0") < F.col("_below")) | (F.col("_r1") >= first_hi + F.col("_top"))  # beyond the sketch's error bound
    value = F.when(missed, F.raise_error(F.lit("a quantile lies outside its interval"))).when(v0 == v1, v0).otherwise(v0 + (v1 - v0) * F.col("_frac"))
    aggs = [F.max(F.when(F.col("_q") == i, value)).alias(f"q_{i}") for i in range(len(qs))]
    return both.groupBy(*by).agg(*aggs) if by else both.agg(*aggs)


def describe(df: DataFrame, col: str, digits: int | None = 2, exact: bool = True) -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75 % (linear interpolation), max.

    ``exact=False`` uses ``percentile_approx`` (single pass, bounded memory).
    """
    x = F.col(col).cast("double")
    # the cleaned value column is written once to the checkpoint folder: moments,
    # quantiles then read n doubles instead of recomputing the input plan
    vals = df.select(x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan(F.col("_x"))).checkpoint(eager=True)
    v = F.col("_x")
    moments = vals.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                       F.min(v).alias("min"), F.max(v).alias("max"))
    m = moments.first()
    if exact:
        qs = _narrowed_quantiles(vals.select(F.col("_x").alias("_v")), [0.25, 0.5, 0.75], []).select(
            F.col("q_0").alias("p25"), F.col("q_1").alias("p50"), F.col("q_2").alias("p75"))
    else:
        qs = vals.agg(F.percentile_approx(v, [0.25, 0.5, 0.75], 10000).alias("_p")).select(
            F.col("_p")[0].alias("p25"), F.col("_p")[1].alias("p50"), F.col("_p")[2].alias("p75"))
    q = qs.first() if m["count"] else None
    row = {**m.asDict(), **(q.asDict() if q is not None else {"p25": None, "p50": None, "p75": None})}
    cols = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    spark = df.sparkSession
    out = spark.createDataFrame([tuple(row[c] if c == "count" else (None if row[c] is None else float(row[c]))
                                       for c in cols)],
                                "count long, mean double, std double, min double, p25 double, p50 double, "
                                "p75 double, max double")
    if digits is not None:
        out = out.select("count", *[F.round(c, digits).alias(c) for c in cols[1:]])
    return out


def histogram(df: DataFrame, col: str, bins: int = 20, digits: int = 6) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed, empty bins kept, nulls and NaN not counted."""
    x = F.col(col).cast("double")
    base = df.where(F.col(col).isNotNull() & ~F.isnan(x))
    st = base.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    spark = df.sparkSession
    if st["lo"] is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, count long")
    lo, hi = float(st["lo"]), float(st["hi"])
    width = (hi - lo) / bins
    idx = (F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0))
    counts = base.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (edges.join(counts, "bin", "left")
            .select("bin",
                    F.round(F.lit(lo) + F.col("bin") * F.lit(width), digits).alias("bin_lo"),
                    F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), digits).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
            .orderBy("bin"))


def class_balance(df: DataFrame, label: str, threshold: float = 0.8) -> DataFrame:
    """Per-class counts, min/max ratio and the imbalance flag.

    One row: ``n_classes, min_count, max_count, ratio, imbalanced``; the flag is
    set when there is more than one class and ratio < threshold.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ratio = F.min("_n").cast("double") / F.max("_n").cast("double")
    return counts.agg(
        F.count(F.lit(1)).alias("n_classes"), F.min("_n").alias("min_count"), F.max("_n").alias("max_count"),
        F.round(ratio, 6).alias("ratio"),
        ((F.count(F.lit(1)) > 1) & (ratio < F.lit(threshold))).alias("imbalanced"))


def dataset_summary(df: DataFrame, date_col: str | None = None, key_col: str | None = None) -> DataFrame:
    """Row count, column count, date span, distinct keys."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_cols")]
    if date_col:
        aggs += [F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date")]
    if key_col:
        aggs += [F.countDistinct(key_col).alias("n_keys")]
    return df.agg(*aggs)
