"""Encoders and scalers (C1-C9): ``fit_*`` returns a small DataFrame of
parameters (one row per category or per group), ``apply_*`` joins it back.

Category tables have one row per distinct value; they are broadcast only after
their row count is checked (``_join_small``), otherwise joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import BROADCAST_ROWS, ordered_index


def _join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left",
                null_safe: bool = True, rows: int | None = None) -> DataFrame:
    """Join a fitted parameter table; broadcast it when its size is checked small.
    ``rows`` is a known upper bound of its row count (then it is not re-counted)."""
    if rows is None:
        small = small.checkpoint(eager=True)  # small; cut its lineage so it is computed once
        rows = small.count()
    if rows <= BROADCAST_ROWS:
        small = F.broadcast(small)
    tmp = [f"_k{i}" for i in range(len(on))]
    s = small.select(*[F.col(c).alias(t) for c, t in zip(on, tmp)], *[c for c in small.columns if c not in on])
    cond = None
    for c, t in zip(on, tmp):
        e = F.col(c).eqNullSafe(F.col(t)) if null_safe else F.col(c) == F.col(t)
        cond = e if cond is None else cond & e
    return big.join(s, cond, how).drop(*tmp)


# ---- C1 / C2: factorize (first-appearance codes) --------------------------------------------

def fit_factorize(df: DataFrame, col: str, order_key: str, code: str = "code") -> DataFrame:
    """Uniques of ``col`` in order of first appearance along ``order_key`` (C2):
    ``(col, code)`` with codes 0.. ; null is not a unique."""
    firsts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(order_key).alias("_first"))
    return (ordered_index(firsts, None, [F.col("_first"), F.col(col)], name="_rn")
            .select(col, (F.col("_rn") - 1).cast("int").alias(code)))


def apply_codes(df: DataFrame, fitted: DataFrame, col: str, code: str = "code", missing: int = -1) -> DataFrame:
    """Replace values by codes; null or unseen -> ``missing`` (C1, C3 transform)."""
    out = _join_small(df, fitted.select(col, code), [col], null_safe=False)
    return out.withColumn(code, F.coalesce(F.col(code), F.lit(missing)).cast("int"))


def factorize(df: DataFrame, col: str, order_key: str, code: str = "code") -> DataFrame:
    """``pd.factorize(col)[0]``."""
    return apply_codes(df, fit_factorize(df, col, order_key, code), col, code)


def factorize_columns(df: DataFrame, codes: dict[str, str], order_key: str) -> DataFrame:
    """``factorize`` of several columns (column -> name of its codes) from one pass over ``df``: the first appearances
    of all columns' values, held as text, come from one aggregate."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in codes])
    firsts = (df.select(F.col(order_key).alias("_k"), F.explode(pairs).alias("_p")).where(F.col("_p.v").isNotNull())
              .groupBy(F.col("_p.c").alias("_c"), F.col("_p.v").alias("_v")).agg(F.min("_k").alias("_first")))
    fitted = ordered_index(firsts, ["_c"], [F.col("_first"), F.col("_v")], name="_rn").checkpoint()
    for c, code in codes.items():
        own = fitted.where(F.col("_c") == c).select("_v", (F.col("_rn") - 1).cast("int").alias(code))
        df = _join_small(df.withColumn("_v", F.col(c).cast("string")), own, ["_v"], null_safe=False)
        df = df.withColumn(code, F.coalesce(F.col(code), F.lit(-1)).cast("int")).drop("_v")
    return df


# ---- C3 / C4: sorted label codes and the class map --------------------------------------------

def fit_label_encoder(df: DataFrame, col: str, code: str = "code") -> DataFrame:
    """Codes 0.. in sorted value order (C3, C4): ``(col, code)``."""
    distinct = df.where(F.col(col).isNotNull()).select(col).distinct()
    return ordered_index(distinct, None, [F.col(col)], name="_rn").select(
        col, (F.col("_rn") - 1).cast("int").alias(code))


def fit_label_encoders(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, int]:
    """Sorted-order codes for several columns of one type in one pass:
    ``(_ci, _v, _code)`` (column index, value, code). The values of all columns are
    stacked, deduplicated with partial aggregation and ranked per column with the
    range shuffle; the table is checkpointed and counted once. Returns it and its
    row count."""
    stacked = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_ci"), F.col(c).alias("_v"))
                                           for i, c in enumerate(cols)])))
    distinct = stacked.where(F.col("_v").isNotNull()).distinct()
    codes = ordered_index(distinct, ["_ci"], [F.col("_v")], name="_rn").select(
        "_ci", "_v", (F.col("_rn") - 1).cast("int").alias("_code")).checkpoint(eager=True)
    return codes, codes.count()


def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Refit a sorted-order encoder for each column (C3); unseen/null -> -1.
    Columns of one type are fitted together in one pass over ``df``."""
    cols = list(cols)
    if len({df.schema[c].dataType for c in cols}) != 1:
        out = df
        for c in cols:
            out = apply_codes(out, fit_label_encoder(df, c, c + suffix), c, c + suffix)
        return out
    codes, rows = fit_label_encoders(df, cols)
    out = df
    for i, c in enumerate(cols):
        fitted = codes.where(F.col("_ci") == i).select(F.col("_v").alias(c), F.col("_code").alias(c + suffix))
        out = _join_small(out, fitted, [c], null_safe=False, rows=rows)
        out = out.withColumn(c + suffix, F.coalesce(F.col(c + suffix), F.lit(-1)).cast("int"))
    return out


def decode(df: DataFrame, fitted: DataFrame, code_col: str, col: str, code: str = "code",
           out: str | None = None) -> DataFrame:
    """Reverse map: code -> value (C4 ``IndexToString``)."""
    rev = fitted.select(F.col(code).alias(code_col), F.col(col).alias(out or col))
    return _join_small(df, rev, [code_col], null_safe=False)


# ---- C5: one-hot -----------------------------------------------------------------------------

def one_hot_columns(df: DataFrame, code: str, k: int, prefix: str = "oh_") -> DataFrame:
    """k 0/1 columns, no dropped level."""
    return df.select("*", *[(F.col(code) == F.lit(i)).cast("int").alias(f"{prefix}{i}") for i in range(k)])


# ---- C6 / C7: min-max scaling fitted on a subset ---------------------------------------------

def _number(col: str) -> Column:
    x = F.col(col).cast("double")
    return F.when(~F.isnan(x), x)


def fit_minmax(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Per-group min and max of ``col``, NaN ignored (C6 fit)."""
    x = _number(col)
    return df.groupBy(*by).agg(F.min(x).alias("_min"), F.max(x).alias("_max"))


def apply_minmax(df: DataFrame, fitted: DataFrame, col: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``(x - min) / (max - min)``; a constant column maps to 0 (sklearn)."""
    j = _join_small(df, fitted, list(by), how="inner") if by else _scalar_join(df, fitted)
    rng = F.col("_max") - F.col("_min")
    scaled = F.when(rng == 0, F.lit(0.0)).otherwise((F.col(col).cast("double") - F.col("_min")) / rng)
    return j.withColumn(out, scaled)


def inverse_minmax(col: str | Column, lo: str = "_min", hi: str = "_max") -> Column:
    """``x * (max - min) + min``."""
    c = F.col(col) if isinstance(col, str) else col
    return c * (F.col(hi) - F.col(lo)) + F.col(lo)


def _scalar_join(df: DataFrame, one_row: DataFrame) -> DataFrame:
    r = one_row.first()
    return df.select("*", *[F.lit(r[c]).alias(c) for c in one_row.columns])


# ---- C8: standard scaling (population std, std 0 -> 1) ------------------------------------------

def fit_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = []
    for c in cols:
        x = _number(c)
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_pop(x).alias(f"{c}__std")]
    return df.agg(*aggs)


def apply_standard(df: DataFrame, fitted: DataFrame, cols: Sequence[str], suffix: str = "_std") -> DataFrame:
    r = fitted.first()
    out = df
    for c in cols:
        mean, std = r[f"{c}__mean"], r[f"{c}__std"]
        std = 1.0 if (std is None or std == 0) else std
        out = out.withColumn(c + suffix, (F.col(c).cast("double") - F.lit(mean)) / F.lit(std))
    return out


# ---- C9: vector -> named columns ----------------------------------------------------------------

def vector_to_columns(df: DataFrame, vec: str, dim: int, prefix: str = "embed_", keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[F.col(vec)[i].alias(f"{prefix}{i}") for i in range(dim)])
