"""Projection, cleaning and row-level predicates (B1-B16). All narrow: no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import hash_key
from tidemark.functions.vec import argmax, sigmoid

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def project(df: DataFrame, columns: Sequence[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Keep named columns in this order, optionally renamed."""
    rename = rename or {}
    return df.select(*[F.col(c).alias(rename.get(c, c)) for c in columns])


def project_position(df: DataFrame, position: int, keep: Sequence[str] = ()) -> DataFrame:
    """Column by position (0-based) next to key columns (B2); prefer a named price column."""
    return df.select(*keep, df.columns[position])


def features_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Features = every column except the target; target alone."""
    return df.drop(target), df.select(target)


def drop_null(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows whose ``subset`` columns are null (or NaN for floating types)."""
    return df.na.drop(subset=list(subset))


def parse_timestamps(df: DataFrame, cols: Sequence[str], fmt: str = TS_FORMAT, lenient: bool = False) -> DataFrame:
    """String -> timestamp with a fixed format (B6). Malformed values raise (ANSI)
    unless ``lenient``, which turns them into null."""
    conv = F.try_to_timestamp if lenient else F.to_timestamp
    out = df
    for c in cols:
        out = out.withColumn(c, conv(F.col(c), F.lit(fmt)) if lenient else conv(F.col(c), fmt))
    return out


def format_date(col, fmt: str = "yyyy-MM-dd") -> Column:
    """Date/time -> text."""
    return F.date_format(col, fmt)


def duration_hours(start, end) -> Column:
    """Fractional hours ``end - start``; negative kept; null if either is null."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return (F.unix_micros(e.cast("timestamp")) - F.unix_micros(s.cast("timestamp"))) / F.lit(3.6e9)


def text_template(parts: Sequence, null_text: str | None = None) -> Column:
    """Concatenate columns and literal text (B10). Any null part gives null unless
    ``null_text`` replaces null column values (the twin's ``'nan'`` behaviour)."""
    cols = []
    for p in parts:
        if isinstance(p, Column):
            cols.append(p if null_text is None else F.coalesce(p.cast("string"), F.lit(null_text)))
        elif isinstance(p, str) and p.startswith("col:"):
            c = F.col(p[4:]).cast("string")
            cols.append(c if null_text is None else F.coalesce(c, F.lit(null_text)))
        else:
            cols.append(F.lit(p))
    return F.concat(*cols)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Fixed-size uniform sample without replacement (B12): the ``n`` rows with the
    smallest ``md5(seed:key)``. Plan is a bounded top-n (TakeOrderedAndProject)."""
    return df.orderBy(hash_key(seed, F.col(key)), F.col(key)).limit(n)


def threshold(prob, cut: float = 0.5, strict: bool = True) -> Column:
    """0/1 decision; ``p > cut`` (strict) or ``p >= cut`` (vote)."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return (p > F.lit(cut) if strict else p >= F.lit(cut)).cast("int")


def logit_decision(logit, cut: float = 0.5) -> Column:
    """``sigmoid(logit) > cut``."""
    return threshold(sigmoid(logit), cut, strict=True)


def argmax_class(scores) -> Column:
    """Index of the largest score, first on ties."""
    return argmax(scores)
