"""Deterministic, engine-independent random keys.

All sampling in tidemark is keyed by ``md5('<seed>:<id>')`` so that the same rows
are picked on every run, every partitioning and in DuckDB (same md5 there).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


def hash_key(seed, *parts) -> Column:
    """``md5(seed ':' part1 [':' part2 ...])`` as a hex string (sortable key)."""
    pieces = [F.lit(str(seed))]
    for p in parts:
        pieces += [F.lit(":"), _text(p)]
    return F.md5(F.concat(*pieces))


def hash_int(seed, *parts) -> Column:
    """First 60 bits of the md5 key as a non-negative bigint (``% n`` reaches every row of any table)."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 15), 16, 10).cast("bigint")


def hash_unit(seed, *parts) -> Column:
    """Uniform double in [0, 1) from the first 60 bits of the md5 key."""
    return hash_int(seed, *parts) / F.lit(float(1 << 60))
