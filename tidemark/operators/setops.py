"""Set operations (H1-H3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def append(*dfs: DataFrame) -> DataFrame:
    """Ordered append by column name (H1, H2); rows keep their own keys."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct values (H3); non-null only."""
    out = df.select(*cols)
    for c in cols:
        out = out.where(out[c].isNotNull())
    return out.distinct()
