"""Positions within ordered groups without putting a group into one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` hash-partitions on ``g``: one
hot group (a ticker with a third of all rows, a majority class) then lands in a
single task. ``ordered_index`` computes the same 1-based position with a range
shuffle on ``(g, o)`` instead: a hot group is cut into many range partitions,
each partition is sorted locally, and a small table of per-(partition, group)
counts gives every partition its starting offset (the ``zipWithIndex`` scheme
expressed with DataFrame operators).

The order must be total (end it with a unique column); then the result is
deterministic for any number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import shuffle_partitions

_PID, _LOCAL, _START, _OFF, _CNT = "_tm_pid", "_tm_local", "_tm_start", "_tm_off", "_tm_cnt"

# Largest small table (rows) that operators broadcast after counting it.
BROADCAST_ROWS = 2_000_000


def _cols(xs) -> list[Column]:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        xs = [xs]
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def ordered_index(df: DataFrame, by: Sequence[str] | str | None, order: Sequence | str,
                  name: str = "rn", partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row inside its ``by`` group under ``order``.

    Plan: one range exchange (explicit partition count, so AQE keeps the range
    boundaries), a local sort, a partial count per (partition, group) whose result
    has at most #groups + #partitions rows, a running sum over that small table,
    and a join back (broadcast after its row count is checked).
    The tagged rows are checkpointed once and read by both branches.
    """
    by_names = [by] if isinstance(by, str) else list(by or [])
    keys = [F.col(b) for b in by_names] + _cols(order)
    n = partitions or shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # The range bounds come from a sample taken when the exchange runs; both branches
    # below must see the same bounds, so the tagged rows are written once to the
    # reliable checkpoint folder (this also cuts the lineage for lost executors).
    tagged = (ranged
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_LOCAL, F.monotonically_increasing_id() - F.shiftleft(F.col(_PID).cast("long"), 33))
              .checkpoint(eager=True))
    counts = tagged.groupBy(_PID, *by_names).agg(F.count(F.lit(1)).alias(_CNT), F.min(_LOCAL).alias(_START))
    w = Window.partitionBy(*by_names).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    g = [f"_tm_g{i}" for i in range(len(by_names))]
    offsets = counts.select(F.col(_PID).alias("_tm_p"), *[F.col(b).alias(x) for b, x in zip(by_names, g)], _START,
                            F.coalesce(F.sum(_CNT).over(w), F.lit(0)).alias(_OFF))
    # offsets has at most #groups + #partitions rows; it is materialised (small) and
    # broadcast only when its row count is under the bound, else joined by shuffle.
    offsets = offsets.checkpoint(eager=True)
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    cond = F.col(_PID) == F.col("_tm_p")
    for b, x in zip(by_names, g):
        cond = cond & F.col(b).eqNullSafe(F.col(x))
    return tagged.join(offsets, cond).select(
        *[F.col(c) for c in df.columns], (F.col(_OFF) + F.col(_LOCAL) - F.col(_START) + 1).alias(name))


def group_sizes(df: DataFrame, by: Sequence[str] | str | None, name: str = "n") -> DataFrame:
    """Rows per group as a small table (partial aggregation handles hot groups)."""
    by_names = [by] if isinstance(by, str) else list(by or [])
    if not by_names:
        return df.agg(F.count(F.lit(1)).alias(name))
    return df.groupBy(*by_names).agg(F.count(F.lit(1)).alias(name))


def with_group_size(df: DataFrame, by, name: str = "n") -> DataFrame:
    """Attach the group size to every row via an aggregate + join (not a window,
    which would gather each group into one task). The sizes are counted and
    broadcast within the bound, so the rows are not exchanged on a hot group."""
    by_names = [by] if isinstance(by, str) else list(by or [])
    sizes = group_sizes(df, by_names, name)
    if not by_names:
        return _attach_scalar(df, sizes, name)
    from tidemark.operators.encode import _join_small

    return _join_small(df, sizes, by_names, how="inner")


def _attach_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach a single aggregated value as a literal (one row, one value to the driver)."""
    value = one_row.first()[0]
    return df.withColumn(name, F.lit(value))
