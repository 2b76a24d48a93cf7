"""Time-series operators (F1-F13) over long tables ``(series key, date, value)``.

Positions inside a series come from ``ordered_index`` (range shuffle), never
from a window over the whole series, so one huge series is spread over many
tasks. Bounded look-back windows (lags, lag arrays, moving averages) run over
fixed-size chunks of a series; each chunk also receives the last ``k`` rows of
the chunk before it ("halo"), so every window is exact while no task holds
more than ``chunk_rows + k`` rows of one series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import hash_key
from tidemark.operators.ordering import ordered_index, with_group_size

CHUNK_ROWS = 1_000_000


def _list(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def positions(df: DataFrame, by, order, name: str = "pos") -> DataFrame:
    """1-based row position per series under ``order`` (ends with a unique column)."""
    return ordered_index(df, _list(by), _list(order), name=name)


def segment_positions(df: DataFrame, by, pos: str, segment: str, name: str = "spos") -> DataFrame:
    """Positions restarted per segment, for chronological segments (each segment is a
    contiguous range of ``pos`` inside its series): ``pos - first pos + 1``. Needs
    one small (series, segment) aggregate joined back, not a second ranking pass."""
    from tidemark.operators.encode import _join_small
    by = _list(by)
    first = df.groupBy(*by, segment).agg(F.min(pos).alias("_p0"))
    return (_join_small(df, first, [*by, segment], how="inner")
            .withColumn(name, F.col(pos) - F.col("_p0") + 1).drop("_p0"))


def with_halo(df: DataFrame, by, pos: str, k: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_chunk`` and duplicate the last ``k`` rows of each chunk into the next
    one with ``_halo = true``. Windows over ``partitionBy(by, _chunk)`` with a
    look-back of at most ``k`` rows are then exact for non-halo rows."""
    size = max(int(chunk_rows), int(k), 1)
    c = F.floor((F.col(pos) - 1) / F.lit(size)).cast("long")
    base = df.withColumn("_chunk", c).withColumn("_halo", F.lit(False))
    if k <= 0:
        return base
    halo = (df.where((F.col(pos) - 1) % F.lit(size) >= F.lit(size - k))
            .withColumn("_chunk", c + 1).withColumn("_halo", F.lit(True)))
    return base.unionByName(halo)


def _chunk_window(by, pos: str, lo: int, hi: int = 0):
    return Window.partitionBy(*_list(by), "_chunk").orderBy(pos).rowsBetween(lo, hi)


# ---- F1 / F2 / R6: chronological splits -----------------------------------------------------

def chrono_split(df: DataFrame, by, order, ratio: float = 0.8, out: str = "segment",
                 labels: tuple[str, str] = ("train", "test"), pos: str = "pos") -> DataFrame:
    """First ``int(n * ratio)`` rows of each series are ``labels[0]``, the rest ``labels[1]``."""
    by = _list(by)
    return split_by_position(positions(df, by, order, pos), by, pos, ratio, out, labels)


def split_by_position(df: DataFrame, by, pos: str, ratio: float = 0.8, out: str = "segment",
                      labels: tuple[str, str] = ("train", "test"), seg_pos: str | None = None) -> DataFrame:
    """``chrono_split`` for rows that already carry their 1-based position ``pos`` in
    the series (e.g. the train prefix of an earlier split): no second ranking pass.
    ``seg_pos`` adds the position restarted per segment (``pos`` or ``pos - cut``)."""
    by = _list(by)
    idx = with_group_size(df, by, "_n")
    cut = F.floor(F.col("_n").cast("double") * F.lit(float(ratio)))
    first = F.col(pos) <= cut
    idx = idx.withColumn(out, F.when(first, labels[0]).otherwise(labels[1]))
    if seg_pos:
        idx = idx.withColumn(seg_pos, F.when(first, F.col(pos)).otherwise(F.col(pos) - cut).cast("long"))
    return idx.drop("_n")


def chrono_split3(df: DataFrame, by, order, ratio: float = 0.8, val_ratio: float = 0.2,
                  out: str = "segment", pos: str = "pos") -> DataFrame:
    """``fit / val / test``: the train part is split again, first ``int(n_train * (1 - val_ratio))``
    rows fit (F2)."""
    by = _list(by)
    idx = with_group_size(positions(df, by, order, pos), by, "_n")
    n_train = F.floor(F.col("_n").cast("double") * F.lit(float(ratio)))
    n_fit = F.floor(n_train * F.lit(1.0 - float(val_ratio)))
    seg = (F.when(F.col(pos) <= n_fit, "fit").when(F.col(pos) <= n_train, "val").otherwise("test"))
    return idx.withColumn(out, seg).drop("_n")


# ---- F3 / F4 / F5: lag windows --------------------------------------------------------------

def lag_windows(df: DataFrame, by, pos: str, value: str, k: int, out: str = "x",
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``X = value[i-k:i]`` (oldest first), ``y = value[i]`` for rows with k predecessors
    inside their ``by`` group; null values keep their place in X. ``pos`` is a 1-based position within the group
    (restart the positions per segment for F4)."""
    by = _list(by)
    h = with_halo(df, by, pos, k, chunk_rows)
    w = _chunk_window(by, pos, -k, -1)
    held = F.collect_list(F.struct(F.col(value).alias("v"))).over(w)  # a list of bare values would leave out nulls
    return (h.withColumn(out, held).where(~F.col("_halo") & (F.size(out) == k))
            .withColumn(out, F.transform(out, lambda s: s["v"])).drop("_chunk", "_halo"))


def lag_value(df: DataFrame, by, pos: str, value: str, lag: int = 1, out: str = "lag",
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``value`` from ``lag`` rows earlier in the group (null for the first rows)."""
    by = _list(by)
    h = with_halo(df, by, pos, lag, chunk_rows)
    w = Window.partitionBy(*by, "_chunk").orderBy(pos)
    return (h.withColumn(out, F.lag(F.col(value), lag).over(w))
            .where(~F.col("_halo")).drop("_chunk", "_halo"))


def moving_avg(df: DataFrame, by, pos: str, value: str, k: int, out: str = "ma",
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean of the previous ``k`` values (only rows with all k present)."""
    by = _list(by)
    h = with_halo(df, by, pos, k, chunk_rows)
    w = _chunk_window(by, pos, -k, -1)
    return (h.withColumn("_cnt", F.count(F.col(value)).over(w)).withColumn(out, F.avg(F.col(value)).over(w))
            .where(~F.col("_halo") & (F.col("_cnt") == k)).drop("_chunk", "_halo", "_cnt"))


def moving_avgs(df: DataFrame, by, pos: str, value: str, ks: Sequence[int], prefix: str = "ma_",
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Means of the previous k values for several k in one pass: one halo of the
    largest k and one window stage with a frame per k. ``<prefix><k>`` is null
    where fewer than k values precede the row."""
    by = _list(by)
    ks = list(ks)
    h = with_halo(df, by, pos, max(ks), chunk_rows)
    cols = []
    for k in ks:
        w = _chunk_window(by, pos, -k, -1)
        cols.append(F.when(F.count(F.col(value)).over(w) == k, F.avg(F.col(value)).over(w)).alias(f"{prefix}{k}"))
    return h.select("*", *cols).where(~F.col("_halo")).drop("_chunk", "_halo")


# ---- F6: lag-length selection ---------------------------------------------------------------

LAG_GRID = (15, 30, 45, 60, 75, 90, 120)  # fixed value: the reference's look-back sweep


def select_lag(metrics: DataFrame, by, k: str = "k", metric: str = "val_mse") -> DataFrame:
    """Per group the k with the smallest validation error; first (smallest k) on ties."""
    by = _list(by)
    best = metrics.groupBy(*by).agg(F.min_by(F.struct(F.col(metric), F.col(k)), F.struct(F.col(metric), F.col(k)))
                                    .alias("_b"))
    return best.select(*by, F.col(f"_b.{k}").alias("best_k"), F.col(f"_b.{metric}").alias(metric))


# ---- F8 / F13: bias correction and the forecast table ----------------------------------------

def bias_correct(df: DataFrame, by, actual: str, pred: str, segment: str = "segment",
                 fit_label: str = "train", out: str = "adjusted") -> DataFrame:
    """``pred + mean(actual - pred)`` with the mean taken over the fit rows of each series."""
    by = _list(by)
    err = (df.where((F.col(segment) == fit_label) & F.col(pred).isNotNull())
           .groupBy(*by).agg(F.avg(F.col(actual) - F.col(pred)).alias("bias")))
    from tidemark.operators.encode import _join_small
    return _join_small(df, err, by).withColumn(out, F.col(pred) + F.col("bias"))


# ---- F9: forecast boundary -------------------------------------------------------------------

def forecast_boundary(df: DataFrame, by, date: str, segment: str = "segment", test_label: str = "test",
                      k: int = 15, pos: str = "pos") -> DataFrame:
    """Per series: first test date + k days, and the date of the (k+1)-th test row;
    only for series with more than k test rows."""
    by = _list(by)
    test = df.where(F.col(segment) == test_label)
    first = test.groupBy(*by).agg(F.min(date).alias("first_test"), F.count(F.lit(1)).alias("n_test"),
                                  F.min(pos).alias("_p0"))
    kth = test.select(*by, F.col(pos).alias("_p"), F.col(date).alias("kth_date"))
    from tidemark.operators.encode import _join_small

    return (_join_small(kth, first.where(F.col("n_test") > k), by, how="inner")
            .where(F.col("_p") == F.col("_p0") + k)
            .select(*by, "first_test", F.date_add(F.col("first_test"), k).alias("boundary_date"), "kth_date",
                    "n_test"))


# ---- F10 / F11: batch and chunk ids ----------------------------------------------------------

def batch_assign(df: DataFrame, key: str, batch: int, seed: int = 42, by=None, drop_tail: bool = True) -> DataFrame:
    """Seeded permutation (md5 order) cut into batches of ``batch``; ``max(1, n // batch)``
    batches, the remainder dropped (F10)."""
    by = _list(by)
    idx = ordered_index(df, by, [hash_key(seed, F.col(key)), F.col(key)], name="perm")
    out = idx.withColumn("batch_id", F.floor((F.col("perm") - 1) / F.lit(batch)).cast("long"))
    if not drop_tail:
        return out
    sized = with_group_size(out, by, "_n")
    nb = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(batch)))
    return sized.where(F.col("batch_id") < nb).drop("_n")


def chunk_assign(df: DataFrame, order, size: int = 32, by=None, name: str = "chunk_id") -> DataFrame:
    """Consecutive chunks of ``size`` rows in ``order``; the last may be short."""
    idx = ordered_index(df, _list(by), _list(order), name="_rn")
    return idx.withColumn(name, F.floor((F.col("_rn") - 1) / F.lit(size)).cast("long")).drop("_rn")


# ---- F12: early stopping ---------------------------------------------------------------------

def _carry_max(tagged: DataFrame, run: str, value) -> DataFrame:
    """Per (range partition, run): the max of ``value`` over the run's rows in all
    earlier range partitions. At most #runs + #partitions rows."""
    from tidemark.operators.encode import _join_small
    part = tagged.groupBy("_pid", run).agg(F.max(value).alias("_pm"))
    prev = Window.partitionBy(run).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return part.select("_pid", run, F.max("_pm").over(prev).alias("_carry"))


def early_stop(metrics: DataFrame, run: str, epoch: str, metric: str, patience: int = 5,
               initial_best: float = -1.0, partitions: int | None = None) -> DataFrame:
    """Stop at the first epoch that completes ``patience`` non-improving evaluations in
    a row, whatever the epochs' numbers (improvement = strictly above the running best, which starts at
    ``initial_best``); keep the best epoch up to the stop.

    One row per run: ``stop_epoch, best_epoch, best_metric``. The running best and
    the last improving epoch are prefix maxima computed as a scan: rows are
    range-partitioned on (run, epoch), so a long run is cut over many partitions;
    each (partition, run) slice is scanned locally and gets a carry-in from a small
    per-(partition, run) summary of the earlier partitions. No run is held by one task.
    """
    from tidemark.operators.encode import _join_small
    from tidemark.session import shuffle_partitions

    n = partitions or shuffle_partitions(metrics.sparkSession)
    numbered = ordered_index(metrics.select(run, epoch, metric), [run], [F.col(epoch)], name="_k", partitions=n)
    tagged = (numbered.repartitionByRange(n, F.col(run), F.col(epoch))
              .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    before = Window.partitionBy("_pid", run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_pid", run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    init = F.lit(float(initial_best))
    # scan 1: best metric before each epoch -> improvement flag
    m = _join_small(tagged, _carry_max(tagged, run, F.col(metric)), ["_pid", run])
    prev_best = F.greatest(init, F.col("_carry"), F.max(metric).over(before))
    m = m.withColumn("_improved", F.col(metric) > prev_best).drop("_carry")
    # scan 2: last improving epoch up to each epoch
    m = _join_small(m, _carry_max(m, run, F.when(F.col("_improved"), F.col("_k"))), ["_pid", run])
    m = m.withColumn("_last_imp", F.greatest(F.col("_carry"), F.max(F.when(F.col("_improved"), F.col("_k"))).over(upto)))
    m = m.withColumn("_streak", F.col("_k") - F.coalesce(F.col("_last_imp"), F.lit(0)))
    stops = m.groupBy(run).agg(
        F.coalesce(F.min(F.when(F.col("_streak") >= patience, F.col(epoch))), F.max(epoch)).alias("stop_epoch"))
    j = _join_small(m, stops, [run], how="inner").where(F.col(epoch) <= F.col("stop_epoch"))
    return j.groupBy(run, "stop_epoch").agg(
        F.max(F.when(F.col("_improved"), F.col(epoch))).alias("best_epoch"),
        F.max(F.when(F.col("_improved"), F.col(metric))).alias("best_metric"))
