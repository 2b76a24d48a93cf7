"""ordered_index equals row_number() and does not depend on partitioning; lag windows
over chunks with a halo equal windows over the whole series."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.operators.ordering import ordered_index


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    # one hot group with most rows, a few small ones
    rows = [(i, "hot" if rnd.random() < 0.7 else f"g{rnd.randint(0, 5)}", rnd.randint(0, 50)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, v int")


def test_ordered_index_matches_row_number(spark):
    df = _data(spark)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    for parts in (1, 3, 8, 17):
        got = ordered_index(df, ["g"], ["v", "id"], name="rn", partitions=parts)
        diff = got.join(ref.withColumnRenamed("rn", "rn2"), ["id", "g", "v"]).where("rn != rn2").count()
        assert diff == 0
        assert got.count() == df.count()


def test_ordered_index_global_and_descending(spark):
    df = _data(spark, 500)
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("v").desc(), "id")))
    got = ordered_index(df, None, [F.col("v").desc(), F.col("id")], name="rn", partitions=5)
    assert got.join(ref.withColumnRenamed("rn", "rn2"), "id").where("rn != rn2").count() == 0


def test_lag_windows_halo_equals_whole_series(spark):
    rnd = random.Random(3)
    rows = [(t, d, float(rnd.random())) for t in ("A", "B") for d in range(400)]
    df = spark.createDataFrame(rows, "ticker string, d int, close double")
    pos = series.positions(df, "ticker", "d")
    whole = series.lag_windows(pos, "ticker", "pos", "close", 15, chunk_rows=10_000)
    chunked = series.lag_windows(pos, "ticker", "pos", "close", 15, chunk_rows=37)
    a = sorted((r.ticker, r.d, tuple(r.x)) for r in whole.collect())
    b = sorted((r.ticker, r.d, tuple(r.x)) for r in chunked.collect())
    assert a == b and len(a) == 2 * (400 - 15)
    lag1 = series.lag_value(pos, "ticker", "pos", "close", 1, chunk_rows=11).collect()
    byk = {(r.ticker, r.d): r.close for r in rows_as(df)}
    for r in lag1:
        assert r.lag == (byk.get((r.ticker, r.d - 1)))


def rows_as(df):
    return df.collect()


def test_short_series_gives_no_windows(spark):
    df = spark.createDataFrame([("A", d, float(d)) for d in range(5)], "ticker string, d int, close double")
    pos = series.positions(df, "ticker", "d")
    assert series.lag_windows(pos, "ticker", "pos", "close", 15).count() == 0


def test_chrono_split_unsorted_input(spark):
    rows = [("A", d, float(d)) for d in range(100)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "ticker string, d int, close double").repartition(7)
    sp = series.chrono_split(df, "ticker", "d", 0.8)
    train = sorted(r.d for r in sp.where("segment = 'train'").collect())
    assert train == list(range(80))


def _early_stop_py(metrics, patience, init=-1.0):
    best, bad = init, 0
    rows = []
    for e, m in metrics:
        imp = m > best
        best = max(best, m)
        bad = 0 if imp else bad + 1
        rows.append((e, m, imp))
        if bad >= patience:
            break
    imps = [(e, m) for e, m, i in rows if i]
    return rows[-1][0], (imps[-1][0] if imps else None), (imps[-1][1] if imps else None)


def test_early_stop_scan_over_range_partitions(spark):
    rnd = random.Random(3)
    runs = {"hot": 600, "a": 40, "b": 7}
    data = {}
    for r, n in runs.items():
        level = 0.0
        seq = []
        for e in range(1, n + 1):
            level += rnd.uniform(-0.05, 0.06)
            seq.append((e, round(level + rnd.uniform(-0.2, 0.2), 3)))
        data[r] = seq
    data["gaps"] = [(10 * e * e, m) for e, m in data["a"]]
    df = spark.createDataFrame([(r, e, m) for r, seq in data.items() for e, m in seq], "run string, epoch int, metric double")
    for patience in (5, 40):
        exp = {r: _early_stop_py(seq, patience) for r, seq in data.items()}
        for parts in (1, 7, 16):
            got = {x.run: (x.stop_epoch, x.best_epoch, x.best_metric)
                   for x in series.early_stop(df, "run", "epoch", "metric", patience, partitions=parts).collect()}
            assert got == exp, (patience, parts)
