"""Hand-written edge inputs (FIXTURES.md §4)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean, encode, metrics, profile, sampling, select, series, vectors
from tidemark.sources import io


def test_null_tickets(spark):
    rows = [(1, None, "2024-01-01 10:00:00", "2024-01-01 08:00:00", "a", None, "P"),
            (2, 3.0, None, "2024-01-02 00:00:00", "b", "fixed", "Q"),
            (3, 4.0, "2024-01-01 00:00:00", "2024-01-01 06:00:00", None, "done", "P")]
    df = spark.createDataFrame(rows, "id long, rating double, a string, b string, d string, r string, p string")
    df = clean.parse_timestamps(df, ["a", "b"])
    assert clean.drop_null(df, ["rating"]).count() == 2
    hours = {r.id: r.h for r in df.select("id", clean.duration_hours("a", "b").alias("h")).collect()}
    assert hours[1] == -2.0 and hours[2] is None and hours[3] == 6.0
    text = {r.id: r.t for r in df.select("id", clean.text_template([F.col("d"), " ", F.col("r")]).alias("t")).collect()}
    assert text[1] is None and text[2] == "b fixed"
    nan_text = df.select("id", clean.text_template([F.col("d"), " ", F.col("r")], null_text="nan").alias("t"))
    assert {r.id: r.t for r in nan_text.collect()}[1] == "a nan"
    vc = profile.value_counts(df, "d").collect()
    assert [(r.d, r["count"]) for r in vc] == [("a", 1), ("b", 1)]
    d = profile.describe(df, "rating").first()
    assert d["count"] == 2 and d["mean"] == 3.5 and d["p50"] == 3.5


def test_lenient_timestamps(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("junk",)], "a string")
    out = clean.parse_timestamps(df, ["a"], lenient=True).collect()
    assert out[1].a is None


def test_constant_column(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(10)], "id long, x double")
    fitted = encode.fit_minmax(df, "x")
    assert {r.s for r in encode.apply_minmax(df, fitted, "x", "s").collect()} == {0.0}
    std = encode.apply_standard(df, encode.fit_standard(df, ["x"]), ["x"]).collect()
    assert {r.x_std for r in std} == {0.0}
    h = profile.histogram(df, "x", 20).collect()
    assert len(h) == 20 and h[0]["count"] == 10 and sum(r["count"] for r in h) == 10


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    xs = rng.normal(size=1001).tolist()
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    q = profile.exact_quantiles(df, "x", [0.1, 0.25, 0.5, 0.9]).first()
    ref = np.percentile(xs, [10, 25, 50, 90])
    assert all(abs(q[f"q_{i}"] - ref[i]) < 1e-12 for i in range(4))


def test_narrowed_quantiles_of_groups_with_ties_and_infinities(spark):
    rng = np.random.default_rng(1)
    groups = {
        "heavy": np.concatenate([np.zeros(4000), rng.exponential(size=2500), [1e300, -1e300]]),
        "spread": np.exp(rng.normal(size=5000) * 40),
        "equal": np.full(3000, 2.5),
        "few": np.array([1.0, 2.0]),
        "one": np.array([7.0]),
        "ends": np.concatenate([np.full(900, -np.inf), rng.integers(0, 50, 3000), np.full(900, np.inf)]),
        None: rng.integers(0, 5, 2000).astype(float),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, _v double").repartition(7)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.g: [r[f"q_{i}"] for i in range(len(qs))] for r in profile._narrowed_quantiles(df, qs, ["g"], gather=20).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        xs = np.sort(xs)
        for q, x in zip(qs, got[g]):
            h = (len(xs) - 1) * q
            a, b = xs[int(np.floor(h))], xs[int(np.ceil(h))]
            ref = a if a == b else a + (b - a) * (h - np.floor(h))
            assert x == ref or abs(x - ref) <= 1e-12 * abs(ref), (g, q, x, ref)


def test_quantiles_of_no_rows(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert tuple(profile.exact_quantiles(df, "x", [0.5]).first()) == (None,)


def test_ties_and_leaderboard(spark):
    m = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7), (3, 0.1)], "config_id int, mcc double")
    lb = {r.config_id: r.position for r in select.leaderboard(m, "mcc", "config_id").collect()}
    assert lb == {1: 1, 2: 2, 0: 3, 3: 4}
    assert select.best_of(m, "mcc", "config_id").first().config_id == 1
    imp = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0)], "idx int, importance double")
    assert [r.idx for r in select.top_k(imp, "importance", "idx", 2).collect()] == [2, 1]


def test_one_class(spark):
    df = spark.createDataFrame([(i, 1) for i in range(9)], "id long, y int")
    b = profile.class_balance(df, "y").first()
    assert b.n_classes == 1 and not b.imbalanced
    sp = sampling.stratified_split(df, "y", "id", 0.25)
    assert sp.where("part = 'test'").count() == 2  # round(2.25)
    pr = df.withColumn("p", F.lit(1))
    assert metrics.mcc(pr, "y", "p").first().mcc == 0.0


def test_unseen_category(spark):
    fit_on = spark.createDataFrame([("a",), ("b",)], "v string")
    apply_to = spark.createDataFrame([("a",), ("z",), (None,)], "v string")
    fitted = encode.fit_label_encoder(fit_on, "v")
    codes = {r.v: r.code for r in encode.apply_codes(apply_to, fitted, "v").collect()}
    assert codes == {"a": 0, "z": -1, None: -1}


def test_empty_prices_write_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "date date, open double, high double, low double, close double, volume long, "
                                      "ticker string")
    assert io.save_prices(io.normalize_prices(empty), str(tmp_path / "p"), "2024-01-01") is None


def test_early_stop(spark):
    rows = [("r", e, m) for e, m in enumerate([0.1, 0.3, 0.2, 0.25, 0.3, 0.29, 0.1, 0.5], start=1)]
    df = spark.createDataFrame(rows, "run string, epoch int, metric double")
    out = series.early_stop(df, "run", "epoch", "metric", patience=5).first()
    # best 0.3 at epoch 2; epochs 3..7 do not improve (0.3 is not > 0.3) -> stop at 7
    assert (out.stop_epoch, out.best_epoch, out.best_metric) == (7, 2, 0.3)


def _brute_knn(q, r, k):
    d = np.sqrt(((q[:, None, :] - r[None, :, :]) ** 2).sum(-1))
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("clustered,block", [(False, 16384), (True, 16384), (False, 64), (True, 7)])
def test_knn_exact_against_brute_force(spark, clustered, block):
    rng = np.random.default_rng(5)
    ref = rng.normal(size=(300, 8)) + (rng.integers(0, 4, size=(300, 1)) * 6 if clustered else 0)
    qs = rng.normal(size=(40, 8)) + (rng.integers(0, 4, size=(40, 1)) * 6 if clustered else 0)
    rdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ref)], "rid long, v array<double>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "qid long, v array<double>")
    got = vectors.knn(qdf, rdf, 5, "qid", "rid", "v", block_rows=block).collect()
    idx, dist = _brute_knn(qs, ref, 5)
    by = {(r.q_id, r.rank): (r.r_id, r.dist) for r in got}
    assert len(got) == 40 * 5
    for qi in range(40):
        for k in range(5):
            assert math.isclose(by[(qi, k + 1)][1], dist[qi, k], rel_tol=1e-9, abs_tol=1e-9)
            assert by[(qi, k + 1)][0] == idx[qi, k]


def test_knn_ties_broken_by_id_across_blocks(spark):
    # many equal distances: the lowest reference ids win, in every block layout
    ref = [(i, [float(i % 3), 0.0]) for i in range(60)]
    rdf = spark.createDataFrame(ref, "rid long, v array<double>")
    qdf = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0])], "qid long, v array<double>")
    for block in (16384, 5):
        got = sorted((r.q_id, r.rank, r.r_id) for r in vectors.knn(qdf, rdf, 4, "qid", "rid", "v", block_rows=block).collect())
        assert got == [(0, 1, 0), (0, 2, 3), (0, 3, 6), (0, 4, 9), (1, 1, 2), (1, 2, 5), (1, 3, 8), (1, 4, 11)]


def test_smote_tiny_minority(spark):
    rows = [(i, [float(i), 0.0], 0) for i in range(10)] + [(100 + i, [float(i), 1.0], 1) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    syn = vectors.smote(df, "y", "id", "v", k=5, seed=1).collect()
    assert len(syn) == 7  # grown to the majority size
    for s in syn:
        assert 0.0 <= s.u < 1.0 and s.y == 1 and s.base_id != s.nbr_id
        assert min(0, 2) <= s.v[0] <= 2 and s.v[1] == 1.0
    res = vectors.smote_resample(df, "y", "id", "v", k=5, seed=1)
    assert res.where("y = 1").count() == res.where("y = 0").count() == 10


def test_bootstrap_sizes_and_determinism(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "id long")
    a = sampling.bootstrap(df, "id", 3, 7)
    assert a.count() == 150 and a.groupBy("replicate").count().where("count != 50").count() == 0
    b = sampling.bootstrap(df.repartition(5), "id", 3, 7)
    key = lambda d: sorted((r.replicate, r.draw, r.id) for r in d.collect())
    assert key(a) == key(b)


def test_bootstrap_counts_equal_the_draws(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "id long")
    drawn = {(r.id, r.replicate): r["count"] for r in sampling.bootstrap(df, "id", 3, 7).groupBy("id", "replicate").count().collect()}
    rows = sampling.bootstrap_counts(df.repartition(5), "id", 3, 7).collect()
    assert len(rows) == 50
    assert all(r.draws == [drawn.get((r.id, k), 0) for k in range(3)] for r in rows)
    assert sampling.bootstrap_counts(df.limit(0), "id", 3, 7).collect() == []


def test_knn_copies_count_as_rows(spark):
    import random
    rng = random.Random(3)
    train = [(i, [rng.random(), rng.random()], rng.randint(0, 1), rng.choice([1, 1, 2, 4, 9])) for i in range(60)]
    q = spark.createDataFrame([(1000 + i, [rng.random(), rng.random()]) for i in range(40)], "id long, embedding array<double>")
    once = spark.createDataFrame(train, "id long, embedding array<double>, y int, c int")
    spread = spark.createDataFrame([(i * 100 + j, v, y) for i, v, y, c in train for j in range(c)], "id long, embedding array<double>, y int")
    a = vectors.knn_classify(q, once, 5, "id", "id", "y", copies="c").collect()
    b = vectors.knn_classify(q, spread, 5, "id", "id", "y").collect()
    assert sorted(a) == sorted(b) and len(a) == 40


@pytest.mark.parametrize("arrival", ["descending", "shuffled"])
@pytest.mark.parametrize("block_rows", [4, 7, 64, 16384])
def test_knn_ties_do_not_depend_on_arrival_or_blocks(spark, arrival, block_rows):
    ids = list(range(20, 0, -1)) if arrival == "descending" else [7, 3, 20, 1, 15, 9, 2, 18, 5, 11, 4, 13, 19, 6, 8, 10, 12, 14, 16, 17]
    ref = spark.createDataFrame([(i, [1.0, 0.0]) for i in ids], "id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(100, [0.0, 0.0]), (101, [0.0, 1.0])], "id long, embedding array<double>")
    out = vectors.knn(q, ref, 5, "id", "id", block_rows=block_rows).collect()
    for k in (100, 101):
        assert [r.r_id for r in sorted((r for r in out if r.q_id == k), key=lambda r: r.rank)] == [1, 2, 3, 4, 5]


def test_nan_is_no_value_for_histogram_and_scalers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("nan"),), (None,)], "x double")
    assert [r["count"] for r in profile.histogram(df, "x", 5).collect()] == [2, 2, 2, 2, 2]
    lo_hi = encode.fit_minmax(df, "x").first()
    assert (lo_hi["_min"], lo_hi["_max"]) == (0.0, 9.0)
    assert encode.fit_standard(df, ["x"]).first()["x__mean"] == 4.5


def test_regression_metrics_keep_the_null_group(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), (None, 3.0, 1.0), (None, 5.0, 5.0)], "g string, y double, p double")
    assert {r.g: r.mse for r in metrics.regression_metrics(df, "y", "p", ["g"]).collect()} == {"a": 0.5, None: 2.0}


def test_lag_windows_keep_nulls_in_place(spark):
    df = spark.createDataFrame([("a", i, None if i == 5 else float(i)) for i in range(1, 13)], "s string, pos int, v double")
    out = {r.pos: r.x for r in series.lag_windows(df, "s", "pos", "v", 3).collect()}
    assert len(out) == 9 and out[7] == [4.0, None, 6.0]


def test_save_prices_keeps_other_tickers_and_runs(spark, tmp_path):
    def day(t, d):
        return spark.createDataFrame([(d, 1.0, 2.0, 0.5, 1.5, 10, t)], "date string, open double, high double, low double, close double, volume long, ticker string")

    path = str(tmp_path / "prices")
    for t, d in (("A", "2024-01-01"), ("B", "2024-01-02"), ("A", "2024-01-02"), ("A", "2024-01-02")):
        io.save_prices(day(t, d), path, d)
    assert sorted((r.ticker, r.date) for r in io.read_prices(spark, path).collect()) == [("A", "2024-01-01"), ("A", "2024-01-02"), ("B", "2024-01-02")]


def test_smote_grows_every_class(spark):
    rows = [(i, 0 if i < 12 else 1 if i < 18 else 2, [float(i), float(i % 3)]) for i in range(21)]
    df = spark.createDataFrame(rows, "id long, y int, embedding array<double>")
    out = vectors.smote_resample(df, "y", "id").groupBy("y").count().collect()
    assert {r.y: r["count"] for r in out} == {0: 12, 1: 12, 2: 12}


def test_wide_tables_refuse_too_many_values(spark):
    df = spark.range(profile.MAX_COLUMNS + 5).selectExpr("1 AS a", "id AS b")
    with pytest.raises(ValueError, match="pair_counts"):
        profile.crosstab(df, "a", "b")
    with pytest.raises(ValueError, match="confusion_long"):
        metrics.confusion_matrix(df, "b", "b")


def test_group_sizes_do_not_exchange_the_rows(spark):
    from tidemark.operators.ordering import with_group_size

    plan = with_group_size(spark.range(10**6).selectExpr("id", "id % 5 AS g"), "g")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
