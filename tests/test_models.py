"""Invariants for trained operators (no SQL oracle for these)."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tidemark.operators import models
from tidemark.sources import fixtures

Q = entry.queries()


def test_vote_two_level_tie_goes_to_one(spark):
    votes = [(1, f, r, 1 if f < 2 else 0) for f in range(4) for r in range(10)]
    df = spark.createDataFrame(votes, "id long, family int, replicate int, pred int")
    assert models.two_level_vote(df, "id", "family", "pred").first().pred == 1


def test_linear_classifiers_shape(spark):
    valid = fixtures.vectors(spark, SF_SMALL).where("split = 'valid'").count()
    for name in ("lr_classify", "svc_classify", "mlp_classify", "text_classify"):
        out = Q[name](spark, SF_SMALL)
        rows = out.collect()
        assert {r.prediction for r in rows} <= {0.0, 1.0}
        if name != "text_classify":
            assert len(rows) == valid


def test_model_roundtrip_equal(spark):
    out = Q["model_roundtrip"](spark, SF_SMALL)
    assert out.count() > 0 and out.where(~F.col("equal")).count() == 0


def test_pca_matches_numpy_up_to_sign(spark):
    v = fixtures.vectors(spark, SF_SMALL).orderBy("vec_id").collect()
    x = np.array([r.embedding for r in v], dtype=float)
    xc = x - x.mean(0)
    w, vec = np.linalg.eigh(np.cov(xc, rowvar=False))
    top = vec[:, ::-1][:, :2]
    ref = xc @ top
    got = {r.vec_id: (r.pca_0, r.pca_1) for r in Q["pca2"](spark, SF_SMALL).collect()}
    g = np.array([got[r.vec_id] for r in v])
    for j in range(2):
        assert min(np.abs(g[:, j] - ref[:, j]).max(), np.abs(g[:, j] + ref[:, j]).max()) < 1e-6


def test_forecast_test_covers_every_test_row(spark):
    out = Q["forecast_test"](spark, SF_SMALL)
    chrono = Q["chrono_split"](spark, SF_SMALL)
    assert out.count() == chrono.where("segment = 'test'").count()
    assert out.where(F.col("pred").isNull() | F.col("adjusted").isNull()).count() == 0


def test_lag_sweep_skips_short_validation(spark):
    # sf0.001: the shortest validation segment is shorter than k = 75, 90, 120
    t = Q["lag_sweep"](spark, SF_SMALL)
    rows = t.collect()
    assert sum(r.selected for r in rows) == 1
    assert all(r.fit_mse >= 0 for r in rows)


def test_rating_features_hold_the_texts_and_are_scaled_on_train(spark):
    from tidemark.plans import models_q as q
    from tests.conftest import SF_SMALL

    d = q._ticket_features(spark, SF_SMALL)
    rows = d.select("part", "features", "raw").collect()
    train = np.array([r.features.toArray() for r in rows if r.part == "train"])
    assert train.shape[1] == q.N_FEATURES
    assert np.abs(train.mean(axis=0)).max() < 1e-9
    spread = train.std(axis=0, ddof=1)
    assert np.all((np.abs(spread - 1) < 1e-6) | (spread < 1e-9))
    assert all(any(r.raw[4 + 8 * c:12 + 8 * c]) for r in rows for c in (0, 1, 2))


def test_text_models_report_and_importances(spark):
    report = {r.label: r for r in Q["ticket_text_classify"](spark, SF_SMALL).collect()}
    classes = [r for k, r in report.items() if k not in ("accuracy", "macro avg", "weighted avg")]
    assert report["accuracy"].support == sum(r.support for r in classes) > 0 and 0 <= report["weighted avg"].f1 <= 1
    table = {r.model: r for r in Q["model_comparison"](spark, SF_SMALL).collect()}
    assert set(table) == {"untuned", "tuned", "majority_baseline"} and all(r.loss > 0 for r in table.values())
    top = Q["booster_importances"](spark, SF_SMALL).collect()
    assert len(top) == 10 and [r.importance for r in top] == sorted((r.importance for r in top), reverse=True) and sum(r.importance for r in top) <= 1 + 1e-9


def test_bagging_fits_by_weight_vote_like_fits_on_copies(spark):
    from pyspark.ml.functions import array_to_vector
    from tidemark.operators import sampling

    v = fixtures.vectors(spark, SF_SMALL).select("vec_id", "split", F.col("gold").cast("double").alias("gold"), F.slice("embedding", 1, 4).alias("e"))
    v = v.withColumn("features", array_to_vector(F.col("e").cast("array<double>")))
    tr, va = v.where("split = 'train'"), v.where("split = 'valid'")
    votes = models.bagging_votes(tr, va, "vec_id", "gold", 2, 42, knn_vec="e", families=("lr", "knn")).collect()
    assert len(votes) == 4 * va.count() and {r.pred for r in votes} <= {0, 1}
    copies = sampling.bootstrap(tr, "vec_id", 1, 42)
    on_copies = {r.vec_id: r.prediction for r in models.logistic(copies, "gold").transform(va).collect()}
    same = [r.pred == on_copies[r.vec_id] for r in votes if r.family == "lr" and r.replicate == 0]
    assert np.mean(same) >= 0.95


def test_random_search_is_whole_and_repeats(spark):
    a = Q["boost_random_search"](spark, SF_SMALL).collect()
    assert len(a) == 20 and all(-1 <= r.cv_mcc <= 1 for r in a) and len({r.config_id for r in a}) == 20
    assert set(models.BOOST_SPACE) <= set(a[0].asDict())
    assert sorted(a) == sorted(Q["boost_random_search"](spark, SF_SMALL).collect())


def test_smote_contexts_take_nothing_from_the_held_out_fold(spark):
    rows = [(i, int(i % 4 == 0), [float(i), float(i * i % 17)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y int, v array<double>, fold int")
    out = models.smote_contexts(df, "y", "id", "v", "fold", 3).collect()
    real = {r.id: r for r in out if r.only is None}
    assert len(real) == 60
    for f in range(4):
        own = [r for r in real.values() if r.fold != f]
        new = [r for r in out if r.only == f]
        assert sum(r.y for r in own) + sum(r.y for r in new) == len(own) - sum(r.y for r in own) + sum(1 - r.y for r in new)
        minority = [r.v for r in own if r.y == 1]
        for r in new:  # on a line between two rows of its own set
            assert any(abs((r.v[0] - a[0]) * (b[1] - a[1]) - (r.v[1] - a[1]) * (b[0] - a[0])) < 1e-6 for a in minority for b in minority if a != b)


def test_softmax_booster_beats_chance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] > 0) + (x[:, 1] * x[:, 2] > 0)
    df = spark.createDataFrame([(i, int(c), [float(a) for a in v]) for i, (v, c) in enumerate(zip(x, y))], "id long, y int, x array<double>")
    from tidemark.operators import boost

    forest, edges = models.boosted_softmax(df.where("id < 300"), "y", "id", "x", 3, rounds=40)
    out = boost.predict(df.where("id >= 300"), forest, edges, "x").collect()
    assert np.mean([r.prediction == r.y for r in out]) > 0.75
