"""Trained-model queries (J rows, F6/F7, R2/K10, A9, I3). Model outputs depend on
MLlib's solvers, so these carry no SQL oracle: the driver checks rows, and
``tests/test_models.py`` checks invariants (row counts, label sets, ranges,
determinism, save/load equality, better than the majority baseline).
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import boost, clean, encode, kernel, lagfit, metrics, models, network, recurrent, sampling, select, series, svd_text, text, vectors
from tidemark.plans.prices_q import CS, SCALED, P
from tidemark.plans.tickets_q import RATING, _rated
from tidemark.sources import fixtures, io
from tidemark.sources.fixture_sql import with_views

Q = {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


# ---- shared inputs -------------------------------------------------------------------------------

# The seven text columns whose embeddings stand beside the numeric features.
TEXT_COLUMNS = ["product_purchased", "ticket_type", "ticket_subject", "ticket_description", "ticket_status", "resolution", "ticket_channel"]
TEXT_DIM = 64
N_FEATURES = 4 + len(TEXT_COLUMNS) * TEXT_DIM
PART_BYTES = 1 << 26  # of feature rows in a partition, at most about so many


def _ticket_rows(spark, sf, test_frac=0.25, seed=42):
    """Rated tickets with ``raw``: age, factorized gender / priority, duration, then the embeddings of the seven text
    columns; label = rating code; part = stratified split."""
    r = _rated(spark, sf)
    e = text.embed_columns(r, "ticket_id", TEXT_COLUMNS, dim=TEXT_DIM, out="_e")
    r = r.select("ticket_id", "customer_age", "customer_gender", "ticket_priority", "resolution_duration", RATING)
    r = encode.factorize_columns(r, {"customer_gender": "gender_code", "ticket_priority": "priority_code"}, "ticket_id")
    fitted = encode.fit_label_encoder(r, RATING, "label")
    r = encode.apply_codes(r, fitted, RATING, "label").withColumn("label", F.col("label").cast("double"))
    r = r.na.fill(0.0, subset=["resolution_duration"])
    r = sampling.stratified_split(r, "label", "ticket_id", test_frac, seed)
    numeric = F.array(*[F.col(c).cast("double") for c in ("customer_age", "gender_code", "priority_code", "resolution_duration")])
    parts = -(-r.count() * 8 * N_FEATURES // PART_BYTES)  # as many as the counted rows need
    if parts > session.shuffle_partitions(spark):
        r, e = r.repartition(parts, "ticket_id"), e.repartition(parts, "ticket_id")
    return r.join(e, "ticket_id").withColumn("raw", F.concat(numeric, "_e")).drop("_e")


def _ticket_features(spark, sf, test_frac=0.25, seed=42):
    """``_ticket_rows`` with ``features``: the raw columns standardised by the training rows."""
    from pyspark.ml.feature import StandardScaler

    d = models.as_vector(_ticket_rows(spark, sf, test_frac, seed).checkpoint(), "raw", out="raw_vector")
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw_vector", outputCol="features").fit(d.where(F.col("part") == "train"))
    return scaler.transform(d).drop("raw_vector")


def _model_rows(spark, sf):
    """What MLlib's models read of ``_ticket_features``; the raw columns need not be kept beside the standardised ones."""
    return _ticket_features(spark, sf).select("ticket_id", "label", "part", "features")


def _vec_split(spark, sf):
    v = fixtures.vectors(spark, sf).withColumn("gold", F.col("gold").cast("double"))
    return models.as_vector(v, "embedding")


def _pred_out(model, df, key, label):
    return model.transform(df).select(key, F.col(label).alias("label"), F.col("prediction").alias("prediction"))


# ---- W4: ticket rating classifiers ------------------------------------------------------------------

@reg("rf_classify")
def rf_classify(spark, sf):
    d = _model_rows(spark, sf).cache()
    m = models.random_forest(d.where(F.col("part") == "train"), "label", num_trees=100, seed=42)
    return _pred_out(m, d.where(F.col("part") == "test"), "ticket_id", "label")


@reg("gbt_ovr_classify")
def gbt_ovr_classify(spark, sf):
    d = _model_rows(spark, sf)
    m = models.boosted_ovr(d.where(F.col("part") == "train"), "label", "ticket_id", rounds=100)
    return _pred_out(m, d.where(F.col("part") == "test"), "ticket_id", "label")


@reg("cv_scores")
def cv_scores(spark, sf):
    """5 stratified folds on the training part; accuracy of a forest per fold and their mean."""
    d = _model_rows(spark, sf).where(F.col("part") == "train")
    d = sampling.kfold_assign(d, "label", "ticket_id", 5, 42).cache()
    rows = []
    for f in range(5):
        m = models.random_forest(d.where(F.col("fold") != f), "label", 100, 42)
        acc = metrics.accuracy(m.transform(d.where(F.col("fold") == f)), "label", "prediction").first()[0]
        rows.append((f, float(acc)))
    scores = spark.createDataFrame(rows, "fold int, accuracy double")
    mean = scores.agg(F.avg("accuracy")).first()[0]
    return scores.withColumn("mean_accuracy", F.lit(mean))


@reg("model_winner")
def model_winner(spark, sf):
    """Accuracy table of the rating models and the winner (J13, G3: forest wins a tie)."""
    d = _ticket_features(spark, sf).checkpoint()
    tr, te = d.where(F.col("part") == "train"), d.where(F.col("part") == "test")
    k = int(d.agg(F.max("label")).first()[0]) + 1
    boosted = models.boosted_softmax(tr, "label", "ticket_id", "raw", k, 100)
    judged = [("random_forest", models.random_forest(tr, "label", 100, 42).transform(te)),
              ("gradient_boosting", boost.predict(te.drop("features"), *boosted, "raw")),
              ("neural_network", models.mlp(tr, "label", [N_FEATURES, 128, 64, k], seed=42).transform(te))]
    rows = [(i, name, float(metrics.accuracy(p, "label", "prediction").first()[0])) for i, (name, p) in enumerate(judged)]
    table = spark.createDataFrame(rows, "model_order int, model string, accuracy double")
    best = select.best_of(table, "accuracy", "model_order").first()["model"]
    return table.withColumn("winner", F.col("model") == F.lit(best))


@reg("model_roundtrip")
def model_roundtrip(spark, sf):
    """Fit a pipeline, save it to the shared folder, load it, predict again."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier

    d = _model_rows(spark, sf).cache()
    tr, te = d.where(F.col("part") == "train"), d.where(F.col("part") == "test")
    model = Pipeline(stages=[RandomForestClassifier(labelCol="label", numTrees=100, seed=42)]).fit(tr)
    path = io.save_model(model, io.scratch_path(spark, "model"))
    again = io.load_pipeline_model(path)
    a = model.transform(te).select("ticket_id", F.col("prediction").alias("before"))
    b = again.transform(te).select("ticket_id", F.col("prediction").alias("after"))
    return a.join(b, "ticket_id").withColumn("equal", F.col("before") == F.col("after"))


@reg("pca2")
def pca2(spark, sf):
    return vectors.pca2(fixtures.vectors(spark, sf), "vec_id", "embedding", 2)


@reg("pca_with_label")
def pca_with_label(spark, sf):
    """PCA of the ticket text embeddings, label attached by key (left join, E2)."""
    t = clean.drop_null(fixtures.tickets(spark, sf), [RATING])
    e = text.embed_columns(t, "ticket_id", TEXT_COLUMNS, dim=TEXT_DIM)
    p = vectors.pca2(e, "ticket_id", "embedding", 2)
    return p.join(t.select("ticket_id", RATING), "ticket_id", "left")


# ---- W5: movement classifiers on vectors ----------------------------------------------------------

@reg("lr_classify")
def lr_classify(spark, sf):
    d = _vec_split(spark, sf)
    m = models.logistic(d.where(F.col("split") == "train"), "gold")
    return _pred_out(m, d.where(F.col("split") == "valid"), "vec_id", "gold")


@reg("svc_classify")
def svc_classify(spark, sf):
    d = _vec_split(spark, sf)
    m = models.linear_svc(d.where(F.col("split") == "train"), "gold")
    return _pred_out(m, d.where(F.col("split") == "valid"), "vec_id", "gold")


@reg("rbf_svc_classify")
def rbf_svc_classify(spark, sf):
    """Support vectors with a Gaussian kernel by random Fourier features, on the vectors."""
    v = fixtures.vectors(spark, sf).withColumn("gold", F.col("gold").cast("double")).checkpoint()
    train = v.where(F.col("split") == "train")
    gamma = kernel.scale_gamma(train, "embedding")
    m = models.linear_svc(kernel.as_features(train, "embedding", gamma), "gold", reg_param=1e-3)
    return _pred_out(m, kernel.as_features(v.where(F.col("split") == "valid"), "embedding", gamma), "vec_id", "gold")


@reg("mlp_classify")
def mlp_classify(spark, sf):
    d = _vec_split(spark, sf)
    m = models.mlp(d.where(F.col("split") == "train"), "gold", [64, 128, 64, 2], seed=42)
    return _pred_out(m, d.where(F.col("split") == "valid"), "vec_id", "gold")


@reg("mlp_grid")
def mlp_grid(spark, sf):
    """The whole network grid, 3 rates x 3 layer sets x 9 dropouts x 3 batch sizes, 50 epochs of mini-batch Adam each,
    ranked by validation MCC (J9, G1)."""
    _, table = models.network_grid(fixtures.vectors(spark, sf), "gold", "vec_id", "embedding", "split", "train", 64, 2)
    return select.leaderboard(table, "val_mcc", "config_id")


@reg("network_classify")
def network_classify(spark, sf):
    """The grid's best network (first on ties), trained anew for up to 100 epochs and stopped after 5 without a better
    validation MCC (F12); its predictions on the validation rows (J8)."""
    v = fixtures.vectors(spark, sf).checkpoint()
    states, _ = models.network_grid(v, "gold", "vec_id", "embedding", "split", "train", 64, 2)
    best = max(range(len(states)), key=lambda k: (states[k].best, -k))
    config = dataclasses.replace(states[best].config, epochs=100, patience=5, seed=258)  # fixed value: the seed of the last fit
    (state,) = network.fit_many(network.make_blocks(v, "embedding", "gold", "vec_id", "split", "train"), [config], 64, 2)
    out = network.predict(v.where(F.col("split") == "valid"), network.trained(state, 64, 2), "embedding")
    return out.select("vec_id", F.col("gold").cast("double").alias("label"), "prediction")


@reg("smote_resample", with_views("""
WITH tr AS (SELECT vec_id, gold FROM vectors WHERE split = 'train'),
c AS (SELECT gold, count(*) AS n FROM tr GROUP BY gold),
m AS (SELECT gold, (SELECT max(n) FROM c) - n AS more, coalesce(sum((SELECT max(n) FROM c) - n) OVER (ORDER BY n, gold
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM c WHERE n > 1)
SELECT CAST(vec_id AS BIGINT) AS vec_id, gold, false AS synthetic FROM tr
UNION ALL SELECT CAST(-(first + j + 1) AS BIGINT), gold, true FROM (SELECT *, unnest(range(CAST(more AS BIGINT))) AS j FROM m)""", "vectors"))
def smote_resample(spark, sf):
    """Training vectors plus SMOTE rows (minority grown to the majority size)."""
    tr = fixtures.vectors(spark, sf).where(F.col("split") == "train")
    return vectors.smote_resample(tr, "gold", "vec_id", "embedding", 5, 42).select("vec_id", "gold", "synthetic")


def _search(spark, sf):
    tr = sampling.kfold_assign(fixtures.vectors(spark, sf).where(F.col("split") == "train"), "gold", "vec_id", 5, 42)
    return models.boost_random_search(tr, "gold", "vec_id", "embedding", "fold", n_iter=20, seed=42)


@reg("boost_random_search")
def boost_random_search(spark, sf):
    """20 configurations of boosted trees drawn (md5 order) from the grid, scored by stratified 5-fold MCC with SMOTE in
    the training folds, the best one refitted on all training rows and judged on the validation rows (J4)."""
    forest, edges, scores = _search(spark, sf)
    valid = fixtures.vectors(spark, sf).where(F.col("split") == "valid").select("vec_id", "embedding", F.col("gold").alias("label"))
    preds = boost.predict(valid, forest, edges, "embedding").select("label", F.col("prediction").cast("int").alias("prediction"))
    mcc_valid = metrics.mcc(preds, "label", "prediction").first()["mcc"]
    return scores.withColumn("valid_mcc_of_best", F.lit(mcc_valid))


@reg("gbt_softmax_classify")
def gbt_softmax_classify(spark, sf):
    """Rating of the held-out tickets by one multiclass booster of 100 rounds."""
    d = _ticket_rows(spark, sf).checkpoint()
    k = int(d.agg(F.max("label")).first()[0]) + 1
    forest, edges = models.boosted_softmax(d.where(F.col("part") == "train"), "label", "ticket_id", "raw", k)
    return boost.predict(d.where(F.col("part") == "test"), forest, edges, "raw").select("ticket_id", "label", "prediction")


@reg("bagging_classify")
def bagging_classify(spark, sf):
    """Four families x 10 bootstrap replicates, two-level vote on the validation rows."""
    d = _vec_split(spark, sf).cache()
    tr = d.where(F.col("split") == "train")
    votes = models.bagging_votes(tr, d.where(F.col("split") == "valid"), "vec_id", "gold", 10, 42, knn_vec="embedding")
    return models.two_level_vote(votes, "vec_id", "family", "pred")


TERM_SLOTS = 1 << 16
TERM_BYTES = 12  # of one counted term of a row
TEXT_PART_BYTES = 1 << 28  # of term counts in a training partition, at most about so many if there are more than the cores need
TEXT_BLOCK_MB = 16.0


def _term_counts(df):
    """Column ``text`` -> hashed term counts ``_tf`` and their number of tokens ``_len``; a text is tokenized here once
    and is not carried on."""
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    df = RegexTokenizer(inputCol="text", outputCol="_tok", pattern=r"\s+").transform(df)
    df = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=TERM_SLOTS).transform(df)
    return df.withColumn("_len", F.size("_tok").cast("long")).drop("text", "_tok")


def _text_model(train, label, weight=None, reg_param=0.0):
    """IDF -> logistic regression over the term counts of checkpointed rows.

    Every pass over the rows sends one gradient (slots x classes) per partition, and one is cleared per block of rows. So
    the rows are read in as many partitions as there are cores (more only if these grew too large) and in large blocks."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF

    held = train.agg(F.sum("_len")).first()[0] or 0
    parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-held * TERM_BYTES // TEXT_PART_BYTES))
    lr = LogisticRegression(labelCol=label, regParam=reg_param, maxIter=100, maxBlockSizeInMB=TEXT_BLOCK_MB)
    stages = [IDF(inputCol="_tf", outputCol="features"), lr.setWeightCol(weight) if weight else lr]
    return Pipeline(stages=stages).fit(train.coalesce(parts))


@reg("text_classify")
def text_classify(spark, sf):
    """Text -> class on the labelled news (J11): tokens -> hashed TF -> IDF -> class-weighted LR."""
    n = fixtures.news(spark, sf).withColumn("gold", F.col("gold").cast("double"))
    w = sampling.class_weights(n.where(F.col("split") == "train"), "gold")
    n = n.join(F.broadcast(w.select("gold", "weight")), "gold")  # one row per class
    n = _term_counts(n.where(F.col("split").isin("train", "valid"))).checkpoint()
    m = _text_model(n.where(F.col("split") == "train"), "gold", "weight")
    return _pred_out(m, n.where(F.col("split") == "valid"), "doc_id", "gold")


@reg("svd_text_classify")
def svd_text_classify(spark, sf):
    """Dense text encoder learned from the training texts, then logistic regression on its vectors."""
    n = fixtures.news(spark, sf).withColumn("gold", F.col("gold").cast("double"))
    model = svd_text.fit_text_svd(n.where(F.col("split") == "train"), "text")
    d = n.select("doc_id", "gold", "split").join(svd_text.encode_text(n, "doc_id", "text", model), "doc_id")
    d = models.as_vector(d, "embedding").checkpoint()
    return _pred_out(models.logistic(d.where(F.col("split") == "train"), "gold"), d.where(F.col("split") == "valid"), "doc_id", "gold")


@reg("ticket_text_classify")
def ticket_text_classify(spark, sf):
    """Rating from the ticket's text template, on all rated tickets with a stratified fifth held out: the held-out
    report, which ends with accuracy, macro and weighted averages (J11, K1, K3, K5)."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("ticket_description", "resolution", "product_purchased")]
    r = _rated(spark, sf).select("ticket_id", RATING, clean.text_template([parts[0], " ", parts[1], " Product: ", parts[2]]).alias("text"))
    r = encode.factorize(r, RATING, "ticket_id", "label").withColumn("label", F.col("label").cast("double"))
    d = _term_counts(r.select("ticket_id", "label", "text")).withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    d = sampling.stratified_mark(d, "label", "ticket_id", "_row", 0.2, 42)  # the counts are written once, the texts never
    m = _text_model(d.where(F.col("part") == "train"), "label")
    return metrics.classification_report(_pred_out(m, d.where(F.col("part") == "test"), "ticket_id", "label"), "label", "prediction")


# Regularisations tried for the tuned model.
REG_GRID = [0.001, 0.01, 0.1, 1.0]


@reg("model_comparison")
def model_comparison(spark, sf):
    """Untuned vs tuned text model and the majority baseline on the same validation rows: accuracy, MCC and loss.

    Tuning picks the regularisation of highest MCC on a stratified fifth of the training rows (the smaller one on
    ties) and fits it on all of them. The baseline's loss is that of the training class share."""
    from pyspark.ml.functions import vector_to_array

    n = fixtures.news(spark, sf).withColumn("gold", F.col("gold").cast("double"))
    n = _term_counts(n.where(F.col("split").isin("train", "valid"))).checkpoint()
    tr, va = n.where(F.col("split") == "train"), n.where(F.col("split") == "valid")
    inner = sampling.stratified_split(tr, "gold", "doc_id", 0.2, 42).checkpoint()

    def judged(reg_param, fit_on, test_on):
        p = _text_model(fit_on, "gold", reg_param=reg_param).transform(test_on)
        p = p.select("gold", "prediction", vector_to_array("probability")[1].alias("p1")).checkpoint()
        return (float(metrics.accuracy(p, "gold", "prediction").first()[0]), float(metrics.mcc(p, "gold", "prediction").first()["mcc"]),
                float(metrics.bce_loss(p, "gold", "p1").first()[0]))

    tuning = [(judged(x, inner.where(F.col("part") == "train"), inner.where(F.col("part") == "test"))[1], -x) for x in REG_GRID]
    rows = [("untuned", 0.0, *judged(0.0, tr, va)), ("tuned", -max(tuning)[1], *judged(-max(tuning)[1], tr, va))]
    share = float(tr.agg(F.avg("gold")).first()[0])
    base = metrics.majority_baseline(tr, va, "gold").first()["accuracy"]
    loss = metrics.bce_loss(va.withColumn("p1", F.lit(share)), "gold", "p1").first()[0]
    rows.append(("majority_baseline", None, float(base), 0.0, float(loss)))
    return spark.createDataFrame(rows, "model string, reg_param double, accuracy double, mcc double, loss double")


@reg("booster_importances")
def booster_importances(spark, sf):
    """The ten most important features (mean gain of their splits) of the booster that the random search picks."""
    forest, edges, _ = _search(spark, sf)
    rows = [(i, float(x)) for i, x in enumerate(boost.importances(forest, len(edges)))]  # one row per feature
    return select.top_k(spark.createDataFrame(rows, "idx int, importance double"), "importance", "idx", 10)


# ---- W2: forecasting with a trained lag regressor -------------------------------------------------

def _scaled_series(spark, sf):
    p = fixtures.prices(spark, sf)
    sp = series.chrono_split(p, "ticker", "date", 0.8)
    fitted = encode.fit_minmax(sp.where(F.col("segment") == "train"), "close", ["ticker"])
    return encode.apply_minmax(sp, fitted, "close", "scaled", ["ticker"])


@reg("forecast_train")
def forecast_train(spark, sf, k: int = 15):
    s = _scaled_series(spark, sf)
    tr = s.where(F.col("segment") == "train")  # the prefix of each series, so the series' positions hold
    w = series.lag_windows(tr.withColumn("y", F.col("scaled")), "ticker", "pos", "scaled", k)
    m = models.fit_lag_regressor(w, "x", "y")
    out = models.forecast(m, w, "x", "pred_scaled")
    return out.select("ticker", "date", F.col("close").alias("actual"),
                      encode.inverse_minmax("pred_scaled").alias("pred"))


@reg("forecast_test")
def forecast_test(spark, sf, k: int = 15):
    """Fit on training windows, predict every test row from windows that reach back
    into the training rows (F5, F7), invert the scaling, add the training bias (F8)."""
    s = _scaled_series(spark, sf).cache()
    w_all = series.lag_windows(s.withColumn("y", F.col("scaled")), "ticker", "pos", "scaled", k)
    train_w = w_all.where(F.col("segment") == "train")
    m = models.fit_lag_regressor(train_w, "x", "y")
    pred = models.forecast(m, w_all, "x", "pred_scaled").withColumn("pred", encode.inverse_minmax("pred_scaled"))
    adj = series.bias_correct(pred, "ticker", "close", "pred", "segment", "train")
    return adj.where(F.col("segment") == "test").select("ticker", "date", F.col("close").alias("actual"), "pred", "adjusted")


@reg("trained_forecast_metrics", P(CS + SCALED + """
, w AS (SELECT *, lag(scaled) OVER (PARTITION BY ticker ORDER BY pos) AS x FROM sc),
m AS (SELECT regr_slope(scaled, x) AS b, regr_intercept(scaled, x) AS a FROM w WHERE segment = 'train' AND x IS NOT NULL),
p AS (SELECT w.*, (a + b * x) * (hi - lo) + lo AS pred FROM w, m WHERE x IS NOT NULL),
bias AS (SELECT ticker, avg(close - pred) AS bias FROM p WHERE segment = 'train' GROUP BY ticker),
q AS (SELECT segment, 'raw' AS stage, close, pred FROM p
      UNION ALL SELECT segment, 'adjusted', close, pred + bias FROM p JOIN bias USING (ticker)),
g AS (SELECT segment, stage, avg(close) AS mean FROM q GROUP BY ALL)
SELECT segment, stage, count(*) AS n, round(avg((close - pred) * (close - pred)), 1) AS mse,
       round(1 - sum((close - pred) * (close - pred)) / sum((close - mean) * (close - mean)), 6) AS r2
FROM q JOIN g USING (segment, stage) GROUP BY ALL"""))
def trained_forecast_metrics(spark, sf):
    """MSE and R2 of the fitted one-lag forecast, per segment, before and after the bias correction (K6, K7, F8)."""
    w = series.lag_windows(_scaled_series(spark, sf).withColumn("y", F.col("scaled")), "ticker", "pos", "scaled", 1)
    m = models.fit_lag_regressor(w.where(F.col("segment") == "train"), "x", "y")
    pred = models.forecast(m, w, "x", "pred_scaled").withColumn("pred", encode.inverse_minmax("pred_scaled"))
    both = series.bias_correct(pred, "ticker", "close", "pred", "segment", "train")
    long = (both.select("segment", F.lit("raw").alias("stage"), "close", "pred")
            .unionByName(both.select("segment", F.lit("adjusted").alias("stage"), "close", F.col("adjusted").alias("pred"))))
    out = metrics.regression_metrics(long, "close", "pred", ["segment", "stage"], digits=9)
    return out.withColumn("mse", F.round("mse", 1)).withColumn("r2", F.round("r2", 6))


def _lag_products(spark, sf, ks):
    """Summed products of the scaled training values, the last fifth of each series' training rows as validation."""
    # the train segment is the prefix of each series, so its series positions are kept
    tr = _scaled_series(spark, sf).where(F.col("segment") == "train").drop("segment").withColumnRenamed("pos", "_p")
    fv = series.split_by_position(tr, "ticker", "_p", 0.8, out="seg", labels=("fit", "val"), seg_pos="spos")
    return lagfit.lag_products(fv, "ticker", "seg", "spos", "scaled", ks)


@reg("lag_sweep")
def lag_sweep(spark, sf):
    """One regressor over all series per look-back, from one aggregate of the fit rows; fit and validation MSE on scaled
    values; the smallest validation MSE wins (first k on ties) (F6)."""
    out = lagfit.sweep(_lag_products(spark, sf, series.LAG_GRID), None, "seg", series.LAG_GRID)
    return out.select("k", "fit_mse", "val_mse", "selected")


@reg("lag_sweep_series")
def lag_sweep_series(spark, sf):
    """``lag_sweep`` with a regressor of its own for every series, from the same aggregate."""
    out = lagfit.sweep(_lag_products(spark, sf, series.LAG_GRID), "ticker", "seg", series.LAG_GRID)
    return out.select("ticker", "k", "n_fit", "n_val", "fit_mse", "val_mse", "selected")


@reg("lag_fit_one", P(CS + SCALED + """
, tr AS (SELECT * FROM sc WHERE segment = 'train'),
fv AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY date) <=
       floor(count(*) OVER (PARTITION BY ticker) * CAST(0.8 AS DOUBLE)) THEN 'fit' ELSE 'val' END AS seg FROM tr),
w AS (SELECT *, lag(scaled) OVER (PARTITION BY ticker, seg ORDER BY date) AS x FROM fv),
m AS (SELECT ticker, regr_slope(scaled, x) AS b, regr_intercept(scaled, x) AS a FROM w WHERE seg = 'fit' AND x IS NOT NULL GROUP BY ticker),
e AS (SELECT ticker, seg, a, b, (scaled - a - b * x) * (scaled - a - b * x) AS se FROM w JOIN m USING (ticker) WHERE x IS NOT NULL)
SELECT ticker, round(any_value(a), 7) AS intercept, round(any_value(b), 7) AS slope, count(*) FILTER (seg = 'fit') AS n_fit,
       count(*) FILTER (seg = 'val') AS n_val, round(avg(se) FILTER (seg = 'fit'), 9) AS fit_mse, round(avg(se) FILTER (seg = 'val'), 9) AS val_mse
FROM e GROUP BY ticker"""))
def lag_fit_one(spark, sf):
    """The one-lag regressor of every series: intercept, slope, rows and errors."""
    out = lagfit.sweep(_lag_products(spark, sf, [1]), "ticker", "seg", [1])
    return out.select("ticker", F.round(F.col("beta")[0], 7).alias("intercept"), F.round(F.col("beta")[1], 7).alias("slope"), "n_fit", "n_val",
                      F.round("fit_mse", 9).alias("fit_mse"), F.round("val_mse", 9).alias("val_mse"))


# Layers, dropout and batch size of the recurrent forecaster.
RECURRENT = {"hidden": (50, 50, 50), "dropout": 0.2, "batch": 32}


@reg("recurrent_forecast")
def recurrent_forecast(spark, sf, k: int = 15, epochs: int = 100):
    """Three stacked recurrent layers over the ``k`` scaled values before a row, learned from the first four fifths of
    each series' training windows and stopped after 5 epochs without a smaller error on the others; every test row is
    forecast from windows that reach back into the training rows, scaled back and corrected by the training bias (J1, F7, F8)."""
    s = _scaled_series(spark, sf)
    w = series.lag_windows(s.withColumn("y", F.col("scaled")), "ticker", "pos", "scaled", k)
    w = series.split_by_position(w.where(F.col("segment") == "train").withColumn("_p", F.col("pos") - k), "ticker", "_p", 0.8, out="role",
                                 labels=("train", "valid"), seg_pos="_q").select("ticker", "pos", "role").join(w, ["ticker", "pos"], "right").checkpoint()
    windows = w.where(F.col("role").isNotNull()).withColumn("id", F.xxhash64("ticker", "pos"))
    config = network.Config(**RECURRENT, rate=1e-3, epochs=epochs, patience=5, seed=42)
    model = recurrent.start(config.hidden, config.seed)
    (state,) = network.fit_models(network.make_blocks(windows, "x", "y", "id", "role", "train"), [config], [model])
    pred = recurrent.forecast(w, model if state.best_flat is None else model.shaped(state.best_flat), "x", "pred_scaled").withColumn("pred", encode.inverse_minmax("pred_scaled"))
    adj = series.bias_correct(pred, "ticker", "close", "pred", "segment", "train")
    return adj.where(F.col("segment") == "test").select("ticker", "date", F.col("close").alias("actual"), "pred", "adjusted")
