"""Fits whose cost must not grow with the number of partitions, replicates or classes."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tidemark.operators import models, vectors
from tidemark.plans import models_q


def test_text_fits_tokenize_once_and_read_as_many_partitions_as_cores(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    rng, words = np.random.default_rng(2), [f"W{i}" for i in range(40)]
    texts = [(i, float(i % 2), " ".join(rng.choice(words[10 * (i % 2):], 12))) for i in range(120)]
    df = spark.createDataFrame(texts, "id long, gold double, text string").repartition(64)
    plain = Pipeline(stages=[RegexTokenizer(inputCol="text", outputCol="_tok", pattern=r"\s+"), HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=1 << 16),
                             IDF(inputCol="_tf", outputCol="features"), LogisticRegression(labelCol="gold", regParam=0.1, maxIter=100)])
    want = {r.id: r.probability[1] for r in plain.fit(df).transform(df).collect()}
    fit, seen = Pipeline.fit, []

    def watched(self, rows, *more):
        seen.append(rows.rdd.getNumPartitions())
        return fit(self, rows, *more)

    monkeypatch.setattr(Pipeline, "fit", watched)
    counts = models_q._term_counts(df).checkpoint()
    assert "text" not in counts.columns and "_tok" not in counts.columns and counts.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    got = {r.id: r.probability[1] for r in models_q._text_model(counts, "gold", reg_param=0.1).transform(counts).collect()}
    assert seen == [spark.sparkContext.defaultParallelism]
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def _drawn_rows(spark, n=90, replicates=3):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 2)), [float(a) for a in rng.integers(0, 4, 3)], [int(c) for c in rng.poisson(0.5, replicates)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y int, v array<double>, d array<int>")


def test_neighbours_of_all_replicates_equal_those_of_each(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARED_ROWS", -10)  # 10 shared rows: some queries must look further
    df = _drawn_rows(spark).cache()
    queries = df.where("id % 7 = 0")
    for block_rows in (1_000, 17):
        got = vectors.knn_drawn(queries, df, 5, "id", "id", "d", "v", block_rows=block_rows).collect()
        for j in range(3):
            own = df.where(F.col("d")[j] > 0)
            want = {tuple(r) for r in vectors.knn(queries, own, 5, "id", "id", "v", block_rows=block_rows).collect()}
            assert {tuple(r)[1:] for r in got if r.replicate == j} == want
    got = {(r.replicate, r.id): r.pred for r in vectors.knn_classify_drawn(queries, df, 5, "id", "id", "y", "d", "v").collect()}
    for j in range(3):
        own = df.withColumn("c", F.col("d")[j]).where("c > 0")
        for r in vectors.knn_classify(queries, own, 5, "id", "id", "y", "v", copies="c").collect():
            assert got.pop((j, r.id)) == r.pred
    assert not got


def test_bagging_compares_queries_with_rows_once(spark, monkeypatch):
    calls, once = [], vectors._meeting

    def watched(*a):
        calls.append(1)
        return once(*a)

    monkeypatch.setattr(vectors, "_meeting", watched)
    df = _drawn_rows(spark).drop("d")
    votes = models.bagging_votes(df.where("id % 3 > 0"), df.where("id % 3 = 0"), "id", "y", 4, 42, knn_vec="v", families=("knn",)).collect()
    assert len(calls) == 1 and len(votes) == 4 * 30 and {r.replicate for r in votes} == {0, 1, 2, 3}


def test_one_vs_rest_fits_share_the_memory():
    assert models.fits_at_once(0, 0) == models.fits_at_once(37_000, 452) == 4
    assert models.fits_at_once(2_240_000, 452) == 1 and models.fits_at_once(1_000_000, 452) == 2
