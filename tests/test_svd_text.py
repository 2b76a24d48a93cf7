import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tidemark.operators import svd_text as S


def test_rank_k_error_is_near_the_best(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").repartition(5)
    model = S.fit_text_svd(docs, "text", width=10, features=512)
    rows = docs.select(S._slots("text", 512).alias("s")).collect()
    a = np.concatenate(list(S.weigh(pa.array([r.s for r in rows], pa.list_(pa.int64())), model.idf)))
    exact = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(model.basis.T @ model.basis, np.eye(10), atol=1e-9)
    left = np.linalg.norm(a - a @ model.basis @ model.basis.T)
    assert left <= 1.05 * np.sqrt((exact[10:] ** 2).sum()) and np.allclose(model.singular[:3], exact[:3], rtol=1e-3)


def test_nulls_empty_texts_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b a"), (3, "a b a"), (None, "b c")], "k long, text string")
    model = S.fit_text_svd(df, "text", width=2, features=64)
    got = S.encode_text(df, "k", "text", model).collect()
    by = [(r.k, r.embedding) for r in got]
    assert len(by) == 5 and [v for k, v in by if k in (1, 2)] == [[0.0, 0.0]] * 2
    three = [v for k, v in by if k == 3]
    assert three[0] == three[1] and any(three[0])
    none = df.limit(0)
    assert S.encode_text(none, "k", "text", S.fit_text_svd(none, "text", width=2, features=64)).collect() == []


def test_classifier_on_the_encoder(spark):
    rows = entry.queries()["svd_text_classify"](spark, SF_SMALL).collect()
    assert rows and {r.prediction for r in rows} <= {0.0, 1.0}
