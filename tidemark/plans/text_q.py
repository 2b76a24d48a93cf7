"""Labelled-text workload (W5 text side): projection, batches, tokens, hashed embeddings, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.vec import sigmoid
from tidemark.operators import clean, metrics, series, text
from tidemark.sources import fixtures
from tidemark.sources.fixture_sql import with_views

Q = {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


def N(sql):
    return with_views(sql, "news")


def _n(spark, sf):
    return fixtures.news(spark, sf)


TOKENS_SQL = r"list_filter(string_split_regex(lower(text), '\s+'), lambda s: s <> '')"
BUCKET_SQL = "CAST(CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % {dim} AS INT)"


@reg("news_project", N("SELECT doc_id, gold AS label, text, split FROM news"))
def news_project(spark, sf):
    return clean.project(_n(spark, sf), ["doc_id", "gold", "text", "split"], {"gold": "label"})


BATCH_SQL = """
WITH tr AS (SELECT * FROM news WHERE split = 'train'),
b AS (SELECT doc_id, gold, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS perm,
             count(*) OVER () AS n FROM tr)
"""


@reg("batch_assign", N(BATCH_SQL + "SELECT doc_id, perm, CAST(floor((perm - 1) / 16) AS BIGINT) AS batch_id FROM b "
                                   "WHERE floor((perm - 1) / 16) < greatest(1, floor(n / 16))"))
def batch_assign(spark, sf):
    tr = _n(spark, sf).where(F.col("split") == "train").select("doc_id", "gold")
    return series.batch_assign(tr, "doc_id", 16, seed=42).select("doc_id", "perm", "batch_id")


@reg("chunk_assign", N("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 32) AS BIGINT) AS chunk_id FROM news"))
def chunk_assign(spark, sf):
    return series.chunk_assign(_n(spark, sf).select("doc_id"), "doc_id", 32)


MCC_SQL = """
, s AS (SELECT sum(CASE WHEN y = 1 AND p = 1 THEN 1.0 ELSE 0.0 END) AS tp, sum(CASE WHEN y = 0 AND p = 0 THEN 1.0 ELSE 0.0 END) AS tn,
               sum(CASE WHEN y = 0 AND p = 1 THEN 1.0 ELSE 0.0 END) AS fp, sum(CASE WHEN y = 1 AND p = 0 THEN 1.0 ELSE 0.0 END) AS fn FROM pr)
SELECT CAST(tp AS DOUBLE) AS tp, CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn,
       round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
             ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc FROM s"""


@reg("mcc", N("WITH pr AS (SELECT gold AS y, CAST(doc_id % 3 <> 0 AS INT) AS p FROM news)" + MCC_SQL))
def mcc(spark, sf):
    pr = _n(spark, sf).select(F.col("gold").alias("y"), (F.col("doc_id") % 3 != 0).cast("int").alias("p"))
    return metrics.mcc(pr, "y", "p")


@reg("embed_text_float", N(f"""
WITH ex AS (SELECT doc_id, unnest({TOKENS_SQL}) AS tok FROM news),
c AS (SELECT doc_id, {BUCKET_SQL.format(dim=32)} AS bucket, count(*) AS c FROM ex GROUP BY 1, 2)
SELECT doc_id, bucket, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS FLOAT) AS value FROM c"""))
def embed_text_float(spark, sf):
    """Embeddings as single-precision vectors."""
    e = text.embed_text(_n(spark, sf), "doc_id", "text", dim=32, dtype="float")
    return (e.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).where(F.col("value") != 0)
            .select("doc_id", F.col("bucket").cast("int").alias("bucket"), "value"))


@reg("embed_text", N(f"""
WITH ex AS (SELECT doc_id, unnest({TOKENS_SQL}) AS tok FROM news),
c AS (SELECT doc_id, {BUCKET_SQL.format(dim=64)} AS bucket, count(*) AS c FROM ex GROUP BY 1, 2)
SELECT doc_id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS value FROM c"""))
def embed_text(spark, sf):
    e = text.embed_text(_n(spark, sf), "doc_id", "text", dim=64)
    return (e.select("doc_id", F.posexplode("embedding").alias("bucket", "value"))
            .where(F.col("value") != 0)
            .select("doc_id", F.col("bucket").cast("int").alias("bucket"), F.round(F.col("value").cast("double"), 6).alias("value")))


VOCAB_SQL = f"""
WITH ex AS (SELECT doc_id, unnest({TOKENS_SQL}) AS token, unnest(generate_series(1, len({TOKENS_SQL}))) AS pos FROM news),
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS token_id FROM ex GROUP BY token),
ids AS (SELECT doc_id, pos, token_id FROM ex JOIN v USING (token) WHERE pos <= 128)
"""


@reg("tokenize_pad", N(VOCAB_SQL + "SELECT doc_id, CAST(pos AS INT) AS pos, token_id FROM ids"))
def tokenize_pad(spark, sf):
    n = _n(spark, sf)
    vocab = text.build_vocab(n, "text")
    ids = text.tokenize(n, "doc_id", "text", vocab, 128)
    return (ids.select("doc_id", F.posexplode("input_ids").alias("_p", "token_id"))
            .select("doc_id", (F.col("_p") + 1).cast("int").alias("pos"), "token_id"))


@reg("pad_batches", N(VOCAB_SQL + """
, lens AS (SELECT d.doc_id, coalesce(l.n_real, 0) AS n_real FROM news d LEFT JOIN
          (SELECT doc_id, count(*) AS n_real FROM ids GROUP BY doc_id) l USING (doc_id)),
b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 16) AS BIGINT) AS batch_id FROM lens)
SELECT doc_id, batch_id, CAST(max(n_real) OVER (PARTITION BY batch_id) AS INT) AS width, CAST(n_real AS INT) AS n_real,
       CAST(max(n_real) OVER (PARTITION BY batch_id) - n_real AS INT) AS n_pad FROM b"""))
def pad_batches(spark, sf):
    n = _n(spark, sf)
    ids = text.tokenize(n, "doc_id", "text", text.build_vocab(n, "text"), 128)
    b = series.chunk_assign(ids, "doc_id", 16, name="batch_id")
    p = text.pad_batches(b, "input_ids", "batch_id")
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return p.select("doc_id", "batch_id", F.size("input_ids").alias("width"), real.alias("n_real"),
                    (F.size("input_ids") - real).alias("n_pad"))


PROB = "1.0 / (1.0 + exp(-((doc_id % 7) - 3) / 2.0))"


def _prob(df):
    return df.withColumn("prob", sigmoid(((F.col("doc_id") % 7) - 3) / F.lit(2.0)))


@reg("avg_batch_loss", N(BATCH_SQL + f"""
, l AS (SELECT b.doc_id, CAST(floor((perm - 1) / 16) AS BIGINT) AS batch_id,
        -(gold * ln({PROB} + 1e-7) + (1 - gold) * ln(1 - {PROB} + 1e-7)) AS loss
        FROM b WHERE floor((perm - 1) / 16) < greatest(1, floor(n / 16)))
SELECT count(*) AS n_batches, round(avg(m), 6) AS avg_batch_loss FROM (SELECT batch_id, avg(loss) AS m FROM l GROUP BY batch_id)"""))
def avg_batch_loss(spark, sf):
    tr = _prob(_n(spark, sf).where(F.col("split") == "train").select("doc_id", "gold"))
    b = series.batch_assign(tr, "doc_id", 16, seed=42)
    b = b.withColumn("loss", metrics.row_bce("gold", "prob"))
    return metrics.avg_batch_loss(b, "batch_id", "loss")


@reg("bce_loss", N(f"SELECT round(avg(-(gold * ln({PROB} + 1e-7) + (1 - gold) * ln(1 - {PROB} + 1e-7))), 6) AS bce FROM news"))
def bce_loss(spark, sf):
    return metrics.bce_loss(_prob(_n(spark, sf)), "gold", "prob")


@reg("majority_baseline", N("""
WITH m AS (SELECT gold FROM news WHERE split = 'train' GROUP BY gold ORDER BY count(*) DESC, gold LIMIT 1)
SELECT (SELECT gold FROM m) AS majority_class, round(avg(CASE WHEN gold = (SELECT gold FROM m) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM news WHERE split = 'valid'"""))
def majority_baseline(spark, sf):
    n = _n(spark, sf)
    return metrics.majority_baseline(n.where(F.col("split") == "train"), n.where(F.col("split") == "valid"), "gold")
