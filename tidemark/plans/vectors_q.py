"""Vector workload (W5 vector side): balance, thresholds, kNN, SMOTE, bootstrap,
leaderboards, votes, and the ticket text embedding concatenation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.vec import argmax, dot, relu, sigmoid
from tidemark.operators import clean, encode, profile, sampling, select, text, vectors
from tidemark.sources import fixtures
from tidemark.sources.fixture_sql import with_views

Q = {}
DIM = 64


def reg(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


def V(sql):
    return with_views(sql, "vectors")


def _v(spark, sf):
    return fixtures.vectors(spark, sf)


def _train(spark, sf):
    return _v(spark, sf).where(F.col("split") == "train")


LOGIT = "list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))"


def _sum_emb():
    return F.aggregate(F.col("embedding"), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))


DIST = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
H = "CAST(CAST(('0x' || substr(md5({s}), 1, 15)) AS BIGINT) AS BIGINT)"


@reg("class_balance", V("""
WITH c AS (SELECT gold, count(*) AS n FROM vectors WHERE split = 'train' GROUP BY gold)
SELECT count(*) AS n_classes, min(n) AS min_count, max(n) AS max_count, round(min(n) / max(n), 6) AS ratio,
       count(*) > 1 AND min(n) / max(n) < 0.8 AS imbalanced FROM c"""))
def class_balance(spark, sf):
    return profile.class_balance(_train(spark, sf), "gold", 0.8)


@reg("threshold_predict", V(f"""
SELECT vec_id, round(1.0 / (1.0 + exp(-{LOGIT})), 9) AS prob, CAST(1.0 / (1.0 + exp(-{LOGIT})) > 0.5 AS INT) AS pred,
       CAST(list_avg(list_transform(embedding, lambda x: CAST(x > 0 AS INT))) >= 0.5 AS INT) AS vote FROM vectors"""))
def threshold_predict(spark, sf):
    v = _v(spark, sf)
    share_pos = F.aggregate(F.col("embedding"), F.lit(0.0).cast("double"),
                            lambda a, x: a + (x > 0).cast("double")) / F.size("embedding")
    return v.select("vec_id", F.round(sigmoid(_sum_emb()), 9).alias("prob"), clean.logit_decision(_sum_emb()).alias("pred"),
                    clean.threshold(share_pos, 0.5, strict=False).alias("vote"))


@reg("argmax_class", V("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS argmax FROM vectors"))
def argmax_class(spark, sf):
    return _v(spark, sf).select("vec_id", argmax("embedding").cast("int").alias("argmax"))


@reg("relu_vector", V("SELECT vec_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INT) AS pos, "
                      "unnest(list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0.0))) AS value FROM vectors"))
def relu_vector(spark, sf):
    v = _v(spark, sf).select("vec_id", relu("embedding").alias("r"))
    return v.select("vec_id", F.posexplode("r").alias("pos", "value")).select("vec_id", F.col("pos").cast("int"), "value")


@reg("vector_dot", V("""
WITH ex AS (SELECT vec_id, split, unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS i FROM vectors),
c AS (SELECT i, avg(CAST(v AS DOUBLE)) AS m FROM ex WHERE split = 'train' GROUP BY i)
SELECT vec_id, round(sum(CAST(v AS DOUBLE) * m), 6) AS dot FROM ex JOIN c USING (i) GROUP BY vec_id"""))
def vector_dot(spark, sf):
    v = _v(spark, sf)
    c = vectors.centroid(v.where(F.col("split") == "train"), "embedding", DIM)
    cen = F.array(*[F.lit(x) for x in c])
    return v.select("vec_id", F.round(dot(F.col("embedding"), cen), 6).alias("dot"))


@reg("vector_to_columns", V("SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS embed_{i}" for i in range(DIM)) + " FROM vectors"))
def vector_to_columns(spark, sf):
    return encode.vector_to_columns(_v(spark, sf), "embedding", DIM, keep=["vec_id"])


KNN_SQL = f"""
WITH tr AS (SELECT * FROM vectors WHERE split = 'train'), te AS (SELECT * FROM vectors WHERE split = 'test'),
nn AS (SELECT a.vec_id AS q_id, b.vec_id AS r_id, b.label AS lab, round({DIST}, 9) AS dist,
              row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DIST}, 9), b.vec_id) AS rank
       FROM te a, tr b QUALIFY rank <= 5)
"""


@reg("knn_neighbors", V(KNN_SQL + "SELECT q_id, CAST(rank AS INT) AS rank, r_id, dist FROM nn"))
def knn_neighbors(spark, sf):
    v = _v(spark, sf)
    return vectors.knn(v.where(F.col("split") == "test"), v.where(F.col("split") == "train"), 5, "vec_id", "vec_id")


ROUNDED = "list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 3))"


@reg("knn_ties", V(f"""
WITH r AS (SELECT vec_id, split, {ROUNDED} AS e FROM vectors)
SELECT a.vec_id AS q_id, CAST(row_number() OVER w AS INT) AS rank, b.vec_id AS r_id, round(list_distance(a.e, b.e), 9) AS dist
FROM r a, r b WHERE a.split = 'test' AND b.split = 'train'
WINDOW w AS (PARTITION BY a.vec_id ORDER BY round(list_distance(a.e, b.e), 9), b.vec_id) QUALIFY row_number() OVER w <= 5"""))
def knn_ties(spark, sf):
    """Vectors rounded to few values, so that many references are equally far; small blocks."""
    v = _v(spark, sf).select("vec_id", "split", F.transform("embedding", lambda x: F.round(x.cast("double") * 3)).alias("embedding"))
    return vectors.knn(v.where(F.col("split") == "test"), v.where(F.col("split") == "train").orderBy(F.col("vec_id").desc()), 5,
                       "vec_id", "vec_id", block_rows=97)


@reg("knn_classify", V(KNN_SQL + """
, votes AS (SELECT q_id, lab, count(*) AS c FROM nn GROUP BY q_id, lab)
SELECT q_id AS vec_id, lab AS pred FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY c DESC, lab) AS r FROM votes) WHERE r = 1"""))
def knn_classify(spark, sf):
    v = _v(spark, sf)
    return vectors.knn_classify(v.where(F.col("split") == "test"), v.where(F.col("split") == "train"), 5,
                                "vec_id", "vec_id", "label")


SMOTE_SQL = f"""
WITH tr AS (SELECT * FROM vectors WHERE split = 'train'),
cnt AS (SELECT gold, count(*) AS n FROM tr GROUP BY gold),
mi AS (SELECT gold AS g, n FROM cnt ORDER BY n, gold LIMIT 1),
mx AS (SELECT max(n) AS nmaj FROM cnt),
m AS (SELECT tr.vec_id, tr.embedding, row_number() OVER (ORDER BY tr.vec_id) AS i FROM tr JOIN mi ON tr.gold = mi.g),
nn AS (SELECT a.vec_id AS q, b.vec_id AS r,
              row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DIST}, 9), b.vec_id) AS rank
       FROM m a JOIN m b ON a.vec_id <> b.vec_id QUALIFY rank <= 5),
d AS (SELECT range AS j FROM range((SELECT nmaj FROM mx) - (SELECT n FROM mi))),
dd AS (SELECT j, {H.format(s="'42:b:' || CAST(j AS VARCHAR)")} % (SELECT n FROM mi) + 1 AS bi,
              {H.format(s="'42:n:' || CAST(j AS VARCHAR)")} % least(5, (SELECT n FROM mi) - 1) + 1 AS rk,
              {H.format(s="'42:u:' || CAST(j AS VARCHAR)")} / 1152921504606846976.0 AS u FROM d),
syn AS (SELECT dd.j AS syn_id, b.vec_id AS base_id, nn.r AS nbr_id, dd.u, b.embedding AS bv, o.embedding AS nv
        FROM dd JOIN m b ON b.i = dd.bi JOIN nn ON nn.q = b.vec_id AND nn.rank = dd.rk JOIN m o ON o.vec_id = nn.r)
"""


@reg("smote", V(SMOTE_SQL + """
SELECT syn_id, base_id, nbr_id, round(u, 9) AS u, CAST(unnest(generate_series(0, 63)) AS INT) AS pos,
       unnest(list_transform(list_zip(bv, nv), lambda t: round(CAST(t[1] AS DOUBLE) + u * (CAST(t[2] AS DOUBLE) - CAST(t[1] AS DOUBLE)), 6))) AS value
FROM syn"""))
def smote(spark, sf):
    s = vectors.smote(_train(spark, sf), "gold", "vec_id", "embedding", k=5, seed=42)
    return (s.select("syn_id", "base_id", "nbr_id", F.round("u", 9).alias("u"), F.posexplode("embedding").alias("pos", "v"))
            .select("syn_id", "base_id", "nbr_id", "u", F.col("pos").cast("int").alias("pos"), F.round("v", 6).alias("value")))


@reg("bootstrap", V(f"""
WITH tr AS (SELECT vec_id FROM vectors WHERE split = 'train'),
idx AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, count(*) OVER () AS n FROM tr),
nn AS (SELECT max(n) AS n FROM idx),
d AS (SELECT CAST(range // (SELECT n FROM nn) AS INT) AS replicate, range % (SELECT n FROM nn) AS draw FROM range((SELECT n FROM nn) * 10))
SELECT replicate, draw, vec_id FROM d JOIN idx ON idx.i = {H.format(s="CAST(replicate + 42 AS VARCHAR) || ':' || CAST(draw AS VARCHAR)")} % idx.n + 1"""))
def bootstrap(spark, sf):
    tr = _train(spark, sf).select("vec_id")
    return sampling.bootstrap(tr, "vec_id", 10, 42).select("replicate", "draw", "vec_id")


@reg("bootstrap_counts", V(f"""
WITH tr AS (SELECT vec_id FROM vectors WHERE split = 'train'),
idx AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, count(*) OVER () AS n FROM tr),
nn AS (SELECT max(n) AS n FROM idx),
r AS (SELECT CAST(range AS INT) AS replicate FROM range(10)),
d AS (SELECT replicate, range AS draw FROM r, range((SELECT n FROM nn))),
c AS (SELECT replicate, {H.format(s="CAST(replicate + 42 AS VARCHAR) || ':' || CAST(draw AS VARCHAR)")} % (SELECT n FROM nn) + 1 AS i, count(*) AS c FROM d GROUP BY 1, 2)
SELECT vec_id, replicate, CAST(coalesce(c, 0) AS INT) AS draws FROM idx CROSS JOIN r LEFT JOIN c USING (i, replicate)"""))
def bootstrap_counts(spark, sf):
    """How often each replicate draws each training row (R4 as weights)."""
    d = sampling.bootstrap_counts(_train(spark, sf).select("vec_id"), "vec_id", 10, 42)
    return d.select("vec_id", F.posexplode("draws").alias("replicate", "draws"))


def _feature_mcc(spark, sf):
    tr = _train(spark, sf).select("vec_id", "gold", F.posexplode("embedding").alias("config_id", "v"))
    pr = tr.select("config_id", F.col("gold").alias("y"), (F.col("v") > 0).cast("int").alias("p"))
    from tidemark.operators.metrics import mcc
    return mcc(pr, "y", "p", digits=9, by=["config_id"]).select(F.col("config_id").cast("int").alias("config_id"), "mcc")


FEATURE_MCC_SQL = """
WITH tr AS (SELECT gold AS y, unnest(embedding) AS v, unnest(generate_series(0, len(embedding) - 1)) AS config_id FROM vectors WHERE split = 'train'),
pr AS (SELECT CAST(config_id AS INT) AS config_id, y, CAST(v > 0 AS INT) AS p FROM tr),
s AS (SELECT config_id, sum(CASE WHEN y = 1 AND p = 1 THEN 1.0 ELSE 0.0 END) AS tp, sum(CASE WHEN y = 0 AND p = 0 THEN 1.0 ELSE 0.0 END) AS tn,
             sum(CASE WHEN y = 0 AND p = 1 THEN 1.0 ELSE 0.0 END) AS fp, sum(CASE WHEN y = 1 AND p = 0 THEN 1.0 ELSE 0.0 END) AS fn FROM pr GROUP BY 1),
fm AS (SELECT config_id, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
             ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 9) AS mcc FROM s)
"""


@reg("leaderboard", V(FEATURE_MCC_SQL + "SELECT config_id, mcc, row_number() OVER (ORDER BY mcc DESC, config_id) AS position FROM fm"))
def leaderboard(spark, sf):
    return select.leaderboard(_feature_mcc(spark, sf), "mcc", "config_id")


@reg("best_model", V(FEATURE_MCC_SQL + "SELECT config_id, mcc FROM fm ORDER BY mcc DESC, config_id LIMIT 1"))
def best_model(spark, sf):
    return select.best_of(_feature_mcc(spark, sf), "mcc", "config_id")


@reg("top_importances", V("""
WITH ex AS (SELECT unnest(embedding) AS v, unnest(generate_series(0, len(embedding) - 1)) AS idx FROM vectors WHERE split = 'train')
SELECT CAST(idx AS INT) AS idx, round(avg(abs(CAST(v AS DOUBLE))), 9) AS importance FROM ex GROUP BY idx
ORDER BY importance DESC, idx DESC LIMIT 10"""))
def top_importances(spark, sf):
    imp = select.vector_importances(_train(spark, sf), "embedding").select(
        F.col("idx").cast("int").alias("idx"), F.round("importance", 9).alias("importance"))
    return select.top_k(imp, "importance", "idx", 10)


def _votes(spark, sf):
    """Deterministic stand-in votes: family f, replicate r votes ``embedding[10 f + r] > 0``."""
    v = _v(spark, sf).select("vec_id", F.posexplode("embedding").alias("pos", "x")).where(F.col("pos") < 40)
    return v.select("vec_id", (F.col("pos") / 10).cast("int").alias("family"), (F.col("pos") % 10).alias("replicate"),
                    (F.col("x") > 0).cast("int").alias("pred"))


@reg("bagging_vote", V("""
WITH v AS (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM vectors),
f AS (SELECT vec_id, CAST(pos // 10 AS INT) AS family, CAST(avg(CAST(x > 0 AS INT)) >= 0.5 AS INT) AS fv FROM v WHERE pos < 40 GROUP BY 1, 2)
SELECT vec_id, CAST(sum(fv) AS BIGINT) AS n_family_yes, CAST(avg(fv) >= 0.5 AS INT) AS pred FROM f GROUP BY vec_id"""))
def bagging_vote(spark, sf):
    from tidemark.operators.models import two_level_vote
    return two_level_vote(_votes(spark, sf), "vec_id", "family", "pred")


EMBED_COLS = ["product_purchased", "ticket_type", "ticket_subject", "ticket_description", "ticket_status",
              "resolution", "ticket_channel"]


@reg("embed_concat", with_views("""
WITH rated AS (SELECT * FROM tickets WHERE customer_satisfaction_rating IS NOT NULL),
st AS (""" + " UNION ALL ".join(
    f"SELECT ticket_id, {i} AS ci, CAST({c} AS VARCHAR) AS text FROM rated" for i, c in enumerate(EMBED_COLS)) + r"""),
ex AS (SELECT ticket_id, ci, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda s: s <> '')) AS tok FROM st),
c AS (SELECT ticket_id, ci, CAST(CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 8 AS INT) AS b, count(*) AS c FROM ex GROUP BY 1, 2, 3)
SELECT ticket_id, CAST(ci * 8 + b AS INT) AS pos, round(c / sqrt(sum(c * c) OVER (PARTITION BY ticket_id, ci)), 6) AS value FROM c""",
                                "tickets"))
def embed_concat(spark, sf):
    t = clean.drop_null(fixtures.tickets(spark, sf), ["customer_satisfaction_rating"])
    e = text.embed_columns(t, "ticket_id", EMBED_COLS, dim=8)
    return (e.select("ticket_id", F.posexplode("embedding").alias("pos", "value")).where(F.col("value") != 0)
            .select("ticket_id", F.col("pos").cast("int").alias("pos"), F.round("value", 6).alias("value")))
