"""Ticket workload (W3 profile + W4 preparation): registered queries and their SQL.

Each entry: name -> (spark_fn(spark, sf_dir) -> DataFrame, DuckDB SQL or None).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.keys import hash_key
from tidemark.operators import clean, encode, metrics, profile, sampling, setops
from tidemark.sources import fixtures
from tidemark.sources.fixture_sql import with_views

RATING = "customer_satisfaction_rating"
RATINGS = [1.0, 2.0, 3.0, 4.0, 5.0]


def _t(spark, sf):
    return fixtures.tickets(spark, sf)


def _rated(spark, sf):
    """Rated tickets with the resolution duration (cleaning order of the notebook twin)."""
    t = clean.drop_null(_t(spark, sf), [RATING])
    return t.withColumn("resolution_duration", clean.duration_hours("first_response_time", "time_to_resolution"))


RATED_SQL = (" rated AS (SELECT *, (epoch_us(CAST(time_to_resolution AS TIMESTAMP)) - "
             "epoch_us(CAST(first_response_time AS TIMESTAMP))) / 3.6e9 AS resolution_duration "
             f"FROM tickets WHERE {RATING} IS NOT NULL AND NOT isnan({RATING}))")


def T(sql):
    return with_views(sql, "tickets")


def TR(sql):
    return with_views("WITH" + RATED_SQL + "\n" + sql, "tickets")


Q = {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


# ---- D: profiling ---------------------------------------------------------------------------------

SUBJECTS = sorted(f"src{i}" for i in range(20))


@reg("crosstab_type_subject", T("SELECT ticket_type, " + ", ".join(f"count(*) FILTER (WHERE ticket_subject = '{s}') AS {s}" for s in SUBJECTS)
                                + " FROM tickets WHERE ticket_type IS NOT NULL AND ticket_subject IS NOT NULL GROUP BY ticket_type"))
def crosstab_type_subject(spark, sf):
    return profile.crosstab(_t(spark, sf), "ticket_type", "ticket_subject")


@reg("crosstab_status_rating", T(
    "SELECT ticket_status, " + ", ".join(
        f"count(*) FILTER (WHERE {RATING} = {v}) AS r{int(v)}" for v in RATINGS)
    + f" FROM tickets WHERE {RATING} IS NOT NULL GROUP BY ticket_status"))
def crosstab_status_rating(spark, sf):
    return profile.crosstab(_t(spark, sf), "ticket_status", RATING, RATINGS, [f"r{int(v)}" for v in RATINGS])


@reg("product_counts", T("SELECT product_purchased, count(*) AS count FROM tickets "
                         "WHERE product_purchased IS NOT NULL GROUP BY 1"))
def product_counts(spark, sf):
    return profile.value_counts(_t(spark, sf), "product_purchased")


@reg("status_counts", T("SELECT ticket_status, count(*) AS count FROM tickets WHERE ticket_status IS NOT NULL GROUP BY 1"))
def status_counts(spark, sf):
    return profile.value_counts(_t(spark, sf), "ticket_status")


@reg("gender_pct", T("SELECT customer_gender, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct "
                     "FROM tickets WHERE customer_gender IS NOT NULL GROUP BY 1"))
def gender_pct(spark, sf):
    return profile.value_shares(_t(spark, sf), "customer_gender")


@reg("rating_pct", T(f"SELECT {RATING}, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct "
                     f"FROM tickets WHERE {RATING} IS NOT NULL GROUP BY 1"))
def rating_pct(spark, sf):
    return profile.value_shares(_t(spark, sf), RATING)


@reg("top_products", T("SELECT product_purchased, count(*) AS count FROM tickets WHERE product_purchased IS NOT NULL "
                       "GROUP BY 1 ORDER BY count DESC, product_purchased LIMIT 10"))
def top_products(spark, sf):
    return profile.top_values(_t(spark, sf), "product_purchased", 10)


@reg("purchase_timeline", T("SELECT date_of_purchase, count(*) AS count FROM tickets "
                            "WHERE date_of_purchase IS NOT NULL GROUP BY 1"))
def purchase_timeline(spark, sf):
    return profile.timeline(_t(spark, sf), "date_of_purchase")


@reg("product_date_pairs", T("SELECT date_of_purchase, product_purchased, count(*) AS count FROM tickets "
                             "WHERE date_of_purchase IS NOT NULL AND product_purchased IS NOT NULL GROUP BY 1, 2"))
def product_date_pairs(spark, sf):
    return profile.pair_counts(_t(spark, sf), "date_of_purchase", "product_purchased")


@reg("type_subject_long", T("SELECT ticket_type, ticket_subject, count(*) AS count FROM tickets "
                            "WHERE ticket_type IS NOT NULL AND ticket_subject IS NOT NULL GROUP BY 1, 2"))
def type_subject_long(spark, sf):
    return profile.pair_counts(_t(spark, sf), "ticket_type", "ticket_subject")


def _describe_sql(col, src):
    x = f"CAST({col} AS DOUBLE)"
    return (f"SELECT count({x}) AS count, round(avg({x}), 2) AS mean, round(stddev_samp({x}), 2) AS std, "
            f"round(min({x}), 2) AS min, round(quantile_cont({x}, 0.25), 2) AS p25, "
            f"round(quantile_cont({x}, 0.5), 2) AS p50, round(quantile_cont({x}, 0.75), 2) AS p75, "
            f"round(max({x}), 2) AS max FROM {src} WHERE {col} IS NOT NULL")


@reg("describe_resolution", TR(_describe_sql("resolution_duration", "rated")))
def describe_resolution(spark, sf):
    return profile.describe(_rated(spark, sf), "resolution_duration")


@reg("describe_rating", T(_describe_sql(RATING, "tickets")))
def describe_rating(spark, sf):
    return profile.describe(_t(spark, sf), RATING)


def _hist_sql(col, src, bins):
    x = f"CAST({col} AS DOUBLE)"
    return (f"""
, st AS (SELECT min({x}) AS lo, max({x}) AS hi FROM {src} WHERE {col} IS NOT NULL),
b AS (SELECT CAST(least(floor(({x} - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INT) AS bin
      FROM {src}, st WHERE {col} IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT r.bin, round(lo + r.bin * ((hi - lo) / {bins}), 6) AS bin_lo, round(lo + (r.bin + 1) * ((hi - lo) / {bins}), 6) AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT CAST(range AS INT) AS bin FROM range({bins})) r CROSS JOIN st LEFT JOIN c ON c.bin = r.bin""")


@reg("hist_age", T("WITH _x AS (SELECT 1)" + _hist_sql("customer_age", "tickets", 20)))
def hist_age(spark, sf):
    return profile.histogram(_t(spark, sf), "customer_age", 20)


@reg("hist_resolution", TR(_hist_sql("resolution_duration", "rated", 50)))
def hist_resolution(spark, sf):
    return profile.histogram(_rated(spark, sf), "resolution_duration", 50)


# ---- B: cleaning ----------------------------------------------------------------------------------

@reg("tickets_rated", T(f"SELECT * FROM tickets WHERE {RATING} IS NOT NULL AND NOT isnan({RATING})"))
def tickets_rated(spark, sf):
    return clean.drop_null(_t(spark, sf), [RATING])


@reg("resolution_hours", TR("SELECT ticket_id, round(resolution_duration, 6) AS resolution_hours FROM rated"))
def resolution_hours(spark, sf):
    return _rated(spark, sf).select("ticket_id", F.round("resolution_duration", 6).alias("resolution_hours"))


@reg("parse_timestamps", T(
    "SELECT ticket_id, strptime(strftime(first_response_time, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS first_response_time, "
    "strptime(strftime(time_to_resolution, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS time_to_resolution FROM tickets"))
def parse_timestamps(spark, sf):
    # the landed CSV holds these as text; format then parse with the fixed format
    t = _t(spark, sf).select("ticket_id", *[F.date_format(c, clean.TS_FORMAT.replace("HH", "HH")).alias(c)
                                            for c in ("first_response_time", "time_to_resolution")])
    out = clean.parse_timestamps(t, ["first_response_time", "time_to_resolution"])
    return out.select("ticket_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_response_time", "time_to_resolution")])


@reg("ticket_text", T("SELECT ticket_id, ticket_description || ' ' || resolution || ' Product: ' || product_purchased "
                      "AS text FROM tickets"))
def ticket_text(spark, sf):
    return _t(spark, sf).select("ticket_id", clean.text_template(
        [F.col("ticket_description"), " ", F.col("resolution"), " Product: ", F.col("product_purchased")]).alias("text"))


@reg("sample_n", T("SELECT ticket_id, product_purchased FROM tickets "
                   "ORDER BY md5('42:' || CAST(ticket_id AS VARCHAR)), ticket_id LIMIT 1000"))
def sample_n(spark, sf):
    return clean.sample_n(_t(spark, sf), 1000, "ticket_id", seed=42).select("ticket_id", "product_purchased")


@reg("features_target_split", TR("SELECT ticket_id, customer_age, customer_gender, ticket_priority, "
                                 "round(resolution_duration, 6) AS resolution_duration FROM rated"))
def features_target_split(spark, sf):
    nontext = _rated(spark, sf).select("ticket_id", "customer_age", "customer_gender", "ticket_priority",
                                       F.round("resolution_duration", 6).alias("resolution_duration"), RATING)
    features, _target = clean.features_target(nontext, RATING)
    return features


# ---- C: encoders ----------------------------------------------------------------------------------

def _fact_sql(col, src, code):
    return (f"LEFT JOIN (SELECT v, CAST(row_number() OVER (ORDER BY f, v) - 1 AS INT) AS code FROM "
            f"(SELECT {col} AS v, min(ticket_id) AS f FROM {src} WHERE {col} IS NOT NULL GROUP BY 1)) {code} "
            f"ON {code}.v = {src}.{col}")


@reg("factorize", TR(
    "SELECT ticket_id, CAST(coalesce(g.code, -1) AS INT) AS gender_code, CAST(coalesce(p.code, -1) AS INT) AS priority_code, "
    "CAST(coalesce(r.code, -1) AS INT) AS rating_code FROM rated "
    + _fact_sql("customer_gender", "rated", "g") + " " + _fact_sql("ticket_priority", "rated", "p") + " "
    + _fact_sql(RATING, "rated", "r")))
def factorize(spark, sf):
    r = _rated(spark, sf).select("ticket_id", "customer_gender", "ticket_priority", RATING)
    r = encode.factorize_columns(r, {"customer_gender": "gender_code", "ticket_priority": "priority_code", RATING: "rating_code"}, "ticket_id")
    return r.select("ticket_id", "gender_code", "priority_code", "rating_code")


@reg("factorize_uniques", T("SELECT v AS product_purchased, CAST(row_number() OVER (ORDER BY f, v) - 1 AS INT) AS code "
                            "FROM (SELECT product_purchased AS v, min(ticket_id) AS f FROM tickets "
                            "WHERE product_purchased IS NOT NULL GROUP BY 1)"))
def factorize_uniques(spark, sf):
    return encode.fit_factorize(_t(spark, sf), "product_purchased", "ticket_id")


LE_COLS = ["product_purchased", "ticket_type", "ticket_subject", "ticket_channel"]


@reg("label_encode", T(
    "SELECT ticket_id, " +
    ", ".join(f"CAST(coalesce(e{i}.code, -1) AS INT) AS {c}_code" for i, c in enumerate(LE_COLS)) + " FROM tickets " +
    " ".join(f"LEFT JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM "
             f"(SELECT DISTINCT {c} AS v FROM tickets WHERE {c} IS NOT NULL)) e{i} ON e{i}.v = tickets.{c}"
             for i, c in enumerate(LE_COLS))))
def label_encode(spark, sf):
    t = _t(spark, sf).select("ticket_id", *LE_COLS)
    return encode.label_encode(t, LE_COLS).select("ticket_id", *[f"{c}_code" for c in LE_COLS])


@reg("class_map_roundtrip", TR(
    f"SELECT ticket_id, {RATING}, m.code AS class_index, m.v AS class_back FROM rated JOIN "
    f"(SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM (SELECT DISTINCT {RATING} AS v FROM rated)) m "
    f"ON m.v = rated.{RATING}"))
def class_map_roundtrip(spark, sf):
    r = _rated(spark, sf).select("ticket_id", RATING)
    fitted = encode.fit_label_encoder(r, RATING, "class_index")
    coded = encode.apply_codes(r, fitted, RATING, "class_index")
    return encode.decode(coded, fitted, "class_index", RATING, code="class_index", out="class_back")


@reg("one_hot", TR(
    "SELECT ticket_id, " + ", ".join(f"CAST(m.code = {i} AS INT) AS oh_{i}" for i in range(5)) +
    f" FROM rated JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM "
    f"(SELECT DISTINCT {RATING} AS v FROM rated)) m ON m.v = rated.{RATING}"))
def one_hot(spark, sf):
    r = _rated(spark, sf).select("ticket_id", RATING)
    fitted = encode.fit_label_encoder(r, RATING, "code")
    coded = encode.apply_codes(r, fitted, RATING, "code")
    k = fitted.count()
    return encode.one_hot_columns(coded, "code", k).select("ticket_id", *[f"oh_{i}" for i in range(k)])


SPLIT_SQL = (f", sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {RATING} ORDER BY "
             f"md5('42:' || CAST(ticket_id AS VARCHAR)), ticket_id) <= round(0.25 * count(*) OVER (PARTITION BY {RATING})) "
             f"THEN 'test' ELSE 'train' END AS part FROM rated)")


@reg("stratified_split", TR(SPLIT_SQL + f" SELECT ticket_id, {RATING}, part FROM sp"))
def stratified_split(spark, sf):
    r = _rated(spark, sf).select("ticket_id", RATING)
    return sampling.stratified_split(r, RATING, "ticket_id", 0.25, 42)


@reg("kfold_assign", TR(f"SELECT ticket_id, {RATING}, CAST((row_number() OVER (PARTITION BY {RATING} ORDER BY "
                        f"md5('42:' || CAST(ticket_id AS VARCHAR)), ticket_id) - 1) % 5 AS INT) AS fold FROM rated"))
def kfold_assign(spark, sf):
    r = _rated(spark, sf).select("ticket_id", RATING)
    return sampling.kfold_assign(r, RATING, "ticket_id", 5, 42)


@reg("standard_scale", TR(SPLIT_SQL + """
, st AS (SELECT avg(customer_age) AS ma, stddev_pop(customer_age) AS sa,
                avg(resolution_duration) AS md, stddev_pop(resolution_duration) AS sd FROM sp WHERE part = 'train')
SELECT ticket_id, round((customer_age - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END, 6) AS customer_age_std,
       round((resolution_duration - md) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS resolution_duration_std
FROM sp, st WHERE part = 'test'"""))
def standard_scale(spark, sf):
    r = _rated(spark, sf).select("ticket_id", RATING, "customer_age", "resolution_duration")
    sp = sampling.stratified_split(r, RATING, "ticket_id", 0.25, 42).cache()
    cols = ["customer_age", "resolution_duration"]
    fitted = encode.fit_standard(sp.where(F.col("part") == "train"), cols)
    out = encode.apply_standard(sp.where(F.col("part") == "test"), fitted, cols)
    return out.select("ticket_id", *[F.round(c + "_std", 6).alias(c + "_std") for c in cols])


# ---- E: joins on keys -----------------------------------------------------------------------------

@reg("outer_align", TR(
    f"SELECT coalesce(a.ticket_id, b.ticket_id) AS ticket_id, a.{RATING}, round(b.resolution_duration, 6) AS resolution_duration "
    f"FROM (SELECT ticket_id, {RATING} FROM rated) a FULL OUTER JOIN "
    "(SELECT ticket_id, (epoch_us(CAST(time_to_resolution AS TIMESTAMP)) - epoch_us(CAST(first_response_time AS TIMESTAMP))) / 3.6e9 "
    "AS resolution_duration FROM tickets WHERE time_to_resolution IS NOT NULL AND ticket_type = 'LARGE') b "
    "ON a.ticket_id = b.ticket_id"))
def outer_align(spark, sf):
    a = _rated(spark, sf).select("ticket_id", RATING)
    t = _t(spark, sf).where(F.col("time_to_resolution").isNotNull() & (F.col("ticket_type") == "LARGE"))
    b = t.select(F.col("ticket_id").alias("_id"),
                 F.round(clean.duration_hours("first_response_time", "time_to_resolution"), 6).alias("resolution_duration"))
    j = a.join(b, a.ticket_id == b._id, "full_outer")
    return j.select(F.coalesce("ticket_id", "_id").alias("ticket_id"), RATING, "resolution_duration")


@reg("features_combine", TR(
    "SELECT rated.ticket_id, customer_age, round(resolution_duration, 6) AS resolution_duration, "
    "CAST(coalesce(g.code, -1) AS INT) AS gender_code, CAST(coalesce(e.code, -1) AS INT) AS ticket_type_code FROM rated "
    + _fact_sql("customer_gender", "rated", "g") +
    " LEFT JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM "
    "(SELECT DISTINCT ticket_type AS v FROM tickets WHERE ticket_type IS NOT NULL)) e ON e.v = rated.ticket_type"))
def features_combine(spark, sf):
    r = _rated(spark, sf)
    nontext = encode.factorize(r.select("ticket_id", "customer_age", "resolution_duration", "customer_gender"),
                               "customer_gender", "ticket_id", "gender_code")
    t = _t(spark, sf).select("ticket_id", "ticket_type")
    codes = encode.apply_codes(r.select("ticket_id", "ticket_type"), encode.fit_label_encoder(t, "ticket_type", "ticket_type_code"),
                               "ticket_type", "ticket_type_code")
    return nontext.join(codes, "ticket_id").select(
        "ticket_id", "customer_age", F.round("resolution_duration", 6).alias("resolution_duration"), "gender_code",
        "ticket_type_code")


# ---- H, K on tickets ------------------------------------------------------------------------------

@reg("distinct_classes", T(f"SELECT DISTINCT {RATING} FROM tickets WHERE {RATING} IS NOT NULL"))
def distinct_classes(spark, sf):
    return setops.distinct_values(_t(spark, sf), RATING)


STAND_IN = f"CAST(1 + ticket_id % 5 AS DOUBLE)"


def _pred(spark, sf):
    return _rated(spark, sf).select("ticket_id", F.col(RATING).alias("y"), (1 + F.col("ticket_id") % 5).cast("double").alias("p"))


PRED_SQL = f", pr AS (SELECT ticket_id, {RATING} AS y, {STAND_IN} AS p FROM rated)"


@reg("accuracy", TR(PRED_SQL + " SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS accuracy FROM pr"))
def accuracy(spark, sf):
    return metrics.accuracy(_pred(spark, sf), "y", "p").select(F.col("accuracy").cast("double"))


@reg("confusion", TR(PRED_SQL + " SELECT y AS actual, " + ", ".join(
    f"count(*) FILTER (WHERE p = {v}) AS p_{int(v)}" for v in RATINGS) + " FROM pr GROUP BY y"))
def confusion(spark, sf):
    return metrics.confusion_matrix(_pred(spark, sf), "y", "p", RATINGS)


def _report_sql():
    return PRED_SQL + """
, labs AS (SELECT y AS label FROM pr UNION SELECT p FROM pr),
pc AS (SELECT l.label,
          CAST((SELECT count(*) FROM pr WHERE y = l.label AND p = l.label) AS DOUBLE) AS tp,
          CAST((SELECT count(*) FROM pr WHERE y = l.label) AS DOUBLE) AS support,
          CAST((SELECT count(*) FROM pr WHERE p = l.label) AS DOUBLE) AS predicted FROM labs l),
prf AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM pc),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM prf)
"""


@reg("classification_report", TR(_report_sql() + """
SELECT CAST(label AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f"""))
def classification_report(spark, sf):
    return metrics.classification_report(_pred(spark, sf), "y", "p")


@reg("weighted_f1", TR(_report_sql() + " SELECT round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f"))
def weighted_f1(spark, sf):
    return metrics.weighted_f1(_pred(spark, sf), "y", "p")


@reg("mcc_multiclass", TR(_report_sql() + """
, t AS (SELECT sum(tp) AS c, sum(support) AS s, sum(predicted * support) AS pt, sum(predicted * predicted) AS pp,
               sum(support * support) AS tt FROM f)
SELECT round(CASE WHEN (s * s - pp) * (s * s - tt) = 0 THEN 0 ELSE (c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) END, 6) AS mcc FROM t"""))
def mcc_multiclass(spark, sf):
    return metrics.mcc_multiclass(_pred(spark, sf), "y", "p")


@reg("class_weights", TR(f"SELECT {RATING}, count(*) AS n_c, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight "
                         f"FROM rated GROUP BY 1"))
def class_weights(spark, sf):
    return sampling.class_weights(_rated(spark, sf), RATING).select(RATING, "n_c", "weight")
