"""Price workload (W1 ingest + W2 forecasting preparation and scoring): queries and SQL.

The forecasting queries use deterministic stand-in predictors (previous value,
moving average) so that every step of the series path is checked exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import encode, metrics, profile, sampling, series, setops
from tidemark.sources import fixtures, io
from tidemark.sources.fixture_sql import with_views

Q = {}

K = 15  # look-back used by the window queries


def reg(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


def P(sql):
    return with_views(sql, "prices")


def _p(spark, sf):
    return fixtures.prices(spark, sf)


def _split(spark, sf):
    return series.chrono_split(_p(spark, sf), "ticker", "date", 0.8)


def _split3(spark, sf):
    return series.chrono_split3(_p(spark, sf), "ticker", "date", 0.8, 0.2)


CS = ("WITH cs AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos, "
      "count(*) OVER (PARTITION BY ticker) AS n FROM prices),\n"
      "sp AS (SELECT *, CASE WHEN pos <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS segment FROM cs)\n")
CS3 = ("WITH cs AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos, "
       "count(*) OVER (PARTITION BY ticker) AS n FROM prices),\n"
       "sp3 AS (SELECT *, CASE WHEN pos <= floor(floor(n * CAST(0.8 AS DOUBLE)) * CAST(0.8 AS DOUBLE)) THEN 'fit' "
       "WHEN pos <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'val' ELSE 'test' END AS segment FROM cs)\n")
# min-max fitted on the train segment, applied to the whole series
SCALED = (", mm AS (SELECT ticker, min(close) AS lo, max(close) AS hi FROM sp WHERE segment = 'train' GROUP BY ticker),\n"
          "sc AS (SELECT sp.*, CASE WHEN hi = lo THEN 0.0 ELSE (close - lo) / (hi - lo) END AS scaled, lo, hi "
          "FROM sp JOIN mm USING (ticker))\n")


def _scaled(spark, sf):
    sp = _split(spark, sf)
    fitted = encode.fit_minmax(sp.where(F.col("segment") == "train"), "close", ["ticker"])
    return encode.apply_minmax(sp, fitted, "close", "scaled", ["ticker"])


# ---- A: ingest ------------------------------------------------------------------------------------

@reg("price_normalize", P("SELECT strftime(date, '%Y-%m-%d') AS date, open, high, low, close, volume, ticker FROM prices"))
def price_normalize(spark, sf):
    return io.normalize_prices(_p(spark, sf))


@reg("price_range_scan", P("SELECT * FROM prices WHERE date >= DATE '1996-01-01' AND date < DATE '1997-01-01'"))
def price_range_scan(spark, sf):
    return io.price_range(_p(spark, sf), "1996-01-01", "1997-01-01")


@reg("price_project", P("SELECT ticker, date, open FROM prices"))
def price_project(spark, sf):
    from tidemark.operators.clean import project_position
    return project_position(_p(spark, sf), 2, keep=["ticker", "date"])


@reg("dataset_summary", P("SELECT count(*) AS n_rows, 7 AS n_cols, min(date) AS min_date, max(date) AS max_date, "
                          "count(DISTINCT ticker) AS n_keys FROM prices"))
def dataset_summary(spark, sf):
    return profile.dataset_summary(_p(spark, sf), "date", "ticker")


# ---- F: splits --------------------------------------------------------------------------------------

@reg("chrono_split", P(CS + "SELECT ticker, date, pos, segment FROM sp"))
def chrono_split(spark, sf):
    return _split(spark, sf).select("ticker", "date", "pos", "segment")


@reg("tail_validation", P("""
SELECT ticker, date, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY date)
       <= floor(count(*) OVER (PARTITION BY ticker) * CAST(0.75 AS DOUBLE)) THEN 'train' ELSE 'val' END AS role FROM prices"""))
def tail_validation(spark, sf):
    """The last quarter of every series validates."""
    return sampling.tail_validation(_p(spark, sf).select("ticker", "date"), "date", 0.25, "ticker").select("ticker", "date", "role")


@reg("chrono_split3", P(CS3 + "SELECT ticker, date, pos, segment FROM sp3"))
def chrono_split3(spark, sf):
    return _split3(spark, sf).select("ticker", "date", "pos", "segment")


@reg("union_segments", P(CS + "SELECT ticker, date, segment FROM sp WHERE segment = 'train' "
                              "UNION ALL SELECT ticker, date, segment FROM sp WHERE segment = 'test'"))
def union_segments(spark, sf):
    sp = _split(spark, sf).select("ticker", "date", "segment")
    return setops.append(sp.where(F.col("segment") == "train"), sp.where(F.col("segment") == "test"))


@reg("minmax_scale", P(CS + SCALED + "SELECT ticker, date, segment, round(scaled, 9) AS scaled FROM sc"))
def minmax_scale(spark, sf):
    return _scaled(spark, sf).select("ticker", "date", "segment", F.round("scaled", 9).alias("scaled"))


@reg("minmax_inverse", P(CS + SCALED + "SELECT ticker, date, round(scaled * (hi - lo) + lo, 4) AS close_back FROM sc"))
def minmax_inverse(spark, sf):
    s = _scaled(spark, sf)
    return s.select("ticker", "date", F.round(encode.inverse_minmax("scaled"), 4).alias("close_back"))


# ---- F: lag windows ---------------------------------------------------------------------------------

def _lag_long(windows, keys):
    return windows.select(*keys, "y", F.posexplode("x").alias("_i", "xv")).select(
        *keys, "y", (F.col("_i") + 1).cast("int").alias("lag_pos"), "xv")


LAG_SQL = ("SELECT {keys}, y, CAST(unnest(generate_series(1, {k})) AS INT) AS lag_pos, unnest(x) AS xv FROM "
           "(SELECT *, close AS y, list(close) OVER (PARTITION BY {part} ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS x "
           "FROM {src}) w WHERE len(x) = {k} {extra}")


@reg("lag_windows", P("SELECT * FROM (" + LAG_SQL.format(keys="ticker, date", k=K, part="ticker", src="prices", extra="") + ")"))
def lag_windows(spark, sf):
    pos = series.positions(_p(spark, sf), "ticker", "date")
    w = series.lag_windows(pos.withColumn("y", F.col("close")), "ticker", "pos", "close", K)
    return _lag_long(w, ["ticker", "date"])


@reg("lag_windows_segmented", P(CS3 + LAG_SQL.format(keys="ticker, segment, date", k=K, part="ticker, segment",
                                                     src="sp3", extra="")))
def lag_windows_segmented(spark, sf):
    pos = series.segment_positions(_split3(spark, sf), "ticker", "pos", "segment", "spos").drop("pos")
    w = series.lag_windows(pos.withColumn("y", F.col("close")), ["ticker", "segment"], "spos", "close", K)
    return _lag_long(w, ["ticker", "segment", "date"])


@reg("lag_windows_test", P(CS + LAG_SQL.format(keys="ticker, date", k=K, part="ticker", src="sp", extra="AND segment = 'test'")))
def lag_windows_test(spark, sf):
    sp = _split(spark, sf)
    w = series.lag_windows(sp.withColumn("y", F.col("close")), "ticker", "pos", "close", K)
    return _lag_long(w.where(F.col("segment") == "test"), ["ticker", "date"])


# ---- F6: lag-length sweep with a moving-average predictor on scaled values --------------------------

def _lag_metrics(spark, sf):
    s = _scaled(spark, sf)
    # the train segment is the prefix of each series, so its series positions are kept
    tr = s.where(F.col("segment") == "train").drop("segment").withColumnRenamed("pos", "_p")
    fv = series.split_by_position(tr, "ticker", "_p", 0.8, out="seg", labels=("fit", "val"), seg_pos="spos")
    spos = fv.drop("_p")
    ks = list(series.LAG_GRID)
    ma = series.moving_avgs(spos, ["ticker", "seg"], "spos", "scaled", ks, prefix="ma_")
    aggs = []
    for k in ks:
        err2 = (F.col("scaled") - F.col(f"ma_{k}")) * (F.col("scaled") - F.col(f"ma_{k}"))
        aggs += [F.count(F.col(f"ma_{k}")).alias(f"n_{k}"),
                 F.avg(F.when(F.col("seg") == "fit", err2)).alias(f"fit_{k}"),
                 F.avg(F.when(F.col("seg") == "val", err2)).alias(f"val_{k}")]
    per = ma.groupBy("ticker").agg(*aggs)
    # unpivot the k columns; a (ticker, k) with no complete window has no row
    long = per.select("ticker", F.inline(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"n_{k}").alias("n"), F.col(f"fit_{k}").alias("fit_mse"),
                 F.col(f"val_{k}").alias("val_mse")) for k in ks])))
    return long.where(F.col("n") > 0).drop("n")


def _lag_metrics_sql():
    parts = []
    for k in series.LAG_GRID:
        parts.append(
            f"SELECT ticker, {k} AS k, avg(CASE WHEN seg = 'fit' THEN (scaled - ma) * (scaled - ma) END) AS fit_mse, "
            f"avg(CASE WHEN seg = 'val' THEN (scaled - ma) * (scaled - ma) END) AS val_mse FROM "
            f"(SELECT *, avg(scaled) OVER (PARTITION BY ticker, seg ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS ma, "
            f"count(scaled) OVER (PARTITION BY ticker, seg ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS c FROM fv) "
            f"WHERE c = {k} GROUP BY ticker")
    return (CS + SCALED + ", tr AS (SELECT * FROM sc WHERE segment = 'train'),\n"
            "fv AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY date) <= "
            "floor(count(*) OVER (PARTITION BY ticker) * CAST(0.8 AS DOUBLE)) THEN 'fit' ELSE 'val' END AS seg FROM tr),\n"
            "lm AS (" + " UNION ALL ".join(parts) + ")\n")


@reg("lag_metrics", P(_lag_metrics_sql() + "SELECT ticker, CAST(k AS INT) AS k, round(fit_mse, 9) AS fit_mse, "
                                            "round(val_mse, 9) AS val_mse FROM lm"))
def lag_metrics(spark, sf):
    m = _lag_metrics(spark, sf)
    return m.select("ticker", F.col("k").cast("int").alias("k"), F.round("fit_mse", 9).alias("fit_mse"),
                    F.round("val_mse", 9).alias("val_mse"))


@reg("lag_select", P(_lag_metrics_sql() + "SELECT ticker, CAST(k AS INT) AS best_k, round(val_mse, 9) AS val_mse FROM "
                                          "(SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY val_mse, k) AS r FROM lm "
                                          "WHERE val_mse IS NOT NULL) WHERE r = 1"))
def lag_select(spark, sf):
    m = _lag_metrics(spark, sf).where(F.col("val_mse").isNotNull())
    best = series.select_lag(m, "ticker", "k", "val_mse")
    return best.select("ticker", F.col("best_k").cast("int").alias("best_k"), F.round("val_mse", 9).alias("val_mse"))


# ---- F8 / F13 / K6 / K7: naive previous-value predictor ------------------------------------------

NAIVE = (", nv AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pred FROM sp),\n"
         "bias AS (SELECT ticker, avg(close - pred) AS bias FROM nv WHERE segment = 'train' AND pred IS NOT NULL GROUP BY ticker)\n")


def _naive(spark, sf):
    sp = _split(spark, sf)
    return series.lag_value(sp, "ticker", "pos", "close", 1, out="pred")


@reg("bias_correct", P(CS + NAIVE + "SELECT ticker, date, segment, close AS actual, pred, round(pred + bias, 6) AS adjusted "
                                    "FROM nv JOIN bias USING (ticker)"))
def bias_correct(spark, sf):
    nv = _naive(spark, sf)
    out = series.bias_correct(nv, "ticker", "close", "pred", "segment", "train")
    return out.select("ticker", "date", "segment", F.col("close").alias("actual"), "pred",
                      F.round("adjusted", 6).alias("adjusted"))


@reg("forecast_series", P(CS + NAIVE + "SELECT ticker, date, segment, close AS actual, pred AS predicted, "
                                       "round(close - pred, 6) AS residual FROM nv"))
def forecast_series(spark, sf):
    nv = _naive(spark, sf)
    return nv.select("ticker", "date", "segment", F.col("close").alias("actual"), F.col("pred").alias("predicted"),
                     F.round(F.col("close") - F.col("pred"), 6).alias("residual"))


@reg("forecast_metrics", P(CS + SCALED + """
, nv AS (SELECT *, lag(scaled) OVER (PARTITION BY ticker ORDER BY date) AS pred FROM sc),
g AS (SELECT ticker, segment, avg(scaled) AS m FROM nv WHERE pred IS NOT NULL GROUP BY 1, 2)
SELECT ticker, segment, count(*) AS n, round(avg((scaled - pred) * (scaled - pred)), 9) AS mse,
       round(CASE WHEN sum((scaled - m) * (scaled - m)) = 0 THEN NULL
             ELSE 1 - sum((scaled - pred) * (scaled - pred)) / sum((scaled - m) * (scaled - m)) END, 9) AS r2
FROM nv JOIN g USING (ticker, segment) WHERE pred IS NOT NULL GROUP BY 1, 2"""))
def forecast_metrics(spark, sf):
    s = _scaled(spark, sf)
    nv = series.lag_value(s, "ticker", "pos", "scaled", 1, out="pred")
    return metrics.regression_metrics(nv, "scaled", "pred", ["ticker", "segment"], digits=9)


@reg("forecast_boundary", P(CS + f"""
, t AS (SELECT * FROM sp WHERE segment = 'test'),
f AS (SELECT ticker, min(date) AS first_test, count(*) AS n_test, min(pos) AS p0 FROM t GROUP BY ticker)
SELECT f.ticker, first_test, CAST(first_test + INTERVAL {K} DAY AS DATE) AS boundary_date, t.date AS kth_date, n_test
FROM f JOIN t ON t.ticker = f.ticker AND t.pos = f.p0 + {K} WHERE n_test > {K}"""))
def forecast_boundary(spark, sf):
    return series.forecast_boundary(_split(spark, sf), "ticker", "date", "segment", "test", K)


EARLY_STOP_SQL = """
, a AS (SELECT ticker, pos AS epoch, close AS metric, close > greatest(coalesce(max(close) OVER (PARTITION BY ticker ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0), -1.0) AS improved FROM cs),
n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY epoch) AS k FROM a),
b AS (SELECT *, k - coalesce(max(CASE WHEN improved THEN k END) OVER (PARTITION BY ticker ORDER BY k
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS streak FROM n),
s AS (SELECT ticker, coalesce(min(CASE WHEN streak >= 5 THEN epoch END), max(epoch)) AS stop_epoch FROM b GROUP BY ticker)
SELECT b.ticker, s.stop_epoch, max(CASE WHEN improved THEN epoch END) AS best_epoch,
       max(CASE WHEN improved THEN metric END) AS best_metric
FROM b JOIN s ON b.ticker = s.ticker WHERE epoch <= stop_epoch GROUP BY b.ticker, s.stop_epoch"""


@reg("early_stop", P(CS + EARLY_STOP_SQL))
def early_stop(spark, sf):
    pos = series.positions(_p(spark, sf), "ticker", "date")
    m = pos.select("ticker", F.col("pos").alias("epoch"), F.col("close").alias("metric"))
    return series.early_stop(m, "ticker", "epoch", "metric", patience=5)


@reg("early_stop_gaps", P(CS + EARLY_STOP_SQL.replace("pos AS epoch", "pos * pos * 10 AS epoch")))
def early_stop_gaps(spark, sf):
    """Epoch numbers far apart: patience counts evaluations, not numbers."""
    pos = series.positions(_p(spark, sf), "ticker", "date")
    m = pos.select("ticker", (F.col("pos") * F.col("pos") * 10).alias("epoch"), F.col("close").alias("metric"))
    return series.early_stop(m, "ticker", "epoch", "metric", patience=5)
