"""Sources and sinks round trips (A1-A3, A6, A7): write with Spark, read back with a
declared schema, compare with the view the files were written from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources import fixtures, io
from tidemark.sources.fixture_sql import with_views
from tidemark.sources.tables import table

Q = {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


@reg("scan_csv_roundtrip", with_views("SELECT * FROM tickets", "tickets"))
def scan_csv_roundtrip(spark, sf):
    path = io.scratch_path(spark, "tickets-csv")
    io.write_csv(fixtures.tickets(spark, sf), path, compression="gzip")
    return io.read_csv(spark, path, io.TICKET_SCHEMA)


@reg("scan_split_corpus", with_views("""
SELECT d.lang AS dataset, n.split, n.doc_id, n.gold AS label, n.text
FROM news n JOIN documents d ON d.doc_id = n.doc_id""", "news"))
def scan_split_corpus(spark, sf):
    news = fixtures.news(spark, sf)
    lang = table(spark, sf, "documents", "doc_id", "lang")
    corpus = news.join(lang, "doc_id").select(
        F.col("lang").alias("dataset"),
        # one corpus names its middle split "validation" on the hub
        F.when((F.col("lang") == "en") & (F.col("split") == "valid"), "validation").otherwise(F.col("split")).alias("split"),
        "doc_id", F.col("gold").alias("label"), "text")
    path = io.scratch_path(spark, "corpus")
    io.write_split_corpus(corpus, path)
    return io.read_split_corpus(spark, path).select("dataset", "split", "doc_id", "label", "text")


PRICE_COLS = "strftime(date, '%Y-%m-%d') AS date, open, high, low, close, volume, ticker, '20240101' AS run_date"


@reg("sink_price_csv", with_views(f"SELECT {PRICE_COLS} FROM prices", "prices"))
def sink_price_csv(spark, sf):
    path = io.scratch_path(spark, "prices-csv")
    io.save_prices(io.normalize_prices(fixtures.prices(spark, sf)), path, "2024-01-01")
    return io.read_prices(spark, path)


@reg("ingest_prices", with_views(f"SELECT {PRICE_COLS} FROM prices WHERE date >= DATE '1995-06-01' AND date < DATE '1998-01-01'",
                                 "prices"))
def ingest_prices(spark, sf):
    path = io.scratch_path(spark, "ingest")
    _df, out = io.ingest_prices(spark, fixtures.prices(spark, sf), None, "1995-06-01", "1998-01-01", path, "2024-01-01")
    return io.read_prices(spark, out)


@reg("ingest_two_runs", with_views(
    PRICE_COLS.join(["SELECT ", " FROM prices WHERE date >= DATE '1995-06-01' AND date < DATE '1996-01-01' UNION ALL SELECT "])
    + PRICE_COLS.replace("20240101", "20240102").join(["", " FROM prices WHERE date >= DATE '1996-01-01' AND date < DATE '1996-06-01'"]), "prices"))
def ingest_two_runs(spark, sf):
    """Two runs into one folder, the second one twice; both are read back."""
    path, prices = io.scratch_path(spark, "ingest"), fixtures.prices(spark, sf)
    io.ingest_prices(spark, prices, None, "1995-06-01", "1996-01-01", path, "2024-01-01")
    for _ in range(2):
        io.ingest_prices(spark, prices, None, "1996-01-01", "1996-06-01", path, "2024-01-02")
    return io.read_prices(spark, path)
