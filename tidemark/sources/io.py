"""File sources and sinks.

CSV is always read with a declared schema (no inference pass over the data);
outputs are partitioned by their natural keys so later reads prune directories.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ensure_checkpoint_dir

TICKET_SCHEMA = T.StructType([
    T.StructField("ticket_id", T.LongType()),
    T.StructField("customer_age", T.IntegerType()),
    T.StructField("customer_gender", T.StringType()),
    T.StructField("product_purchased", T.StringType()),
    T.StructField("date_of_purchase", T.DateType()),
    T.StructField("ticket_type", T.StringType()),
    T.StructField("ticket_subject", T.StringType()),
    T.StructField("ticket_description", T.StringType()),
    T.StructField("ticket_status", T.StringType()),
    T.StructField("resolution", T.StringType()),
    T.StructField("ticket_priority", T.StringType()),
    T.StructField("ticket_channel", T.StringType()),
    T.StructField("first_response_time", T.TimestampNTZType()),
    T.StructField("time_to_resolution", T.TimestampNTZType()),
    T.StructField("customer_satisfaction_rating", T.DoubleType()),
])

PRICE_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
])

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "dateFormat": "yyyy-MM-dd"}


# Price rows hold no line breaks, so their files can be split among tasks.
PRICE_OPTIONS = {**CSV_OPTIONS, "multiLine": "false"}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a machine-local tmp)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tidemark-io", f"{name}-{uuid.uuid4().hex[:12]}")


# ---- A1 / A2: CSV ---------------------------------------------------------------------------

def read_csv(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.{csv,csv.gz}") -> DataFrame:
    """Every ``*.csv`` or ``*.csv.gz`` under ``path`` (not just the first found), header row,
    quoted multi-line text, all columns nullable."""
    return (spark.read.schema(schema).options(**CSV_OPTIONS).option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").csv(path))


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "none") -> str:
    """With ``compression`` "gzip" the files are ``*.csv.gz``; multi-line CSV is read a file a task in either case."""
    w = df.write.mode("overwrite").options(**CSV_OPTIONS).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


# ---- A3: split corpora --------------------------------------------------------------------------

SPLIT_ALIASES = {"validation": "valid"}  # fixed value: hub split name normalisation


def write_split_corpus(df: DataFrame, path: str) -> str:
    """Corpus rows with ``dataset`` and ``split`` columns as Parquet partitions."""
    df.write.mode("overwrite").partitionBy("dataset", "split").parquet(path)
    return path


def read_split_corpus(spark: SparkSession, path: str, datasets: Sequence[str] | None = None,
                      splits: Sequence[str] | None = None) -> DataFrame:
    """All (or the named) corpora and splits in one DataFrame; ``validation`` is
    read as ``valid``. Filters on the partition columns prune directories."""
    df = spark.read.parquet(path)
    split = F.col("split")
    for src, dst in SPLIT_ALIASES.items():
        split = F.when(F.col("split") == src, F.lit(dst)).otherwise(split)
    if datasets:
        df = df.where(F.col("dataset").isin(list(datasets)))
    df = df.withColumn("split", split)
    if splits:
        df = df.where(F.col("split").isin(list(splits)))
    return df


# ---- A4-A7: price files ---------------------------------------------------------------------------

def normalize_prices(df: DataFrame, ticker: str | None = None, date_col: str = "date") -> DataFrame:
    """Date as ``yyyy-MM-dd`` text, ticker column added (literal) or kept (A4)."""
    cols = [F.date_format(F.col(date_col), "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", "volume"]
    tick = F.lit(ticker).alias("ticker") if ticker is not None else F.col("ticker")
    return df.select(*cols, tick)


def price_range(df: DataFrame, start: str, end: str, date_col: str = "date") -> DataFrame:
    """Half-open ``[start, end)`` on the date (A5); pushed into the scan."""
    d = F.col(date_col).cast("date")
    return df.where((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date")))


def save_prices(df: DataFrame, out_dir: str, run_date: str) -> str | None:
    """CSV with header under ``out_dir/ticker=<t>/run_date=<yyyymmdd>/`` (A6);
    an empty input writes nothing and returns None. A save replaces only the
    (ticker, run_date) folders it has rows for; other tickers and run dates stay."""
    if df.isEmpty():
        return None
    (df.withColumn("run_date", F.lit(run_date.replace("-", "")))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**PRICE_OPTIONS)
     .partitionBy("ticker", "run_date").csv(out_dir))
    return out_dir


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(PRICE_SCHEMA.fields + [T.StructField("ticker", T.StringType()),
                                                 T.StructField("run_date", T.StringType())])
    return spark.read.schema(schema).options(**PRICE_OPTIONS).csv(path)


def ingest_prices(spark: SparkSession, src: DataFrame, tickers: Sequence[str] | None, start: str, end: str,
                  out_dir: str | None = None, run_date: str = "2024-01-01") -> tuple[DataFrame, str | None]:
    """Normalise + range-filter many tickers in one job, optionally save.
    Returns ``(prices, path or None)``."""
    df = price_range(src, start, end)
    if tickers:
        df = df.where(F.col("ticker").isin(list(tickers)))
    df = normalize_prices(df)
    path = save_prices(df, out_dir, run_date) if out_dir else None
    return df, path


# ---- A9: model persistence --------------------------------------------------------------------------

def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
