"""Incremental price ingest with Structured Streaming (W1 on landed files).

Price files land as CSV in a folder (one per ticker and day, header row).
``start_price_ingest`` picks up every new file, normalises it (A4), keeps the
requested date range (A5) and appends it to a Parquet table partitioned by
ticker (A6). Progress is kept in a checkpoint under the shared checkpoint
folder, so a restarted job (or lost executor) resumes without re-reading or
duplicating files. ``availableNow`` processes what has landed and stops, which
suits a scheduled batch; ``processingTime`` keeps it running.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.io import CSV_OPTIONS

LANDED_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("ticker", T.StringType()),
])


def landed_prices(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = (spark.readStream.schema(LANDED_SCHEMA).options(**CSV_OPTIONS).option("pathGlobFilter", "*.csv")
              .option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(landing_dir)


def normalised(stream: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    out = stream.where(F.col("date").isNotNull() & F.col("ticker").isNotNull())
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("date") < F.lit(end).cast("date"))
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", "volume",
                      "ticker")


def start_price_ingest(spark: SparkSession, landing_dir: str, out_dir: str, start: str | None = None,
                       end: str | None = None, checkpoint: str | None = None, once: bool = True,
                       interval: str = "1 minute") -> StreamingQuery:
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "tidemark-stream", "price-ingest")
    w = (normalised(landed_prices(spark, landing_dir), start, end).writeStream
         .format("parquet").option("path", out_dir).option("checkpointLocation", ckpt)
         .partitionBy("ticker").outputMode("append"))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)
    return w.start()
