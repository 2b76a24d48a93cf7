"""The streaming ingest reads each landed file exactly once across restarts."""

import os
import tempfile

from tidemark.sources import fixtures
from tidemark.streaming.ingest import start_price_ingest
from tests.conftest import SF_SMALL


def test_price_ingest_incremental(spark):
    base = tempfile.mkdtemp(prefix="tidemark-stream-", dir="/tmp")
    landing, out, ckpt = (os.path.join(base, x) for x in ("landing", "out", "ckpt"))
    # landed layout: date first, ticker last (the crawler's column order)
    prices = fixtures.prices(spark, SF_SMALL).select("date", "open", "high", "low", "close", "volume", "ticker").cache()
    first = prices.where("ticker = 'F'")
    first.coalesce(1).write.options(header="true").csv(os.path.join(landing, "f"))
    q = start_price_ingest(spark, landing, out, checkpoint=ckpt)
    q.awaitTermination()
    n1 = spark.read.parquet(out).count()
    assert n1 == first.count()
    prices.where("ticker = 'O'").coalesce(1).write.options(header="true").csv(os.path.join(landing, "o"))
    q = start_price_ingest(spark, landing, out, checkpoint=ckpt)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == n1 + prices.where("ticker = 'O'").count()
