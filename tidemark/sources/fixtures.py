"""Fixture views over the driver tables (the data the reference's workloads read).

``tickets``  support tickets (W3/W4) built from orders, customer, part, documents, lineitem
``prices``   daily OHLCV series per ticker (W1/W2) aggregated from orders
``news``     labelled texts with a train/valid/test split (W5)
``vectors``  64-d embeddings with a 10-class label, binary ``gold`` and a split

Each view is a lazy DataFrame; Catalyst prunes columns and pushes filters into
the scans of whatever a query finally uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

# Fixed values of the fixture definitions (must equal the SQL views in FIXTURES.md).
# A ticket takes part o_orderkey % (#parts) and document o_orderkey % (#documents):
# keys are dense from 0, so every order keeps its row and every part and document
# is used; the ticket description is the document's whole text.
AGE_BASE, AGE_MOD = 18, 53
RATING_MOD = 5
SPLIT_MOD = 10        # doc_id % 10: < 7 train, = 7 valid, else test


def _split(key: str):
    m = F.col(key) % SPLIT_MOD
    return F.when(m < 7, "train").when(m == 7, "valid").otherwise("test")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_name")
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    # Table sizes as uncorrelated scalar subqueries (one small aggregate each, planned
    # lazily with the query). The dimension joins are plain equi-joins: Spark broadcasts
    # a side only when its measured size is under the broadcast threshold, else it
    # shuffles both sides on the key.
    n_part = p.select(F.count(F.lit(1))).scalar()
    n_doc = d.select(F.count(F.lit(1))).scalar()
    # First ship date per order: partial aggregation before the shuffle on l_orderkey.
    ship = (table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate")
            .groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship")))
    filled = F.col("o_orderstatus") == "F"
    return (
        o.join(ship, o.o_orderkey == ship.l_orderkey, "left")
        .join(c, o.o_custkey == c.c_custkey)
        .withColumn("_part", F.col("o_orderkey") % n_part)
        .withColumn("_doc", F.col("o_orderkey") % n_doc)
        .join(p, F.col("_part") == p.p_partkey)
        .join(d, F.col("_doc") == d.doc_id)
        .select(
            F.col("o_orderkey").alias("ticket_id"),
            (F.lit(AGE_BASE) + F.col("c_custkey") % AGE_MOD).cast("int").alias("customer_age"),
            F.col("c_mktsegment").alias("customer_gender"),
            F.col("p_brand").alias("product_purchased"),
            F.col("o_orderdate").cast("date").alias("date_of_purchase"),
            F.col("p_type").alias("ticket_type"),
            F.col("source").alias("ticket_subject"),
            F.col("text").alias("ticket_description"),
            F.col("o_orderstatus").alias("ticket_status"),
            F.when(filled, F.col("p_name")).alias("resolution"),
            F.col("o_orderpriority").alias("ticket_priority"),
            F.col("lang").alias("ticket_channel"),
            F.col("o_orderdate").alias("first_response_time"),
            F.col("ship").alias("time_to_resolution"),
            F.when(filled, (F.lit(1) + F.col("o_custkey") % RATING_MOD).cast("double"))
            .alias("customer_satisfaction_rating"),
        )
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return (
        o.groupBy(F.col("o_orderstatus").alias("ticker"), F.col("o_orderdate").cast("date").alias("date"))
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    lab = table(spark, sf_dir, "labels", "doc_id", "quality")
    return d.join(lab, "doc_id").select("doc_id", F.col("quality").alias("gold"), "text", _split("doc_id").alias("split"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select("vec_id", "embedding", "label",
                    F.when(F.col("label") < 3, 1).otherwise(0).alias("gold"), _split("vec_id").alias("split"))
