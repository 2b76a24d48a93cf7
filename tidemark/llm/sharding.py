"""Extendible hashing of rows to byte-limited shards, with DataFrame functions only.

Every row gets 60 hash bits of its key. The directory maps hash prefixes to shards; a bucket whose bytes exceed
the limit splits on one more bit, all others stay, so a shard is the shortest prefix whose rows fit the limit.
The splits are decided on a histogram of bytes by fine prefixes (one small aggregate), not by moving rows bit by
bit; only cells that are still too large at the histogram's depth are counted again, some bits deeper.

Rows with all bits equal (one key repeated) cannot be split by hashing: their bucket is chained into pages of
``limit // largest row`` rows each. A row larger than the limit has a shard of its own and is marked ``oversized``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small
from tidemark.operators.ordering import ordered_index

BITS = 60
STEP = 8


def hash_bits(key: Column) -> Column:
    """60 bits of md5 of the key's text ('' for null) as a non-negative bigint."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def _prefix(h: Column, depth) -> Column:
    return F.shiftright(h, BITS - depth) if depth else F.lit(0).cast("bigint")


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth): the shortest prefix of low..high bits under which the bytes fit; null depth if none does."""
    out = cells.select("cell", "b")
    depth = F.lit(None).cast("int")
    for d in range(low, high + 1):
        at = F.shiftright("cell", high - d)
        sums = cells.groupBy(at.alias(f"p{d}")).agg(F.sum("b").alias(f"s{d}")) if d < high else None
        if sums is None:
            out = out.withColumn(f"s{d}", F.col("b"))
        else:
            out = out.join(sums, at == F.col(f"p{d}")).drop(f"p{d}")
    for d in range(high, low - 1, -1):
        depth = F.when(F.col(f"s{d}") <= limit, F.lit(d)).otherwise(depth)
    return out.select("cell", depth.cast("int").alias("depth"))


def assign_shards(df: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """Add ``shard`` (prefix bits as text, '' when one shard holds all), ``page`` and ``oversized`` to every row.

    ``size`` gives a row's bytes (null counts 0). Every shard page holds at most ``limit`` bytes unless it is a
    single larger row. Null keys share one hash; an empty table gives an empty result. Added columns replace
    columns of the same names in ``df``.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "page", "oversized")]
    # the given columns travel as one struct, so that none of their names meets one of the names used here
    rows = df.select(F.struct(*names).alias("_row"), hash_bits(F.col(key)).alias("_h"), F.coalesce(size, F.lit(0)).cast("bigint").alias("_b"))
    sizes = rows.select("_h", "_b").checkpoint()  # the splits are decided on these narrow rows; sizes are measured once
    total = sizes.agg(F.sum("_b")).first()[0] or 0
    high = min(BITS, max(4, math.ceil(math.log2(max(total / limit, 1))) + 4))
    low, base, directory = 0, sizes, []
    while True:
        cells = base.groupBy(_prefix(F.col("_h"), high).alias("cell")).agg(F.sum("_b").alias("b")).checkpoint()
        leaves = _leaves(cells, low, high, limit).checkpoint()
        n, deeper = leaves.agg(F.count("*"), F.count(F.when(F.col("depth").isNull(), 1))).first()
        directory.append((high, leaves, n))
        if not deeper or high == BITS:
            break
        over = leaves.filter("depth is null").select(F.col("cell").alias("_c"))
        base = base.join(small(over, deeper), _prefix(F.col("_h"), high) == F.col("_c"), "left_semi")
        low, high = high + 1, min(BITS, high + STEP)
    out, depth = rows, F.lit(None).cast("int")
    for k, (bits, leaves, n) in enumerate(directory):
        side = leaves.select(F.col("cell").alias(f"_c{k}"), F.col("depth").alias(f"_d{k}"))
        out = out.join(small(side, n), _prefix(F.col("_h"), bits) == F.col(f"_c{k}"), "left")
        depth = F.coalesce(depth, F.col(f"_d{k}"))
    out = out.select("_row", "_h", "_b", depth.alias("_depth"))
    d = F.coalesce(F.col("_depth"), F.lit(BITS))
    shard = F.when(d == 0, "").otherwise(F.substring(F.lpad(F.bin("_h"), BITS, "0"), F.lit(1), d))
    if deeper:
        chained = out.filter("_depth is null")
        per = chained.groupBy(F.col("_h").alias("_g")).agg(F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.max("_b"), F.lit(1)))).alias("_per"))
        paged = ordered_index(chained, "_h", ["_b"], "_rn").join(per, F.col("_h") == F.col("_g"))
        paged = paged.withColumn("page", F.floor((F.col("_rn") - 1) / F.col("_per")).cast("int")).drop("_rn", "_g", "_per")
        out = out.filter("_depth is not null").withColumn("page", F.lit(0)).unionByName(paged)
    else:
        out = out.withColumn("page", F.lit(0))
    return out.select("_row.*", shard.alias("shard"), "page", (F.col("_b") > limit).alias("oversized"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write assigned rows as Parquet, one folder per shard and page."""
    df.repartition("shard", "page").write.partitionBy("shard", "page").mode("overwrite").parquet(path)


SHARD_BYTES = 512 * 1024


def op8_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").alias("n_bytes"))
    return assign_shards(docs, "doc_id", F.col("n_bytes"), SHARD_BYTES)


_DEPTHS = 24
SQL = f"""
WITH r AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT *, {', '.join(f"sum(coalesce(n_bytes, 0)) OVER (PARTITION BY h >> {BITS - d}) AS s{d}" for d in range(_DEPTHS + 1))} FROM r),
t AS (SELECT *, CASE {' '.join(f'WHEN s{d} <= {SHARD_BYTES} THEN {d}' for d in range(_DEPTHS + 1))} END AS depth FROM s)
SELECT doc_id, n_bytes::INT AS n_bytes, substr(lpad(bin(h), {BITS}, '0'), 1, depth) AS shard, 0 AS page,
       coalesce(n_bytes, 0) > {SHARD_BYTES} AS oversized FROM t"""
