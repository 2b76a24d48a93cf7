import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame
from tidemark.llm import sharding


def _check(rows, limit):
    """Shards are prefixes of the hash, disjoint, within the limit unless a single larger row, and not split needlessly."""
    pages = {}
    for r in rows:
        h = int(hashlib.md5(("" if r.k is None else str(r.k)).encode()).hexdigest()[:15], 16)
        bits = f"{h:060b}"
        assert bits.startswith(r.shard)
        pages.setdefault((r.shard, r.page), []).append((bits, r.b or 0))
    shards = {s for s, _ in pages}
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    for (s, _), v in pages.items():
        assert sum(x for _, x in v) <= limit or len(v) == 1
    for s in shards:  # the parent was too large
        if s:
            assert sum((r.b or 0) for r in rows if f"{int(hashlib.md5(('' if r.k is None else str(r.k)).encode()).hexdigest()[:15], 16):060b}".startswith(s[:-1])) > limit


@pytest.mark.parametrize("limit", [1, 50, 400, 10**9])
def test_limits(spark, limit):
    df = frame(spark, [(i, i % 37 + 1) for i in range(400)], "k bigint, b int")
    rows = sharding.assign_shards(df, "k", F.col("b"), limit).collect()
    assert len(rows) == 400
    _check(rows, limit)


def test_repeated_and_null_keys_are_paged(spark):
    df = frame(spark, [(7, 10)] * 30 + [(None, 10)] * 9 + [(i, None) for i in range(5)] + [(3, 500)], "k bigint, b int")
    rows = sharding.assign_shards(df, "k", F.col("b"), 40).collect()
    assert len(rows) == 45
    _check(rows, 40)
    assert sum(r.oversized for r in rows) == 1
    assert len({(r.shard, r.page) for r in rows if r.k == 7}) == 8


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "k bigint, b int, shard string, page int")
    assert sharding.assign_shards(df, "k", F.col("b"), 10).collect() == []
    one = frame(spark, [(1, 5, "x", 9)], "k bigint, b int, shard string, page int")
    assert [(r.shard, r.page) for r in sharding.assign_shards(one, "k", F.col("b"), 10).collect()] == [("", 0)]


def test_names_used_inside_and_one_scan(spark):
    names = ["_h", "_b", "_c0", "_d0", "_depth", "_g", "_per", "_rn", "_row"]
    df = frame(spark, [(i % 40, 7) for i in range(100)], "k bigint, b int").select("k", "b", *[F.lit(c).alias(c) for c in names])
    rows = sharding.assign_shards(df, "k", F.col("b"), 20).collect()
    assert len(rows) == 100 and all(r[c] == c for r in rows for c in names)
    _check(rows, 20)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    src = spark.range(500).selectExpr("id AS k", "10 AS b").mapInArrow(counted, "k bigint, b int")
    sharding.assign_shards(src, "k", F.col("b"), 100).collect()
    assert seen.value <= 2 * 500  # once for the sizes, once for the result
