from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import frame
from tidemark.llm import mixing


def test_raked_weights_meet_targets(spark):
    rows = [(i, f"s{i % 5 if i % 3 else 0}", "ab"[i % 2], "xy"[(i // 7) % 2], 1 + i % 11) for i in range(600)]
    df = frame(spark, rows, "doc_id bigint, source string, lang string, topic string, n bigint")
    out = mixing.mix(df, ["source", "lang", "topic"], "n", rounds=40).collect()
    assert len(out) == 600 and max(r.probability for r in out) == 1.0
    kept = Counter()
    for r in out:
        kept["all"] += r.probability * r.n
        kept[r.source] += r.probability * r.n
    total = Counter()
    for r in out:
        total[r.source] += r.n
    goal = {s: t ** 0.85 for s, t in total.items()}
    for s in goal:
        assert abs(kept[s] / kept["all"] - goal[s] / sum(goal.values())) < 1e-6


def test_nulls_empty_rows_and_repeats(spark):
    rows = [(1, None, "a", "x", 5), (1, None, "a", "x", 5), (None, "s", None, "y", 3), (2, "s", "a", "x", 0), (3, "s", "a", None, None)]
    df = frame(spark, rows, "doc_id bigint, source string, lang string, topic string, n bigint").withColumn("weight", F.lit("mine"))
    out = mixing.mix(df, ["source", "lang", "topic"], "n").collect()
    assert len(out) == 5
    assert len({(r.probability, r.sampled) for r in out if r.doc_id == 1}) == 1
    assert all(r.sampled and r.probability == 1.0 for r in out if r.doc_id in (2, 3))
    assert mixing.mix(df.limit(0), ["source", "lang", "topic"], "n").collect() == []


def test_tokens_and_topics(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t\n",), ("a b\x0bc ",), ("| a | b |",), ("x" * 500,)], "t string")
    got = [tuple(r) for r in df.select(mixing.n_tokens(F.col("t")), mixing.form_topic(F.col("t"))).collect()]
    assert got == [(0, "list"), (0, "list"), (0, "list"), (3, "list"), (5, "table"), (1, "prose")]


def test_clashing_names(spark):
    names = ["_w", "_p", "_v_lang", "_g_lang", "_row", "tokens"]
    df = frame(spark, [(i, "s", "ab"[i % 2], 3 + i) for i in range(20)], "doc_id bigint, source string, lang string, n bigint").select("*", *[F.lit(c).alias(c) for c in names])
    rows = mixing.mix(df, ["source", "lang"], "n", temper={"source": 1.0, "lang": 1.0}).collect()
    assert len(rows) == 20 and all(r[c] == c for r in rows for c in names)
