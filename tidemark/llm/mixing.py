"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

1. Tokens are summed per cell (source, language, topic): the only pass over the rows before sampling.
2. Raking scales the cells' weights to the target marginals of source, language and topic in turn, for a fixed
   number of rounds. It runs on the cells (as many as there are value combinations), by grouped sums and joins.
3. A document is kept with probability proportional to its cell's weight per token, scaled so that the largest
   probability is 1: expected kept tokens follow the raked weights exactly, no cell is clipped. The draw is a
   hash of the seed and the id, so it repeats on every run and partitioning.

Targets here are tempered shares: share ** ``temper`` of a value's tokens, normalised (1 keeps the mix as it is,
0 asks for equal parts). Explicit targets can be passed instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small

TEMPER = {"source": 0.85, "lang": 0.85, "topic": 0.85}
ROUNDS = 8
SEED = 17
DRAW = 1 << 52


def n_tokens(text: Column) -> Column:
    """Words of a whole text, cut at 0x20 and 0x09-0x0D; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+"))).cast("bigint")


def form_topic(text: Column) -> Column:
    """Topic by the text's form: table (many |), numeric (many digits), list (short lines) or prose.

    The documents carry no topic column; any other column can be raked in its place.
    """
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    digits = F.length(t) - F.length(F.translate(t, "0123456789", ""))
    pipes = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    lines = 1 + F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return (F.when(20 * pipes > chars, "table").when(50 * digits > chars, "numeric")
            .when(chars < 200 * lines, "list").otherwise("prose"))


def unit_draw(key: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from 52 bits of md5 of the seed and the key ('' for null)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(DRAW))


def tempered_targets(cells: DataFrame, dim: str, temper: float) -> DataFrame:
    """(value, share): token shares of one dimension raised to ``temper`` and normalised."""
    by = cells.groupBy(F.col(dim).alias("v")).agg(F.sum("tokens").cast("double").alias("t"))
    by = by.filter("t > 0").withColumn("p", F.pow("t", F.lit(temper)))
    return by.crossJoin(F.broadcast(by.agg(F.sum("p").alias("all")))).select("v", (F.col("p") / F.col("all")).alias("share"))


def rake(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Add ``weight`` (sums to 1) to the cells with positive ``tokens``, fitted to the targets of each dimension.

    ``targets[d]`` is (v, share). Values without a target get weight 0. Null values are values of their own.
    """
    base = cells.filter("tokens > 0")
    total = base.agg(F.sum("tokens")).first()[0]
    out = base.withColumn("weight", F.col("tokens") / F.lit(float(total or 1)))
    for d in dims:
        goal = targets[d].select(F.col("v").alias(f"_v_{d}"), F.col("share").alias(f"_g_{d}"))
        out = out.join(goal, F.col(d).eqNullSafe(F.col(f"_v_{d}")), "left").drop(f"_v_{d}")
    out = out.checkpoint()
    for k in range(rounds):
        for d in dims:
            now = F.sum("weight").over(Window.partitionBy(d))
            out = out.withColumn("weight", F.coalesce(F.col("weight") * F.col(f"_g_{d}") / F.when(now > 0, now), F.lit(0.0)))
        if k % 4 == 3:
            out = out.checkpoint()
    return out.drop(*[f"_g_{d}" for d in dims])


def mix(df: DataFrame, dims: list[str], tokens: str, key: str = "doc_id", temper: dict[str, float] | None = None,
        targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Add ``probability``, ``sampled`` (the draw is below it) and ``weight`` (the cell's raked share) to every row.

    Rows without tokens carry no weight to rake: probability 1, weight 0. Added names replace columns of ``df``.
    Rows that repeat an id are drawn alike. An empty table gives an empty result.
    """
    names = [c for c in df.columns if c not in ("probability", "sampled", "weight")]
    # the given columns travel as one struct, so that none of their names meets one of the names used here
    rows = df.select(F.struct(*names).alias("_row"))
    own = {c: F.col("_row")[c] for c in names}
    cells = rows.groupBy(*[own[d].alias(d) for d in dims]).agg(F.sum(own[tokens]).cast("bigint").alias("tokens")).checkpoint()
    live = cells.filter("tokens > 0")
    goals = targets or {d: tempered_targets(live, d, (temper or TEMPER)[d]) for d in dims}
    raked = rake(cells, dims, goals, rounds).withColumn("_ratio", F.col("weight") / F.col("tokens"))
    n, top = raked.agg(F.count("*"), F.max("_ratio")).first()
    side = raked.select(*[F.col(d).alias(f"_v_{d}") for d in dims], F.col("weight").alias("_w"),
                        (F.col("_ratio") / F.lit(top or 1.0)).alias("_p"))
    on = None
    for d in dims:
        same = own[d].eqNullSafe(F.col(f"_v_{d}"))
        on = same if on is None else on & same
    weighed = rows.join(small(side, n), on, "left")
    none = F.coalesce(own[tokens], F.lit(0)) <= 0
    p = F.when(none, 1.0).otherwise(F.coalesce(F.col("_p"), F.lit(0.0)))
    return weighed.select("_row.*", F.when(none, 0.0).otherwise(F.coalesce(F.col("_w"), F.lit(0.0))).alias("weight"),
                          p.alias("probability"), (unit_draw(own[key], seed) < p).alias("sampled"))


DIMS = ["source", "lang", "topic"]


def op3_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "source", "lang", form_topic(F.col("text")).alias("topic"), n_tokens(F.col("text")).alias("n_tokens"))
    docs = docs.checkpoint()  # narrow rows; the texts are read once
    out = mix(docs, DIMS, "n_tokens")
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def rake_sql(docs: str = "documents") -> str:
    """Common table expressions d (documents with topic and tokens) and drawn (d with probability and sampled)."""
    n = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    ctes = [f"""m AS (SELECT *, coalesce(text, '') AS t, {n}::BIGINT AS n_tokens FROM {docs})""",
            """f AS (SELECT *, greatest(length(t), 1) AS ch FROM m)""",
            """d AS (SELECT * EXCLUDE (t, ch), CASE WHEN 20 * (length(t) - length(replace(t, '|', ''))) > ch THEN 'table'
 WHEN 50 * (length(t) - length(translate(t, '0123456789', ''))) > ch THEN 'numeric'
 WHEN ch < 200 * (1 + length(t) - length(replace(t, chr(10), ''))) THEN 'list' ELSE 'prose' END AS topic FROM f)""",
            f"""cells AS (SELECT {', '.join(DIMS)}, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"""]
    for x in DIMS:
        ctes.append(f"""goal_{x} AS (SELECT v, pow(t, {TEMPER[x]}) / sum(pow(t, {TEMPER[x]})) OVER () AS share FROM
 (SELECT {x} AS v, sum(tokens)::DOUBLE AS t FROM cells GROUP BY 1))""")
    goals = " ".join(f"JOIN goal_{x} ON {x} IS NOT DISTINCT FROM goal_{x}.v" for x in DIMS)
    ctes.append(f"""r0 AS MATERIALIZED (SELECT cells.*, tokens / sum(tokens) OVER () AS w, {', '.join(f'goal_{x}.share AS g_{x}' for x in DIMS)}
 FROM cells {goals})""")
    k = 0
    for _ in range(ROUNDS):
        for x in DIMS:
            k += 1
            ctes.append(f"r{k} AS MATERIALIZED (SELECT * REPLACE (w * g_{x} / sum(w) OVER (PARTITION BY {x}) AS w) FROM r{k - 1})")
    ctes.append(f"p AS (SELECT {', '.join(DIMS)}, w / tokens / max(w / tokens) OVER () AS pr FROM r{k})")
    same = " AND ".join(f"d.{x} IS NOT DISTINCT FROM p.{x}" for x in DIMS)
    u = f"('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(DRAW)}"
    ctes.append(f"""drawn AS (SELECT d.*, CASE WHEN n_tokens = 0 THEN 1.0 ELSE coalesce(p.pr, 0) END AS probability, {u} AS u
 FROM d LEFT JOIN p ON {same})""")
    return ",\n".join(ctes)


SQL = f"""WITH {rake_sql()}
SELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability, u < probability AS sampled FROM drawn"""
