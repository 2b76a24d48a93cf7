"""Quality rules whose thresholds come from the data: mergeable quantile sketches per language and source.

1. One pass over the texts counts words, symbols, repeated lines and repeated three-word windows.
2. Every rule's metric is summarised by a logarithmic histogram (relative error ``ACCURACY``): (group, rule, bin)
   -> rows. Bins of partial sketches add up, so sketches merge in any order and their size does not grow with the
   rows. Sketches exist per (language, source), per language and over all rows.
3. Fences are q25 - K * IQR and q75 + K * IQR (with a least distance) of the most specific group of at least
   ``MIN_ROWS`` rows; for metrics that are 0 in most documents, where the quartiles say nothing, the upper fence is
   at least the quantile ``TAIL``. A joined filter gives every document its verdict.

Documents that already fail the fixed base rules take no part in the sketches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import A1, A2, A3, mix, small, split_words, texts, with_batches

ACCURACY = 0.01
MIN_ROWS = 200
# rule -> (metric, K times the quartile distance, least distance below q25 (None: no lower fence), least above q75)
RULES = {
    "word_length": ("word_chars / n_words", 6.0, 1.5, 1.5),
    "symbols": ("n_symbols / n_words", 6.0, None, 0.1),
    "dup_lines": ("n_dup_lines / n_lines", 6.0, None, 0.1),
    "repeats": ("n_repeat_words / n_words", 6.0, None, 0.1),
}
TAIL = 0.99
TAIL_RULES = ("dup_lines", "repeats")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_GAMMA = math.log((1 + ACCURACY) / (1 - ACCURACY))
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(_SPACES.encode())] = True


def _repeat_words(h: np.ndarray) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    if len(h) < 4:
        return 0
    w = mix(h[:-2] * A1 + h[1:-1] * A2 + h[2:] * A3)
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h), bool)
    for k in range(3):
        cover[k:k + len(w)] |= twice
    return int(cover.sum())


def count_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the long columns of ``COUNTS`` (whole texts; null counts as empty); keep all other columns but the text.

    ``n_lines`` are the \\n-split lines that hold a word, ``n_dup_lines`` those equal to an earlier line.
    """
    names = [c for c in df.columns if c != text and c not in COUNTS]
    schema = df.select(*names, *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema
    keep, at = [df.columns.index(c) for c in names], df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            out = np.zeros((len(COUNTS), batch.num_rows), np.int64)
            for a, b, buf, offs in texts(column):
                h, _, woff = split_words(buf, offs, fold=False)
                chars = np.concatenate(([0], np.cumsum(((buf & 0xC0) != 0x80) & ~_BLANK[buf])))
                symbols = np.concatenate(([0], np.cumsum(_SYMBOL[buf])))
                out[0, a:b] = np.diff(woff)
                out[1, a:b] = chars[offs[1:]] - chars[offs[:-1]]
                out[2, a:b] = symbols[offs[1:]] - symbols[offs[:-1]]
                for k in range(b - a):
                    out[5, a + k] = _repeat_words(h[woff[k]:woff[k + 1]])
            for k, t in enumerate(pc.fill_null(column, "").to_pylist()):
                lines = [x for x in t.split("\n") if x.strip(_SPACES)]
                out[3, k] = len(lines)
                out[4, k] = len(lines) - len(set(lines))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(x) for x in out],
                                             names=[*names, *COUNTS])

    return with_batches(df).mapInArrow(run, schema)


def _bin(x):
    """Sketch bin of a value: -2**31 for zero, else floor(log_gamma(x))."""
    return F.when(x <= 0, F.lit(-2**31)).otherwise(F.floor(F.log(x) / _GAMMA)).cast("int")


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """q25, q75 and the upper edge of the bin of ``TAIL`` per (keys, rule) of (keys, rule, bin, n); a group has a bounded
    number of bins."""
    by = [*keys, "rule"]
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("bin") == -2**31, 0.0).otherwise(F.exp((F.col("bin") + 0.5) * _GAMMA))
    edge = F.when(F.col("bin") == -2**31, 0.0).otherwise(F.exp((F.col("bin") + 1) * _GAMMA) * (1 + 1e-9))
    ranked = sketch.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return ranked.groupBy(*by).agg(F.max("all").alias("rows"),
                                   F.min(F.when(F.col("upto") >= 0.25 * F.col("all"), value)).alias("q25"),
                                   F.min(F.when(F.col("upto") >= 0.75 * F.col("all"), value)).alias("q75"),
                                   F.min(F.when(F.col("upto") >= TAIL * F.col("all"), edge)).alias("tail"))


def fences(counts: DataFrame, lang: str = "lang", source: str = "source", min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, <rule>_low, <rule>_high) for every language and source of ``counts``, nulls included.

    A group under ``min_rows`` rows uses its language's sketch, a language under it the sketch of all rows.
    """
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(m).cast("double").alias("x")) for r, (m, *_) in RULES.items()])
    sketch = (counts.filter("n_words > 0")
              .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(rules).alias("r"))
              .groupBy("lang", "source", F.col("r.rule").alias("rule"), _bin(F.col("r.x")).alias("bin"))
              .agg(F.count("*").alias("n"))).checkpoint()
    levels = []
    for keys in (["lang", "source"], ["lang"], []):
        merged = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
        q = _quantiles(merged, keys)
        wide = [F.max("rows").alias("rows")]
        for r, (_, k, below, above) in RULES.items():
            q25, q75, tail = (F.max(F.when(F.col("rule") == r, F.col(c))) for c in ("q25", "q75", "tail"))
            wide.append((q25 - F.greatest(k * (q75 - q25), F.lit(below))).alias(f"{r}_low") if below is not None
                        else F.lit(None).cast("double").alias(f"{r}_low"))
            high = q75 + F.greatest(k * (q75 - q25), F.lit(above))
            wide.append((F.greatest(high, tail) if r in TAIL_RULES else high).alias(f"{r}_high"))
        levels.append(q.groupBy(*keys).agg(*wide))
    top, by_lang, overall = levels
    names = [f"{r}_{e}" for r in RULES for e in ("low", "high")]
    by_lang = by_lang.select(F.col("lang").alias("_l"), F.col("rows").alias("_rows"), *[F.col(c).alias(f"_{c}") for c in names])
    whole = overall.first()
    out = top.join(by_lang, F.col("lang").eqNullSafe(F.col("_l")), "left")
    picked = [F.when(F.col("rows") >= min_rows, F.col(c)).when(F.col("_rows") >= min_rows, F.col(f"_{c}"))
              .otherwise(F.lit(whole[c] if whole else None).cast("double")).alias(c) for c in names]
    return out.select("lang", "source", *picked)


def apply_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                min_words: int = 50, max_repeat_pct: int = 50, min_rows: int = MIN_ROWS) -> DataFrame:
    """Add the counts, ``base_failed``, ``failed_rule`` (first adaptive rule broken, or null) and ``kept``.

    A document fails the base rules with fewer than ``min_words`` words or if more than ``max_repeat_pct`` per
    cent of its words repeat; null, empty and blank texts therefore fail. Null languages and sources form groups
    of their own. Columns of the added names are replaced; the text column is not returned.
    """
    added = {*COUNTS, "base_failed", "failed_rule", "kept"}
    names = [c for c in df.columns if c not in added]
    kept = [c for c in names if c != text]
    # the given columns travel as one struct, so that none of their names meets one of the names used here
    counted = count_features(df.select(F.struct(*kept).alias("_row") if kept else F.lit(None).alias("_row"), F.col(lang).alias("_lang"), F.col(source).alias("_source"),
                                       F.col(text).alias("_text")), "_text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed).checkpoint()
    limits = fences(counted.filter(~F.col("base_failed")), "_lang", "_source", min_rows).checkpoint()
    joined = counted.join(small(limits, limits.count()), F.col("_lang").eqNullSafe(F.col("lang")) & F.col("_source").eqNullSafe(F.col("source")), "left")
    broken = F.lit(None).cast("string")
    for r, (metric, _, below, _) in reversed(RULES.items()):
        x = F.expr(metric)
        out_of = (x > F.col(f"{r}_high")) | (x < F.col(f"{r}_low") if below is not None else F.lit(False))
        broken = F.when(F.coalesce(out_of, F.lit(False)), F.lit(r)).otherwise(broken)
    broken = F.when(F.col("base_failed"), F.lit(None).cast("string")).otherwise(broken)
    return joined.select(*(["_row.*"] if kept else []), *COUNTS, "base_failed", broken.alias("failed_rule")).withColumn(
        "kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


def op7_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return apply_rules(docs).drop("lang", "source", "n_lines")
