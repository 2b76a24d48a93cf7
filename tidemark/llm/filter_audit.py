"""Filter interaction audit by wide packed counters.

What a filter removes depends on the filters before it, so every order of the filters is asked. Which filters a
document fails is a mask of a few bits, and the mask alone decides what happens to it at every step of every
order. Each mask therefore has one big integer with a field for every outcome of every (order, step): 1 where the
outcome holds, else 0. Integers of documents are added up per part, each times the number of its documents, and the
sum is read back field by field. A field is ``WIDTH`` = 64 bits wide and a count of rows stays below 2**63, so no
field can run over into the next one.

Scale: documents are counted per (part, mask, labels) first, with a map-side combine, so a part reaches the packed
sum as at most 2**filters * 4 rows whatever its size. Texts are read once; copies are found on 256-bit text
hashes, and only (hash, id, part, mask) rows are shuffled. No key of a join is a text hash alone, so a text with
thousands of copies meets no single task.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WIDTH = 64
# Outcomes of one step that the integer has a field for.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
SCHEMA = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
          "good_lost bigint, toxic_lost bigint, shapley bigint")
_SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """Bits of the filters that a text alone decides: A (bit 0) to D (bit 3). A null text counts as empty.

    A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * ``[A-Z]`` > 5 * code points; D: a character of
    ``#$%&*|``. Words are maximal runs of ``[^\\x20\\x09-\\x0D]``, compared with their case.
    """
    x = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(x, _SPACE), "")

    def bits(w: Column) -> Column:
        few = F.size(w) < 50
        repeated = 100 * F.size(F.array_distinct(w)).cast("long") < 65 * F.size(w).cast("long")
        return F.when(few, 1).otherwise(0) + F.when(repeated, 2).otherwise(0)

    # transform over a one-element array: the words are split once, not once per use
    of_words = F.transform(F.array(words), bits)[0]
    capitals = F.length(x) - F.length(F.regexp_replace(x, "[A-Z]", ""))
    loud = 100 * capitals.cast("long") > 5 * F.length(x).cast("long")
    return of_words + F.when(loud, 4).otherwise(0) + F.when(x.rlike(r"[#$%&*|]"), 8).otherwise(0)


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents per part, failed filters and labels.

    Bit 4 is filter E: the text equals that of a smaller doc_id, anywhere in the table. Of equal rows with one doc_id
    none is smaller than the other; a null doc_id is never larger, so such a document passes E. A document is good
    (toxic) if any of its label rows says 1; label rows of other documents have no effect. Other columns are ignored.
    """
    x = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"),
                       text_failures(docs["text"]).alias("mask"), F.unhex(F.sha2(x, 256)).alias("h"))
    rows = rows.groupBy("h", "id", "part", "mask").agg(F.count("*").alias("n")).checkpoint()
    # every text's smallest id; joined on hash and id, so that copies of one text are different keys
    first = rows.filter("id is not null").groupBy(F.col("h").alias("_h")).agg(F.min("id").alias("_first"))
    joined = rows.filter("id is not null").join(first, (F.col("h") == F.col("_h")) & (F.col("id") == F.col("_first")), "left")
    copy = joined.select("id", "part", (F.col("mask") + F.when(F.col("_first").isNull(), 16).otherwise(0)).alias("mask"), "n")
    marks = (labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("_g"), F.max((F.col("toxic") == 1).cast("int")).alias("_t")))
    known = copy.join(marks, F.col("id") == F.col("_id"), "left").select(
        "part", "mask", (F.coalesce("_g", F.lit(0)) == 1).alias("good"), (F.coalesce("_t", F.lit(0)) == 1).alias("toxic"), "n")
    nameless = rows.filter("id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return known.unionByName(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def packed(mask: int, good: bool, toxic: bool, orders: list[str], filters: str = FILTERS) -> int:
    """The integer of one document: a ``WIDTH``-bit field for every order, step and outcome, in that order."""
    out = np.zeros((len(orders), len(filters), len(OUTCOMES)), "<u8")
    for o, order in enumerate(orders):
        gone = False
        for s, letter in enumerate(order):
            bit = 1 << filters.index(letter)
            fails = bool(mask & bit)
            lost = fails and not gone
            out[o, s] = (not fails and not gone, lost, fails and gone, mask == bit, lost and good, lost and toxic)
            gone = gone or fails
    return int.from_bytes(out.tobytes(), "little")


def unpack(total: int, orders: list[str], filters: str = FILTERS) -> np.ndarray:
    """Counts (order, step, outcome) of a sum of ``packed`` integers."""
    shape = (len(orders), len(filters), len(OUTCOMES))
    size = int(np.prod(shape)) * WIDTH // 8
    return np.frombuffer(total.to_bytes(size, "little"), "<u8").astype(np.int64).reshape(shape)


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row (``SCHEMA``) per part, order of the ``filters`` and step from (part, mask, good, toxic, n) rows.

    Rows of one (part, mask, good, toxic) may come in pieces. ``shapley`` is the step's filter's ``removed`` summed
    over all orders. No rows give no rows.
    """
    orders = ["".join(p) for p in permutations(filters)]

    def run(table: pa.Table) -> pa.Table:
        total, integers = 0, {}
        for mask, good, toxic, n in zip(*(table.column(c).to_pylist() for c in ("mask", "good", "toxic", "n"))):
            key = (mask, good, toxic)
            if key not in integers:
                integers[key] = packed(*key, orders, filters)
            total += n * integers[key]
        at = unpack(total, orders, filters)
        letters = np.array([[filters.index(c) for c in o] for o in orders])
        shapley = np.zeros(len(filters), np.int64)
        np.add.at(shapley, letters, at[:, :, OUTCOMES.index("removed")])
        k = len(filters)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()] * (len(orders) * k)),
                         "filter_order": pa.array(np.repeat(orders, k).tolist()),
                         "step": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))),
                         **{c: pa.array(at[:, :, i].ravel()) for i, c in enumerate(OUTCOMES)},
                         "shapley": pa.array(shapley[letters].ravel())})

    whole = counts.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").cast("long").alias("n"))
    return whole.groupBy("part").applyInArrow(run, SCHEMA)


def op11_filter_audit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(document_failures(docs, labels))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS ws, min(doc_id) OVER (PARTITION BY x) AS smallest FROM t),
lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
             100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x), regexp_matches(x, '[#$%&*|]'),
             coalesce(w.doc_id > smallest, false)] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
m AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM l a, l b, l d, l e, l g
      WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, good, toxic, fails,
             fails[ascii(substr(filter_order, step, 1)) - 64] AS bad,
             len(list_filter(range(1, step), lambda i: fails[ascii(substr(filter_order, CAST(i AS BIGINT), 1)) - 64])) > 0 AS gone FROM m, s),
q AS (SELECT part, filter_order, CAST(step AS INT) AS step, letter, CAST(sum(n) FILTER (NOT bad AND NOT gone) AS BIGINT) AS kept,
             CAST(sum(n) FILTER (bad AND NOT gone) AS BIGINT) AS removed, CAST(sum(n) FILTER (bad AND gone) AS BIGINT) AS redundant,
             CAST(sum(n) FILTER (bad AND len(list_filter(fails, lambda y: y)) = 1) AS BIGINT) AS unique_fails,
             CAST(sum(n) FILTER (bad AND NOT gone AND good = 1) AS BIGINT) AS good_lost,
             CAST(sum(n) FILTER (bad AND NOT gone AND toxic = 1) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
       coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM q"""
