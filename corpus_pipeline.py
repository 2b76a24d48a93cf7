"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing, SentencePiece encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.
``run`` writes each stage's rows as Parquet to the shared checkpoint folder and reads them again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, line_dedup, mixing, ngram_jaccard, sentencepiece_chunks
from tidemark.llm.common import small, small_batches
from tidemark.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# A document is rejected if the evidence for its best language is further than ``LANG_SLACK`` below the quantile
# ``LANG_TAIL`` of that language's own documents and below 0, where the language's classifier itself says no.
LANG_TAIL, LANG_SLACK = 0.01, 0.1
# Near copies share this percentage of their shingles of so many words; op1 has a contract of its own (3 words, 90 %).
COPY_WORDS, COPY_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language: no letter at all, or none that fits like its own documents do."""
    with small_batches(spark):
        model = language_id.fit(docs.select("doc_id", "text", "lang"), fit_rows=None)
    if not model[0]:
        return docs.select(COLUMNS)  # nothing to learn from: nothing to reject by
    rows = docs.select(COLUMNS)
    # The evidence follows from the text alone, so it is kept by the text's hashes and the texts are not written twice.
    own = (F.col("text").isNotNull() & F.col("doc_id").isNotNull()).alias("own")
    hashed = rows.select("text", "lang", own, F.xxhash64("text").alias("_h"), F.hash("text").alias("_g"))
    with small_batches(spark):
        scored = language_id.predict(hashed, model, evidence=True).drop("text", "score").checkpoint()
    by_lang = scored.filter(F.col("own") & (F.col("lang_pred") == F.col("lang"))).groupBy("lang")
    rows_of = by_lang.agg(F.percentile_approx("evidence", F.lit(LANG_TAIL), F.lit(10_000)).alias("low")).collect()  # one row per language
    low = {r.lang: min(0.0, r.low - LANG_SLACK) for r in rows_of}
    fence = F.coalesce(*[F.when(F.col("lang_pred") == name, x) for name, x in sorted(low.items())], F.lit(0.0))
    kept = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("evidence") >= fence)
    gone = scored.filter(~F.coalesce(kept, F.lit(False))).select("_h", "_g").distinct().checkpoint()
    on = (F.xxhash64("text") == F.col("_h")) & (F.hash("text") == F.col("_g"))
    return rows.filter(F.col("text").isNotNull()).join(small(gone, gone.count()), on, "left_anti")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated lines of any length and nearly repeated longer ones; documents of which no word is left go, n_chars follows the text."""
    out = line_dedup.dedup_lines(docs.select(COLUMNS), short_repeats=True)
    left = F.length(F.regexp_replace("text", r"[ \t-\r]+", "")) > 0
    return out.filter(left | (F.col("n_exact") + F.col("n_near") == 0)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of linked documents; of equal rows with one id, one."""
    rows = docs.select(COLUMNS)
    found = ngram_jaccard.jaccard_components(rows, width=COPY_WORDS, percent=COPY_PERCENT).checkpoint()
    gone = found.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_k"), F.col("text_hash").alias("_h")).distinct().checkpoint()
    on = (F.col("doc_id") == F.col("_k")) & (F.xxhash64("text") == F.col("_h"))
    kept = rows.join(small(gone, gone.count()), on, "left_anti")
    repeated = found.filter("doc_id is not null").groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates() if repeated else kept


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that source, language and topic take their target shares of the tokens."""
    rows = docs.select(*COLUMNS, mixing.form_topic(F.col("text")).alias("topic"), mixing.n_tokens(F.col("text")).alias("n_tokens"))
    return mixing.mix(rows, mixing.DIMS, "n_tokens").filter("sampled").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with an end id, and whether they decode to the text again."""
    import public_tokenizers

    out = sentencepiece_chunks.encode_decode(docs.select(COLUMNS), public_tokenizers.path("piece_bpe_32k.model"),
                                             ("n_tokens", "ids", "decoded_sha256"))
    lossless = F.col("decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", lossless.alias("lossless"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

# The language model of the first stage cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
