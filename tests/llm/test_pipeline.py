import base64
import random

from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.helpers import SF, frame, words


def test_stages_chain_and_keep_their_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
    last = C.run(spark, SF)
    rows = last.collect()
    assert 0 < len(rows) <= docs.count() and all(r.lossless and len(r.ids) == r.n_tokens for r in rows)


def test_decisions_take_effect(spark):
    prose = " ".join(f"word{i} the of and to" for i in range(40))
    edited = prose.replace("word20 ", "other ")
    line = "a line that several of the documents hold, word for word"
    rows = [(1, prose, "en", "s", 1), (2, prose + " x", "en", "s", 1), (3, "12 34 ###", "en", "s", 1), (4, None, None, None, None), (5, line, "en", "t", 1),
            (6, f"{line}\nown words of this document, many more of them here", "en", "t", 1), (7, edited, "en", "s", 1), (1, prose, "en", "s", 1), (None, "the end of it", "en", "s", 1)]
    docs = frame(spark, rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id or 0 for r in C.identify_language(spark, docs, "").collect()) == [0, 1, 1, 2, 5, 6, 7]
    lines = {r.doc_id: r for r in C.drop_lines(spark, docs, "").collect()}
    assert 5 in lines and lines[6].text == "own words of this document, many more of them here" and lines[6].n_chars == len(lines[6].text)
    near = sorted(r.doc_id or 0 for r in C.drop_near_copies(spark, docs, "").collect())
    assert near == [0, 1, 3, 4, 5, 6]
    assert {r.doc_id for r in C.mix_sources(spark, docs, "").collect()} <= {r[0] for r in rows}
    got = {r.doc_id: r for r in C.encode(spark, docs, "").collect()}
    assert got[4].n_tokens == 1 and all(r.lossless for r in got.values()) and got[1].n_tokens > len(words(prose))


def test_near_copies_equal_comparing_all_pairs(spark):
    """Groups at five words and a similarity of 0.8, among them copies of 200 words with four scattered changes."""
    rng = random.Random(8)
    texts = []
    for size in (200, 60, 12, 8, 7, 4):
        for _ in range(4):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            texts.append(" ".join(base))
            texts.append(" ".join(base + ["more"]))
            for edits in range(1, 7):
                x = list(base)
                for i in rng.sample(range(size), min(edits, size // 2)):
                    x[i] = f"e{rng.randrange(10**6)}"
                texts.append(" ".join(x))
    base = [f"s{i}" for i in range(200)]
    for at in (20, 70, 120, 170):
        base[at] = "changed"
    texts += [" ".join(f"s{i}" for i in range(200)), " ".join(base)]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in map(words, texts)]
    group = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    docs = frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(r.doc_id for r in C.drop_near_copies(spark, docs, "").collect())
    assert group[-1] == len(texts) - 2 and got == sorted(set(group))


def test_gibberish_and_unlearned_languages_are_rejected(spark):
    rng = random.Random(2)
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    hidden = docs.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(200)),
            rng.randbytes(500).hex(), base64.b64encode(rng.randbytes(600)).decode(), "Это небольшой текст на русском языке, другого нет. " * 8]
    more = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(junk)], docs.select(C.COLUMNS).schema)
    kept = {r.doc_id for r in C.identify_language(spark, hidden.select(C.COLUMNS).unionByName(more), "").select("doc_id").collect()}
    spanish = {r.doc_id for r in docs.filter("lang = 'es'").select("doc_id").collect()}
    others = {r.doc_id for r in docs.filter("lang <> 'es'").select("doc_id").collect()}
    assert not any(k >= 10**9 for k in kept)
    assert len(spanish & kept) <= 0.1 * len(spanish) and len(others & kept) >= 0.98 * len(others)


def test_short_repeated_lines_go(spark):
    rows = [(1, "first of them\nAll rights reserved.\n\n \nyes"), (2, "All rights reserved.\n\n \nsecond of them\nyes\nyes!"), (3, "All rights reserved.\nyes"), (4, "yes"), (5, "")]
    docs = frame(spark, [(k, t, "en", "s", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in C.drop_lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "\n \nsecond of them\nyes!", 5: ""}
