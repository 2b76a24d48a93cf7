from tests.llm.helpers import SF, WORD, frame, words
from tidemark.llm import quality_rules as Q


def _counts(text):
    t = text or ""
    w = words(t, fold=False)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    cover = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_counts_equal_plain_python(spark):
    texts = [None, "", " \n\t", "a b c a b c", "a a a a", "x\ny\nx\n\n \n", "é ü | # é", "w " * 30000, "q\x0br\x0cs", "a b c d a b c"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    df = frame(spark, list(enumerate(texts)), "i int, text string")
    for r in Q.count_features(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _counts(texts[r.i])


def test_adaptive_verdicts(spark):
    clean = " ".join(f"word{k} other{k * 7 % 89}" for k in range(40))
    junk = " ".join(f"word{k} ### $$" for k in range(40))
    rows = [(i, clean + f" tail{i}", "en", "s") for i in range(300)] + [(900, junk, "en", "s"), (901, junk, "en", "rare"), (902, clean, None, None)]
    rows += [(903, None, "en", "s"), (904, "short", "xx", "s"), (900, junk, "en", "s")]
    df = frame(spark, rows, "doc_id int, text string, lang string, source string").selectExpr("*", "1 AS kept", "'c' AS n_words")
    got = {}
    for r in Q.apply_rules(df).collect():
        got.setdefault(r.doc_id, []).append((r.kept, r.base_failed, r.failed_rule))
    assert sum(len(v) for v in got.values()) == len(rows)
    assert all(got[i] == [(True, False, None)] for i in range(300))
    assert [x[:2] for x in got[900] + got[901]] == [(False, False)] * 3 and all(x[2] for x in got[900] + got[901])
    assert got[902] == [(True, False, None)] and got[903] == got[904] == [(False, True, None)]
    assert Q.apply_rules(df.limit(0)).collect() == []


def test_sketch_quantiles(spark):
    rows = [(i, "en", "s", 100, 400 + i) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id int, lang string, source string, n_words bigint, word_chars bigint")
    df = df.selectExpr("*", "0L AS n_symbols", "1L AS n_lines", "0L AS n_dup_lines", "0L AS n_repeat_words")
    r = Q.fences(df).first()
    q25, q75 = 6.50, 11.50  # (400 + i) / 100 at a quarter and three quarters
    assert abs(r.word_length_high - (q75 + 6 * (q75 - q25))) < 0.02 * 7 * 12
    assert abs(r.symbols_high - 0.1) < 1e-9 and r.symbols_low is None


def test_every_rule_fails_its_document(spark):
    clean = " ".join(f"word{k} other{k * 7 % 89}" for k in range(40))
    planted = {
        "word_length": " ".join(f"w{k}" + "x" * 40 for k in range(60)),
        "symbols": " ".join(f"longerword{k} #" for k in range(40)),
        "dup_lines": "\n".join(f"line{k} " + " ".join(f"wor{k}x{j}" for j in range(8)) + ("\nyes" if k % 2 else "") for k in range(10)),
        "repeats": f"{' '.join(clean.split()[:16])} {clean}",
    }
    # in a group of its own one document in ten repeats a fifth of its words; only the one beyond them fails
    some = f"{' '.join(clean.split()[:9])} x {clean}"
    rows = [(i, clean + f" tail{i}", "en", "s") for i in range(300)] + [(1000 + k, t, "en", "s") for k, t in enumerate(planted.values())]
    rows += [(2000 + i, some if i % 10 == 0 else clean, "en", "t") for i in range(300)] + [(3000, planted["repeats"], "en", "t")]
    got = {r.doc_id: r for r in Q.apply_rules(frame(spark, rows, "doc_id int, text string, lang string, source string")).collect()}
    assert [got[1000 + k].failed_rule for k in range(4)] == list(planted) and not any(got[1000 + k].base_failed for k in range(4))
    assert all(got[i].kept for i in range(300)) and all(got[2000 + i].kept for i in range(300))
    assert got[2000].n_repeat_words > 0.1 * got[2000].n_words and got[3000].failed_rule == "repeats"


def test_clashing_names(spark):
    names = ["_lang", "_source", "symbols_high", "_row", "rows", "_rows", "_l", "_text"]
    df = frame(spark, [(k, "word " * (60 + k), "en", "s") for k in range(5)], "doc_id bigint, text string, lang string, source string")
    df = df.selectExpr("*", *[f"'{c}' AS {c}" for c in names])
    rows = Q.apply_rules(df).collect()
    assert len(rows) == 5 and all(r[c] == c for r in rows for c in names) and sorted(r.n_words for r in rows) == [60, 61, 62, 63, 64]
