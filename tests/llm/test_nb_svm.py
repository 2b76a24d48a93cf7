"""Quality classifier: indicators and counts against plain Python, the fit against its optimum, held-out labels."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import WORD, frame
from tidemark.llm import nb_svm
from tidemark.llm.common import held_out

TEXTS = [None, "", " \n\t", "a", "ab", "abc", "abc abc", "x x x x y", "x " * 9, "Füße übér 漢字 漢字", "A a A a", "q" * 300_000, "one two three " * 20_000]


def plain(text):
    """Number of distinct things switched on: byte 3-grams, words and runs (bins may meet, so at most that many)."""
    raw, words = (text or "").encode(), WORD.findall(text or "")
    run = best = 0
    for k, w in enumerate(words):
        run = run + 1 if k and words[k - 1] == w else 1
        best = max(best, run)
    return {raw[i:i + 3] for i in range(len(raw) - 2)} | {("w", w) for w in words} | {("r", n) for n in (2, 4, 8) if best >= n}


def test_indicators_are_the_distinct_ngrams():
    got = list(nb_svm.indicators(pa.array(TEXTS)))
    assert len(got) == len(TEXTS)
    for text, bins in zip(TEXTS, got):
        assert len(bins) == len(set(bins.tolist())) == len(plain(text)), text
    alone = [next(nb_svm.indicators(pa.array([t]))) for t in TEXTS]
    assert all(set(a.tolist()) == set(b.tolist()) for a, b in zip(got, alone))  # neighbours in a batch don't matter
    same = {}
    for text, bins in zip(TEXTS, got):  # one n-gram, one bin
        for other, others in zip(TEXTS, got):
            same[text, other] = (len(plain(text) & plain(other)), len(set(bins.tolist()) & set(others.tolist())))
    assert all(a == b for a, b in same.values())


def test_ratio_by_hand():
    r = nb_svm.log_count_ratio(np.array([0.0, 3, 1]), np.array([0.0, 0, 5]))
    assert np.allclose(r, [0, np.log(1 / 8) - np.log(4 / 7), np.log(6 / 8) - np.log(2 / 7)])


def test_descent_in_pieces_reaches_the_optimum(spark):
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(300, 12, replace=False)) for _ in range(120)]
    y = [int(r[0] < 14) for r in rows]
    schema = "piece int, id bigint, y int, calibrate boolean, bins array<int>"
    ratio = np.zeros(1 << nb_svm.BITS)
    ratio[:300] = rng.normal(size=300)
    data = [(k % 3, k, y[k], k % 10 == 0, [int(b) for b in rows[k]]) for k in range(120)]
    table = spark.createDataFrame(data, schema).repartition(3, "piece").sortWithinPartitions("piece", "id").checkpoint()
    w, margins, classes = nb_svm.solve(table, ratio, cost=0.5, rounds=400, gap=1e-3)
    used = [k for k in range(120) if k % 10]
    x = np.zeros((120, 301))
    for k in range(120):
        x[k, rows[k]], x[k, 300] = nb_svm.scaled(rows[k], ratio), 1
    s = np.where(np.array(y) == 1, 1.0, -1.0)
    alpha, best = np.zeros(120), np.zeros(301)  # plain dual coordinate descent, to the end
    for _ in range(3000):
        for k in used:
            new = min(max(alpha[k] - (s[k] * (best @ x[k]) - 1) / 2, 0), 0.5)
            best += (new - alpha[k]) * s[k] * x[k]
            alpha[k] = new

    def value(v):
        return 0.5 * v @ v + 0.5 * np.maximum(0, 1 - s[used] * (x[used] @ v)).sum()

    mine = np.append(w[:300], w[-1])
    assert w[300:-1].max() == 0 and value(best) <= value(mine) <= 1.002 * value(best)
    assert len(margins) == 12 and sorted(classes) == sorted(s[::10]) and np.allclose(sorted(margins), sorted(x[::10] @ mine))


def _corpus(n=240):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(150)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words, 40))
        bad = k % 3 == 0
        rows.append((k, text.replace(" ", " ## ") if bad and k % 2 else (f"{words[k % 150]} " * 30 + text if bad else text), int(not bad)))
    return rows


def test_held_out_texts_and_odd_rows(spark):
    rows = _corpus()
    odd = [(1000, None), (1001, ""), (1002, " \n"), (None, rows[0][1]), (None, None), (3, rows[3][1]), (1003, "long text " * 100_000)]
    docs = frame(spark, [(i, t, 0.5, "x") for i, t, _ in rows] + [(i, t, 0.1, "y") for i, t in odd], "doc_id bigint, text string, score double, _y string")
    labels = frame(spark, [(i, q, 7) for i, _, q in rows] + [(None, 1, 7), (5000, 0, 7), (1, None, 7), (2, 3, 7)], "doc_id bigint, quality int, text int")
    model = nb_svm.fit(docs, labels.filter(~held_out("doc_id", 5, 0)))
    got = nb_svm.score_texts(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model)
    assert got.columns == ["doc_id", "text", "_y", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    truth = {i: q for i, _, q in rows}
    tested = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert len(tested) > 30 and np.mean([a == b for a, b in tested]) >= 0.95
    blank = {r.score for r in out if not (r.text or "").strip()}
    assert len({r.score for r in out if not r.text}) == 1 and len(blank) <= 2
    again = nb_svm.fit(docs.repartition(5), labels.filter(~held_out("doc_id", 5, 0)).repartition(3))
    assert np.allclose(again.weights, model.weights) and np.isclose(again.slope, model.slope)


def test_nothing_or_one_class_to_learn(spark):
    docs = frame(spark, [(1, "a b c"), (2, None)], "doc_id bigint, text string")
    labels = "doc_id bigint, quality int"
    for rows, expected in (([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)):
        out = nb_svm.score_texts(docs, nb_svm.fit(docs, frame(spark, rows, labels))).collect()
        # a class whose only texts switch nothing on teaches nothing
        assert [round(r.score, 6) for r in out] == [expected] * 2
    none = docs.filter(F.lit(False))
    assert nb_svm.score_texts(none, nb_svm.fit(none, frame(spark, [(1, 1)], labels))).collect() == []
