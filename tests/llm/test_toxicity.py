import random

import numpy as np

from tests.llm.helpers import frame
from tidemark.llm import toxicity as X


def _maximal(s):
    """All maximal scoring segments, from their definition by recursion on the best segment."""
    best, at = 0.0, None
    for i in range(len(s)):
        t = 0.0
        for j in range(i, len(s)):
            t += s[j]
            if t > best + 1e-12 or (at is not None and abs(t - best) <= 1e-12 and j - i < at[1] - at[0]):
                best, at = t, (i, j)
    if at is None:
        return []
    i, j = at
    left = _maximal(s[:i])
    return left + [(i, j + 1)] + [(a + j + 1, b + j + 1) for a, b in _maximal(s[j + 1:])]


def test_segments_are_the_maximal_ones():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.uniform(-1, 1) for _ in range(rng.randint(0, 14))]
        assert [(a, b) for a, b, _ in X.segments(np.array(s))] == _maximal(s)


def test_held_out_detection_and_odd_rows(spark):
    rng = random.Random(7)
    bad, good = [f"vile{k}" for k in range(12)], [f"calm{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        w = rng.choices(good, k=rng.randint(30, 120))
        for _ in range(rng.randint(3, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    labels += [(3, None), (9999, 1), (0, 0), (None, 1)]
    rows += [(900, None), (901, ""), (902, " \n"), (None, "calm1 calm2"), (0, rows[0][1]), (903, "calm5 " * 30000)]
    docs = frame(spark, rows, "doc_id bigint, text string").selectExpr("*", "'mine' AS score")
    known = frame(spark, [x for x in labels if x[0] is None or x[0] % 3 != 1], "doc_id bigint, toxic int")
    out = X.find_toxic(docs, X.fit(docs, known)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    unseen = [r for r in out if r.doc_id is not None and r.doc_id < 500 and r.doc_id % 3 == 1]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in unseen) >= 0.97 * len(unseen)
    for r in unseen:
        w = dict(rows)[r.doc_id].split()
        assert all(any(x.startswith("vile") for x in w[p["first"]:p["last"] + 1]) for p in r.passages) or not r.predicted
    assert all(not r.predicted and not r.passages for r in out if r.doc_id in (900, 901, 902))
    assert len({r.score for r in out if r.doc_id == 0}) == 1


def test_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None)], "doc_id bigint, text string")
    model = X.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {(r.score, r.predicted) for r in X.find_toxic(docs, model).collect()} == {(0.5, 0)}
    assert X.find_toxic(docs.limit(0), model).collect() == []


def test_calibration_sees_every_segment(spark):
    """Texts of hundreds of toxic passages: the curve is fitted to the evidence that scoring uses, however many there are."""
    rng = np.random.default_rng(0)
    plain, bad = [f"word{k}" for k in range(300)], [f"slur{k}" for k in range(8)]
    rows = []
    for k in range(120):
        passages = (200 if k % 4 else 3) if k % 2 else 0
        parts = [" ".join(rng.choice(plain, 15)) + (" " + " ".join(rng.choice(bad, 3)) if i < passages else "") for i in range(210)]
        rows.append((k, " ".join(parts), int(k % 2)))
    docs = frame(spark, [r[:2] for r in rows], "doc_id bigint, text string")
    model = X.fit(docs, frame(spark, [(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    out = {r.doc_id: r for r in X.find_toxic(docs, model).collect()}
    assert all(out[k].predicted == y for k, _, y in rows)
    assert model.slope > 0
