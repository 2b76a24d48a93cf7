import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import SF, frame
from tidemark.llm import language_id as L
from tidemark.llm.common import held_out


def test_kernel_equals_set_arithmetic():
    import numpy as np

    def plain(t):
        b = bytes(x if x >= 0x80 else (ord(chr(x).lower()) if chr(x).isalpha() else 0x20) for x in t.encode())
        b = b" " + b + b" "
        return {b[i:i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    texts = ["The cat", "le chat é", "Katze 12!", "a"]
    sets = [L.grams(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    k = L.Landmarks(sets).kernel(sets)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y = plain(a), plain(b)
            assert abs(k[i, j] - len(x & y) / (len(x) * len(y)) ** 0.5) < 1e-5


def test_windows_cover_the_text():
    import numpy as np

    for t in ("", "a", "x" * 5000, "ab cd " * 1000, "é" * 700 + " y" * 300):
        buf = np.frombuffer(t.encode(), np.uint8)
        assert np.concatenate(L.windows(buf)).tobytes() == t.encode()


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out("doc_id", 4, 2)
    model = L.fit(docs.filter(~out))
    odd = frame(spark, [(-1, None, None), (-2, "", "en"), (-3, "12 34 ##", None), (None, "漢字", "fr"), (-2, "the", "en")], "doc_id bigint, text string, lang string")
    rows = L.predict(docs.withColumn("score", F.lit("mine")).unionByName(odd, allowMissingColumns=True).withColumn("h", out), model).collect()
    assert len(rows) == docs.count() + 5 and all(0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.h and r.lang is not None and (r.doc_id or 0) >= 0]
    assert sum(r.lang == r.lang_pred for r in known) >= 0.95 * len(known)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (-1, -3))
    assert [r.lang_pred for r in rows if r.doc_id is None][0] in model[0]
    none = L.fit(docs.limit(0))
    assert {r.lang_pred for r in L.predict(odd, none).collect()} == {"und"}


def test_a_letter_at_a_cut_is_found(spark):
    text = "1" * 511 + "漢" + "1" * 600
    assert all(w.tobytes().decode() or True for w in L.windows(np.frombuffer(text.encode(), np.uint8)))  # whole characters only
    docs = frame(spark, [(k, "the cat sat on the mat " * 5, "en") for k in range(8)], "doc_id bigint, text string, lang string")
    odd = frame(spark, [(1, text), (2, "1" * 2000)], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in L.predict(odd, L.fit(docs)).collect()} == {1: "en", 2: "und"}


def test_fifty_languages(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(50):
        letters = [chr(0x4E00 + 20 * k + i) for i in range(20)]
        rows += [(100 * k + i, " ".join("".join(rng.choice(letters, 3)) for _ in range(40)), f"lang{k:02d}") for i in range(6)]
    df = frame(spark, rows, "doc_id bigint, text string, lang string")
    out = L.predict(df, L.fit(df, landmarks=4)).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)


def test_whole_fit_learns_from_every_window_of_every_text(spark):
    """Against the same regression by dense algebra, on texts of several windows and of a language with few rows."""
    import numpy as np

    from tidemark.llm import language_id as L

    rng = np.random.default_rng(5)
    vocab = {"aa": ["uno", "dos", "tres", "perro"], "bb": ["eins", "zwei", "drei", "hund"]}
    rows = [(i, " ".join(rng.choice(vocab[g], 10 + 400 * (i % 3 == 0))), g) for i, g in enumerate(["aa"] * 40 + ["bb"] * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    langs, marks, weights, bias = L.fit(df, landmarks=3, fit_rows=None)
    sets, w, y = [], [], []
    for _, text, g in rows:
        buf = np.frombuffer(text.encode(), np.uint8)
        for piece in L.windows(buf):
            sets.append(L.grams(piece))
            w.append(len(piece) / len(buf) / sum(r[2] == g for r in rows))
            y.append([1.0 if g == name else -1.0 for name in langs])
    assert langs == ["aa", "bb"] and len(sets) > len(rows)
    k, w, y = np.hstack([marks.kernel(sets), np.ones((len(sets), 1))]).astype(float), np.array(w)[:, None], np.array(y)
    # at the optimum of ridge regression on Nyström features the gradient in feature space is ridge * beta; the fitted values show it
    fitted = k @ np.vstack([weights, bias])
    assert np.sign(fitted).tolist() == np.sign(y).tolist()
    inner = marks.kernel([s for s in _columns(marks)]).astype(float)
    values, vectors = np.linalg.eigh(inner)
    good = values > values[-1] * 1e-6
    turn = np.zeros((k.shape[1], good.sum() + 1))
    turn[:-1, :-1], turn[-1, -1] = vectors[:, good] / np.sqrt(values[good]), 1.0
    phi = k @ turn
    beta = np.linalg.solve(phi.T @ (phi * w) + L.RIDGE * np.eye(phi.shape[1]), phi.T @ (y * w))
    assert np.allclose(phi @ beta, fitted, atol=1e-5)


def _columns(marks):
    """Gram sets of the landmarks, read back from their matrix."""
    return [marks.ids[marks.matrix[:, j] > 0] for j in range(marks.matrix.shape[1])]
