import math
from collections import Counter

import pytest

from tests.llm.helpers import SF, frame, words
from tidemark.llm import kneser_ney as K


def _plain(train, test):
    c, b = Counter(), Counter()
    for t in train:
        w = words(t) + ["</s>"]
        c.update(w)
        b.update(zip(["<s>", *w], w))
    n, v = sum(c.values()), len(c)
    d = K.discounts([sum(x == k for x in b.values()) for k in (1, 2, 3, 4)])
    a = Counter(w for _, w in b)
    e = K.discounts([sum(x == k for x in a.values()) for k in (1, 2, 3, 4)])
    rest = sum(e[min(x, 3)] for x in a.values()) / len(b) if b else 1.0
    total, follow = Counter(), Counter()
    for (x, _), k in b.items():
        total[x] += k
        follow[x] += d[min(k, 3)]

    def low(w):
        return max(a[w] - e[min(a[w], 3)], 0) / max(len(b), 1) + rest / (v + 1)

    def p(x, w):
        k = b[x, w]
        return (max(k - d[min(k, 3)], 0) + follow[x] * low(w)) / total[x] if total[x] else low(w)

    out = []
    for t in test:
        w = words(t) + ["</s>"]
        out.append((len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(x, y)) for x, y in zip(["<s>", *w], w))))
    for x in ["<s>", *list(c)[:20]]:
        assert abs(sum(p(x, w) for w in c) + p(x, "never seen") - 1) < 1e-9
    return out


@pytest.mark.parametrize("shard_bytes", [20_000, 1 << 24])
def test_equals_plain_python(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(K, "SHARD_BYTES", shard_bytes)
    train = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(120).collect()] + [None, "", "the " * 3000, "The the a"]
    test = train[:40] + [None, "", "unknownword", "the unknownword the", "x\ny\x0bz", "word " * 20000]
    model = K.train(frame(spark, [(t,) for t in train], "text string"))
    df = frame(spark, list(enumerate(test)), "i int, text string").selectExpr("*", "'mine' AS score")
    want = _plain(train, test)
    rows = K.score(df, model).collect()
    assert len(rows) == len(test)
    for r in rows:
        n, known, total, base, score = want[r.i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_no_training_text(spark):
    df = frame(spark, [("a b",), (None,)], "text string")
    model = K.train(df.limit(0))
    assert sorted((r.n_tokens, r.n_known, r.score, r.base_score) for r in K.score(df, model).collect()) == [(1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]
    assert K.score(df.limit(0), model).collect() == []
