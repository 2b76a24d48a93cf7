import random

import pytest

from tests.llm.helpers import SF, frame, words
from tidemark.llm import ngram_jaccard as J


def _plain(rows):
    sets = []
    for k, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for j in range(len(rows)):
        for i in range(j):
            x = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and x and 100 * x >= 90 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted(((k, len(sets[i]), low.get(find(i)) if k is not None else None) for i, (k, _) in enumerate(rows)), key=str)


def _family(rng, n, size, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        x = list(base)
        for _ in range(rng.randint(0, edits)):
            x[rng.randrange(len(x))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize("tokens,sets", [(J.GROUP_TOKENS, J.GROUP_SETS), (400, 3)])
def test_equals_comparing_all_pairs(spark, monkeypatch, tokens, sets):
    """Also with groups so small that every family is split over many."""
    monkeypatch.setattr(J, "GROUP_TOKENS", tokens)
    monkeypatch.setattr(J, "GROUP_SETS", sets)
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = _family(rng, 30, 90, 4) + _family(rng, 12, 25, 1) + [f"{passage} {x}" for x in _family(rng, 15, 60, 3) + _family(rng, 1, 80, 0) * 3]
    texts += [passage + f" q{i}" for i in range(8)] + [None, "", " \n ", "one", "One", "one two", "a b c", "A  b\tc", "x y z " * 2000]
    texts += [" ".join(f"s{i}" for i in range(11)), " ".join(f"s{i}" for i in range(12)), " ".join(f"s{i}" for i in range(13))]
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    rows += [(1000, "other text under the same id"), (1000, texts[0]), (None, texts[0]), (None, "lonely")]
    df = frame(spark, rows, "doc_id bigint, text string").selectExpr("*", "1 AS n", "2 AS component_id")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()), key=str)
    assert got == _plain(rows)


def test_given_documents_and_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()), key=str)
    assert got == _plain([tuple(r) for r in docs.collect()])
    assert J.jaccard_components(docs.limit(0)).collect() == []
