import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame
from tidemark.llm import line_dedup as L


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _changed(rng, text, n, alphabet):
    b = list(text)
    for _ in range(n):
        i, op = rng.randrange(len(b)), rng.randrange(3)
        if op == 0:
            b[i] = rng.choice(alphabet)
        elif op == 1:
            b.insert(i, rng.choice(alphabet))
        else:
            b.pop(i)
    return "".join(b)


def _plain(rows, tau, least):
    """(lines, exact, near, text) per document by comparing all lines."""
    first = {}
    for k, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, x in enumerate(t.split("\n")):
            if len(x) >= least or x.strip(" \t\n\x0b\x0c\r"):
                first.setdefault(x, (k, p))
    lines = [x for x in first if len(x) >= least]  # in order of their first places
    near = {b for j, b in enumerate(lines) for a in lines[:j] if abs(len(a) - len(b)) <= tau and _edits(a, b) <= tau}
    out = []
    for k, t in rows:
        if t is None:
            out.append((k, 0, 0, 0, None))
            continue
        keep, exact, close = [], 0, 0
        for p, x in enumerate(t.split("\n")):
            if x in first and first[x] != (k, p):
                exact += 1
            elif x in near:
                close += 1
            else:
                keep.append(x)
        out.append((k, len(t.split("\n")), exact, close, "\n".join(keep)))
    return out


@pytest.mark.parametrize("tau", [1, 2])
def test_equals_comparing_all_lines(spark, tau):
    rng = random.Random(tau)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 34))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([x, _changed(rng, x, rng.randint(0, tau + 1), "abé")]) for x in rng.choices(base, k=rng.randint(1, 6)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "short\nshort"), (104, "x" * 9000), (105, "x" * 8999 + "y"), (None, base[0]), (40, rows[3][1]), (40, rows[3][1])]
    df = frame(spark, rows, "doc_id bigint, text string").withColumn("n_near", F.lit("mine")).withColumn("pos", F.lit(1))
    got = sorted(((r.doc_id, r.n_lines, r.n_exact, r.n_near, r.text) for r in L.dedup_lines(df, tau=tau, min_chars=12).collect()), key=str)
    assert got == sorted(_plain(rows, tau, 12), key=str)


def test_short_lines_go_as_exact_repeats_only(spark):
    rows = [(1, "Ietzte.\n\nAll rights\n  \n"), (2, "Ietzte.\nAll right\n\n  \nAll rights"), (3, "Ietzte.")]
    df = frame(spark, rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_exact, r.n_near, r.text) for r in L.dedup_lines(df).collect()}
    assert got == {1: (0, 0, rows[0][1]), 2: (2, 0, "All right\n\n  "), 3: (1, 0, "")}
    assert {r.doc_id: r.n_exact for r in L.dedup_lines(df, short_repeats=False).collect()} == {1: 0, 2: 0, 3: 0}


def test_clashing_names(spark):
    names = ["k", "th", "_drop", "_near", "_h", "h", "line", "pos", "_row", "_key", "_text"]
    text = "one long line that repeats itself here\n" * 2
    df = frame(spark, [(1, text), (2, text)], "doc_id bigint, text string").select("doc_id", "text", *[F.lit(c).alias(c) for c in names])
    out = L.dedup_lines(df)
    rows = out.collect()
    assert out.columns[:-3] == df.columns and all(r[c] == c for r in rows for c in names) and sorted(r.n_exact for r in rows) == [1, 2]


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_bit_parallel_distance(spark):
    rng = random.Random(5)
    pairs = [(a, _changed(rng, a, rng.randint(0, 4), "abü")) for a in ("".join(rng.choice("abü") for _ in range(rng.randint(8, 16))) for _ in range(400))]
    df = spark.createDataFrame(pairs, "a string, b string")
    for tau in (1, 3):
        assert [r[0] for r in df.select(L.within(F.split("a", ""), F.split("b", ""), tau)).collect()] == [_edits(a, b) <= tau for a, b in pairs]
