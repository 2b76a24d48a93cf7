"""Filter audit against plain per-document simulation of every order, and against its SQL on hostile rows."""

from itertools import permutations

import duckdb
import pytest

from tests.llm.helpers import WORD, frame
from tests.oracle_harness import rows_of
from tidemark.llm import filter_audit as fa

DOCS = "doc_id bigint, text string, source string, mask int, h string, part string, n int"
LABELS = "doc_id bigint, quality int, toxic int, good string"
GOOD = " ".join(f"word{i}" for i in range(60))


def brute(docs, labels):
    good = {i for i, q, *_ in labels if q == 1}
    toxic = {i for i, _, t, *_ in labels if t == 1}
    out = {}
    for i, text, source, *_ in docs:
        x, ws = text or "", WORD.findall(text or "")
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws),
                 "C": 100 * sum("A" <= c <= "Z" for c in x) > 5 * len(x), "D": any(c in "#$%&*|" for c in x),
                 "E": i is not None and any(j is not None and j < i and (t or "") == x for j, t, *_ in docs)}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, c in enumerate(order, 1):
                row = out.setdefault((source or "", order, step), [0] * 6)
                lost = fails[c] and not gone
                for k, hit in enumerate((not gone and not fails[c], lost, fails[c] and gone, [f for f in fails if fails[f]] == [c],
                                         lost and i is not None and i in good, lost and i is not None and i in toxic)):
                    row[k] += hit
                gone = gone or fails[c]
    shapley = {}
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + row[1]
    return {(p, o, s, *row, shapley[p, o[s - 1]]) for (p, o, s), row in out.items()}


def hostile():
    texts = [None, "", " \t\n", GOOD, GOOD, GOOD, GOOD + " #", GOOD.upper(), "a " * 200, "\x85".join(["x"] * 70), "É" * 40 + "A", "A" + "b" * 19,
             "word " * 49 + "$", "lo ng " * 40_000, " ".join(str(k % 39) for k in range(60)), " ".join(str(k % 38) for k in range(60)), "\x1f".join("ab")]
    rows = [(k, t, ("s1", "s2", None, "")[k % 4]) for k, t in enumerate(texts)]
    rows += [(3, GOOD, "s1"), (3, GOOD, "s1"), (None, GOOD, "s2"), (None, GOOD, None), (None, None, "s1"), (40, GOOD + " #", "s2"), (3, "other", "s2")]
    labels = [(0, 1, 0), (3, 1, 1), (3, 0, 0), (4, None, 1), (6, 0, 1), (7, 1, None), (None, 1, 1), (99, 1, 1), (40, 2, 1)]
    return [(*r, 1, "x", "y", 2) for r in rows], [(*r, "z") for r in labels]


def test_equals_simulation_and_sql(spark):
    docs, labels = hostile()
    d, lab = frame(spark, docs, DOCS), frame(spark, labels, LABELS)
    got = fa.audit(fa.document_failures(d, lab))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 600 * 3
    assert set(rows) == brute(docs, labels)
    con = duckdb.connect()
    con.register("documents", d.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", lab.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    sql = con.execute(fa.SQL)
    names = [c[0] for c in sql.description]
    assert rows_of(got.columns, rows) == rows_of(names, sql.fetchall())


def test_empty_tables(spark):
    none = frame(spark, [], DOCS)
    assert fa.audit(fa.document_failures(none, frame(spark, [], LABELS))).collect() == []
    one = fa.audit(fa.document_failures(frame(spark, [(1, GOOD, "s", 0, "", "", 0)], DOCS), frame(spark, [], LABELS))).collect()
    assert len(one) == 600 and all(r.kept == 1 and r.removed == r.good_lost == r.shapley == 0 for r in one)


@pytest.mark.parametrize("n", [1, 2**31, 2**62])
def test_fields_do_not_overflow(spark, n):
    rows = [("p", 31, True, False, n), ("p", 31, True, False, 5), ("p", 0, False, True, 7)]
    counts = frame(spark, rows, "part string, mask int, good boolean, toxic boolean, n bigint")
    got = {(r.filter_order, r.step): r for r in fa.audit(counts, "ABCDE").collect()}
    for order in map("".join, permutations("ABCDE")):
        assert (got[order, 1].removed, got[order, 1].good_lost, got[order, 1].kept, got[order, 1].redundant) == (n + 5, n + 5, 7, 0)
        assert all((got[order, s].removed, got[order, s].redundant, got[order, s].kept) == (0, n + 5, 7) for s in range(2, 6))


def test_other_filter_sets(spark):
    counts = frame(spark, [("p", 1, False, False, 3), ("p", 3, False, True, 2)], "part string, mask int, good boolean, toxic boolean, n bigint")
    got = {(r.filter_order, r.step): (r.removed, r.redundant, r.toxic_lost, r.shapley) for r in fa.audit(counts, "XY").collect()}
    assert got == {("XY", 1): (5, 0, 2, 8), ("XY", 2): (0, 2, 0, 2), ("YX", 1): (2, 0, 2, 2), ("YX", 2): (3, 2, 0, 8)}
