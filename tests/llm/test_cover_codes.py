"""Vector codes: trees and assignment against full search, the whole operator against its SQL and plain Python."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import frame
from tests.oracle_harness import rows_of
from tidemark.llm import cover_codes as cc


def full_search(points, entries):
    return ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)


def codes_of(tree, points, entries):
    low, high, entry, _ = cc.assign(tree, points, entries)
    assert (high > low).all() and (high - low).sum() == len(points)
    out = np.full(len(points), -1)
    out[tree.order[cc._ragged(low, high - low)]] = np.repeat(entry, high - low)
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 5), st.integers(1, 40), st.sampled_from([1, 3, 50, 2**27]), st.integers(1, 30), st.integers(0, 2**32 - 1))
def test_assignment_equals_full_search(n, width, k, spread, leaf, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread + 1, (n, width))
    points[rng.random(n) < 0.3] = points[0]  # many equal points; small spreads give ties and equal entries
    entries = np.concatenate([points[:k], rng.integers(-spread, spread + 1, (k, width))])
    tree = cc.Tree.from_bytes(cc.build(points, leaf).to_bytes())
    assert (codes_of(tree, points, entries) == full_search(points, entries)).all()


def test_tree_covers_and_separates():
    rng = np.random.default_rng(2)
    points = rng.integers(-100, 100, (3000, 4))
    t = cc.build(points, 8)
    assert sorted(t.order) == list(range(3000))
    for k in range(len(t.low)):
        mine = points[t.order[t.low[k]:t.high[k]]]
        far = np.sqrt(((mine - points[t.centre[k]]) ** 2).sum(axis=1)).max()
        assert np.isclose(far, t.radius[k]) and (t.children[k] or t.high[k] - t.low[k] <= 8 or far == 0)
        kids = range(t.first[k], t.first[k] + t.children[k])
        if len(kids):
            assert t.low[kids[0]] == t.low[k] and t.high[kids[-1]] == t.high[k] and all(t.high[a] == t.low[a + 1] for a in kids[:-1])
            centres = points[t.centre[list(kids)]]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))[~np.eye(len(kids), dtype=bool)]
            assert (apart > t.radius[k] / 2).all() and all(t.radius[c] <= t.radius[k] / 2 for c in kids)


def test_most_points_are_never_compared_with_all_entries():
    rng = np.random.default_rng(3)
    points = rng.normal(0, 32, (8000, 4)).astype(np.int64)
    entries = points[:64]
    *_, exact = cc.assign(cc.build(points), points, entries)
    assert exact < 0.4 * 64 * len(points)


def plain(rows, entries=cc.ENTRIES):
    """Codes, errors, digest by the definition, with Python integers."""
    kept = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    w = len(kept[0][2]) // 16
    cut = [[v[p * w:(p + 1) * w] for p in range(16)] for _, _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(16)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        found = [[nearest(p, c[p])[1] for c in cut] for p in range(16)]
        for p in range(16):
            for e in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found[p]) if f == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    codes = [[nearest(p, c[p]) for p in range(16)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in c) for c in codes]
    total = {}
    for (_, lab, _), e in zip(kept, errors):
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in c), e, total[lab], digest) for (i, lab, _), c, e in zip(kept, codes, errors)), key=str)


def _rows(n, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(i % 4) if i % 7 else None, [float(np.float32(x)) for x in rng.normal(0, 0.3, dim)]) for i in rng.permutation(n)]
    hot = rows[0][2]
    rows += [(n + k, 1, hot) for k in range(n // 2)]  # one very common vector
    odd = [None, [*hot[:-1], None], [*hot[:-1], float("nan")], [float("-inf"), *hot[1:]]]
    return rows + [(-1 - k, 1, v) for k, v in enumerate(odd)]


SCHEMA = "vec_id bigint, label int, embedding array<float>, code string, _id int"


@pytest.mark.parametrize("n", [30, 300])
def test_equals_definition_and_sql(spark, n, monkeypatch):
    rows = _rows(n)
    monkeypatch.setattr(cc, "BLOCK", 70)  # several blocks a task
    df = frame(spark, [(*r, "x", 1) for r in rows], SCHEMA)
    coded, books = cc.compress(df)
    out = cc.with_label_error(coded)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, cc.codebook_digest(books)) for r in out.collect()), key=str)
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, label INT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    sql = con.execute(cc.SQL)
    names = [c[0] for c in sql.description]
    assert rows_of(["vec_id", "code", "error", "label_error", "codebooks_sha256"], got) == rows_of(names, sql.fetchall())


def test_odd_ids_lengths_and_sizes(spark):
    rows = [(5, None, [1.0, 2.0, 3.0]), (5, None, [1.0, 2.0, 3.0]), (None, 2, [0.5, 0.25, -3.0]), (7, 2, [1.0]), (8, 3, []), (9, 3, [1e300, -1e300, 0.0])]
    df = frame(spark, [(*r, "x", 1) for r in rows], SCHEMA.replace("float", "double"))
    coded, books = cc.compress(df)
    out = {(r.vec_id, r.label): r for r in cc.with_label_error(coded).collect()}
    assert set(out) == {(5, None), (None, 2), (9, 3)} and coded.count() == 4 and books.shape == (16, 4, 1)
    assert all(r.error == 0 and len(r.code) == 32 for r in out.values()) and out[5, None].code == "00" * 16
    for none in ([], [(1, 1, None, "x", 1)]):
        coded, books = cc.compress(frame(spark, none, SCHEMA))
        assert cc.with_label_error(coded).collect() == [] and books.size == 0
    coded, _ = cc.compress(frame(spark, [(1, 1, [], "x", 1), (2, 1, [], "x", 1)], SCHEMA))
    assert [(r.code, r.error) for r in coded.collect()] == [("00" * 16, 0)] * 2
