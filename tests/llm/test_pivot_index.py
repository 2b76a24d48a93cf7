import numpy as np
import pytest

from tests.llm.helpers import frame
from tidemark.llm import pivot_index as P


def _plain(rows, threshold=0.98):
    ok = [v is not None and lab is not None and k is not None and None not in v and np.isfinite(v).all() and np.any(v) for k, v, lab in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if o else None for (k, v, lab), o in zip(rows, ok)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for j in range(len(rows)):
        for i in range(j):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return [(r[0], n[i], low.get(find(i)), r[0] is None or low[find(i)] == r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [5, P.BLOCK])
def test_links_and_components(spark, block):
    rng = np.random.default_rng(1)
    rows = []
    for f in range(12):
        base = rng.normal(size=32)
        rows += [(1000 - len(rows) - k, (base + rng.normal(size=32) * 0.05).astype(np.float32).tolist(), f % 3) for k in range(10)]
    rows += [(2000 + k, rng.normal(size=32).astype(np.float32).tolist(), k % 3) for k in range(100)]
    rows += [(3000 + k, rows[0][1], rows[0][2]) for k in range(4)] + [(3000, rows[0][1], rows[0][2]), (3100, rows[0][1], None), (None, rows[0][1], 0)]
    rows += [(4000, None, 1), (4001, [0.0] * 32, 1), (4002, [float("nan")] * 32, 1), (4003, [float("inf")] + [1.0] * 31, 1), (4004, [None] + [1.0] * 31, 1),
             (4005, [], 1), (4006, [1.0, 2.0], 1), (4007, [2.0, 4.0], 1), (4008, [-0.0, 1.0], 2), (4009, [0.0, 1.0], 2), (4010, [1e-30] * 32, 1), (4011, [1e30] * 32, 1)]
    df = frame(spark, rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 AS links", "true AS ok")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in P.near_duplicates(df, "vec_id", "embedding", "label", block=block).collect()]
    want = _plain(rows)
    assert len(got) == len(rows)
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want) > 0
    assert sorted(got, key=str) == sorted(want, key=str)  # this sample is found whole


def test_empty_table(spark):
    assert P.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int"), "vec_id", "embedding", "label").collect() == []


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a + rng.normal(size=(600, 64)) * 0.0245  # cosines about 0.98
    rows = [(i, x.astype(np.float32).tolist(), 0) for i, x in enumerate(np.concatenate((a, b)))]
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = int((np.triu(u @ u.T, 1) >= 0.98).sum())
    got = sum(r.n_links for r in P.near_duplicates(frame(spark, rows, "vec_id bigint, embedding array<float>, label int"), "vec_id", "embedding", "label").collect()) // 2
    assert want > 100 and 0.9 * want <= got <= want


@pytest.mark.parametrize("kind", ["third", "whole", "axes"])
def test_recall_in_noisy_families(spark, kind):
    """A third of the rows, or all, in one family of unequal near copies; families about axes, alike far from all others."""
    rng = np.random.default_rng(6)
    family = lambda base, n: base / np.linalg.norm(base) + rng.normal(size=(n, 64)) * 0.14 / 8
    if kind == "axes":
        x = np.concatenate([family(np.eye(64)[k], 20) for k in range(40)])
    else:
        x = np.concatenate((family(rng.normal(size=64), 500), rng.normal(size=(1000 if kind == "third" else 0, 64))))
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = int((np.triu(u @ u.T, 1) >= 0.98).sum())
    got = sum(r.n_links for r in P.near_duplicates(frame(spark, rows, "vec_id bigint, embedding array<float>, label int"), "vec_id", "embedding", "label").collect()) // 2
    assert want > 1000 and 0.9 * want <= got <= want


@pytest.mark.parametrize("cosine", [0.5, 0.8])
def test_common_direction_is_taken_off(spark, cosine):
    """Vectors with a common direction, as trained encoders give: most are told apart, and near pairs are found."""
    rng = np.random.default_rng(2)
    c = np.eye(64)[0]
    r = rng.normal(size=(2000, 64))
    r[:, 0] = 0
    x = np.sqrt(cosine) * c + np.sqrt(1 - cosine) * r / np.linalg.norm(r, axis=1, keepdims=True)
    x = np.concatenate((x, x[:400] + rng.normal(size=(400, 64)) * 0.15 / 8))
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = int((np.triu(u @ u.T, 1) >= 0.98).sum())
    df = frame(spark, rows, "vec_id bigint, embedding array<float>, label int")
    got = sum(r.n_links for r in P.near_duplicates(df, "vec_id", "embedding", "label").collect()) // 2
    assert want > 300 and 0.9 * want <= got <= want
    reps = df.selectExpr("vec_id AS id", "CAST(label AS string) AS label", "embedding AS vec", "1L AS copies", "64 AS dim")
    placed = P.with_means(reps)
    signed = P.signatures(placed, P.pick_pivots(placed))
    assert signed.filter("lost").count() < 0.3 * len(rows)


def test_signs_drop_no_pair_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g = rng.normal(size=a.shape)
    g -= (g * a).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    planes = np.random.default_rng(1).normal(size=(64, P.BITS))
    assert (((a @ planes > 0) != (b @ planes > 0)).sum(axis=1) <= P.most_differences(0.98)).all()
    assert 10 < P.most_differences(0.98) < 30
