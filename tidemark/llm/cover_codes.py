"""Vector code compression: product codes learned by Lloyd rounds over cover trees.

A vector's components become integers floor(256 * x); the vector is cut into ``PARTS`` equal parts and every part is
coded by the nearest of its codebook's entries (squared Euclidean distance, ties to the lower index). The codebooks
start as the parts of the smallest ids and are improved by ``ROUNDS`` Lloyd rounds.

* **Trees.** Every task cuts its vectors into blocks of bounded size and builds one cover tree per block and part: a
  node's children have centres more than half its radius apart and cover its points within half its radius; small
  nodes are not split. A node's points are one range of the tree's order, so the sums and counts of any subtree are
  differences of cumulative sums. The trees are built once and checkpointed, and serve every round.
* **Assignment.** Starting with all entries at the root, an entry leaves a node's candidates when it is further from
  the centre than the best one by more than the node's diameter. A node with one candidate left is assigned whole,
  by the triangle inequality; only ambiguous nodes descend, and only ambiguous smallest nodes compare their points
  exactly, in integers. All nodes of a level are worked on at once.

Per round the tasks send at most PARTS * entries sums, and the codebooks are all that is broadcast; vectors are never
shuffled. Results do not depend on how the rows are dealt.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small

PARTS, ENTRIES, ROUNDS = 16, 64, 2
# Vectors and components in one block at most, points of a node that is not split.
BLOCK, BLOCK_VALUES = 16_384, 1 << 20
LEAF = 24


@dataclass
class Tree:
    order: np.ndarray  # points; a node owns order[low:high]
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray  # a point of the node
    radius: np.ndarray
    first: np.ndarray  # first child; children follow one another
    children: np.ndarray  # 0 in a node that is not split

    def to_bytes(self) -> bytes:
        ints = [self.low, self.high, self.centre, self.first, self.children]
        head = np.array([len(self.order), len(self.low)], np.int32)
        return b"".join([head.tobytes(), self.order.astype(np.int32).tobytes(), *[x.astype(np.int32).tobytes() for x in ints], self.radius.tobytes()])

    @staticmethod
    def from_bytes(raw: bytes) -> Tree:
        n, nodes = np.frombuffer(raw, np.int32, 2)
        ints = np.frombuffer(raw, np.int32, n + 5 * nodes, 8).astype(np.int64)
        radius = np.frombuffer(raw, np.float64, nodes, 8 + 4 * int(n + 5 * nodes))
        low, high, centre, first, children = ints[n:].reshape(5, nodes)
        return Tree(ints[:n], low, high, centre, radius, first, children)


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Cover tree of integer points (n x width, n > 0), nodes in breadth-first order."""
    p = points.astype(np.float64)
    order = np.arange(len(p))
    dist = np.sqrt(((p - p[0]) ** 2).sum(axis=1))  # of every point (in tree order) to its node's centre
    low, high, centre, radius = [0], [len(p)], [0], [float(dist.max())]
    first, children = [], []
    node = 0
    while node < len(low):
        a, b, r = low[node], high[node], radius[node]
        first.append(len(low))
        if b - a <= leaf or r == 0.0:
            children.append(0)
            node += 1
            continue
        half, at, rest, d = r / 2, a, order[a:b].copy(), dist[a:b].copy()
        c = centre[node]
        while True:  # the node's own centre first, then the first point that is not yet covered
            near = d <= half
            mine, its = rest[near], d[near]
            end = at + len(mine)
            order[at:end], dist[at:end] = mine, its
            low.append(at), high.append(end), centre.append(c), radius.append(float(its.max()))
            at = end
            if at == b:
                break
            rest = rest[~near]
            c = int(rest[0])
            step = p[rest] - p[c]
            d = np.sqrt(np.einsum("ij,ij->i", step, step))
        children.append(len(low) - first[node])
        node += 1
    return Tree(order, *(np.array(x, np.int64) for x in (low, high, centre)), np.array(radius), np.array(first, np.int64), np.array(children, np.int64))


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... (counts[i] of them) for every i, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _first_least(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive groups of ``counts`` values the place of the first least one."""
    starts = np.cumsum(counts) - counts
    group = np.repeat(np.arange(len(counts)), counts)
    hit = np.flatnonzero(d == np.minimum.reduceat(d, starts)[group])
    g = group[hit]
    return hit[np.concatenate(([True], g[1:] != g[:-1]))]


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(first, end, entry) of ranges of ``tree.order``, each coded alike, and how many exact comparisons it took.

    Ranges cover every point once. ``entries`` (k x width) are integers; of equal ones the first is ever chosen.
    """
    _, distinct = np.unique(entries, axis=0, return_index=True)
    cand = np.sort(distinct)  # in the order of the index, so that the first least one wins ties
    nodes, counts = np.zeros(1, np.int64), np.array([len(cand)])
    out, exact = [], 0
    while len(nodes):
        step = points[np.repeat(tree.centre[nodes], counts)] - entries[cand]
        square = np.einsum("ij,ij->i", step, step)
        d, r = np.sqrt(square.astype(np.float64)), tree.radius[nodes]
        starts = np.cumsum(counts) - counts
        bound = np.minimum.reduceat(d, starts) + 2 * r
        keep = d <= np.repeat(bound, counts) * (1 + 1e-9)  # the margin is far above the rounding error
        least = _first_least(square, counts)
        left = np.add.reduceat(keep.astype(np.int64), starts)
        whole = (left == 1) | (r == 0.0)  # equal points are all as far as their centre is
        out.append((tree.low[nodes[whole]], tree.high[nodes[whole]], cand[least[whole]]))
        go_on = keep & ~np.repeat(whole, counts)
        nodes, counts, cand = nodes[~whole], left[~whole], cand[go_on]
        first = np.cumsum(counts) - counts
        end = tree.children[nodes] == 0
        if end.any():
            size = tree.high[nodes[end]] - tree.low[nodes[end]]
            at = _ragged(tree.low[nodes[end]], size)
            of = np.repeat(np.flatnonzero(end), size)
            picked = cand[_ragged(first[of], counts[of])]
            step = points[np.repeat(tree.order[at], counts[of])] - entries[picked]
            exact += len(picked)
            if len(picked):
                out.append((at, at + 1, picked[_first_least(np.einsum("ij,ij->i", step, step), counts[of])]))
        inner = np.flatnonzero(~end)
        kids = tree.children[nodes[inner]]
        of = np.repeat(inner, kids)
        nodes = _ragged(tree.first[nodes[inner]], kids)
        cand, counts = cand[_ragged(first[of], counts[of])], counts[of]
    return *(np.concatenate(x) for x in zip(*out)), exact


def _blocks(df: DataFrame, key: str, label: str, dim: int, width: int, limit: int) -> DataFrame:
    """(ids, labels, points, trees) per block: integers of all components and the trees of all parts."""
    rows = max(1, min(BLOCK, BLOCK_VALUES // max(dim, 1)))
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            n = t.num_rows
            values = t.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(256.0 * values.astype(np.float64)), -limit, limit).astype(np.int32)
            points = np.zeros((n, PARTS * width), np.int32)
            points[:, :dim] = whole
            trees = [build(points[:, k * width:(k + 1) * width]).to_bytes() for k in range(PARTS)]
            listed = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), t.column(c).combine_chunks()) for c in (0, 1)]
            return pa.RecordBatch.from_arrays([*listed, pa.array([points.tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))],
                                              names=["ids", "labels", "points", "trees"])

        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == rows:
                    yield block(held)
                    held, count = [], 0
        if held:
            yield block(held)

    return df.mapInArrow(run, f"ids array<{fields[key]}>, labels array<{fields[label]}>, points binary, trees array<binary>")


def _open(batch: pa.RecordBatch, row: int, width: int) -> Iterator[tuple[int, Tree, np.ndarray]]:
    """(part, tree, points of the part) of a block."""
    points = np.frombuffer(batch.column("points")[row].as_py(), np.int32).reshape(-1, PARTS, width).astype(np.int64)
    for k, raw in enumerate(batch.column("trees")[row].as_py()):
        yield k, Tree.from_bytes(raw), np.ascontiguousarray(points[:, k])


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts x entries x width) after one Lloyd round."""
    spark, (_, k, width) = blocks.sparkSession, books.shape
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, k, width + 1), np.int64)  # components, then the count
        for batch in batches:
            for row in range(batch.num_rows):
                for part, tree, points in _open(batch, row, width):
                    low, high, entry, _ = assign(tree, points, shared.value[part])
                    upto = np.zeros((len(points) + 1, width + 1), np.int64)
                    np.cumsum(points[tree.order], axis=0, out=upto[1:, :width])
                    upto[:, width] = np.arange(len(points) + 1)
                    np.add.at(sums[part], entry, upto[high] - upto[low])
        at = np.nonzero(np.broadcast_to(sums[:, :, -1:] > 0, sums.shape))
        yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in at], pa.array(sums[at])], names=["part", "entry", "position", "value"])

    got = (blocks.mapInArrow(run, "part int, entry int, position int, value bigint").groupBy("part", "entry", "position")
           .agg(F.sum("value").alias("value")).toArrow())
    sums = np.zeros((PARTS, k, width + 1), np.int64)
    sums[tuple(got.column(c).to_numpy() for c in ("part", "entry", "position"))] = got.column("value").to_numpy()
    shared.unpersist()
    used = sums[:, :, -1:] > 0
    return np.where(used, sums[:, :, :-1] // np.maximum(sums[:, :, -1:], 1), books)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error) of every usable vector, and the final codebooks (parts x entries x width).

    ``code`` holds the entry indices in part order, two hex digits each (``entries`` <= 256); ``error`` is the squared
    distance to the coded vector, in integer steps of 1/256. Other columns are not returned.

    Dropped are null vectors, those with a null or non-finite component, and those whose length is not that of the
    smallest id's vector. A length that ``PARTS`` does not divide is filled up with zeros. With fewer than ``entries``
    vectors every vector is an entry. Of equal ids the smaller vector comes first; a null id comes last. Components
    beyond the range in which squared distances fit 64 bits (|x| > 2**18 at 64 dimensions) are held at its edge.
    """
    spark = df.sparkSession
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = df.filter(F.col(vector).isNotNull() & finite).select(F.col(key).alias("_id"), F.col(label).alias("_label"), x.alias("_x"))
    start = usable.orderBy(F.col("_id").asc_nulls_last(), "_x").limit(1).select(F.size("_x")).first()
    dim = start[0] if start else 0
    usable = usable.filter(F.size("_x") == dim)
    width = max(1, -(-dim // PARTS))
    limit = min(math.isqrt((1 << 61) // (PARTS * width)) // 2, 2**30)
    head = usable.orderBy(F.col("_id").asc_nulls_last(), "_x").limit(entries).select("_x").toArrow().column(0).to_pylist()
    books = np.zeros((len(head), PARTS * width), np.int64)
    if head and dim:
        with np.errstate(over="ignore"):
            books[:, :dim] = np.clip(np.floor(256.0 * np.array(head)), -limit, limit)
    books = books.reshape(len(head), PARTS, width).transpose(1, 0, 2).copy()
    blocks = _blocks(usable, "_id", "_label", dim, width, limit).checkpoint()
    for _ in range(rounds if head else 0):
        books = _round(blocks, books)
    shared = spark.sparkContext.broadcast(books)
    types = {f.name: f.dataType.simpleString() for f in usable.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes = error = None
                for part, tree, points in _open(batch, row, width):
                    if codes is None:
                        codes, error = np.zeros((len(points), PARTS), np.uint8), np.zeros(len(points), np.int64)
                    low, high, entry, _ = assign(tree, points, shared.value[part])
                    of = np.empty(len(points), np.int64)
                    of[tree.order[_ragged(low, high - low)]] = np.repeat(entry, high - low)
                    step = points - shared.value[part][of]
                    codes[:, part] = of
                    error += np.einsum("ij,ij->i", step, step)
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(row, 1).flatten(), batch.column("labels").slice(row, 1).flatten(),
                                                  pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["_id", "_label", "code", "error"])

    coded = blocks.mapInArrow(run, f"_id {types['_id']}, _label {types['_label']}, code string, error bigint")
    return coded.select(F.col("_id").alias(key), F.col("_label").alias(label), "code", "error"), books


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 (lowercase hex) of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_error``: the errors of all vectors with the row's label (nulls together); null beyond 64 bits."""
    total = coded.groupBy(F.col(label).alias("_l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")).checkpoint()
    return coded.join(small(total, total.count()), F.col(label).eqNullSafe(F.col("_l"))).drop("_l")


def op13_vector_codes(spark, sf_dir):
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = with_label_error(coded.checkpoint())
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    nearest = """
a{n} AS (SELECT id, x.p, arg_min(e, ({sq}) * 64 + e) AS e, min({sq}) AS sq FROM x JOIN c{n} c ON x.p = c.p GROUP BY id, x.p),""".replace(
        "{sq}", " + ".join(f"(x.{v} - c.{v}) * (x.{v} - c.{v})" for v in "abcd"))
    mean = "coalesce((s.{v} - ((s.{v} % s.n) + s.n) % s.n) // s.n, c.{v}) AS {v}"
    update = f"""
s{{n}} AS (SELECT a.p, a.e, count(*) AS n, {', '.join(f'CAST(sum(x.{v}) AS BIGINT) AS {v}' for v in 'abcd')} FROM a{{n}} a JOIN x ON a.id = x.id AND a.p = x.p GROUP BY a.p, a.e),
c{{m}} AS (SELECT c.p, c.e, {', '.join(mean.format(v=v) for v in 'abcd')} FROM c{{n}} c LEFT JOIN s{{n}} s ON s.p = c.p AND s.e = c.e),"""
    rounds = "".join(nearest.replace("{n}", str(n)) + update.replace("{n}", str(n)).replace("{m}", str(n + 1)) for n in range(ROUNDS))
    last = nearest.replace("{n}", str(ROUNDS))
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS v
              FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS (SELECT id, p, v[4 * p + 1] AS a, v[4 * p + 2] AS b, v[4 * p + 3] AS c, v[4 * p + 4] AS d FROM kept, (SELECT unnest(range({PARTS})) AS p)),
c0 AS (SELECT p, id - 1 AS e, a, b, c, d FROM x WHERE id <= {ENTRIES}),{rounds}{last}
coded AS (SELECT id, string_agg(lpad(printf('%x', CAST(e AS INT)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(sq) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id),
book AS (SELECT sha256(string_agg(a || ',' || b || ',' || c || ',' || d, ',' ORDER BY p, e)) AS digest FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM kept JOIN coded USING (id), book"""


SQL = _sql()
