"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest of ``PIVOTS`` reference points in order. Vectors close to each
other share many of them, so the index is an inverted list per pivot combination: two vectors of one label are
candidates when they share at least ``SHARED`` of their nearest pivots, that is when they meet in the list of some
combination of ``SHARED`` pivots. A pair meeting in several lists is handled only in the list of its lowest shared
pivots. Candidates are verified by the exact cosine.

* Where the vectors of a label have a common direction (their mean has a squared length of ``COMMON`` or more), the
  label's mean is taken off before vectors are held against pivots; cosines are always those of the whole vectors.
* Pivots are picked from a bounded sample (``SAMPLE`` distinct vectors per length, by hash) so that no two have a
  cosine of ``APART`` or more: a family of near copies holds one pivot, however large it is. Of few pivots any two
  vectors share ``SHARED``, so a table that is one family is compared whole. All vectors are indexed.
* A vector whose nearest pivots do not tell it apart is *unsure*: of ``PROBES`` points at the threshold from it,
  fewer than ``SURE`` would meet it. It is in no list of pivots and is compared with all vectors of its label.
* Lists carry no vectors but ``BITS`` signs of random projections. Pairs whose signs differ in more places than pairs
  at the threshold do but once in a million times are dropped; vectors are sent only to the lists where an entry has a
  partner left, and there the exact cosine decides.
* Equal vectors of one label are collapsed first, so a vector repeated in a third of all rows is one entry.
* Long lists are cut into blocks of ``BLOCK`` vectors and worked on block pair by block pair. A task sends link
  counts and a spanning forest of the links it found, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forest, lowest_per_group, small, whole_groups
from tidemark.llm.components import connected_components

PIVOTS = 64  # a bit set of 64 bits holds a vector's pivots
NEAREST = 6
SHARED = 3
BLOCK = 512
SAMPLE = 1024
APART = 0.7
PROBES = 16
SURE = 0.9
THRESHOLD = 0.98
COMMON, COMMON_ROWS = 0.25, 64  # least squared length of a label's mean, least rows
BITS = 128


def usable(vec: str, label: str):
    """Rows that can link: a label and a vector of finite numbers, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest entry first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def with_means(reps: DataFrame, common: float = COMMON, least: int = COMMON_ROWS) -> DataFrame:
    """Add ``mean``: the mean of the label's unit vectors of that length, where it is long enough; else null."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}

        def rows():
            keys = [k for k, v in total.items() for _ in v]
            values = np.concatenate([np.empty(0), *total.values()])
            at = np.concatenate([np.empty(0, int), *[np.arange(len(v)) - 1 for v in total.values()]])  # -1: the number of vectors
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(at.astype(np.int32)), pa.array(values)],
                                              names=["label", "dim", "at", "s"])

        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = _unit(_matrix(part.column(2)))
                names, of = np.unique(np.array(part.column(0).to_pylist(), object), return_inverse=True)
                add = np.zeros((len(names), x.shape[1] + 1))
                np.add.at(add, of, np.concatenate([np.ones((len(x), 1)), x], axis=1))
                for name, v in zip(names, add):
                    total[name, int(d)] = total.get((name, int(d)), 0) + v
            if len(total) > 10_000:
                yield rows()
                total.clear()
        yield rows()

    long = reps.select("label", "dim", "vec").mapInArrow(sums, "label string, dim int, at int, s double").groupBy("label", "dim", "at").agg(F.sum("s").alias("s"))
    table = long.groupBy("label", "dim").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("v")).select(
        F.col("label").alias("_l"), F.col("dim").alias("_d"), F.col("v")[0]["s"].alias("_n"), F.transform(F.slice("v", 2, 1 << 30), lambda e: e["s"]).alias("_s"))
    mean = F.transform("_s", lambda e: e / F.col("_n"))
    table = table.filter(F.col("_n") >= least).withColumn("mean", mean).filter(F.aggregate("mean", F.lit(0.0), lambda a, e: a + e * e) >= common).drop("_n", "_s").checkpoint()
    return reps.join(small(table, table.count(), 50_000), (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")), "left").drop("_l", "_d")


def _means(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    have = column.is_valid().to_numpy(zero_copy_only=False)
    if have.any():
        out[have] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def pick_pivots(reps: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, apart: float = APART) -> dict[int, np.ndarray]:
    """Up to ``pivots`` vectors (less their ``mean``) per vector length, by hash, with cosines under ``apart`` to each other."""
    rows = lowest_per_group(reps, "dim", max(pivots, sample), [F.xxhash64("vec"), F.col("id")]).select("dim", "_n", "vec", "mean").collect()
    seen: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.dim, r._n)):
        x = _unit(np.array([r.vec], np.float64))[0] - (np.array(r.mean) if r.mean else 0.0)
        if np.any(x):
            seen.setdefault(r.dim, []).append(x)
    out = {}
    for d, v in seen.items():
        x = _unit(np.array(v))
        free, kept = np.ones(len(x), bool), []
        while free.any() and len(kept) < pivots:
            kept.append(int(free.argmax()))
            free &= x @ x[kept[-1]] < apart
            free[kept[-1]] = False
        out[d] = x[kept]
    return out


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST, means: np.ndarray | float = 0.0) -> np.ndarray:
    """The ordered numbers of each vector's nearest pivots by cosine, less its mean (ties: lower number first)."""
    return np.argsort(-((vectors - means) @ pivots.T), axis=1, kind="stable")[:, :nearest]


def unsure(x: np.ndarray, pivots: np.ndarray, near: np.ndarray, threshold: float, shared: int = SHARED,
           probes: int = PROBES, sure: float = SURE, means: np.ndarray | None = None) -> np.ndarray:
    """Which unit vectors share their nearest pivots with too few of the points at cosine ``threshold`` from them."""
    out = np.zeros(len(x), bool)
    nearest = near.shape[1]
    if 2 * nearest - len(pivots) >= min(shared, nearest):  # any two vectors share that many
        return out
    g = np.random.default_rng(0).normal(size=(probes, x.shape[1]))
    toward, length = g @ pivots.T, (g * g).sum(axis=1)
    away = np.sqrt(max(0.0, 1 - threshold * threshold))
    for a in range(0, len(x), 2048):
        part = x[a:a + 2048]
        cos, along = part @ pivots.T, part @ g.T
        across = np.sqrt(np.maximum(length - along * along, 1e-12))
        y = threshold * cos[:, None, :] + (away / across)[:, :, None] * (toward - along[:, :, None] * cos[:, None, :])
        if means is not None:
            y -= (means[a:a + 2048] @ pivots.T)[:, None, :]
        top = np.argpartition(-y, nearest - 1, axis=2)[:, :, :nearest]
        own = np.zeros(cos.shape, bool)
        np.put_along_axis(own, near[a:a + 2048], True, axis=1)
        met = np.take_along_axis(own[:, None, :], top, axis=2).sum(axis=2) >= shared
        out[a:a + 2048] = met.mean(axis=1) < sure
    return out


def signatures(reps: DataFrame, pivots: dict[int, np.ndarray], nearest: int = NEAREST, shared: int = SHARED,
               threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """(id, label, dim, copies, mask: the pivots as bits, lost: unsure, s0, s1: signs of projections), checkpointed."""
    points = reps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = _unit(_matrix(part.column(4)))
                means, p = _means(part.column(5), x.shape[1]), points.value.get(int(d), np.empty((0, int(d))))
                near = nearest_pivots(x, p, nearest, means)
                lost = unsure(x, p, near, threshold, shared, means=means)
                mask = np.bitwise_or.reduce(np.uint64(1) << near.astype(np.uint64), axis=1)
                up = x @ np.random.default_rng(1).normal(size=(int(d), bits)) > 0
                signs = np.packbits(up, axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(mask.view(np.int64)), pa.array(lost), pa.array(signs[:, 0].copy()), pa.array(signs[:, 1].copy())],
                                                 names=["id", "label", "dim", "copies", "mask", "lost", "s0", "s1"])

    return reps.select("id", "label", "dim", "copies", "vec", "mean").mapInArrow(
        run, "id bigint, label string, dim int, copies bigint, mask bigint, lost boolean, s0 bigint, s1 bigint").checkpoint()


def index_entries(signed: DataFrame, shared: int = SHARED) -> DataFrame:
    """A row per vector and list, with ``list``: the list's pivots as bits, and ``hub``.

    List 0 holds all vectors; its hubs, the unsure ones, are compared with all of it. Other lists have hubs only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, lost = batch.column(4).to_numpy().view(np.uint64), batch.column(5).to_numpy(zero_copy_only=False)
            at, lists = [np.arange(len(mask))], [np.zeros(len(mask), np.uint64)]
            held = np.bitwise_count(mask)
            for n in np.unique(held[~lost]):
                rows = np.flatnonzero((held == n) & ~lost)
                rest, pivots = mask[rows].copy(), []
                for _ in range(int(n)):
                    pivots.append(rest & (~rest + np.uint64(1)))
                    rest ^= pivots[-1]
                for combo in combinations(range(int(n)), min(shared, int(n))):
                    at.append(rows)
                    lists.append(np.bitwise_or.reduce([pivots[k] for k in combo], axis=0))
            at, lists = np.concatenate(at), np.concatenate(lists)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(lists.view(np.int64)), pa.array((lists != 0) | lost[at])],
                                             names=[*batch.schema.names, "list", "hub"])

    return signed.mapInArrow(run, "id bigint, label string, dim int, copies bigint, mask bigint, lost boolean, s0 bigint, s1 bigint, list bigint, hub boolean")


def _lowest(x: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` lowest set bits of every entry."""
    out, rest = np.zeros_like(x), x.copy()
    for _ in range(n):
        low = rest & (~rest + np.uint64(1))
        out |= low
        rest ^= low
    return out


def most_differences(threshold: float, bits: int = BITS) -> int:
    """Signs in which pairs at the threshold differ at most, but once in a million times."""
    p = np.arccos(threshold) / np.pi
    chance, upto = (1 - p) ** bits, 0
    total = chance
    while total < 1 - 1e-6 and upto < bits:
        chance *= (bits - upto) / (upto + 1) * p / (1 - p)
        upto += 1
        total += chance
    return upto


def _meet(m1, m2, b1, b2, s1, s2, lists, i, j, shared, most) -> np.ndarray:
    """Whether entries of one list and block pair are a pair to be looked at here (arrays that broadcast)."""
    counts = np.bitwise_count(lists).astype(np.int64)
    lowest = _lowest(m1 & m2, shared)
    if (counts < shared).any():  # shorter lists: those of fewer pivots than ``shared``, and list 0
        lowest = np.where(counts == 0, np.uint64(0), lowest)
    near = sum(np.bitwise_count(x ^ y).astype(np.int16) for x, y in zip(s1, s2)) <= most
    return near & (lowest == lists) & ((i == j) | (b1 != b2))


def screen(rows: DataFrame, threshold: float, shared: int) -> DataFrame:
    """Entries of ``rows`` (sorted by g, whole groups in a partition) that have a partner left in their block pair."""
    most = most_differences(threshold)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            g, i, j, b = (batch.column(names.index(c)).to_numpy() for c in ("g", "i", "j", "b"))
            mask, lists, s0, s1 = (batch.column(names.index(c)).to_numpy().view(np.uint64) for c in ("mask", "list", "s0", "s1"))
            cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
            size = np.repeat(np.diff(cuts), np.diff(cuts))
            hit = np.zeros(len(g), bool)
            tiny = size <= 32
            for step in range(1, int(size[tiny].max(initial=1))):  # all small groups at once, neighbours at every distance
                a = np.flatnonzero(tiny[:-step] & (g[step:] == g[:-step]))
                c = a + step
                a, c = (x[_meet(mask[a], mask[c], b[a], b[c], (s0[a], s1[a]), (s0[c], s1[c]), lists[a], i[a], j[a], shared, most)] for x in (a, c))
                hit[a] = hit[c] = True
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z - a > 32:
                    pair = _meet(mask[a:z, None], mask[None, a:z], b[a:z, None], b[None, a:z], (s0[a:z, None], s1[a:z, None]), (s0[None, a:z], s1[None, a:z]),
                                 lists[a:z, None], i[a], j[a], shared, most)
                    np.fill_diagonal(pair, False)
                    hit[a:z] = pair.any(axis=1)
            yield batch.filter(pa.array(hit))

    return rows.mapInArrow(run, rows.schema)


def find_links(signed: DataFrame, reps: DataFrame, threshold: float, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """(id, links, root): per list and block pair, the copies linked to a vector and a smaller connected id."""
    where = ["label", "dim", "list"]
    entries = index_entries(signed, shared)
    # lists of more than one block, and those with vectors that are not hubs; the other lists are one block
    sizes = entries.groupBy(*where).agg(F.count_if("hub").alias("_h"), F.count("*").alias("_m")).filter("_h > 0 and _m > 1 and (_h > %d or _m > _h or list = 0)" % block)
    sizes = sizes.select(*[F.col(c).alias(f"_{c}") for c in where], F.ceil(F.col("_h") / block).cast("int").alias("_hubs"),
                         F.ceil((F.col("_m") - F.col("_h")) / block).cast("int").alias("_others")).checkpoint()
    on = [F.col(c) == F.col(f"_{c}") for c in where]
    # the hubs' blocks come first and meet every block, the others' blocks meet those of the hubs
    rows = entries.join(small(sizes, sizes.count()), on, "left").filter("_hubs is not null or list <> 0").na.fill({"_hubs": 1, "_others": 0})
    place = F.when(F.col("hub"), F.expr("pmod(xxhash64(id), _hubs)")).otherwise(F.expr("_hubs + pmod(xxhash64(id), _others)"))
    rows = rows.withColumn("_b", place.cast("int"))
    rows = rows.withColumn("_o", F.explode(F.expr("sequence(0, IF(hub, _hubs + _others, _hubs) - 1)")))
    rows = rows.withColumn("_pair", F.struct(F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j")))
    rows = rows.select(F.xxhash64("label", "dim", "list", "_pair").alias("g"), F.col("_pair.i").alias("i"), F.col("_pair.j").alias("j"), F.col("_b").alias("b"),
                       "id", "copies", "mask", "list", "s0", "s1")
    left = screen(rows.repartition("g").sortWithinPartitions("g", "id"), threshold, shared).select("g", "i", "j", "b", "id", "copies", "mask", "list").checkpoint()
    vectors = reps.select(F.col("id").alias("_id"), "vec")
    rows = vectors.join(small(left, left.count()), F.col("id") == F.col("_id")).select("g", "i", "j", "b", "id", "vec", "copies", "mask", "list")
    rows = rows.repartition("g").sortWithinPartitions("g", "id")

    def work(batch: pa.RecordBatch, out: list) -> None:
        g, i, j, b, ids = (batch.column(k).to_numpy() for k in range(5))
        copies, mask, lists = batch.column(6).to_numpy(), batch.column(7).to_numpy().view(np.uint64), batch.column(8).to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
        for a, z in zip(cuts[:-1], cuts[1:]):
            if z - a < 2:
                continue
            x = _unit(_matrix(batch.column(5).slice(a, z - a)))
            m = mask[a:z]
            common = m[:, None] & m[None, :]
            link = (x @ x.T >= threshold) & (_lowest(common, min(shared, int(lists[a]).bit_count())) == lists[a])
            if j[a] != i[a]:  # two blocks: pairs inside a block are met in the block's own pair
                link &= b[a:z, None] != b[None, a:z]
            np.fill_diagonal(link, False)
            touched = link.any(axis=1)
            if touched.any():
                root = forest(link)
                n = link @ copies[a:z]
                out.append((ids[a:z][touched], n[touched], ids[a:z][root][touched]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            out: list = []
            work(batch, out)
            cols = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["id", "links", "root"])

    return rows.mapInArrow(run, "id bigint, links bigint, root bigint")


def near_duplicates(df: DataFrame, key: str, vec: str, label: str, threshold: float = THRESHOLD,
                    pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept): one row per row of ``df``.

    Vectors of one label and length link when their cosine is at least ``threshold`` and the index finds them.
    Null, zero or non-finite vectors, rows without label and rows with a null key link with nothing. Every row
    counts: of two rows with equal vectors each has the other as a link, also if they repeat one id.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"),
                     F.transform(vec, lambda x: x.cast("float") + F.lit(0.0).cast("float")).alias("vec"), F.col(key).alias("_key"))
    rows = rows.withColumn("ok", usable("vec", "label") & F.col("id").isNotNull())
    rows = rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(7), F.reverse("vec")))
    live = rows.filter("ok")
    reps = (live.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
            .withColumn("dim", F.size("vec"))).checkpoint()
    placed = with_means(reps)
    signed = signatures(placed, pick_pivots(placed, pivots), nearest, shared, threshold)
    found = find_links(signed, reps, threshold, shared, block).checkpoint()
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    table = (reps.join(links, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
             .select(F.col("label").alias("l"), F.xxhash64("vec").alias("r1"), F.xxhash64(F.lit(7), F.reverse("vec")).alias("r2"),
                     (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "id").alias("component"))).checkpoint()
    on = F.col("ok") & (F.col("label") == F.col("l")) & (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))
    out = rows.drop("vec").join(small(table, table.count()), on, "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op9_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
