"""N-gram Jaccard join through a token-group matrix.

A document is its set of distinct shingles of ``width`` words; two link when 100 * |A & B| >= percent * |A | B| (3 and
90 unless given; 90 is written below). The result is the connected components of the links; every link between different sets
counts, none is sampled or capped.

1. *Equal sets* collapse by a 128-bit digest: a text copied to a third of all rows is one set from then on.
2. *Order.* A count sketch (a fixed number of counters, summed over all documents) orders shingles from rare to
   frequent. Two sets only link if the first n - ceil(0.9 n) + h shingles of both (their *prefixes*) have at least h
   in common, whatever the order; with rare shingles first, shared passages seldom get into a prefix.
3. *Groups.* Similar sets are put together: every set joins the most popular of its ``MINHASHES`` min-hashes.
   Small families share a group, large ones are split, to about ``GROUP_TOKENS`` shingles and ``GROUP_SETS`` sets.
4. *Matrix.* The token-group matrix is stored sparsely as (token, group) rows over the prefix tokens of the group's
   members. A query that meets fewer than h of a group's columns has an overlap below its bound with every member,
   so only (query, group) pairs with h shared columns are routed on; all other sets are finished.
5. *Sift.* Where a query and a group meet, first an eighth of the columns (by hash) is compared: sets whose
   differences there alone exceed (n + m) * 10 / 190 cannot link. Most sets that share a passage only end here.
6. *Bound and open.* The full sets of the rest are compared with the union of the others' tokens: a query whose
   overlap with that union is under ceil(0.9 n) links with none of them. What remains is opened: all overlaps by
   products of presence matrices, exact comparison, and a spanning forest of the links leaves the task.

Hashes of words and shingles have 64 bits; two shingles are taken for equal if their hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import A1, A2, forest, mix, shingles, small, small_batches, split_words, texts, whole_groups, with_batches
from tidemark.llm.components import connected_components

WIDTH = 3
PERCENT = 90
SKETCH_BITS = 20
SKETCH_PARTS = 16
MINHASHES = 4
GROUP_TOKENS = 256_000
GROUP_SETS = 2048
EXTRA = 32  # one more shared shingle is asked for, and one more put in the prefix, per so many of the set
CELLS = 4_000_000  # entries of a presence matrix held at a time
PAIRS = 500_000  # pairs of sets that are judged at a time


def need(n, percent: int = PERCENT):
    """Least overlap of a set of n shingles with a set it links with."""
    return -(-percent * n // 100)


def lead(n, percent: int = PERCENT):
    """Length of the prefix of a set of n shingles."""
    return n - need(n, percent) + 1 + n // EXTRA


def hits(n, percent: int = PERCENT):
    """Least number of prefix shingles that a set of n shares with any set it links with (of need(n) at least)."""
    return 1 + need(n, percent) // EXTRA


def least_size(percent: int = PERCENT) -> int:
    """Size from which a set links with a larger one; a smaller set links with equal sets only."""
    return -(-percent // (100 - percent))


def _sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    for _, _, buf, offs in texts(column):
        h, _, woff = split_words(buf, offs)
        yield from shingles(h, woff, width)


def _digest(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s * A1).sum(dtype=np.uint64).view(np.int64)), int(mix(s * A2 + np.uint64(1)).sum(dtype=np.uint64).view(np.int64))


def count_sketch(df: DataFrame, text: str, width: int = WIDTH) -> np.ndarray:
    """How many documents hold a shingle, summed per hash slot: 2 ** SKETCH_BITS counters, whatever the input."""
    size = (1 << SKETCH_BITS) // SKETCH_PARTS

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for s in _sets(batch.column(0), width):
                np.add.at(total, s >> np.uint64(64 - SKETCH_BITS), 1)
        parts = total.reshape(SKETCH_PARTS, size)
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_py(), np.int32)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = with_batches(df.select(text)).mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    out = np.zeros((SKETCH_PARTS, size), np.int64)
    for r in rows:
        out[r.part] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out.ravel(), (1 << 24) - 1).astype(np.uint32)


def ranked(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """A set's shingles from rare to frequent; the same order for every set (counter, then hash)."""
    key = (sketch[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(40)) | (s >> np.uint64(24))
    return s[np.argsort(key, kind="stable")]  # s is sorted, so equal keys stay in hash order


_EMPTY = np.empty(0, np.int64)


def describe(df: DataFrame, key: str, text: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, th, n, d1, d2, mins) of every row: text hash, set size, digest and min-hashes. Sets under ``least_size``
    get no min-hashes: with fewer than 9 shingles, nine of ten in common means all."""
    floor = least_size(percent)

    def run(batches):
        seeds = mix(np.arange(1, MINHASHES + 1, dtype=np.uint64) * A2)
        for batch in batches:
            sets = list(_sets(batch.column(2), width))
            digests = [_digest(s) for s in sets]
            mins = [mix(np.array([mix(s ^ x).min() for x in seeds], np.uint64) ^ seeds).view(np.int64) if len(s) >= floor else _EMPTY for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()),
                 pa.array([d[1] for d in digests], pa.int64()), pa.array(mins, pa.list_(pa.int64()))], names=["id", "th", "n", "d1", "d2", "mins"])

    return with_batches(df.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("th"), text)).mapInArrow(
        run, "id bigint, th bigint, n bigint, d1 bigint, d2 bigint, mins array<bigint>")


def _sample(s: np.ndarray) -> np.ndarray:
    """The shingles in an eighth of the hash space, as 32 bits each."""
    return np.sort((s[(s & np.uint64(7)) == 0] >> np.uint64(3)).astype(np.uint32)).view(np.int32)


def set_arrays(df: DataFrame, key: str, text: str, wanted: DataFrame, rows: int, sketch, full: bool,
               width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Arrays of the sets of ``wanted`` (rid, cid, ...): (cid, tokens from rare to frequent) if ``full``, else
    (cid, n, prefix, sample). The texts of their documents are read again, which is cheaper than to keep all sets."""
    ids = wanted.select(F.col("rid").alias("_r"), F.col("cid").alias("_c")).distinct()
    docs = df.select(F.col(key).cast("bigint").alias("id"), text).join(small(ids, rows), F.col("id") == F.col("_r"))

    def run(batches):
        for batch in batches:
            sets = list(_sets(batch.column(1), width))
            digests = [_digest(s) for s in sets]
            order = [ranked(s, sketch.value).view(np.int64) for s in sets]
            arrays = [pa.array(order, pa.list_(pa.int64()))] if full else [
                pa.array([o[:lead(len(o), percent)] for o in order], pa.list_(pa.int64())), pa.array([_sample(s) for s in sets], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()),
                 pa.array([d[1] for d in digests], pa.int64()), *arrays], names=["_c", "n", "d1", "d2", *(["tokens"] if full else ["prefix", "sample"])])

    arrays = "tokens array<bigint>" if full else "prefix array<bigint>, sample array<int>"
    out = with_batches(docs.select("_c", text)).mapInArrow(run, f"_c bigint, n bigint, d1 bigint, d2 bigint, {arrays}")
    # an id that repeats with another text brings that text's set along
    return out.filter(F.col("_c") == F.xxhash64("n", "d1", "d2")).withColumnRenamed("_c", "cid").drop("d1", "d2")


def assign_groups(sets: DataFrame) -> DataFrame:
    """(cid, rid, g) of (cid, rid, n, mins): the group of the most popular min-hash, small ones pooled, large ones split."""
    keys = sets.select("cid", "n", F.explode("mins").alias("key"))
    popular = (keys.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("t")).filter("c > 1")).checkpoint()
    total = sets.agg(F.sum("n")).first()[0] or 0
    pools = max(1, int(total // GROUP_TOKENS))
    best = (keys.join(small(popular, popular.count()), "key").groupBy("cid").agg(F.max(F.struct("c", "key", "t")).alias("b")))
    split = F.greatest(F.ceil(F.col("b.t") / GROUP_TOKENS), F.ceil(F.col("b.c") / GROUP_SETS))
    g = (F.when(F.col("b").isNull(), F.xxhash64(F.lit(0), F.pmod(F.xxhash64("cid"), F.lit(pools))))
         .when(split > 1, F.xxhash64(F.lit(1), "b.key", F.pmod(F.xxhash64("cid"), split)))
         .otherwise(F.xxhash64(F.lit(0), F.pmod(F.xxhash64("b.key"), F.lit(pools)))))
    return sets.join(best, "cid", "left").select("cid", "rid", g.alias("g"))


def route(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(cid, i, j): sets that meet in the pair of groups i <= j, from the token-group matrix of (cid, g, n, prefix)."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = sets.select("cid", "g", "n", F.explode("prefix").alias("t")).repartition(n, "t", "g")
    matrix = places.groupBy("t", "g").agg(F.count("*").alias("c"))

    def meet(batches):
        for batch in whole_groups(batches):
            t, g, c = (batch.column(k).to_numpy() for k in range(3))
            first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            length = np.diff(np.append(first, len(t)))
            out = [[t[c > 1]], [g[c > 1]], [g[c > 1]]]
            for a, k in zip(first[length > 1], length[length > 1]):  # columns of several groups
                x, y = np.divmod(np.arange(k * k), k)
                x, y = x[x != y], y[x != y]
                out[0].append(np.full(len(x), t[a]))
                out[1].append(g[a + x])
                out[2].append(g[a + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["t", "g", "other"])

    met = matrix.repartition(n, "t").sortWithinPartitions("t", "g").select("t", "g", "c").mapInArrow(meet, "t bigint, g bigint, other bigint")
    least = 1 + F.floor(-F.floor(-percent * F.col("n") / 100) / EXTRA)
    shared = places.join(met, ["t", "g"]).groupBy("cid", "g", "other").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    return shared.filter(F.col("c") >= least).select("cid", F.least("g", "other").alias("i"), F.greatest("g", "other").alias("j")).distinct()


def _clusters(token: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Label of every document; documents with a token in common have the same label."""
    order = np.argsort(token, kind="stable")
    t, d = token[order], doc[order]
    run = np.cumsum(np.concatenate(([0], (t[1:] != t[:-1]).astype(np.int64)))) if len(t) else t
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(t) else np.empty(0, np.int64)
    label = np.arange(docs)
    while len(t):
        low = np.minimum.reduceat(label[d], first)
        new = label.copy()
        np.minimum.at(new, d, low[run])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _meetings(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray | None, list[np.ndarray]]]:
    """Per pair of groups in a batch of (p, i, j, cid, g, ..., array): rows, side of each (None: one group), arrays."""
    p, i, j, cid, g = (batch.column(k).to_numpy() for k in range(5))
    values = batch.column(batch.num_columns - 1)
    offs, flat = values.offsets.to_numpy(), values.values.to_numpy()
    cuts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1], [True])))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        at = lo + np.unique(cid[lo:hi], return_index=True)[1]  # a row per set, also if its document repeats
        side = (g[at] == j[at]) if i[lo] != j[lo] else None
        if len(at) > 1 and (side is None or side.any() and not side.all()):
            yield at, side, [flat[offs[k]:offs[k + 1]] for k in at]


def _together(rows: DataFrame, *columns: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.select(F.xxhash64("i", "j").alias("p"), "i", "j", "cid", "g", *columns).repartition(n, "p").sortWithinPartitions("p", "i", "j", "cid"))


def _groups_of(label: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(label, kind="stable")
    ends = np.flatnonzero(np.concatenate(([True], label[order][1:] != label[order][:-1], [True])))
    for x, y in zip(ends[:-1], ends[1:]):
        if y - x > 1:
            yield order[x:y]


def _overlaps(sets: list[np.ndarray], side: np.ndarray | None = None) -> np.ndarray:
    """Sizes of all intersections, by products of presence matrices over the tokens that at least two sets hold. With
    ``side``, only of the sets of the one side (rows) with those of the other (columns)."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(column)
    keep = held[column] > 1
    number = np.cumsum(held > 1) - 1
    d, c = doc[keep], number[column[keep]]
    order = np.argsort(c, kind="stable")
    d, c = d[order], c[order]
    m, width = len(sets), int((held > 1).sum())
    x, y = _sides(m, side)
    out, step = np.zeros((len(x), len(y)), np.float32), max(1, CELLS // m)
    for a in range(0, width, step):
        lo, hi = np.searchsorted(c, [a, a + step])
        present = np.zeros((m, min(step, width - a)), np.float32)
        present[d[lo:hi], c[lo:hi] - a] = 1
        out += present @ present.T if side is None else present[x] @ present[y].T
    return out


def _sides(m: int, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the sets that may link: all with all, or those of one side with those of the other."""
    return (np.arange(m), np.arange(m)) if side is None else (np.flatnonzero(~side), np.flatnonzero(side))


def _slices(n: int, others: int) -> Iterator[slice]:
    """Cut ``n`` rows so that a slice meets the ``others`` in at most about ``PAIRS`` pairs."""
    step = max(1, PAIRS // max(1, others))
    return (slice(a, a + step) for a in range(0, n, step))


def _unparted(size: np.ndarray, length: np.ndarray, shared: np.ndarray, side: np.ndarray | None, percent: int) -> np.ndarray:
    """Which sets (``size`` shingles, ``length`` of them in the sample) their samples do not part from all others."""
    x, y = _sides(len(size), side)
    alive = np.zeros(len(size), bool)
    for at in _slices(len(x), len(y)):
        rows = x[at]
        apart = length[rows][:, None] + length[y][None, :] - 2 * shared[at]
        may = (100 + percent) * apart <= (100 - percent) * (size[rows][:, None] + size[y][None, :])
        if side is None:
            may[np.arange(len(rows)), rows] = False
        alive[rows] |= may.any(axis=1)
        alive[y] |= may.any(axis=0)
    return alive


def sift(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(cid, i, j) of the routed sets that an eighth of the columns does not part from all others they meet."""
    differ, whole = 100 - percent, 100 + percent  # linked sets differ in at most differ / whole of n + m shingles

    def run(batches):
        for batch in whole_groups(batches):
            i, j, cid, n = (batch.column(k).to_numpy() for k in (1, 2, 3, 5))
            alive = []
            for at, side, samples in _meetings(batch):
                label = _clusters(np.concatenate(samples), np.repeat(np.arange(len(at)), [len(x) for x in samples]), len(at))
                for part in _groups_of(label):
                    size, length = n[at[part]].astype(np.float64), np.array([len(samples[k]) for k in part], np.float64)
                    own = None if side is None else side[part]
                    alive.append(at[part[_unparted(size, length, _overlaps([samples[k] for k in part], own), own, percent)]])
                # sets with few columns in the sample may link with sets that share none of them
                size, length = n[at], np.array([len(x) for x in samples])
                thin = np.flatnonzero(whole * length <= differ * size)
                for cut in _slices(len(thin), len(at)):
                    some = thin[cut]
                    may = whole * (length[some][:, None] + length[None, :]) <= differ * (size[some][:, None] + size[None, :])
                    if side is not None:
                        may &= side[some][:, None] != side[None, :]
                    may[np.arange(len(some)), some] = False
                    alive += [at[some[may.any(axis=1)]], at[may.any(axis=0)]]
            rows = np.unique(np.concatenate(alive)) if alive else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (cid, i, j)], names=["cid", "i", "j"])

    return _together(rows, "n", "sample").mapInArrow(run, "cid bigint, i bigint, j bigint")


def open_group(sets: list[np.ndarray], side: np.ndarray | None, percent: int = PERCENT) -> np.ndarray | None:
    """Link matrix of the sets; with ``side``, only between different sides. None: no link."""
    n = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), n)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(column)
    others = held[column] - 1
    if side is not None:
        right = np.bincount(column, weights=side[doc])[column]
        others = np.where(side[doc], held[column] - right, right)
    bound = np.bincount(doc, weights=others > 0, minlength=len(sets))
    opened = np.flatnonzero(bound >= need(n, percent))  # overlap with the union of the sets it could link with
    if len(opened) < 2:
        return None
    own = None if side is None else side[opened]
    overlap, size = _overlaps([sets[k] for k in opened], own), n[opened].astype(np.float64)
    x, y = _sides(len(opened), own)
    out = np.zeros((len(sets), len(sets)), bool)
    for at in _slices(len(x), len(y)):
        rows, common = x[at], overlap[at].astype(np.float64)
        link = 100 * common >= percent * (size[rows][:, None] + size[y][None, :] - common)
        if side is None:
            link[np.arange(len(rows)), rows] = False
        else:
            out[np.ix_(opened[y], opened[rows])] = link.T
        out[np.ix_(opened[rows], opened[y])] = link
    return out if out.any() else None


def find_links(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): spanning forests of the links of every pair of groups, from (i, j, cid, g, tokens)."""

    def run(batches):
        for batch in whole_groups(batches):
            cid = batch.column(3).to_numpy()
            a_out, b_out = [], []
            for at, side, sets in _meetings(batch):
                sets = [s.view(np.uint64) for s in sets]
                heads = [s[:len(s) - need(len(s), percent) + 1] for s in sets]
                label = _clusters(np.concatenate(heads), np.repeat(np.arange(len(at)), [len(x) for x in heads]), len(at))
                for part in _groups_of(label):
                    link = open_group([sets[k] for k in part], None if side is None else side[part], percent)
                    if link is not None:
                        root = forest(link)
                        moved = root != np.arange(len(root))
                        a_out.append(cid[at[part[moved]]])
                        b_out.append(cid[at[part[root[moved]]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else _EMPTY, pa.int64()) for x in (a_out, b_out)], names=["a", "b"])

    return _together(rows, "tokens").mapInArrow(run, "a bigint, b bigint")


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, text_hash) of every row: set size, smallest key reachable by links, xxhash64.

    Null, empty and blank texts have no shingles and link with nothing; so do rows with a null key, whose component
    is null. Rows repeating a key are documents of their own with that key. Row count is kept. ``percent`` is 1 to 99.
    """
    spark = df.sparkSession
    with small_batches(spark):
        described = describe(df, key, text, width, percent).checkpoint()
        classes = (described.filter("n > 0 and id is not null").groupBy("n", "d1", "d2")
                   .agg(F.min("id").alias("rid"), F.first("mins").alias("mins")).withColumn("cid", F.xxhash64("n", "d1", "d2"))).checkpoint()
        groups = assign_groups(classes.filter(F.col("n") >= least_size(percent))).checkpoint()
        n_groups = groups.count()
        sketch = spark.sparkContext.broadcast(count_sketch(df, text, width))
        able = (set_arrays(df, key, text, groups, n_groups, sketch, False, width, percent)
                .join(small(groups.select("cid", "g"), n_groups), "cid")).checkpoint()
        routes = route(able, percent).checkpoint()
        met = able.select("cid", "g", "n", "sample").join(small(routes, routes.count()), "cid")
        left = sift(met, percent).checkpoint()
        busy = left.select("cid").distinct().join(groups, "cid").checkpoint()
        n_busy = busy.count()
        full = set_arrays(df, key, text, busy, n_busy, sketch, True, width, percent).join(small(busy.select("cid", "g"), n_busy), "cid")
        routed = full.join(small(left, left.count()), "cid")
        parts = connected_components(find_links(routed, percent)).checkpoint()
    named = (classes.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    smallest = named.groupBy("component").agg(F.min("rid").alias("component_id"))
    table = named.select("cid", "component").join(smallest, "component").select("cid", "component_id")
    out = described.select("id", "th", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.xxhash64("n", "d1", "d2")).alias("cid")).join(table, "cid", "left")
    return out.select(F.col("id").cast(df.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("th").alias("text_hash"))


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text_hash")
