"""Vector operators: exact k-nearest neighbours, SMOTE, centroids, PCA.

Exact kNN as a blocked distance computation. Pivot or cell pruning does not
help on these inputs (the 64-d embeddings are spread like random points: every
cell bound admits every cell), so the exact answer needs every distance. The
plan never materialises a pair row for that:

* queries are hashed into ``Bq`` blocks and references into ``Br`` blocks of
  at most ``block_rows`` rows each (``B = ceil(n / block_rows)``, sizes from two
  counts), and every query block meets every reference block in one cogroup
  ``(qb, rb)``; a group therefore holds at most ``2 * block_rows`` rows, however
  many rows the tables have;
* inside the group numpy computes the distances in slices of queries and keeps
  only each query's k best (distance rounded to 9 digits, then reference id),
  so a task emits ``k`` rows per query, never the pairs;
* the ``Br`` partial lists of a query (``k * Br`` rows) are merged by one
  shuffle on the query id; with a single reference block the partial list is
  already final and that shuffle is skipped.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import hash_int, hash_unit
from tidemark.functions.vec import lerp
from tidemark.operators.ordering import ordered_index

BLOCK_ROWS = 16_384      # rows of one side in a cogroup (16k x 64 doubles = 8 MB)
MAX_BLOCKS = 32          # blocks of one side that small ``block_rows`` may ask for
SCREEN_CELLS = 1 << 20   # (query, reference) pairs of a screening slice (8 MB of doubles)
MOMENT_ROWS = 4096       # vectors whose moments are taken by one matrix product
MERGE = 32               # sets of moments that one task adds up
SHARED_ROWS = 16         # nearest rows, beyond four times k, that the replicates of a block choose theirs from
DIST_DIGITS = 9          # distances are compared after rounding; ties broken by id
KNN_SCHEMA = "q_id long, rank int, r_id long, dist double"
DRAWN_SCHEMA = f"replicate int, {KNN_SCHEMA}"


def _nearest(qs, qi, rv, rid, rn2, rmax, k, exclude_self):
    """(query position, reference position, distance) of the k nearest references of every query, by query, rounded
    distance and reference id."""
    qn2 = np.einsum("ij,ij->i", qs, qs)
    # screening distances by the matrix product (one BLAS call per slice)
    d2 = qs @ rv.T
    d2 *= -2.0
    d2 += rn2
    d2 += qn2[:, None]
    if exclude_self:
        d2[qi[:, None] == rid[None, :]] = np.inf
    kk = min(k, d2.shape[1])
    kth = np.partition(d2, kk - 1, axis=1)[:, kk - 1:kk]
    # margin far above the float error of the screen plus the 9-digit rounding,
    # so every true top-k entry is a candidate
    margin = 1e-9 * (qn2[:, None] + rmax) + 1e-8 * np.sqrt(np.maximum(kth, 0.0)) + 1e-12
    rows, cols = np.nonzero(d2 <= kth + margin)
    # exact distances of the candidates, summed left to right like a sequential loop
    acc = np.zeros(len(rows))
    for j in range(qs.shape[1]):
        gap = qs[rows, j] - rv[cols, j]
        acc += gap * gap
    dv = np.round(np.sqrt(acc), DIST_DIGITS)
    o = np.lexsort((rid[cols], dv, rows))  # per query: distance, then reference id
    rows, cols, dv = rows[o], cols[o], dv[o]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1 <= kk
    return rows[keep], cols[keep], dv[keep]


def _block_topk(k: int, exclude_self: bool):
    """Per cogroup: the k nearest references of every query in the group."""
    import pyarrow as pa

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        out_q, out_rank, out_r, out_d = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0)]
        if q.num_rows and r.num_rows:
            qv, rv = _matrix(q.column("v").combine_chunks()), _matrix(r.column("v").combine_chunks())
            qid, rid = q.column("id").to_numpy(), r.column("id").to_numpy()
            rn2 = np.einsum("ij,ij->i", rv, rv)
            rmax = float(rn2.max())
            step = max(1, SCREEN_CELLS // len(rv))
            for s in range(0, len(qv), step):
                qs, qi = qv[s:s + step], qid[s:s + step]
                rows, cols, dv = _nearest(qs, qi, rv, rid, rn2, rmax, k, exclude_self)
                out_q.append(qi[rows])
                out_rank.append((np.arange(len(rows)) - np.searchsorted(rows, rows) + 1).astype(np.int32))
                out_r.append(rid[cols])
                out_d.append(dv)
        cat = np.concatenate
        return pa.table({"q_id": cat(out_q), "rank": cat(out_rank), "r_id": cat(out_r), "dist": cat(out_d)})

    return run


def _block_topk_drawn(k: int):
    """Per cogroup and replicate: the k nearest of the references that the replicate draws (``w``, a count for each).

    The distances are computed once. The replicates choose from the nearest references of all; a query for which too few
    of these are drawn is compared with all that its replicate draws."""
    import pyarrow as pa

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0)]]

        def put(replicate, ids, rank, found, dv):
            for column, x in zip(out, (np.full(len(ids), replicate, np.int32), ids, rank.astype(np.int32), found, dv)):
                column.append(x)

        if q.num_rows and r.num_rows:
            qv, rv = _matrix(q.column("v").combine_chunks()), _matrix(r.column("v").combine_chunks())
            drawn = _matrix(r.column("w").combine_chunks()) > 0
            qid, rid = q.column("id").to_numpy(), r.column("id").to_numpy()
            rn2 = np.einsum("ij,ij->i", rv, rv)
            rmax = float(rn2.max())
            step = max(1, SCREEN_CELLS // len(rv))
            for s in range(0, len(qv), step):
                qs, qi = qv[s:s + step], qid[s:s + step]
                rows, cols, dv = _nearest(qs, qi, rv, rid, rn2, rmax, 4 * k + SHARED_ROWS, False)
                first = np.searchsorted(rows, np.arange(len(qs)))
                for j in range(drawn.shape[1]):
                    mine = drawn[cols, j]
                    upto = np.concatenate(([0], np.cumsum(mine)))
                    rank = upto[1:] - upto[first[rows]]
                    have = np.bincount(rows[mine], minlength=len(qs))
                    few = have < min(k, int(drawn[:, j].sum()))
                    keep = mine & (rank <= k) & ~few[rows]
                    put(j, qi[rows[keep]], rank[keep], rid[cols[keep]], dv[keep])
                    if few.any():
                        own = np.flatnonzero(drawn[:, j])
                        x, c, d = _nearest(qs[few], qi[few], rv[own], rid[own], rn2[own], rmax, k, False)
                        put(j, qi[few][x], np.arange(len(x)) - np.searchsorted(x, x) + 1, rid[own[c]], d)
        return pa.table(dict(zip(("replicate", "q_id", "rank", "r_id", "dist"), map(np.concatenate, out))))

    return run


def block_count(n: int, block_rows: int) -> int:
    """Blocks of a side with ``n`` rows: of ``block_rows`` rows, but more than ``MAX_BLOCKS`` only if these would hold over
    ``BLOCK_ROWS`` rows. Every row meets every block of the other side, so small blocks would multiply what is shuffled."""
    return max(1, min(math.ceil(n / block_rows), max(MAX_BLOCKS, math.ceil(n / BLOCK_ROWS))))


def _meeting(queries: DataFrame, n_q: int, reference: DataFrame, n_r: int, qkey: str, rkey: str, vec: str, block_rows: int, draws: str | None = None):
    """Cogroups in which every block of queries meets every block of references, and the number of reference blocks."""
    bq, br = block_count(n_q, block_rows), block_count(n_r, block_rows)

    def side(df, key, nb, other_nb, own, other, *more):
        out = df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"),
                        F.pmod(F.xxhash64(F.col(key)), F.lit(nb)).cast("int").alias(own), *more)
        if other_nb == 1:
            return out.withColumn(other, F.lit(0))
        # each row meets every block of the other side once
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_nb - 1))))

    q = side(queries, qkey, bq, br, "qb", "rb")
    r = side(reference, rkey, br, bq, "rb", "qb", *([F.col(draws).alias("w")] if draws else []))
    return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")), br


def knn(queries: DataFrame, reference: DataFrame, k: int, qkey: str, rkey: str, vec: str = "embedding",
        exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest reference rows of every query row by Euclidean distance (exact).

    Output ``(q_id, rank, r_id, dist)``; rank 1.. by (distance rounded to 9
    digits, reference id). With ``exclude_self`` a row is not its own neighbour
    (query and reference keys compared)."""
    spark = queries.sparkSession
    n_q, n_r = queries.count(), reference.count()
    if n_q == 0 or n_r == 0 or k <= 0:
        return spark.createDataFrame([], KNN_SCHEMA)
    groups, br = _meeting(queries, n_q, reference, n_r, qkey, rkey, vec, block_rows)
    part = groups.applyInArrow(_block_topk(k, exclude_self), KNN_SCHEMA)
    if br == 1:
        return part
    w = Window.partitionBy("q_id").orderBy("dist", "r_id")
    return (part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("q_id", F.col("rank").cast("int").alias("rank"), "r_id", "dist"))


def knn_classify(queries: DataFrame, train: DataFrame, k: int, qkey: str, rkey: str, label: str,
                 vec: str = "embedding", copies: str | None = None) -> DataFrame:
    """Majority label of the k nearest training rows; smaller label on ties (J7). With ``copies`` a training row
    stands there that many times (at least once) and takes as many of the k places."""
    nn = knn(queries, train, k, qkey, rkey, vec)
    lab = train.select(F.col(rkey).alias("r_id"), F.col(label).alias("_lab"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("_c"))
    near = nn.join(lab, "r_id")
    best = _copies_vote(near, k, ["q_id"]) if copies else _vote(near, ["q_id"])
    return best.select(F.col("q_id").alias(qkey), "pred")


def _copies_vote(near: DataFrame, k: int, by: list[str]) -> DataFrame:
    """``_vote`` of the first k copies by rank (at most k rows a query have any)."""
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _vote(near.withColumn("_c", F.least(F.col("_c"), F.lit(k) - before)).where(F.col("_c") > 0), by)


def _vote(near: DataFrame, by: list[str]) -> DataFrame:
    votes = near.groupBy(*by, "_lab").agg(F.sum("_c").alias("_v"))
    return votes.groupBy(*by).agg(F.max_by(F.col("_lab"), F.struct(F.col("_v"), -F.col("_lab"))).alias("pred"))


def knn_drawn(queries: DataFrame, reference: DataFrame, k: int, qkey: str, rkey: str, draws: str, vec: str = "embedding",
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``knn`` for every bootstrap replicate at once: ``draws`` is an array that tells how often each replicate draws the
    reference row (0: not at all). Output ``(replicate, q_id, rank, r_id, dist)``; distances are computed once for all."""
    n_q, n_r = queries.count(), reference.count()
    if n_q == 0 or n_r == 0 or k <= 0:
        return queries.sparkSession.createDataFrame([], DRAWN_SCHEMA)
    groups, br = _meeting(queries, n_q, reference, n_r, qkey, rkey, vec, block_rows, draws)
    part = groups.applyInArrow(_block_topk_drawn(k), DRAWN_SCHEMA)
    if br == 1:
        return part
    w = Window.partitionBy("q_id", "replicate").orderBy("dist", "r_id")
    return (part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("replicate", "q_id", F.col("rank").cast("int").alias("rank"), "r_id", "dist"))


def knn_classify_drawn(queries: DataFrame, train: DataFrame, k: int, qkey: str, rkey: str, label: str, draws: str,
                       vec: str = "embedding") -> DataFrame:
    """``knn_classify`` for every bootstrap replicate at once: ``(replicate, <qkey>, pred)``. A training row stands in a
    replicate as often as its array ``draws`` tells."""
    nn = knn_drawn(queries, train, k, qkey, rkey, draws, vec)
    lab = train.select(F.col(rkey).alias("r_id"), F.col(label).alias("_lab"), F.col(draws).alias("_d"))
    near = nn.join(lab, "r_id").withColumn("_c", F.get("_d", F.col("replicate")).cast("long")).where(F.col("_c") > 0).drop("_d")
    return _copies_vote(near, k, ["replicate", "q_id"]).withColumnRenamed("q_id", qkey).select("replicate", qkey, "pred")


def smote(df: DataFrame, label: str, key: str, vec: str = "embedding", k: int = 5, seed: int = 42,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Synthetic rows until every class has as many rows as the largest one.

    Classes grow from the smallest on; draws are numbered through. Draw j of a class picks base row ``md5('seed:b:j') mod n_min`` (dense id order), its
    neighbour of rank ``md5('seed:n:j') mod min(k, n_min-1) + 1`` among the
    minority rows, and ``u = md5('seed:u:j') / 2^60``; the new vector is
    ``base + u * (neighbour - base)``. Output: ``syn_id, base_id, nbr_id, u,
    <label>, <vec>`` (originals are not repeated; union them with ``smote_resample``).
    """
    spark = df.sparkSession
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").asc(), F.col(label).asc()).collect()
    if len(counts) < 2:
        return spark.createDataFrame([], f"syn_id long, base_id long, nbr_id long, u double, {label} int, {vec} array<double>")
    n_maj, first, out = max(r["n"] for r in counts), 0, None
    for r in counts:  # a loop over classes, not rows
        n_syn = n_maj - r["n"]
        if n_syn > 0 and r["n"] > 1 and k > 0 and r[label] is not None:
            part = _smote_class(df, label, key, vec, r[label], r["n"], n_syn, first, k, seed, block_rows)
            out, first = part if out is None else out.unionByName(part), first + n_syn
    return spark.createDataFrame([], f"syn_id long, base_id long, nbr_id long, u double, {label} int, {vec} array<double>") if out is None else out


def _smote_class(df, label, key, vec, minority, n_min, n_syn, first, k, seed, block_rows) -> DataFrame:
    """``n_syn`` synthetic rows of one class; their draws are numbered from ``first``."""
    spark = df.sparkSession
    k_eff = min(k, n_min - 1)
    mino = df.where(F.col(label) == F.lit(minority)).select(key, vec)
    nn = knn(mino, mino, k_eff, key, key, vec, exclude_self=True, block_rows=block_rows)
    idx = ordered_index(mino, None, [F.col(key)], name="_i").select(F.col("_i"), F.col(key).alias("base_id"),
                                                                    F.col(vec).alias("_bv"))
    draws = spark.range(first, first + n_syn).select(
        F.col("id").alias("syn_id"),
        (hash_int(seed, F.lit("b"), F.col("id")) % F.lit(n_min) + 1).alias("_i"),
        (hash_int(seed, F.lit("n"), F.col("id")) % F.lit(k_eff) + 1).cast("int").alias("rank"),
        hash_unit(seed, F.lit("u"), F.col("id")).alias("u"))
    d = draws.join(idx, "_i")
    d = d.join(nn.select(F.col("q_id").alias("base_id"), "rank", F.col("r_id").alias("nbr_id")), ["base_id", "rank"])
    d = d.join(mino.select(F.col(key).alias("nbr_id"), F.col(vec).alias("_nv")), "nbr_id")
    return d.select("syn_id", "base_id", "nbr_id", "u", F.lit(minority).alias(label),
                    lerp(F.col("_bv"), F.col("_nv"), F.col("u")).alias(vec))


def smote_resample(df: DataFrame, label: str, key: str, vec: str = "embedding", k: int = 5, seed: int = 42) -> DataFrame:
    """Originals plus SMOTE rows: ``(<key>, <label>, <vec>, synthetic)``; synthetic keys are negative."""
    syn = smote(df, label, key, vec, k, seed)
    orig = df.select(F.col(key).cast("long").alias(key), F.col(label),
                     F.col(vec).cast("array<double>").alias(vec), F.lit(False).alias("synthetic"))
    new = syn.select((-(F.col("syn_id") + 1)).alias(key), F.col(label), F.col(vec), F.lit(True).alias("synthetic"))
    return orig.unionByName(new)


def centroid(df: DataFrame, vec: str, dim: int) -> list[float]:
    """Mean vector (dim values to the driver)."""
    row = df.agg(*[F.avg(F.col(vec)[i].cast("double")).alias(f"c{i}") for i in range(dim)]).first()
    return [float(row[f"c{i}"]) if row[f"c{i}"] is not None else 0.0 for i in range(dim)]


def _moments(column):
    """Rows, mean and centred second moments of a batch's vectors."""
    x = _matrix(column)
    mean = x.mean(axis=0)
    return len(x), mean, (x - mean).T @ (x - mean)


def _add_moments(a, b):
    """Moments of two sets of rows together, without the cancellation of raw sums."""
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _matrix(column):
    """Rows x width of an Arrow list column; every vector must have the first one's length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) == 0 or not (sizes == sizes[0]).all():
        raise ValueError("vectors are null or of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)


def mean_and_covariance(df: DataFrame, vec: str):
    """Mean vector and covariance (n - 1) of all rows by one pass: a task sends one set of moments, ``MERGE`` of them are
    added up in a task, the rest on the driver. ``None`` for an empty table."""
    import pickle

    import pyarrow as pa
    from pyspark import TaskContext

    schema = "part bigint, found binary"

    def run(batches):
        found = None
        for batch in batches:
            for start in range(0, batch.num_rows, MOMENT_ROWS):
                found = _add_moments(found, _moments(batch.column(0).slice(start, MOMENT_ROWS)))
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([pickle.dumps(found)], pa.binary())], names=["part", "found"])

    def merged(table):
        found = None
        for x in table.sort_by("part").column("found"):  # a fixed order
            found = _add_moments(found, pickle.loads(x.as_py()))
        return pa.table({"part": pa.array([table.column("_to")[0].as_py()], pa.int64()), "found": pa.array([pickle.dumps(found)], pa.binary())})

    tasks = df.select(F.col(vec).cast("array<double>").alias(vec)).mapInArrow(run, schema)
    rows = tasks.withColumn("_to", F.expr(f"part div {MERGE}")).groupBy("_to").applyInArrow(merged, schema).collect()  # one row per MERGE tasks
    found = None
    for r in sorted(rows, key=lambda r: r.part):
        found = _add_moments(found, pickle.loads(bytes(r.found)))
    return None if found is None else (found[1], found[2] / max(found[0] - 1, 1))


def pca2(df: DataFrame, key: str, vec: str, k: int = 2, out: str = "pca") -> DataFrame:
    """Centred projection on the k leading principal axes (I3), each signed so that its largest-magnitude loading is
    positive. The rows are read twice: for the covariance and for the projection."""
    import pyarrow as pa

    names = [f"{out}_{j}" for j in range(k)]
    schema = df.select(key, *[F.lit(0.0).alias(n) for n in names]).schema
    found = mean_and_covariance(df, vec)
    if found is None:
        return df.sparkSession.createDataFrame([], schema)
    mean, cov = found
    pc = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    pc = pc * np.where(pc[np.abs(pc).argmax(axis=0), np.arange(k)] >= 0, 1.0, -1.0)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p = (_matrix(batch.column(1)) - mean) @ pc
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(p[:, j])) for j in range(k)]], names=[key, *names])

    return df.select(key, F.col(vec).cast("array<double>").alias(vec)).mapInArrow(run, schema)
