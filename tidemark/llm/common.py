"""Helpers shared by the operators: hold-out rule, bounded broadcasts, word hashing on Arrow text columns.

Text is handled as UTF-8 bytes. A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D (all ASCII, so
a cut never falls inside a code point). ``split_words`` hashes every word of a batch with array arithmetic; no
Python loop runs over words or characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows of a table that may be broadcast after they were counted (each a few dozen bytes).
BROADCAST_ROWS = 500_000
# Bytes of text that one array pass works on; a longer single text is one pass of its own.
PASS_BYTES = 1 << 19
# Bytes of rows that Spark collects for one Arrow batch within ``small_batches``; a longer single row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
A1, A2, A3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)
_P = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64


def held_out(doc_id: str | Column, mod: int, remainder: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod`` equals ``remainder`` (false for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % F.lit(mod) == F.lit(remainder), F.lit(False))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` are within ``limit``; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


class Batched:
    """A DataFrame whose ``mapInArrow`` hands its function batches of at most ``rows`` rows.

    Spark bounds the bytes of a batch (64 MB); the arrays that the operators make of a batch are several times its size.
    """

    def __init__(self, df: DataFrame, rows: int):
        self.df, self.rows = df, rows

    def mapInArrow(self, func, schema) -> DataFrame:  # noqa: N802
        rows = self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return func(b.slice(a, rows) for b in batches for a in range(0, b.num_rows, rows))

        return self.df.mapInArrow(run, schema)


def with_batches(df: DataFrame, rows: int = 512) -> Batched:
    """Keep the Arrow batches of long texts small, without a change to the session's settings."""
    return Batched(df, rows)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the bytes of the Arrow batches of jobs that run inside to ``BATCH_BYTES``, unless the session has a bound set.

    Spark's own bound of 64 MB takes a whole input split of texts or sets as one batch: each task then holds twice its
    bytes in the JVM while the buffers grow, and once more in the Python worker. The setting is taken back at the end.
    """
    if spark.conf.get(_BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_SETTING)


def lowest_per_group(df: DataFrame, by: str, k: int, order: list[str | Column], salts: int = 16) -> DataFrame:
    """Add ``_n`` (from 1) and keep the ``k`` first rows of every group in a total order.

    Groups are cut into ``salts`` parts first, so a group with most of the rows reaches one task only as
    ``salts * k`` rows.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    first = Window.partitionBy(by, "_s").orderBy(*order)
    part = df.withColumn("_s", salt).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_s", "_n")
    return part.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= k)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CASED = mix(np.arange(1, 257, dtype=np.uint64) * A1)
_CASED[_IS_SPACE] = 0
_FOLDED = _CASED.copy()
_FOLDED[0x41:0x5B] = _CASED[0x61:0x7B]
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n, kept for the life of the worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            k = 1
            while k < size:  # doubling: p[k:2k] = p[:k] * base**k
                p[k:2 * k] = p[:k] * np.uint64(pow(base, k, 1 << 64))
                k *= 2
            out.append(p)
        _POWERS[:] = out
    return _POWERS


def split_words(buf: np.ndarray, offs: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts ``buf[offs[i]:offs[i+1]]``.

    Returns their 64-bit hashes (A-Z folded to a-z if ``fold``), the byte each starts at, and for every text the
    position of its first word (one entry more than texts).
    """
    h, starts, woff, _ = _split(buf, offs, fold, 0)
    return h, starts, woff


def split_stems(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded hashes of the words, hashes of their first ``length`` bytes, and the texts' first word positions."""
    h, _, woff, stems = _split(buf, offs, True, length)
    return h, stems, woff


def _split(buf, offs, fold, stem):
    if len(buf) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(offs), np.int64), np.empty(0, np.uint64)
    space = _IS_SPACE[buf]
    first = ~space
    first[1:] &= space[:-1]
    at = offs[:-1][offs[:-1] < offs[1:]]
    first[at] = ~space[at]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.empty(0, np.uint64), starts, np.zeros(len(offs), np.int64), np.empty(0, np.uint64)
    p, inverse = _powers(len(buf))
    values = (_FOLDED if fold else _CASED)[buf] * p[:len(buf)]
    h = mix(np.add.reduceat(values, starts) * inverse[starts])
    stems = h
    if stem:
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
        ends = np.minimum(starts + stem, np.append(starts[1:], len(buf)))
        stems = mix((upto[ends] - upto[starts]) * inverse[starts])
    return h, starts, np.searchsorted(starts, offs), stems


def texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into passes of whole texts: (first row, end row, bytes, offsets); null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    _, o, d = column.buffers()
    offs = np.frombuffer(o, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + PASS_BYTES, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def shingles(h: np.ndarray, woff: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its ``width``-word shingles; with fewer words the whole sequence is one."""
    by = [A1, A2, A3, *(mix(np.arange(4, width + 1, dtype=np.uint64) * A1) | np.uint64(1))][:width]
    many = len(h) - width + 1
    s = mix(sum(h[k:k + many] * x for k, x in enumerate(by))) if many > 0 else np.empty(0, np.uint64)
    for a, b in zip(woff[:-1], woff[1:]):
        n = b - a
        if n >= width:
            x = s[a:b - width + 1].copy()
            x.sort()
            yield x[np.concatenate(([True], x[1:] != x[:-1]))] if n > width else x
        elif n:
            yield mix(sum(h[a + k:a + k + 1] * by[k] for k in range(n)) + np.uint64(n))
        else:
            yield np.empty(0, np.uint64)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebatch rows sorted by an integer first column so that no value of it spans two batches."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    for batch in batches:
        if batch.num_rows == 0:
            continue
        g = batch.column(0).to_numpy()
        if held and held[-1].column(0)[0].as_py() != g[0]:
            yield from joined(held)
            held = []
        last = int(np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))[-1])
        if last > 0:
            yield from joined([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield from joined(held)


def forest(link: np.ndarray) -> np.ndarray:
    """For every vertex of a symmetric boolean link matrix the smallest vertex it is connected with."""
    root, step = np.arange(len(link)), max(1, 500_000 // max(1, len(link)))  # rows of the matrix that are read at a time
    while True:
        new = root.copy()
        for a in range(0, len(link), step):
            new[a:a + step] = np.minimum(root[a:a + step], np.where(link[a:a + step], root[None, :], len(link)).min(axis=1))
        new = new[new]
        if (new == root).all():
            return root
        root = new
