"""Bigram language model with interpolated modified Kneser-Ney smoothing, counted in Spark and memory-mapped.

The model is a folder of plain arrays in the shared checkpoint folder, cut into shards whose number follows the
input's size:

* words: sorted 64-bit hashes with counts and continuation counts; a word's id is its position over all shards;
* bigrams: sorted (context id, word id) keys with their counts (one byte; larger counts in a list beside it);
* contexts: sorted ids with the numbers of their bigrams counted once, twice, and more often.

Counting: each task sums what it has read and sends sorted, compressed runs, one per shard; a shard's task merges
the runs and writes the arrays. Bigrams are sharded by context, except for *hot* contexts (over a quarter shard's
worth of tokens, at most four times as many as shards), which are spread by bigram; of those alone the driver adds
the partial numbers. Only totals per shard and hot contexts reach the driver.

Scoring: tasks map the arrays (shared, read-only pages) and look up the distinct words and bigrams of a batch by
binary search. Where the shared folder is not a mounted file system, a worker copies a shard to a temporary file
when it first needs it and maps that.

P(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) P1(w), with g(v) = (D1 N1(v) + D2 N2(v) + D3 N3+(v)) / c(v), and
P1(w) = max(a(w) - d(a(w)), 0) / A + l / (V + 1), a(w) the number of different words before w. D and d come from
counts of counts. An unknown word has P1 = l / (V + 1), after an unknown context P = P1; both sum to 1.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, mix, split_words, texts, with_batches
from tidemark.session import ensure_checkpoint_dir

SHARD_BYTES = 16 << 20  # text per shard
FLUSH = 2_000_000  # counted entries a task holds before it sends them
MOST_WORDS = (1 << 32) - 1  # an id has 32 bits, one id is the unknown word's
END = np.uint64(0x3C2F733E3C2F733E)
_RUN = "kind int, shard bigint, keys binary, counts binary"


# --- arrays in the shared folder ---------------------------------------------------------------------------------


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return re.sub("^file:/*", "/", uri)
    return uri if uri.startswith("/") else None


def _write(uri: str, array: np.ndarray) -> None:
    """Write whole or not at all, so that a repeated task leaves the same file."""
    data = np.ascontiguousarray(array).tobytes()
    path, part = _local(uri), f"{uri}.{uuid.uuid4().hex}"
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(part), "wb") as f:
            f.write(data)
        os.replace(_local(part), path)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(name))
    part = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, name)


_MAPPED: dict[str, np.ndarray] = {}


def _map(uri: str, dtype) -> np.ndarray:
    if uri not in _MAPPED:
        path, handle = _local(uri), None
        if path is None:
            from pyarrow import fs

            store, name = fs.FileSystem.from_uri(uri)
            handle = tempfile.TemporaryFile()  # has no name, so it goes with the worker
            with store.open_input_stream(name) as f:
                while chunk := f.read(1 << 22):
                    handle.write(chunk)
            handle.flush()
            size = handle.tell()
        else:
            size = os.path.getsize(path)
        _MAPPED[uri] = np.memmap(handle or path, dtype, "r") if size else np.empty(0, dtype)
    return _MAPPED[uri]


# --- runs of counts between tasks ---------------------------------------------------------------------------------


def _pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, then compressed: high bytes of gaps and counts are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 0:
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


class Counter:
    """Sums counts of 64-bit keys and turns them into runs per shard when they get many."""

    def __init__(self, shard_of, kind: int = 0):
        self.shard_of, self.kind, self.parts, self.held = shard_of, kind, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n.astype(np.int64)))
        self.held += len(k)
        if self.held > FLUSH:
            yield from self.runs()

    def runs(self) -> Iterator[pa.RecordBatch]:
        keys, counts = _sum(*(np.concatenate(x) for x in zip(*self.parts))) if self.parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.parts, self.held = [], 0
        shard = self.shard_of(keys)
        order = np.argsort(shard, kind="stable")
        keys, counts, shard = keys[order], counts[order], shard[order]
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(keys) else [0]
        rows = [(self.kind, int(shard[a]), _pack(np.diff(keys[a:b], prepend=np.uint64(0))), _pack(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kind, shard, keys, counts = zip(*rows) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(shard, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                                      names=["kind", "shard", "keys", "counts"])


def _merge(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = [np.cumsum(_unpack(k.as_py(), np.uint64), dtype=np.uint64) for k in table.column("keys")]
    counts = [_unpack(c.as_py(), np.int64) for c in table.column("counts")]
    return table.column("shard")[0].as_py(), *_sum(np.concatenate(keys), np.concatenate(counts))


# --- model --------------------------------------------------------------------------------------------------------


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an end after each, and the position of each text's first token (one entry more)."""
    words, starts, n = [], [], 0
    for _, _, buf, offs in texts(column):
        h, _, woff = split_words(buf, offs)
        words.append(np.insert(h, woff[1:], END))
        starts.append(n + woff[:-1] + np.arange(len(offs) - 1))
        n += len(words[-1])
    return np.concatenate([*words, np.empty(0, np.uint64)]), np.concatenate([*starts, [n]]).astype(np.int64)


class Model:
    """Where the arrays are, and the numbers that the driver holds."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards
        self.base = np.zeros(shards + 1, np.int64)  # first word id of each shard
        self.train_tokens = self.train_texts = self.types = 0
        self.pair_shards: frozenset[int] = frozenset()  # shards that hold a bigram
        self.hot = np.empty(0, np.uint64)  # sorted ids of contexts spread over all shards
        self.hot_numbers = np.empty((0, 3), np.int64)
        self.discount, self.low_discount = np.zeros(4), np.zeros(4)  # D by count 0, 1, 2, 3 and more
        self.low_rest = 1.0

    @property
    def vocabulary(self) -> int:
        return int(self.base[-1])

    def uri(self, shard: int, what: str) -> str:
        return f"{self.folder}/{what}-{shard:06d}"

    def word_shard(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.shards.bit_length() + 1)).astype(np.int64) if self.shards > 1 else np.zeros(len(h), np.int64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ids of sorted word hashes; the vocabulary's size for an unknown word."""
        out = np.full(len(h), self.vocabulary, np.uint64)
        for s, lo, hi in _slices(self.word_shard(h)):
            if self.base[s] == self.base[s + 1]:
                continue
            at, hit = _find(_map(self.uri(s, "word"), np.uint64), h[lo:hi])
            out[lo:hi][hit] = (self.base[s] + at[hit]).astype(np.uint64)
        return out

    def by_id(self, ids: np.ndarray, what: str) -> np.ndarray:
        """Values of a word array for sorted ids; 0 for an unknown word."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.base, ids.astype(np.int64), "right") - 1
        for s, lo, hi in _slices(shard):
            if s < self.shards:
                out[lo:hi] = _map(self.uri(s, what), np.int64)[ids[lo:hi].astype(np.int64) - self.base[s]]
        return out

    def is_hot(self, ids: np.ndarray) -> np.ndarray:
        return _find(self.hot, ids)[1]

    def bigram_shard(self, keys: np.ndarray) -> np.ndarray:
        v = keys >> np.uint64(32)
        return (mix(np.where(self.is_hot(v), keys, v) + np.uint64(1)) & np.uint64(self.shards - 1)).astype(np.int64)

    def bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        shard = self.bigram_shard(keys)
        order = np.argsort(shard, kind="stable")
        for s, lo, hi in _slices(shard[order]):
            if s not in self.pair_shards:
                continue
            at, hit = _find(_map(self.uri(s, "pair"), np.uint64), keys[order[lo:hi]])
            n = np.where(hit, _map(self.uri(s, "pair-n"), np.uint8)[at] if hit.any() else 0, 0).astype(np.int64)
            if (n == 255).any():
                at, hit = _find(_map(self.uri(s, "pair-big"), np.uint64), keys[order[lo:hi]])
                n = np.where(n == 255, _map(self.uri(s, "pair-big-n"), np.int64)[at], n)
            out[order[lo:hi]] = n
        return out

    def context_numbers(self, ids: np.ndarray) -> np.ndarray:
        """N1, N2 and N3+ of contexts (sorted ids; the begin of a text has the vocabulary's size as id)."""
        out = np.zeros((len(ids), 3), np.int64)
        at, hit = _find(self.hot, ids)
        out[hit] = self.hot_numbers[at[hit]]
        shard = np.where(hit, -1, (mix(ids + np.uint64(1)) & np.uint64(self.shards - 1)).astype(np.int64))
        order = np.argsort(shard, kind="stable")
        for s, lo, hi in _slices(shard[order]):
            if s in self.pair_shards:
                at, hit = _find(_map(self.uri(s, "context"), np.uint64), ids[order[lo:hi]])
                rows = _map(self.uri(s, "context-n"), np.int64).reshape(-1, 3)
                out[order[lo:hi][hit]] = rows[at[hit]]
        return out


def _slices(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(sorted_values):
        cuts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(sorted_values[a]), int(a), int(b)


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, found) of ``wanted`` in a sorted array; positions stay inside it."""
    if len(known) == 0:
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def discounts(n: list[int]) -> np.ndarray:
    """Chen and Goodman's D1, D2, D3+ (after a zero) from how many counts are 1, 2, 3 and 4; 0.5 where undefined."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 > 0 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0.0] + [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)])


def train(df: DataFrame, text: str = "text") -> Model:
    """Count the rows of ``df``; a null text counts as an empty one (an end token alone)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/kneser-ney-{uuid.uuid4().hex}"
    rows = with_batches(df.select(text))
    size, n_texts = df.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    model = Model(folder, 1 << max(0, int((size or 0) // SHARD_BYTES)).bit_length())
    model.train_texts = n_texts

    def count_words(batches):
        counter = Counter(model.word_shard)
        for batch in batches:
            yield from counter.add(_tokens(batch.column(0))[0])
        yield from counter.runs()

    def write_words(table: pa.Table) -> pa.Table:
        s, words, counts = _merge(table)
        _write(model.uri(s, "word"), words)
        _write(model.uri(s, "word-n"), counts)
        top = np.argsort(-counts, kind="stable")[:64]
        return pa.table({"shard": pa.array([s]), "words": pa.array([len(words)]), "tokens": pa.array([int(counts.sum())]),
                         "top": pa.array([top.tolist()], pa.list_(pa.int64())), "top_n": pa.array([counts[top].tolist()], pa.list_(pa.int64()))})

    got = (rows.mapInArrow(count_words, _RUN).groupBy("shard")
           .applyInArrow(write_words, "shard bigint, words bigint, tokens bigint, top array<bigint>, top_n array<bigint>").collect())
    sizes = np.zeros(model.shards, np.int64)
    for r in got:
        sizes[r.shard] = r.words
    model.base = np.concatenate(([0], np.cumsum(sizes)))
    if model.vocabulary >= MOST_WORDS:
        raise ValueError(f"{model.vocabulary} different words; a bigram key holds {MOST_WORDS} at most")
    model.train_tokens = sum(r.tokens for r in got)
    often = model.train_tokens / (4 * model.shards)
    model.hot = np.array(sorted(model.base[r.shard] + i for r in got for i, n in zip(r.top, r.top_n) if n > often), np.uint64)
    if model.shards > 1 and n_texts > often:  # the begin of a text is a context, too
        model.hot = np.append(model.hot, np.uint64(model.vocabulary))
    shared = spark.sparkContext.broadcast(model)

    def count_pairs(batches):
        m = shared.value
        counter = Counter(m.bigram_shard)
        for batch in batches:
            tokens, starts = _tokens(batch.column(0))
            yield from counter.add(_pairs(_ids(m, tokens)[0], starts, m.vocabulary))
        yield from counter.runs()

    def write_pairs(table: pa.Table) -> pa.Table:
        m = shared.value
        s, keys, counts = _merge(table)
        big = counts >= 255
        _write(m.uri(s, "pair"), keys)
        _write(m.uri(s, "pair-n"), np.where(big, 255, counts).astype(np.uint8))
        _write(m.uri(s, "pair-big"), keys[big])
        _write(m.uri(s, "pair-big-n"), counts[big])
        v = keys >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        numbers = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (counts == 1, counts == 2, counts > 2)], axis=1)
        v = v[first]
        hot = m.is_hot(v)
        _write(m.uri(s, "context"), v[~hot])
        _write(m.uri(s, "context-n"), numbers[~hot])
        totals = np.array([(counts == k).sum() for k in range(1, 5)] + [len(keys)], np.int64)
        out = [(0, s, _pack(v[hot]) if hot.any() else b"", _pack(np.concatenate((totals, numbers[hot].ravel()))))]
        before = Counter(lambda w: np.searchsorted(m.base, w.astype(np.int64), "right") - 1, kind=1)
        list(before.add(keys & np.uint64(0xFFFFFFFF)))
        done = next(before.runs())
        return pa.concat_tables([pa.Table.from_batches([_rows(out)]), pa.Table.from_batches([done])])

    pairs = rows.mapInArrow(count_pairs, _RUN).groupBy("shard").applyInArrow(write_pairs, _RUN).checkpoint()
    n, hot = np.zeros(5, np.int64), {}
    totals = pairs.filter("kind = 0").collect()
    model.pair_shards = frozenset(r.shard for r in totals)
    for r in totals:
        values = _unpack(r.counts, np.int64)
        n += values[:5]
        for v, row in zip(_unpack(r["keys"], np.uint64) if r["keys"] else [], values[5:].reshape(-1, 3)):
            hot[int(v)] = hot.get(int(v), 0) + row
    model.hot_numbers = np.array([hot.get(int(v), np.zeros(3, np.int64)) for v in model.hot], np.int64).reshape(-1, 3)
    model.types, model.discount = int(n[4]), discounts(n[:4])

    def write_before(table: pa.Table) -> pa.Table:
        m = shared.value
        s, ids, counts = _merge(table)
        dense = np.zeros(int(m.base[s + 1] - m.base[s]), np.int64)
        dense[ids.astype(np.int64) - m.base[s]] = counts
        _write(m.uri(s, "word-before"), dense)
        return pa.table({"n": pa.array([[int((counts == k).sum()) for k in range(1, 5)] + [len(counts)]], pa.list_(pa.int64()))})

    low = sum((np.array(r.n) for r in pairs.filter("kind = 1").groupBy("shard").applyInArrow(write_before, "n array<bigint>").collect()), np.zeros(5, np.int64))
    model.low_discount = discounts(low[:4])
    if model.types:
        rest = low[0] * model.low_discount[1] + low[1] * model.low_discount[2] + (low[4] - low[0] - low[1]) * model.low_discount[3]
        model.low_rest = float(rest / model.types)
    return model


def _ids(m: Model, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of tokens, the distinct ids among them (sorted) and each token's place there."""
    words, place = np.unique(tokens, return_inverse=True)
    ids = m.ids(words)
    distinct, again = np.unique(ids, return_inverse=True)
    return ids[place], distinct, again[place]


def _pairs(ids: np.ndarray, starts: np.ndarray, begin: int) -> np.ndarray:
    """(context, word) keys of all tokens; the first token of a text follows ``begin``."""
    context = np.concatenate(([0], ids[:-1])).astype(np.uint64) if len(ids) else ids
    context[starts[:-1]] = begin
    return (context << np.uint64(32)) | ids


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add n_tokens, n_known, train_tokens (long), base_score, score (double, log10) and perplexity to every row.

    A null text is scored as an empty one. Columns of the added names are replaced. Without training text every
    probability is 1 (one unknown word is all there is).
    """
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    names = [c for c in df.columns if c not in added]
    keep, at = [df.columns.index(c) for c in names], df.columns.index(text)
    types = [F.lit(0).cast("long")] * 3 + [F.lit(0.0)] * 3
    schema = df.select(*names, *[t.alias(c) for t, c in zip(types, added)]).schema
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        v, n = m.vocabulary, m.train_tokens
        for batch in batches:
            tokens, starts = _tokens(batch.column(at))
            ids, words, place = _ids(m, tokens)
            count = m.by_id(words, "word-n")
            before = m.by_id(words, "word-before")
            low = (np.maximum(before - m.low_discount[np.minimum(before, 3)], 0) / max(m.types, 1) + m.low_rest / (v + 1))
            keys, pair = np.unique(_pairs(ids, starts, v), return_inverse=True)
            context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
            heads, head = np.unique(context, return_inverse=True)
            numbers = m.context_numbers(heads)
            total = np.where(heads == v, 0, m.by_id(heads, "word-n"))
            # an unknown word and the begin of a text share the id v; only begins are followed by a first token
            follow = numbers @ m.discount[1:]
            c = m.bigram_counts(keys)
            known = low[np.searchsorted(words, word)]
            total = np.where(heads == v, m.train_texts, total)
            seen = total[head] > 0
            p = np.where(seen, (np.maximum(c - m.discount[np.minimum(c, 3)], 0) + follow[head] * known) / np.maximum(total[head], 1), known)
            logs = np.log10(p)[pair]
            lost = np.concatenate(([False], (ids == v)[:-1])) if len(ids) else np.empty(0, bool)
            lost[starts[:-1]] = False
            logs[lost] = np.log10(low)[place[lost]]
            base = np.log10((count + 1) / (n + v + 1))[place]
            sums = [np.add.reduceat(x, starts[:-1]) if len(x) else np.empty(0) for x in (logs, base, (count > 0)[place].astype(np.int64))]
            length = np.diff(starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array(length, pa.int64()), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(length), n), pa.int64()),
                 pa.array(sums[1], pa.float64()), pa.array(sums[0], pa.float64()), pa.array(10 ** np.minimum(-sums[0] / np.maximum(length, 1), 300.0))], names=[*names, *added])

    return with_batches(df).mapInArrow(run, schema)


def op6_lm_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out: Column = held_out("doc_id", 7, 2)
    model = train(docs.filter(~out))
    return score(docs.withColumn("held_out", out), model).drop("text", "perplexity")
