"""Language identification with string kernels.

A text is the set of its byte n-grams of length 1 to 3 (A-Z folded, other ASCII non-letters read as spaces): the
blended-spectrum presence kernel is k(x, y) = |X & Y| / sqrt(|X| |Y|). Nyström landmarks (``LANDMARKS`` texts per
language) turn it into finite features, and kernel ridge regression, one language against the rest, is solved in
closed form from at most ``FIT_ROWS`` texts per language, both chosen by a hash of the id, or from all windows of all
texts (``fit_rows=None``, as the pipeline does). Those two bounds are parameters; they fix the size of everything that reaches the driver (gram sets of the landmarks, kernel rows of
the fit texts). Scoring is a presence matrix times the landmark matrix per batch, over all rows, with no shuffle.

Presence says nothing about how much of a text is in a language, so a long foreign quotation would decide a text.
Texts are therefore scored in windows of about ``WINDOW`` bytes that together cover the whole text, and the
windows' scores are averaged by length. Fitting takes one window of each chosen text, picked by hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, lowest_per_group, texts, with_batches

LANDMARKS = 24
FIT_ROWS = 1500
RIDGE = 1e-3
SHARPNESS = 4.0
FIT_PARTS = 8
WINDOW = 512
UNDETERMINED = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = (_FOLD != 0x20) & (np.arange(256) < 0x80)


def grams(buf: np.ndarray) -> np.ndarray:
    """Sorted distinct 1- to 3-grams of a text's bytes as (length << 24 | bytes)."""
    x = _FOLD[buf].astype(np.uint32)
    if len(x) == 0:
        return np.empty(0, np.uint32)
    x = np.concatenate(([0x20], x, [0x20])).astype(np.uint32)
    three = np.unique((x[:-2] << 16) | (x[1:-1] << 8) | x[2:])
    two = np.unique(np.append(three >> 8, (x[-2] << 8) | x[-1]))
    one = np.unique(np.append(two >> 8, x[-1]))
    return np.concatenate((one | (1 << 24), two | (2 << 24), three | (3 << 24))).astype(np.uint32)


def has_letter(buf: np.ndarray) -> bool:
    """Whether the text holds a letter of any script."""
    if _ASCII_LETTER[buf].any():
        return True
    return bool((buf >= 0x80).any()) and any(c.isalpha() for c in buf.tobytes().decode("utf-8", "ignore"))


def windows(buf: np.ndarray, size: int = WINDOW) -> list[np.ndarray]:
    """Cut a text into pieces of about ``size`` bytes, at a space where one follows within another ``size`` bytes."""
    if len(buf) <= size * 3 // 2:
        return [buf]
    spaces = np.flatnonzero(buf == 0x20)
    cuts = np.arange(size, len(buf) - size // 2, size)
    at = np.searchsorted(spaces, cuts)
    found = at < len(spaces)
    snapped = cuts.copy()
    snapped[found] = spaces[at[found]]
    cuts = np.unique(np.where(snapped - cuts < size, snapped, cuts))
    while (inside := (cuts < len(buf)) & ((buf[np.minimum(cuts, len(buf) - 1)] & 0xC0) == 0x80)).any():
        cuts = np.where(inside, cuts + 1, cuts)  # no cut inside a character
    cuts = np.unique(cuts)
    return np.split(buf, cuts[(cuts > 0) & (cuts < len(buf))])


class Landmarks:
    """Gram sets of the landmark texts as a (gram x landmark) matrix, columns scaled by 1 / sqrt(set size)."""

    def __init__(self, sets: list[np.ndarray]):
        self.ids = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.uint32)
        self.matrix = np.zeros((len(self.ids), len(sets)), np.float32)
        for j, s in enumerate(sets):
            self.matrix[np.searchsorted(self.ids, s), j] = 1 / np.sqrt(len(s))

    def kernel(self, sets: list[np.ndarray], rows: int = 64) -> np.ndarray:
        """Kernel rows of gram sets against all landmarks, by batched matrix products."""
        out = np.zeros((len(sets), self.matrix.shape[1]), np.float32)
        if len(self.ids) == 0:
            return out
        for a in range(0, len(sets), rows):
            part = sets[a:a + rows]
            present = np.zeros((len(part), len(self.ids)), np.float32)
            for i, s in enumerate(part):
                if len(s):
                    at = np.searchsorted(self.ids, s)
                    at[at == len(self.ids)] = 0
                    present[i, at[self.ids[at] == s]] = 1 / np.sqrt(len(s))
            out[a:a + rows] = present @ self.matrix
        return out


def _picked_grams(column: pa.Array, keys: pa.Array) -> list[np.ndarray]:
    """Gram set of one window of every text, picked by a hash of the text's key."""
    out = []
    for a, _, buf, offs in texts(column):
        for i in range(len(offs) - 1):
            pieces = windows(buf[offs[i]:offs[i + 1]])
            out.append(grams(pieces[zlib.crc32(str(keys[a + i]).encode()) % len(pieces)]))
    return out


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        landmarks: int = LANDMARKS, fit_rows: int | None = FIT_ROWS, ridge: float = RIDGE):
    """Fit on rows with a language and a text. Returns (languages, Landmarks, weights, bias); no rows, no languages.

    The sample is the ``fit_rows`` rows of lowest key hash per language, its first ``landmarks`` the landmarks.
    With ``fit_rows`` None only the landmarks are chosen so, and the regression learns from every window with a letter of
    every row; a text counts once, its windows by their length. Sums of a fixed size leave the tasks.
    """
    spark = train.sparkSession
    known = train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    picked = (lowest_per_group(known.select(key, lang), lang, landmarks if fit_rows is None else fit_rows, [F.xxhash64(key), F.col(key)])
              .select(F.col(key).alias("_k"), F.col("_n")).dropDuplicates(["_k"]))
    rows = known.select(key, text, lang).join(F.broadcast(picked), F.col(key) == F.col("_k")).select(text, lang, "_n", "_k")

    def sets_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(_picked_grams(batch.column(0), batch.column(3)), pa.list_(pa.int32()))], names=["lang", "n", "k", "grams"])

    schema = f"lang string, n int, k {picked.schema['_k'].dataType.simpleString()}, grams array<int>"
    # gram sets of a bounded number of windows, in few partitions of a fixed order: each sends one sum
    sets = with_batches(rows).mapInArrow(sets_of, schema).repartition(FIT_PARTS, "k").sortWithinPartitions("k", "lang", F.hash("grams")).checkpoint()
    chosen = sets.filter((F.col("n") <= landmarks) & (F.size("grams") > 0)).collect()
    chosen = sorted(((r.lang, r.n, np.array(r.grams, np.uint32)) for r in chosen), key=lambda r: (r[0], r[1], r[2].tobytes()))
    marks = Landmarks([s for _, _, s in chosen])
    counted = sets.groupBy("lang") if fit_rows is not None else known.groupBy(F.col(lang).alias("lang"))
    found = {r.lang: r["count"] for r in counted.count().collect()}  # one row per language
    langs = sorted(found)
    if not chosen or not langs:
        return [], marks, np.zeros((0, 0)), np.zeros(0)
    shared = spark.sparkContext.broadcast((marks, {name: i for i, name in enumerate(langs)}, found))

    def moments(batches):
        marks, number, found = shared.value
        m = marks.matrix.shape[1] + 1
        square, cross, seen = np.zeros((m, m)), np.zeros((m, len(number))), False
        for batch in batches:
            lists = batch.column(3)
            k = np.hstack([marks.kernel([np.array(g, np.uint32) for g in lists.to_pylist()]).astype(np.float64), np.ones((len(lists), 1))])
            names = batch.column(0).to_pylist()
            weight = np.array([1 / found[x] for x in names])  # languages count alike however many rows they have
            y = np.where(np.array([number[x] for x in names])[:, None] == np.arange(len(number)), 1.0, -1.0)
            square += (k * weight[:, None]).T @ k
            cross += (k * weight[:, None]).T @ y
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([square.tobytes()], pa.binary()), pa.array([cross.tobytes()], pa.binary())], names=["square", "cross"])

    def all_moments(batches):
        from pyspark import TaskContext

        marks, number, found = shared.value
        m = marks.matrix.shape[1] + 1
        square, cross = np.zeros((m, m)), np.zeros((m, len(number)))
        for batch in batches:
            names = batch.column(1).to_pylist()
            for a, _, buf, offs in texts(batch.column(0)):
                sets, weight, of = [], [], []
                for i in range(len(offs) - 1):
                    for w in windows(buf[offs[i]:offs[i + 1]]):
                        if has_letter(w):
                            sets.append(grams(w))
                            weight.append(len(w) / (offs[i + 1] - offs[i]) / found[names[a + i]])
                            of.append(number[names[a + i]])
                for b in range(0, len(sets), 4096):
                    k = np.hstack([marks.kernel(sets[b:b + 4096]).astype(np.float64), np.ones((len(sets[b:b + 4096]), 1))])
                    y = np.where(np.array(of[b:b + 4096])[:, None] == np.arange(len(number)), 1.0, -1.0)
                    weighted = (k * np.array(weight[b:b + 4096])[:, None]).T
                    square += weighted @ k
                    cross += weighted @ y
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([square.tobytes()], pa.binary()), pa.array([cross.tobytes()], pa.binary())],
                                         names=["part", "square", "cross"])

    def merged(table: pa.Table) -> pa.Table:
        t = table.sort_by("part")
        added = [sum(np.frombuffer(x.as_buffer()) for x in t.column(c)).tobytes() for c in ("square", "cross")]
        return pa.table({"part": t.column("part").slice(0, 1), **{c: pa.array([x], pa.binary()) for c, x in zip(("square", "cross"), added)}})

    if fit_rows is None:
        schema = "part bigint, square binary, cross binary"
        sums = (with_batches(known.select(text, lang)).mapInArrow(all_moments, schema).withColumn("_to", F.col("part") % FIT_PARTS)
                .groupBy("_to").applyInArrow(lambda t: merged(t.drop(["_to"])), schema).collect())  # at most FIT_PARTS rows
        sums = sorted(sums, key=lambda r: r.part)
    else:
        sums = with_batches(sets.select("lang", "n", "k", "grams")).mapInArrow(moments, "square binary, cross binary").collect()  # at most FIT_PARTS rows
    size = marks.matrix.shape[1] + 1
    square = sum(np.frombuffer(bytes(r.square)).reshape(size, size) for r in sums)
    cross = sum(np.frombuffer(bytes(r.cross)).reshape(size, len(langs)) for r in sums)
    values, vectors = np.linalg.eigh(marks.kernel([s for _, _, s in chosen]).astype(np.float64))
    good = values > values[-1] * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    turn = np.zeros((size, root.shape[1] + 1))  # kernel rows and the constant, turned into Nyström features
    turn[:-1, :-1], turn[-1, -1] = root, 1.0
    gram = turn.T @ square @ turn + ridge * np.eye(turn.shape[1])
    beta = np.linalg.solve(gram, turn.T @ cross)
    return langs, marks, root @ beta[:-1], beta[-1]


def predict(df: DataFrame, model, text: str = "text", evidence: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1: softmax of the regression outputs; 0 for ``und``) to every row.

    A null text or one without a letter is ``und``, as is every row if the model knows no language. With ``evidence``
    also the best regression output itself, which unlike the softmax is low if no language fits (null for ``und``).
    """
    langs, marks, weights, bias = model
    added = ["lang_pred", "score", *(["evidence"] if evidence else [])]
    names = [c for c in df.columns if c not in added]
    keep, at = [df.columns.index(c) for c in names], df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast((langs, marks, weights.astype(np.float32), bias))
    schema = df.select(*names, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"),
                       *([F.lit(None).cast("double").alias("evidence")] if evidence else [])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, marks, weights, bias = shared.value
        for batch in batches:
            pred, score, raw = [], [], []
            for _, _, buf, offs in texts(batch.column(at)):
                pieces, owner = [], []
                for i in range(len(offs) - 1):
                    for w in windows(buf[offs[i]:offs[i + 1]]) if langs else []:
                        if has_letter(w):
                            pieces.append(w)
                            owner.append(i)
                total = np.zeros((len(offs) - 1, max(1, len(langs))))
                output = np.zeros(total.shape)
                if pieces:
                    z = SHARPNESS * (marks.kernel([grams(w) for w in pieces]) @ weights + bias)
                    np.add.at(output, np.array(owner), z / SHARPNESS * np.array([len(w) for w in pieces])[:, None])
                    z = np.exp(z - z.max(axis=1, keepdims=True))
                    z *= np.array([len(w) for w in pieces])[:, None] / z.sum(axis=1, keepdims=True)
                    np.add.at(total, np.array(owner), z)
                weight = total.sum(axis=1)
                best = total.argmax(axis=1)
                top = total[np.arange(len(total)), best] / np.where(weight > 0, weight, 1)
                pred += [langs[b] if w > 0 else UNDETERMINED for b, w in zip(best, weight)]
                score += np.clip(top, 0.0, 1.0).tolist()
                raw += [x / w if w > 0 else None for x, w in zip(output.max(axis=1), weight)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                                             + ([pa.array(raw, pa.float64())] if evidence else []), names=[*names, *added])

    return with_batches(df).mapInArrow(run, schema)


def op2_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out("doc_id", 4, 2)
    model = fit(docs.filter(~out))
    return predict(docs.select("doc_id", "text", out.alias("held_out")), model).drop("text")
