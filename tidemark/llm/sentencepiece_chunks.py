"""SentencePiece encoding and decoding through a table of distinct chunks.

The library marks every space with U+2581, puts one mark before a text and then merges pieces. If no piece of
the model holds a mark after another character, no merge crosses from a character to a following mark, so a text
falls into *chunks* (a run of marks and the characters up to the next mark) that are segmented independently.
Each task keeps a table of the distinct chunks it has met: a chunk is segmented by the library once and its ids
are joined back by position. The table is emptied when it holds ``TABLE_ROWS`` chunks, which bounds memory and
changes no result; there is no shuffle, and a lost task only repeats its own rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import with_batches

MARK = "▁"
TABLE_ROWS = 300_000
_TYPES = {"n_tokens": (T.LongType(), pa.int64()), "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
          "decoded": (T.StringType(), pa.string()), "ids_sha256": (T.StringType(), pa.string()),
          "decoded_sha256": (T.StringType(), pa.string())}


def check_model(processor) -> None:
    """Raise if a piece holds a mark after another character: then chunks would not be independent."""
    for i in range(processor.get_piece_size()):
        if MARK in processor.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} crosses a whitespace marker")


class ChunkTable:
    """Distinct chunk -> its ids (as text) and decoded text, for one task."""

    def __init__(self, processor, rows: int = TABLE_ROWS):
        self.processor, self.rows = processor, rows
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}  # only chunks that do not decode to themselves

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text's chunks without their first mark, other marks as spaces; none for an empty text."""
        if not text:
            return []
        out = text.replace(MARK, " ").split(" ")
        if "" in out:  # runs of spaces: every extra space belongs to the chunk after it
            runs, extra = [], ""
            for k, x in enumerate(out):
                if x == "" and k < len(out) - 1:
                    extra += " "
                else:
                    runs.append(extra + x)
                    extra = ""
            return runs
        return out

    def learn(self, wanted: set[str]) -> None:
        new = [c for c in wanted if c not in self.ids]
        if len(self.ids) + len(new) > self.rows:
            self.ids.clear()
            self.decoded.clear()
            new = list(wanted)
        if "" in wanted:  # a lone mark, as after a trailing space; the library has no text for it
            self.ids[""] = str(self.processor.piece_to_id(MARK))
            new = [c for c in new if c]
        for a in range(0, len(new), 20_000):
            part = new[a:a + 20_000]
            rows = self.processor.encode(part, out_type=int, num_threads=1)
            for c, ids, text in zip(part, rows, self.processor.decode(rows, num_threads=1)):
                self.ids[c] = " ".join(map(str, ids))
                if text != c:
                    self.decoded[c] = text

    def encode(self, text: str) -> tuple[str, str]:
        """Ids of a text as decimal numbers joined by one space, and the decoded text; its chunks are known."""
        parts = self.chunks(text)
        ids = " ".join(map(self.ids.__getitem__, parts))
        return ids, " ".join(map(self.decoded.get, parts, parts))


def encode_decode(df: DataFrame, model: str, want: tuple[str, ...] = ("n_tokens", "ids"), text: str = "text",
                  end_id: bool = True) -> DataFrame:
    """Encode column ``text`` with the model file ``model``, decode the ids again, add the columns of ``want``.

    ``want`` is any of n_tokens (long), ids (array<int>), decoded (string), ids_sha256 (of the decimal ids joined
    by one space) and decoded_sha256 (of the decoded text in UTF-8), both lowercase hex. A null text counts as
    empty: no ids but the end id. All other columns are kept; columns of the wanted names are replaced.
    ``model`` must be readable at the same path on every worker (ship it with the environment or ``addFile``).
    """
    unknown = set(want) - set(_TYPES)
    if unknown:
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    names = [c for c in df.columns if c not in want]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(c, _TYPES[c][0]) for c in want])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        check_model(processor)
        table, end = ChunkTable(processor), str(processor.eos_id())
        for batch in batches:
            column = [t or "" for t in batch.column(at).to_pylist()]
            out: dict[str, list] = {c: [] for c in want}
            for a in range(0, len(column), 64):
                part = column[a:a + 64]
                wanted: set[str] = set()
                for t in part:
                    wanted.update(table.chunks(t))
                table.learn(wanted)
                for t in part:
                    ids, decoded = table.encode(t)
                    if end_id:
                        ids = f"{ids} {end}" if ids else end
                    if "n_tokens" in out:
                        out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                    if "ids" in out:
                        out["ids"].append([int(x) for x in ids.split()])
                    if "decoded" in out:
                        out["decoded"].append(decoded)
                    if "ids_sha256" in out:
                        out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(out[c], _TYPES[c][1]) for c in want],
                                             names=[*names, *want])

    at = df.columns.index(text)
    keep = [df.columns.index(c) for c in names]
    return with_batches(df).mapInArrow(run, schema)


def op4_sentencepiece(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = ("n_tokens", "ids_sha256", "decoded_sha256")
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), want).drop("text")
