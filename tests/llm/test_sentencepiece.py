import hashlib

import pytest

from tests.llm.helpers import SF, frame
from tidemark.llm import sentencepiece_chunks as S

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "   a", "a  b ", "a\nb\tc", "▁x ▁▁ y", "a\x00b", "　z\xa0", "<s> </s> <unk>", "😀 ퟿", "x" * 3000, " \n ", "a ", "Ä ö  ﬁ",
       "ab " * 4000]


def _expect(p, text):
    ids = p.encode(text or "") + [p.eos_id()]
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(p.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("rows", [3, S.TABLE_ROWS])
def test_equals_the_library(spark, rows, monkeypatch):
    p = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = S.ChunkTable(p, rows)
    for t in ODD:
        table.learn(set(table.chunks(t)))
        ids, decoded = table.encode(t)
        assert [int(x) for x in ids.split()] == p.encode(t) and decoded == p.decode(p.encode(t))


def test_operator_on_odd_and_given_texts(spark):
    p = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ODD + [None] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    df = frame(spark, [(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    out = S.encode_decode(df, MODEL, ("n_tokens", "ids", "ids_sha256", "decoded_sha256")).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _expect(p, texts[r.doc_id])
        assert r.ids == p.encode(texts[r.doc_id] or "") + [p.eos_id()]
    assert S.encode_decode(df.limit(0), MODEL).collect() == []
