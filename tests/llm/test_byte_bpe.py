"""Ids and texts equal the tokenizers library's, row for row."""

import hashlib

import pytest

from segmint.llm import byte_bpe
from segmint.llm.queries import op7_byte_bpe
from segmint.llm.tokens import load_tokenizer

TEXTS = [
    None, "", " ", "\n", "Hello <|endoftext|> world", "a<|endoftext|>b", "a  b   c    d\n\n e\t\tf \n x", " lead", "trail ",
    "aaaaaaaaaaaaaaaaaaa", "it's 's 'S don't we'll", "a\x1cb \x85 e\xa0f", "日本語 한국어 👩‍👩‍👧", "½ Ⅷ ² é", "x" * 20000, "word " * 5000,
]


def test_equal_to_the_library(spark):
    tk = load_tokenizer(byte_bpe.vocabulary_path())
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, ids int")
    rows = byte_bpe.round_trip(df).collect()
    assert len(rows) == 2 * len(TEXTS)
    got = sorted((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in rows)
    for (_, ids, decoded), t in zip(got, TEXTS * 2):
        assert ids == tk.encode(t or "", add_special_tokens=False).ids
        assert decoded == tk.decode(ids, skip_special_tokens=False)


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    tk = load_tokenizer(byte_bpe.vocabulary_path())
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = op7_byte_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = tk.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(tk.decode(ids, skip_special_tokens=False))


def test_clashing_output_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, _t int")
    assert byte_bpe.encode(df, decoded="back").columns == ["doc_id", "text", "_t", "ids", "back"]
    assert byte_bpe.encode(df, decoded="back").count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(spark.createDataFrame([], "text string, IDS int"))
