"""Ids equal the tiktoken library's, decoded bytes the text's."""

import base64
import hashlib
import random

import numpy as np
import pytest

from segmint.llm import pretokens, rank_bpe
from segmint.llm.queries import op11_rank_bpe

TEXTS = [
    None, "", " ", "\n", "Hello <|endoftext|> world", "a  b   c    d\n\n e\t\tf \n x", " lead", "trail ", "\0\0 \0",
    "aaaaaaaaaaaaaaaaaaa", "it's 's 'S don't we'll", "a\x1cb \x85 e\xa0f", "日本語 한국어 👩‍👩‍👧", "½ Ⅷ ² é", "word " * 50000,
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(rank_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_the_library(spark, library):
    rows = [(i if i else None, t, 1) for i, t in enumerate(TEXTS * 2)]
    out = rank_bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, _t int")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_long_words(library):
    rng = random.Random(5)
    words = ["x" * 20000, "a" * 3333, "ab" * 4000, "thequickbrownfox" * 300, "日本語" * 700, "".join(rng.choice("etaoinshrdlu") for _ in range(1500)), "y" * 65, "z" * 64]
    bpe = rank_bpe.RankBpe(*rank_bpe.defaults())
    assert [x.tolist() for x in bpe.encode([w.encode() for w in words])] == [library.encode_ordinary(w) for w in words]


def test_both_queries_agree_on_words_of_any_size(monkeypatch):
    """The keyed query, leftmost pair by pair or many at once, on all words."""
    rng = random.Random(6)
    words = ["".join(rng.choice("aabst ehin") for _ in range(rng.randint(1, 40))).encode() for _ in range(60)]
    flat, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    bpe = rank_bpe.RankBpe(*rank_bpe.defaults())
    one = bpe.encode_flat(flat, sizes)
    monkeypatch.setattr(rank_bpe, "SHORT", 0)
    two = bpe.encode_flat(flat, sizes)
    assert one[0].tolist() == two[0].tolist() and one[1].tolist() == two[1].tolist()


def test_words_are_forgotten_and_learnt_again(library):
    bpe = rank_bpe.RankBpe(*rank_bpe.defaults())
    bpe.table.limit = 3
    for t in ["one two three four", "five six", "one seven eight", "five five one", "ééé ½", "日本 five"] * 2:
        assert bpe.encode([t.encode()])[0].tolist() == library.encode_ordinary(t)


def test_long_texts_are_cut_where_no_pre_token_lies(library, monkeypatch):
    rng = random.Random(7)
    text = "".join(rng.choice(["ab", " ", "  ", "\n", "'s", ".", "é", " x", "12"]) for _ in range(4000))
    for size in (1, 7, 100):
        pieces, owner = pretokens.cut_long([text.encode(), b"", b"a b"], size)
        assert b"".join(p for p, k in zip(pieces, owner) if k == 0) == text.encode()
        ids = [library.encode_ordinary(p.decode()) for p, k in zip(pieces, owner) if k == 0]
        assert sum(ids, []) == library.encode_ordinary(text)
    monkeypatch.setattr(pretokens.cut_long, "__defaults__", (50,))
    bpe = rank_bpe.RankBpe(*rank_bpe.defaults())
    assert [x.tolist() for x in bpe.encode([text.encode(), b"", b"a b"])] == [library.encode_ordinary(x) for x in (text, "", "a b")]


def test_unknown_ids_are_an_error():
    import numpy as np

    bpe = rank_bpe.RankBpe(*rank_bpe.defaults())
    assert bpe.decode([np.array([72, 73], np.int32), np.empty(0, np.int32)])[1] == b""
    with pytest.raises(ValueError):
        bpe.decode([np.array([10**6], np.int32)])


def test_query_on_a_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_rank_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_clashing_output_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, _t int")
    assert rank_bpe.round_trip(df).columns == ["doc_id", "text", "_t", "ids", "decoded"]
    assert rank_bpe.round_trip(df).count() == 0
    with pytest.raises(ValueError):
        rank_bpe.round_trip(spark.createDataFrame([], "text string, IDS int"))
