"""Token counts and packed pieces against the tokenizers library."""

import os
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest

from segmint.llm import packing, token_count
from segmint.llm.queries import op1_packing, op5_token_count
from segmint.llm.tokens import TextIds, load_tokenizer, tokenizer_path

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " \n\t", "Hello <|endoftext|> world<|startoftext|>x", "don't we'll 's 'tis \"'s I'M x'RE 'd d'd'd ''s '", "'", "a'",
    "ÄÖ 123 á x  y\n z İstanbul ﬁ ½ \xa0b c é ΑΣ Σ", "日本語 テスト 👩‍👩‍👧", "×÷ a×b ÀÉÎ ß ÿ", "a\x1cb \x85 x\x00y", "word " * 9000, "x" * 30000,
]


@pytest.fixture(scope="module")
def tk():
    return load_tokenizer(tokenizer_path())


def test_ids_of_odd_texts(tk):
    enc = TextIds(tokenizer_path(), batch_bytes=64)
    for _ in range(2):
        for t, ids in zip(TEXTS, enc.encode([None if t is None else t.encode() for t in TEXTS])):
            assert ids.tolist() == tk.encode(t or "", add_special_tokens=False).ids


def test_count_query(spark, tk):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_token_count(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(tk.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 2048)


def test_count_edge_rows(spark, tk):
    df = spark.createDataFrame([(None if i == 3 else i // 2, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    got = sorted((r["n_bytes"], r["n_tokens"]) for r in token_count.count_tokens(df).collect())
    assert got == sorted((len((t or "").encode()), len(tk.encode(t or "", add_special_tokens=False).ids)) for t in TEXTS)
    assert token_count.count_tokens(df.limit(0)).count() == 0


def check_packing(rows, docs, tk, length=4096, end=2):
    """Every id in exactly one piece, sequences gapless and not too long."""
    ids = {k: np.array(tk.encode(t or "", add_special_tokens=False).ids + [end], np.uint32) for k, t in docs.items()}
    seen: dict = {}
    seqs: dict = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(part.astype("<u4").tobytes()) == r["ids_crc32"]
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(seen) == set(ids)
    for k, spans in seen.items():
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
        assert at == len(ids[k])
    for spans in seqs.values():
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
        assert at <= length
    return sum(map(len, ids.values())), len(seqs)


def test_packing_query(spark, tk):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    total, n = check_packing(op1_packing(spark, "/root/testdata/sf0.01").collect(), docs, tk)
    assert total / (n * 4096) > 0.985


def test_packing_edge_rows(spark, tk):
    docs = dict(enumerate(TEXTS))
    df = spark.createDataFrame([(i, t, 0) for i, t in docs.items()], "doc_id long, text string, length int")
    out = packing.pack_documents(df)
    from pyspark.sql import functions as F

    check_packing(out.withColumn("ids_crc32", F.crc32("ids")).collect(), docs, tk)
    same = spark.createDataFrame([(None, "a b c")] * 40 + [(7, "a b c")] * 40, "doc_id long, text string")
    rows = packing.pack_documents(same).collect()
    assert len(rows) == 80 and {(r["sequence_id"], r["offset"]) for r in rows} == {(0, 4 * k) for k in range(80)}
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_column_generation_reaches_the_bound():
    rng = np.random.default_rng(5)
    sizes = np.arange(1, 65)
    demand = rng.integers(0, 400, 64)
    sizes, demand = sizes[demand > 0], demand[demand > 0]
    plan = packing.integer_patterns(sizes, demand, 64)
    held = sum(p * n for p, n in plan)
    assert (held == demand).all() and all(int(p @ sizes) <= 64 for p, _ in plan)
    patterns, uses = packing.column_generation(sizes, demand.astype(float), 64)
    assert (patterns.T @ uses >= demand * (1 - 1e-6)).all() and (patterns @ sizes <= 64).all()
    lower = max(sizes @ demand / 64, demand[sizes > 32].sum())
    assert lower - 1e-6 <= uses.sum() <= sum(n for _, n in plan) <= 1.003 * uses.sum() + 5


def test_inverse_by_elimination():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30):
        m = rng.integers(0, 4, (n, n)) + np.diag(rng.integers(1, 9, n)[rng.permutation(n)])
        m = m[rng.permutation(n)].astype(float)
        if abs(np.linalg.det(m)) > 1e-6:
            assert np.allclose(packing.inverted(m) @ m, np.eye(n), atol=1e-8)


def test_whole_query_at_sf01_in_a_process_of_its_own():
    """The plan needs hundreds of steps there; the time limit is generous."""
    code = (
        "from segmint.session import build_session\n"
        "from segmint.llm.queries import op1_packing\n"
        "spark = build_session(master='local[4]')\n"
        "print(op1_packing(spark, '/root/testdata/sf0.1').selectExpr('sum(length) s', 'count(distinct sequence_id) n', 'count(distinct doc_id) d').first())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=240, check=True).stdout
    s, n, d = map(int, re.search(r"s=(\d+), n=(\d+), d=(\d+)", out).groups())
    assert d == 10_000 and s / (4096 * n) > 0.99
