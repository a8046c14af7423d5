"""Sketches against exact sets; neighbours against a plain loop."""

import hashlib
import random

import numpy as np

from segmint.llm import fingerprints as fp
from segmint.llm.common import shingle_set
from segmint.llm.queries import op2_fingerprints

SF = "/root/testdata/sf0.001"


def shingles(text: str) -> set:
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    """docs: (id, text) -> rows in order."""
    order = sorted(((i, t or "") for i, t in docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    out = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), e, nxt, t))
    return out


def check(rows, docs):
    want = brute(docs)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in rows), key=key)
    want.sort(key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, (_, _, _, e, nxt, t) in zip(got, want):
        assert g[3] == fp.to_text(fp.sketch(t.encode()))
        for near, other in ((g[4], e), (g[5], nxt)):
            a, b = shingles(t), shingles(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - exact) < 0.2
            if len(a | b) <= fp.K:
                assert abs(near - exact) < 1e-12


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(op2_fingerprints(spark, SF).collect(), docs)


def test_edge_rows(spark):
    from pyspark.sql import functions as F

    def run(docs):
        df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, block string")
        return fp.neighbours(df).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).collect()

    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("ab cd éf gh ij".split()) for _ in range(rng.randint(0, 30)))
    check(run([(7, "one two three")]), [(7, "one two three")])
    check(run([(None, "x y")]), [(None, "x y")])
    docs = [(rng.choice([None, *range(40)]), rng.choice([None, "", text(), text(), "Ü " * 4000])) for _ in range(300)]
    check(run(docs), docs)
    docs = [(5, "same text here")] * 30 + [(6, None)] * 3 + [(9, "b")]
    check(run(docs), docs)
    assert run([]) == []


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a = " ".join(map(str, rng.integers(0, 500, 6000))).encode()
    b = " ".join(map(str, rng.integers(0, 500, 3000))).encode()
    sa, sb = fp.sketch(a), fp.sketch(b)
    whole = np.union1d(shingle_set(a), shingle_set(b))
    assert (fp.merge(sa, sb) == whole[: fp.K]).all()
    assert abs(fp.distinct(fp.merge(sa, sb)) / len(whole) - 1) < 0.3
    both = fp.sketch(a + b" " + b)
    assert fp.containment(sa, both) > 0.8 and fp.containment(both, sb) < 0.6
    assert fp.from_text(fp.to_text(sa)).tolist() == sa.tolist()


def test_merge_by_key(spark):
    rows = [(i, ["a", "b", None][i % 3], f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4} w{i + 5}") for i in range(60)] + [(99, "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    s = fp.sketch_documents(df).join(df.select("doc_id", "source"), "doc_id")
    got = {r["key"]: r["fingerprint"] for r in fp.merge_sketches(s, "source").collect()}
    for key in ("a", "b", None, "c"):
        sets = [shingle_set(t.encode()) for _, k, t in rows if k == key and t]
        want = np.unique(np.concatenate(sets))[: fp.K] if sets else np.empty(0, np.uint64)
        assert got[key] == fp.to_text(want)


def test_ids_beyond_doubles(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    ids = [*(2**62 + rng.randrange(2**20) for _ in range(200)), *(rng.randrange(-(2**63), 2**63) for _ in range(200)), 2**63 - 1, -(2**63)]
    docs = [(i, " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(12))) for i in ids]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = fp.neighbours(df).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).collect()
    check(rows, docs)
