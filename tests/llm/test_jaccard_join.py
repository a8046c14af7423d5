"""The join against brute force over exact shingle sets."""

import random

import numpy as np
import pytest

from segmint.llm import jaccard_join as jj
from segmint.llm.components import connected_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    """(id, n, component) by union-find over all pairs."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j > i}:
            o = len(s & sets[j])
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = root(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d is None, d or 0, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    words = lambda m: [rng.choice(vocab) for _ in range(m)]
    passage = words(18)
    base = words(120)
    docs = []
    for _ in range(n):
        r = rng.random()
        if r < 0.35:  # edits of one text, near and far
            w = list(base)
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w = w[: rng.randint(60, 120)]
        elif r < 0.55 and docs:
            w = (rng.choice(docs) or "x").split()
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = words(rng.randint(0, 90))
        if rng.random() < 0.4:
            at = rng.randint(0, len(w))
            w = w[:at] + passage + w[at:]
        docs.append(rng.choice([" ", "\n", "\t "]).join(w) if w else rng.choice([None, "", " \n"]))
    docs += ["a b", "A  b", "a b c d e", "a b c d", None, "one"]
    return docs


def run(spark, docs, parts=5, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    rows = jj.join_documents(df, **options).collect()
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs = list(enumerate(corpus(seed), start=-20))
    assert run(spark, docs) == brute(docs)


def test_blocks_of_large_groups_and_few_frequent(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 7)
    monkeypatch.setattr(jj, "FREQUENT", 11)
    docs = list(enumerate(corpus(9)))
    assert run(spark, docs, 3) == brute(docs)


def test_repeated_rows_null_ids_and_extra_columns(spark):
    texts = corpus(4, 60)
    docs = [(None if i % 9 == 0 else i % 50, t) for i, t in enumerate(texts)]
    assert run(spark, docs) == brute(docs)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, k string, _first int")
    kept = jj.one_of_each(df)
    want = {(d, t) for (d, t) in docs if d is None or d in {c for _, _, _, c in brute(docs)}}
    assert kept.columns == df.columns and {(r["doc_id"], r["text"]) for r in kept.collect()} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jj.join_documents(df).count() == 0 and jj.one_of_each(df).count() == 0
    assert run(spark, [(1, None), (2, " ")]) == brute([(1, None), (2, " ")])


def test_group_links_connect_what_links_connect():
    rng = np.random.default_rng(3)
    base = rng.choice(10_000, 80, replace=False)
    sets = []
    for _ in range(60):
        s = set(rng.choice(base, rng.integers(55, 80), replace=False).tolist()) | set(rng.choice(10_000, rng.integers(0, 9)).tolist())
        sets.append(np.array(sorted(s), np.uint64))
    f = jj.Forest(60)
    for i, j in jj.group_links(sets, sets, True):
        f.join(i, j)
    g = jj.Forest(60)
    for i in range(60):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if jj.linked(o, len(sets[i]), len(sets[j])):
                g.join(i, j)
    assert [f.root(i) for i in range(60)] == [g.root(i) for i in range(60)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + rng.randint(1, 400)) for _ in range(300)] + [(5000, 5000), (7, 6)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["vertex"]: r["component"] for r in connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(301)) and {got[b] for _, b in edges if b > 1000 and b < 5000} == {1000} and 5000 not in got
    assert connected_components(df.limit(0)).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    for n in (3, 900, 1025, 2500, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        for changed in (0, n // 20, n // 12, n // 9):
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 2**63, rng.integers(0, changed + 1), dtype=np.int64).astype(np.uint64)]))
            o = len(np.intersect1d(a, b))
            x, y = jj.bitmap(a), jj.bitmap(b)
            w = min(len(x), len(y))
            if jj.linked(o, len(a), len(b)):
                assert jj.may_link(jj.fold(x, w), len(a), jj.fold(y, w), len(b))
        far = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        if n > 100:
            assert not jj.may_link(jj.bitmap(a), len(a), jj.bitmap(far), len(far))
