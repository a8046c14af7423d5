"""Counts, shares and ranks against a plain loop."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from segmint.llm import divergence

PATTERN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return [w.translate(LOWER) for w in PATTERN.findall(text or "")]


def brute(rows, least, top):
    """Rows of (lang, source, text) -> the audit's rows."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(words(text))
        docs[lang].update(set(words(text)))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:limit])]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n, sources):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "GAMMA", "été", "日本", "x", "abcdefgh", "abcdefghi", "abcdefghijklmnopq", "abcdefghijklmnopQ", "Ünder", "zz"]
    rows = []
    for k in range(n):
        s = rng.randrange(sources)
        favoured = vocabulary[s % len(vocabulary)]
        text = rng.choice([" ", ", ", "\n", "1"]).join(rng.choice([*vocabulary, favoured, favoured]) for _ in range(rng.randrange(0, 9)))
        rows.append((rng.choice(["en", "de", None]), f"s{s}", text))
    return rows + [("xx", "none", None), ("xx", None, ""), ("xx", "rare", "one two"), (None, None, "alpha")] + rows[:5] * 3


@pytest.mark.parametrize("block", [2, 256])
def test_audit_equals_a_plain_loop(spark, block):
    rows = corpus(1, 400, 7)
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, n int")
    out = divergence.audit(df.repartition(5), least_docs=20, top=3, block=block, share_rows=20)
    assert got(out) == brute(rows, 20, 3)


def test_slices_do_not_change_a_count(spark, monkeypatch):
    rows = corpus(2, 200, 3)
    df = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(2)
    one = sorted(map(tuple, divergence.term_counts(df).collect()), key=str)
    monkeypatch.setattr(divergence, "SLICE", 50)
    assert sorted(map(tuple, divergence.term_counts(df).collect()), key=str) == one


def test_pointer_sort_orders_words_as_bytes():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "B", "é", "日", "aaaaaaaa", " ", "-"]) for _ in range(rng.randrange(40))).encode() for _ in range(300)] + [b"x" * 70, b"x" * 71, b"abcdefgh abcdefg abcdefghi"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts, lengths = divergence.pointers(data, np.cumsum(sizes) - sizes)
    expected = [w for t in texts for w in re.findall(rb"[A-Za-z\x80-\xff]+", t)]
    assert [data[a : a + n].tobytes() for a, n in zip(starts, lengths)] == expected
    order, run = divergence.sorted_runs(data, starts, lengths)
    assert [expected[k] for k in order] == sorted(expected)
    assert run.tolist() == [sorted(set(expected)).index(w) for w in sorted(expected)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(df).collect() == []


def test_one_very_long_text(spark):
    rows = [("en", "a", "word " * 400_000), ("en", "b", "y" * 3_000_000)] + [("en", "a", "word")] * 30
    out = divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"))
    assert got(out) == brute(rows, 30, 50)
