"""Planted passages and near copies of paragraphs against plain loops."""

import random

import numpy as np

from segmint.llm import substring_dedup as sd


def words(rng, n, vocab=4000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def test_bands_reach_the_recall():
    bands, rows = sd.tune_bands(0.8, 0.99, 3)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_any_51_shared_words_share_a_unit():
    rng = random.Random(4)
    for _ in range(300):
        passage = words(rng, 51)
        keys = []
        for _ in range(2):
            t = " ".join(words(rng, rng.randint(0, 60)) + passage + words(rng, rng.randint(0, 60))).encode()
            w = sd.Words([t])
            _, lo, hi = w.units()
            assert ((hi - lo >= sd.SPAN) & (hi - lo <= 2 * sd.SPAN)).all()
            keys.append(set(w.key(lo, hi).tolist()))
        assert keys[0] & keys[1]


def test_units_do_not_depend_on_the_batch():
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randint(0, 80))).encode() for _ in range(30)] + [b"", None, b"die " * 200]
    w = sd.Words(texts)
    doc, lo, hi = w.units()
    together = {k: set() for k in range(len(texts))}
    for d, k in zip(doc.tolist(), w.key(lo, hi).tolist()):
        together[d].add(k)
    for d, t in enumerate(texts):
        own = sd.Words([t])
        _, lo, hi = own.units()
        alone = set(own.key(lo, hi).tolist())
        # cuts next to a border may differ; what lies inside is the same
        assert len(alone & together[d]) >= len(alone) - 6


def build(seed):
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (55, 80, 140)]
    line = words(rng, 70)
    docs, planted = {}, {}
    for i in range(140):
        w = words(rng, rng.randint(20, 150))
        if i % 4 == 1:
            p = rng.randrange(3)
            at = rng.randint(0, len(w))
            w = w[:at] + passages[p] + w[at:]
            planted.setdefault(p, []).append(i)
        t = " ".join(w)
        if i % 10 == 3:
            near = list(line)
            near[rng.randrange(70)] = f"x{i}"
            t += "\n" + " ".join(near)
            planted.setdefault("line", []).append(i)
        docs[i] = t
    return docs, planted


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sd.removed_passages(df, **kw).collect()


def test_planted_passages(spark):
    docs, planted = build(1)
    rows = run(spark, list(docs.items()))
    hit = {r["doc_id"] for r in rows}
    want = {d for ids in planted.values() for d in ids if d != min(ids)}
    assert hit == want
    low = {i: t.lower() for i, t in docs.items()}
    for r in rows:
        raw = docs[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode()
        assert raw == r["passage"] and len(raw.split()) == r["n_words"] >= sd.LEAST_WORDS
        if r["doc_id"] not in planted["line"]:
            assert any(raw.lower() in low[j] for j in docs if j < r["doc_id"])


def test_cut_texts_keep_the_first(spark):
    docs, planted = build(2)
    df = spark.createDataFrame([(i, t, "en", len(t), 0) for i, t in docs.items()], "doc_id long, text string, lang string, n_chars long, d int")
    out = sd.without_repeats(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    untouched = set(docs) - {d for ids in planted.values() for d in ids if d != min(ids)}
    assert all(got[i][0] == docs[i] for i in untouched)
    for i, (t, n) in got.items():
        assert n == len(t)
    assert all(len(got[d][0].split()) <= len(docs[d].split()) - sd.LEAST_WORDS for ids in planted.values() for d in ids if d != min(ids))


def test_copies_nulls_and_empty(spark):
    rng = random.Random(7)
    t = " ".join(words(rng, 90))
    rows = [(None, t), (5, t), (5, t), (2, t.upper()), (9, None), (9, ""), (10, " \n"), (11, "short text"), (12, "die " * 3000)]
    got = run(spark, rows)
    assert sorted({(r["doc_id"] is None, r["doc_id"], r["kept_doc_id"]) for r in got}, key=str) == sorted({(True, None, 2), (False, 5, 2)}, key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in sd.without_repeats(df).collect()]
    assert sorted(x[0] for x in left) == [2, 9, 9, 10, 11, 12]  # of copies nothing is left
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.removed_passages(empty).count() == 0 and sd.without_repeats(empty).count() == 0


def test_many_owners_of_one_key_in_one_task():
    k = np.array([5, 5, 5, 7, 7, 9], np.uint64)
    o = np.array([3, 1, 1, 4, 4, 2])
    keys, least, several, more_k, more_o = sd.collapse(k, o)
    assert keys.tolist() == [5, 7, 9] and least.tolist() == [1, 4, 2] and several.tolist() == [True, False, False]
    assert more_k.tolist() == [5] and more_o.tolist() == [3]


def wrapped(w, n):
    return "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))


def test_line_breaks_do_not_hide_a_passage(spark):
    rng = random.Random(9)
    for _ in range(200):
        p, keys = words(rng, 51), []
        for n in (60, rng.randint(3, 14)):
            w = sd.Words([(" ".join(words(rng, 15)) + " " + wrapped(p, n) + "\n" + wrapped(words(rng, 15), n)).encode()])
            _, lo, hi = w.units()
            keys.append(set(w.key(lo, hi).tolist()))
        assert keys[0] & keys[1]
    rows, want = [], set()
    for k, (size, n) in enumerate((a, b) for a in (51, 55, 80, 140) for b in (5, 8, 12)):
        p = words(rng, size)
        rows += [(2 * k, " ".join(words(rng, 30) + p + words(rng, 30))), (2 * k + 1, wrapped(words(rng, 29) + p + words(rng, 30), n))]
        want.add(2 * k + 1)
    assert {r["doc_id"] for r in run(spark, rows)} == want


def test_spans_are_the_planted_passages(spark):
    rng = random.Random(10)
    rows, want = [], set()
    for k in range(60):
        p = words(rng, rng.choice((51, 55, 80, 140)), 10**9)
        rows.append((2 * k, " ".join(words(rng, rng.randint(20, 40), 10**9) + p + words(rng, rng.randint(20, 40), 10**9))))
        before = "".join(x + " " for x in words(rng, rng.randint(20, 40), 10**9))
        text = wrapped(p, 9) if k % 2 else " ".join(p)
        rows.append((2 * k + 1, before + text + "".join(" " + x for x in words(rng, rng.randint(20, 40), 10**9))))
        want.add((2 * k + 1, len(before), len(before) + len(text), len(p), 2 * k))
    assert {(r["doc_id"], r["start_byte"], r["end_byte"], r["n_words"], r["kept_doc_id"]) for r in run(spark, rows)} == want


def test_near_copies_of_wrapped_paragraphs(spark):
    rng = random.Random(11)
    p = words(rng, 120)
    rows, plant = [], []
    for i in range(8):
        near = list(p)
        for k in (15, 75)[: 1 + i % 2] if i else ():
            near[k] = f"x{i}"
        plant.append(wrapped(near, 8 + i % 5))
        rows.append((i, wrapped(words(rng, 40), 9) + "\n\n" + plant[i] + "\n\n" + wrapped(words(rng, 40), 10)))
    got = {(r["doc_id"], r["passage"]) for r in run(spark, rows)}
    assert got == {(i, plant[i]) for i in range(1, 8)}


def test_all_colliding_paragraphs_are_compared(spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    lines = []
    for _ in range(12):
        base = words(rng, 60)
        for _ in range(25):
            own = list(base)
            for k in rng.sample(range(60), rng.randint(1, 5)):
                own[k] = f"x{rng.randrange(3)}"
            lines.append(" ".join(own))
    bands, rows = sd.tune_bands()
    sets, keys = [], []
    for t in lines:
        w = sd.Words([t.encode()])
        sets.append(set(w.shingles()[: len(w.h) - 4].tolist()))
        keys.append(set(w.band_keys(np.array([0]), np.array([len(w.h)]), bands, rows).ravel().tolist()))
    least = list(range(len(lines)))
    for _ in range(len(lines)):
        before = list(least)
        for i in range(len(lines)):
            for j in range(i):
                if keys[i] & keys[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
        if least == before:
            break
    docs = spark.createDataFrame(list(enumerate(lines)), "d long, t string").select("d", F.col("t").cast("binary").alias("t"))
    for n in (1, 7):
        part = docs.repartition(n)
        got = {r["d"]: r["keeper"] for r in sd.similar_paragraphs(part, sd.index(part, 8, bands, rows), 0.8).collect()}
        assert got == {i: c for i, c in enumerate(least) if least.count(c) > 1}


def test_spans_of_many_texts_are_those_of_each_alone():
    rng = random.Random(5)
    shared = " ".join(words(rng, 60))
    text = lambda n: " ".join(words(rng, n))
    texts = [b"", b" \n ", b"one two"]
    for k in range(12):
        texts.append("\n".join(f" \t{text(rng.randrange(0, 70))}\x0b{shared if k % 3 else text(30)}\r{text(9)}" for _ in range(3)).encode())
    w = sd.Words([shared.encode()])
    unit = np.arange(len(w.h) - sd.SPAN + 1)
    known = w.key(unit, unit + sd.SPAN).view(np.int64).tolist()
    keys = [known if k % 4 else known[:5] + known[:3] for k in range(len(texts))]
    keepers = [[100 * k + j for j in range(len(x))] for k, x in enumerate(keys)]
    got = sd.spans(texts, keys, keepers)
    assert got == [sd.spans([t], [k], [o])[0] for t, k, o in zip(texts, keys, keepers)]
    assert any(got) and not any(got[:3])
    for k, (t, runs) in enumerate(zip(texts, got)):
        for a, b, n, keeper in runs:
            assert t[a:b].split() == shared.encode().split() and n == 60 and keeper == 100 * k
    # a run that ends a text and one that begins the next stay two
    whole = shared.encode()
    assert sd.spans([whole, whole], [known, known], [[7] * len(known), [8] * len(known)]) == [[(0, len(whole), 60, 7)], [(0, len(whole), 60, 8)]]


def test_blocks_pack_ids_and_sorted_keys():
    import zlib

    rng = np.random.default_rng(3)
    keys, ids = np.sort(rng.integers(0, 1 << 63, 5000, np.uint64)), rng.integers(0, 50_000, 5000)
    for a in (keys, ids, ids[:0]):
        assert np.array_equal(sd.from_planes(sd.planes(a), a.dtype), a)
        assert not len(a) or len(zlib.compress(sd.planes(a))) < 0.9 * len(zlib.compress(a.tobytes()))
    (row,) = sd.entry_blocks(0, [keys], [ids], 1)
    assert np.array_equal(sd.from_planes(row[2], np.uint64), keys)


def test_only_texts_that_lose_words_are_shuffled(spark):
    docs = spark.createDataFrame([(k, bytearray(b"t%d" % k)) for k in range(300)] + [(sd.NO_ID, bytearray(b"none"))], "d long, t binary")
    found = spark.createDataFrame([(5, 1), (250, 1), (sd.NO_ID, 1)], "d long, k int")
    assert sorted((r["d"], bytes(r["t"])) for r in sd.touched(docs, found).collect()) == [(5, b"t5"), (250, b"t250"), (sd.NO_ID, b"none")]
    assert sd.touched(docs, found.where("d < 0")).isEmpty()


def test_links_across_are_a_forest_of_components():
    """All pairs of many lines are links; fewer are told than there are lines."""
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 1 << 62, 200, np.uint64))
    members = [(k, k, np.sort(np.r_[base, np.uint64(k + 1)])) for k in range(60)]
    links = sd.cross_links(members[:40], members[20:], 0.8)
    told = sd.forest(links, {k: k for k in range(60)})
    assert len(links) > 1000 and len(told) == 59 and set(told) <= set(links)
