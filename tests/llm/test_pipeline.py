"""The pipeline against brute-force versions of its stages."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from segmint.llm import quality, toxicity
from segmint.llm.common import table
from segmint.llm.tokens import load_tokenizer, tokenizer_path
from test_jaccard_join import brute
from test_tokens_packing import check_packing

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stages_over_the_small_table(spark):
    docs = table(spark, SF, "documents")
    before = rows_of(docs)
    columns = docs.columns

    # toxicity: what the classifier scores at 0.3 or more goes
    model = toxicity.train(docs, table(spark, SF, "labels"))
    step = cp.toxicity_stage(spark, docs, SF)
    now = rows_of(step)
    assert step.columns == columns and set(now) == {i for i, r in before.items() if model.score(r["text"]) < 0.3}

    # quality: statistics by plain loops, fences by sorting
    docs, before = spark.createDataFrame(list(now.values()), docs.schema), now
    step = cp.quality_stage(spark, docs, SF)
    now = rows_of(step)
    assert step.columns == columns and set(now) == plain_quality(before)

    # near duplicates: exact union-find
    docs, before = spark.createDataFrame(list(now.values()), docs.schema), now
    step = cp.near_duplicate_stage(spark, docs, SF)
    now = rows_of(step)
    first = {c for _, _, _, c in brute([(i, r["text"]) for i, r in before.items()])}
    assert step.columns == columns and set(now) == first

    # passages: what is cut occurs in an earlier document, what stays is whole
    docs, before = spark.createDataFrame(list(now.values()), docs.schema), now
    step = cp.passage_stage(spark, docs, SF)
    now = rows_of(step)
    assert step.columns == columns and set(now) <= set(before)
    for i, r in now.items():
        assert r["n_chars"] == len(r["text"]) and {k: v for k, v in r.items() if k not in ("text", "n_chars")} == {k: v for k, v in before[i].items() if k not in ("text", "n_chars")}
        assert iter_contains(before[i]["text"].split(), r["text"].split())

    # packing: every id once
    docs = spark.createDataFrame(list(now.values()), docs.schema)
    rows = cp.packing_stage(spark, docs, SF).collect()
    check_packing(rows, {i: r["text"] for i, r in now.items()}, load_tokenizer(tokenizer_path()))

    # the run is the stages one after another
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in cp.run(spark, SF).collect()} == {(r["doc_id"], r["start"], r["ids_crc32"]) for r in rows}


def iter_contains(long, short):
    it = iter(long)
    return all(any(w == x for x in it) for w in short)


def plain_statistics(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered)


def plain_quality(docs):
    """Ids that the rules keep."""
    stats = {i: plain_statistics(r["text"]) for i, r in docs.items()}
    pm = {i: {"symbols": 1000 * s[2] // max(s[1], 1), "dup_lines": 1000 * s[4] // max(s[3], 1), "repeats": 1000 * s[5] // max(s[0], 1)} for i, s in stats.items()}

    passed = {i for i, s in stats.items() if s[0] >= 50 and 100 * s[5] <= 50 * s[0]}

    def tail(ids, k):
        v = sorted(pm[i][k] for i in ids)
        q = lambda x: next(y for n, y in enumerate(v, 1) if n >= x * len(v))
        return q(0.5) + quality.TAIL * (q(quality.SHARES[k][2]) - q(0.5))

    def fence(r, k):
        prior = quality.PRIOR
        language = [j for j in passed if docs[j]["lang"] == r["lang"]]
        group = [j for j in language if docs[j]["source"] == r["source"]]
        wide = (len(language) * tail(language, k) + prior * tail(passed, k)) // (len(language) + prior)
        return (len(group) * tail(group, k) + prior * wide) // (len(group) + prior) + quality.SHARES[k][3]

    out = {i for i in passed if all(pm[i][k] <= fence(docs[i], k) for k in quality.SHARES)}
    return out


def test_quality_statistics_of_odd_texts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b", "a b c a b c", "a a a a", "x\n\nx\n x", "#*$%&|<> é\xa0é", "w " * 5000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))).replace(" ", rng.choice([" ", "\n", "\x0b ", "\x1c"])) for _ in range(60)]
    rows = [(None if i % 7 == 0 else i, None if i % 5 == 0 else "en", t, "s", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string, n_words int")
    got = quality.text_statistics(df, prefix="q_").select("n_words", "q_n_words", "q_word_chars", "q_n_symbols", "q_n_lines", "q_n_dup_lines", "q_n_repeat_words").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: plain_statistics(t) for i, t in enumerate(texts)}
    judged = quality.judge(df)
    assert judged.count() == len(rows) and judged.where("kept is null or base_failed is null").count() == 0
    assert quality.filter_documents(df).columns == df.columns
    empty = df.limit(0)
    assert quality.judge(empty).count() == 0 and quality.filter_documents(empty).count() == 0


def test_quality_filter_judges_each_row(spark):
    rng = random.Random(6)
    good = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    rows = [(None, None if i % 2 else "en", good(), "s", i) for i in range(20)]
    rows += [(7, "en", good(), "s", 100), (7, "en", "too short", "s", 101), (None, "en", "too short", None, 102)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string, _q_n int")
    got = quality.filter_documents(df)
    assert got.columns == df.columns
    assert sorted(r["_q_n"] for r in got.collect()) == [*range(20), 100]


def test_fences_follow_the_group(spark):
    """A source with many symbols gets a higher fence than a clean one; clean
    documents stay, and so do the symbols of the source that is full of them."""
    rng = random.Random(8)
    clean = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    noisy = lambda: " ".join(f"w{rng.randrange(3000)}" + "#*" * (rng.random() < 0.3) for _ in range(80))
    junk = lambda: " ".join(f"w{rng.randrange(3000)}" + "#*$%" for _ in range(80))
    rows = [("en", "clean", clean()) for _ in range(600)] + [("en", "code", noisy()) for _ in range(600)]
    rows += [("en", "small", noisy()) for _ in range(5)] + [("de", "clean", clean()) for _ in range(300)] + [("de", "clean", junk()) for _ in range(20)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    fence = {(r["lang"], r["source"]): r["fence_symbols"] for r in quality.report(df).collect()}
    assert fence["en", "clean"] < fence["en", "code"] and fence["de", "clean"] < fence["en", "code"]
    kept = {r["doc_id"] for r in quality.judge(df).where("kept").collect()}
    assert kept == {i for i, (lang, source, t) in enumerate(rows) if "$" not in t and not (source == "clean" and "#" in t)}


def test_fences_differ_between_groups_of_the_tables(spark):
    rows = quality.report(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    for k in quality.SHARES:
        assert len({r[f"fence_{k}"] for r in rows}) >= 10
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    told = quality.judge(docs).join(labels, "doc_id").where("quality = 1 AND NOT base_failed").selectExpr("avg(cast(kept as int)) AS kept").first()
    assert told["kept"] >= 0.98
