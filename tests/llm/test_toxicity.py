"""Held-out accuracy, the counterfactual penalty and odd rows."""

import random
import zlib

import pytest

from segmint.llm import toxicity
from segmint.llm.queries import op6_toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op6_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    test = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    pos = [s for s, y in test if y == 1]
    neg = [s for s, y in test if y == 0]
    assert len(pos) > 50
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    hit = sum(p >= 0.3 for p in pos)
    false = sum(n >= 0.3 for n in neg)
    print("auc", auc, "recall", hit / len(pos), "false", false / len(neg))
    assert auc > 0.8 and hit / (hit + false) > 0.9


def rows_with_biased_mentions(rng):
    out = []
    for i in range(900):
        toxic = i % 5 == 0
        w = [f"n{rng.randint(0, 60)}" for _ in range(25)]
        if toxic and rng.random() < 0.7:
            w.append("scum")
        if rng.random() < (0.8 if toxic else 0.05):  # mentions go with the label in this sample
            w.append("muslims")
        text = "Some " + " ".join(w) + "."
        out.append((int(toxic), " ".join(sorted(toxicity.words(text))), list(toxicity.swaps(text).items())))
    return out


def test_penalty_takes_weight_off_mentions():
    rows = rows_with_biased_mentions(random.Random(2))
    free = toxicity.fit(rows, counterfactual=0.0)
    held = toxicity.fit(rows, counterfactual=20.0)
    assert free.weights["muslims"] > 2 and abs(held.weights.get("muslims", 0.0)) < 0.2
    change = lambda m: m.score("Some n1 n2 muslims") - m.score("Some n1 n2 jews")
    assert abs(change(held)) < 0.2 * change(free)
    assert held.score("you scum") > 0.6


def test_swaps_count_sentences():
    assert toxicity.swaps("Muslims came. They met Jews, jews! None.\nmuslims") == {"muslims": 2, "jews": 1}
    assert toxicity.swaps("") == {}


@pytest.mark.parametrize("labels", [[], [(1, 0, 0)], [(None, 1, 1), (1, None, None)]])
def test_edge_rows(spark, labels):
    docs = spark.createDataFrame([(None, None, "s", 1), (1, "", "s", 2), (1, "", "s", 2), (2, "idiot " * 30000, None, 3)], "doc_id long, text string, source string, score int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.classify(docs, lab).collect()
    assert len(rows) == 4 and all(r["held_out"] is not None for r in rows)
    kept = toxicity.filter_documents(docs, lab)
    assert kept.columns == docs.columns and kept.count() == 4
    assert toxicity.classify(docs.limit(0), lab).count() == 0
