"""Toxicity classifier with a counterfactual penalty.

A logistic model over the words of a text (presence of each) with an L1
penalty, so that it keeps to few words. In the labelled sentences that mention
a group, the identity term is swapped for the other terms of its kind, and for
none; the penalty on the change of the score takes weight off the mention
itself, so that neutral mentions of a group do not raise the score.

The model is fitted on the driver from the words of at most ``TRAIN_ROWS``
labelled documents (those with the smallest hashes of their ids). Scoring
goes over all whole texts on the executors.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, text_rows

TRAIN_ROWS = 6000
#: Words in fewer training documents than this are no features.
LEAST_DOCS = 5
L1 = 1e-3
COUNTERFACTUAL = 5.0
THRESHOLD = 0.3

# Identity terms by kind; a term is swapped within its kind.
IDENTITY: list[list[str]] = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer"],
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["female", "male"],
    ["immigrants", "refugees", "foreigners", "locals"],
    ["american", "mexican", "chinese", "indian", "german", "french", "spanish", "russian"],
    ["deaf", "blind", "disabled", "autistic"],
    ["old", "young", "elderly"],
]
TERMS = {t: k for k, kind in enumerate(IDENTITY) for t in kind}

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def swaps(text: str) -> dict[str, int]:
    """Identity term -> number of sentences in which it can be swapped."""
    out: dict[str, int] = {}
    if TERMS.keys().isdisjoint(words(text)):
        return out
    for s in SENTENCE.split(text):
        for t in words(s) & TERMS.keys():
            out[t] = out.get(t, 0) + 1
    return out


# ------------------------------------------------------------------ training
def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[int, str, list]]:
    """(label, words, swaps) of the training documents. A document with
    several labels takes the largest; null labels and ids do not count."""
    import pyarrow as pa

    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("y"))
    known = known.where(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.md5(F.col("i").cast("string").cast("binary")), "i").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    joined = texts.join(F.broadcast(chosen), "i")  # at most ``rows`` rows

    @lean
    def run(batches):
        for y, t in text_rows(batches, ("y", "t")):
            t = [x or "" for x in t]
            s = [swaps(x) for x in t]
            yield pa.RecordBatch.from_arrays(
                [pa.array(y, pa.int32()), pa.array([" ".join(sorted(words(x))) for x in t]), pa.array([" ".join(f"{k}:{n}" for k, n in sorted(x.items())) for x in s])],
                names=["y", "w", "s"],
            )

    found = joined.mapInArrow(run, "y int, w string, s string").collect()
    return sorted((r["y"], r["w"], [(k, int(n)) for k, _, n in (x.partition(":") for x in r["s"].split())]) for r in found)


class Model:
    """Weights of few words and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[w] for w in sorted(words(text or "") & self.weights.keys()))
        return float(1 / (1 + np.exp(-max(min(z, 500), -500))))


def fit(rows: list[tuple[int, str, list]], l1: float = L1, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Accelerated proximal gradient on the mean log loss, the L1 penalty and
    the counterfactual penalty; then the kept words are fitted again without
    L1 (a slight L2 instead), which calibrates the scores."""
    if not rows or len({y for y, _, _ in rows}) < 2:
        return Model({}, 500.0 if rows and rows[0][0] else -500.0)
    y = np.array([r[0] for r in rows], float)
    n = len(rows)
    counts: dict[str, int] = {}
    for _, t, _ in rows:  # split again below: lists of all words would be large
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    vocab = {w: k for k, w in enumerate(sorted(w for w, c in counts.items() if c >= LEAST_DOCS))}
    del counts
    cols = [np.array([vocab[w] for w in t.split() if w in vocab], np.int64) for _, t, _ in rows]
    seen: dict[str, int] = {}
    for _, _, s in rows:
        for k, c in s:
            seen[k] = seen.get(k, 0) + c
    pairs = []  # (term, other or -1, weight): swapped for each other term of its kind, and for none
    for t, c in sorted(seen.items()):
        if t in vocab:
            others = [vocab[o] for o in IDENTITY[TERMS[t]] if o != t and o in vocab]
            pairs += [(vocab[t], o, counterfactual * c / n / len(others)) for o in others] + [(vocab[t], -1, counterfactual * c / n)]

    def solve(cols: list, size: int, l1: float, l2: float, pairs: list, steps: int) -> tuple[np.ndarray, float]:
        idx = np.concatenate([*cols, np.empty(0, np.int64)])
        row = np.repeat(np.arange(n), [len(c) for c in cols])
        a = np.array([p[0] for p in pairs], np.int64)
        b = np.array([p[1] for p in pairs], np.int64)
        c = np.array([p[2] for p in pairs])
        longest = max(max((len(x) for x in cols), default=0), 1)
        load = np.bincount(a, 4 * c, size) + np.bincount(b[b >= 0], 4 * c[b >= 0], size) if len(a) else np.zeros(size)
        step = 1.0 / (0.25 * (1 + longest) + l2 + load.max(initial=0))
        w, v = np.zeros(size), np.zeros(size)
        bias = vb = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
        t = 1.0
        for _ in range(steps):
            z = vb + np.bincount(row, v[idx], n)
            g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
            grad = np.bincount(idx, g[row], size) + l2 * v
            if len(a):
                d = 2 * c * (v[a] - np.where(b >= 0, v[b], 0))
                grad += np.bincount(a, d, size) - np.bincount(b[b >= 0], d[b >= 0], size)
            new = v - step * grad
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            new_bias = vb - step * g.sum()
            nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, vb = new + (t - 1) / nt * (new - w), new_bias + (t - 1) / nt * (new_bias - bias)
            moved = max(np.abs(new - w).max(initial=0), abs(new_bias - bias))
            w, bias, t = new, new_bias, nt
            if moved < 1e-7:
                break
        return w, bias

    w, bias = solve(cols, len(vocab), l1, 0.0, pairs, 600)
    kept = np.flatnonzero(w)
    place = np.full(len(vocab), -1)
    place[kept] = np.arange(len(kept))
    small = [place[c][place[c] >= 0] for c in cols]
    moved = [(place[a], place[b] if b >= 0 else -1, c) for a, b, c in pairs if place[a] >= 0 and (b < 0 or place[b] >= 0)]
    w2, bias = solve(small, len(kept), 0.0, 1e-4, moved, 2000)
    names = {k: t for t, k in vocab.items()}
    return Model({names[k]: float(x) for k, x in zip(kept.tolist(), w2)}, float(bias))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    return fit(training_rows(docs, labels, rows))


# ------------------------------------------------------------------- scoring
def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out`` (0 to 1). Null texts are empty: the bias alone speaks."""
    import pyarrow as pa

    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the column {out} exists already")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the words of the training sample
    t = fresh(docs, ["t"])["t"]
    own = docs.columns

    @lean
    def run(batches):
        m = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                s = [m.score(x) for x in part.column(part.schema.get_field_index(t)).to_pylist()]
                cols = [part.column(part.schema.get_field_index(c)) for c in own]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64())], names=[*own, out])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn(t, F.col(text).cast("string")).mapInArrow(run, f"{fields}, `{out}` double")


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Repeated rows are
    scored each; null ids are never held out."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    s = score(narrow, train(docs, labels, rows))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents whose score is below the threshold, all columns as they
    came."""
    s = fresh(docs, ["score"])["score"]
    return score(docs, train(docs, labels, rows), out=s).where(F.col(s) < THRESHOLD).drop(s)
