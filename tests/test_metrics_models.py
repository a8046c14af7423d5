"""Cluster metrics and evaluation against brute force; Ward merge; split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmint.operators.cluster_metrics import cluster_metrics
from segmint.operators.clustering import minmax_normalize
from segmint.operators.ward import merge_here
from segmint.operators.evaluate import classification_report, roc_auc, roc_curve


def _brute(x, lab):
    ks = sorted(set(lab))
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d2[i, own].sum() / (own.sum() - 1)
        b = min(d2[i, lab == k].mean() for k in ks if k != lab[i])
        s.append((b - a) / max(a, b))
    mus = np.array([x[lab == k].mean(0) for k in ks])
    spread = np.array([np.linalg.norm(x[lab == k] - mus[j], axis=1).mean() for j, k in enumerate(ks)])
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(mus[i] - mus[j]) for j in range(len(ks)) if j != i) for i in range(len(ks))])
    mu = x.mean(0)
    B = sum((lab == k).sum() * ((mus[j] - mu) ** 2).sum() for j, k in enumerate(ks))
    W = sum(((x[lab == k] - mus[j]) ** 2).sum() for j, k in enumerate(ks))
    ch = (B / (len(ks) - 1)) / (W / (len(x) - len(ks)))
    return np.mean(s), db, ch


def test_cluster_metrics_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 1.0, size=(30, 4)) for c in (0, 4, 9)])
    lab = np.repeat([0, 1, 2], 30)
    lab[5] = -1  # noise is excluded
    df = spark.createDataFrame([(x[i].tolist(), int(lab[i])) for i in range(len(x))], "x array<double>, label int")
    m = cluster_metrics(df, "x", "label")
    keep = lab != -1
    sil, db, ch = _brute(x[keep], lab[keep])
    assert m.silhouette == pytest.approx(sil, rel=1e-9)
    assert m.davies_bouldin == pytest.approx(db, rel=1e-9)
    assert m.calinski_harabasz == pytest.approx(ch, rel=1e-9)


def test_single_cluster_has_no_metrics(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0), ([2.0, 1.0], 0)], "x array<double>, label int")
    m = cluster_metrics(df, "x", "label")
    assert m.silhouette is None and m.n_clusters == 1


def test_normalize_rules(spark):
    def norm(values, higher=True):
        df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
        return [r["o"] for r in minmax_normalize(df, "v", "o", higher).orderBy("i").collect()]

    assert norm([None, None]) == [0.0, 0.0]
    assert norm([2.0, 2.0]) == [0.5, 0.5] and norm([2.0, 2.0], False) == [0.5, 0.5]
    assert norm([1.0, None, 3.0], False) == [1.0, 0.0, 0.0]


def test_chosen_algorithm_gives_cluster_id(spark):
    from segmint.plans.models import with_cluster_id

    df = spark.createDataFrame([(1, 2, 3)], "kmeans_label int, dbscan_label int, hierarchical_label int")
    got = [with_cluster_id(df, a).first()["cluster_id"] for a in ("K-Means", "DBSCAN", "Hierarchical")]
    assert got == [1, 2, 3]


def ward_merge(x, weights):
    """Labels by number of clusters, from the merges of one task."""
    labels = np.arange(len(x))
    cuts = {len(x): labels.copy()}
    for a, b, _ in merge_here(np.arange(len(x)), weights, x):
        labels[labels == labels[b]] = labels[a]
        cuts[len(set(labels.tolist()))] = labels.copy()
    return cuts


def test_ward_merge_two_groups():
    pts = np.array([[0.0], [0.1], [10.0], [10.2]])
    cuts = ward_merge(pts, np.ones(4))
    two = cuts[2]
    assert two[0] == two[1] and two[2] == two[3] and two[0] != two[2]


def test_roc_and_report(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.6 + y * 0.3, 2)  # ties on purpose
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    auc = roc_auc(df).first()[0]
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert auc == pytest.approx(brute, rel=1e-12)
    pts = roc_curve(df).orderBy(F.col("threshold").desc()).collect()
    assert pts[-1]["fpr"] == pytest.approx(1.0) and pts[-1]["tpr"] == pytest.approx(1.0)
    rep = {r["cls"]: r for r in classification_report(df.select("label", (F.col("score") >= 0.5).cast("int").alias("prediction"))).collect()}
    pred = (s >= 0.5).astype(int)
    assert rep["accuracy"]["precision"] == pytest.approx((pred == y).mean())
    tp = ((pred == 1) & (y == 1)).sum()
    assert rep["1"]["precision"] == pytest.approx(tp / (pred == 1).sum())
    assert rep["1"]["recall"] == pytest.approx(tp / (y == 1).sum())


def test_stratified_split_counts(spark):
    from segmint.operators.churn import stratified_split

    df = spark.createDataFrame([(str(i), int(i % 3 == 0)) for i in range(101)], "customer_id string, y int")
    out = dict(((r["y"], r["is_test"]), r["count"]) for r in stratified_split(df, "y").groupBy("y", "is_test").count().collect())
    assert out[(1, True)] == 7 and out[(0, True)] == 14  # ceil(0.2 × 34), ceil(0.2 × 67)


def test_ward_merge_matches_naive_greedy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 3))
    clusters = {i: [i] for i in range(len(x))}
    naive = {}
    nid = len(x)
    while len(clusters) > 1:
        keys = sorted(clusters)

        def cost(a, b):
            A, B = x[clusters[a]], x[clusters[b]]
            return len(A) * len(B) / (len(A) + len(B)) * ((A.mean(0) - B.mean(0)) ** 2).sum()

        _, a, b = min((cost(a, b), a, b) for i, a in enumerate(keys) for b in keys[i + 1:])
        clusters[nid] = clusters.pop(a) + clusters.pop(b)
        nid += 1
        naive[len(clusters)] = sorted(sorted(v) for v in clusters.values())
    cuts = ward_merge(x, np.ones(len(x)))
    for k in range(1, 11):
        got = sorted(sorted(np.where(cuts[k] == c)[0].tolist()) for c in set(cuts[k].tolist()))
        assert got == naive[k]


def test_clv_trees_take_equal_features_as_one_row(spark, monkeypatch):
    """The trees of weighted distinct rows are those of all rows."""
    import numpy as np

    from pyspark.ml import Pipeline

    from segmint.functions.constants import CLV_FEATURES
    from segmint.operators import clv as CLV

    rng = np.random.default_rng(3)
    kinds = [[float(v) for v in rng.integers(1, 40, len(CLV_FEATURES))] for _ in range(50)]
    rows = [(str(50 * c + i), 50 * c + i, *kinds[i]) for c in range(1 + 4) for i in range(50) if c < 1 + i % 5]
    df = spark.createDataFrame(rows, "customer_id string, ingest_seq long, " + ", ".join(f"{c} double" for c in CLV_FEATURES)).checkpoint()
    seen = []
    fit = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, d, *a: seen.append(d.count()) or fit(self, d, *a))
    one = {r["customer_id"]: r["clv_12m"] for r in CLV.clv_model(df, max_iter=4)[0].collect()}
    monkeypatch.setattr(CLV, "training_rows", lambda train: train.withColumn("clv_weight", CLV.F.lit(1.0)))
    every = {r["customer_id"]: r["clv_12m"] for r in CLV.clv_model(df, max_iter=4)[0].collect()}
    assert seen[0] <= 50 < seen[1]
    assert len(one) == len(rows) and all(np.isclose(one[k], every[k]) for k in every)
