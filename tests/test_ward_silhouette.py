"""Exact Ward and Euclidean silhouettes against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmint.operators import cluster_metrics as CM
from segmint.operators import silhouette as SI
from segmint.operators import ward as W


def greedy_ward(x, ks):
    """Labels for each k by merging the cheapest pair of all, again and again."""
    clusters = {i: [i] for i in range(len(x))}
    n, c = {i: 1.0 for i in clusters}, {i: x[i].astype(float) for i in clusters}
    labels = {}
    while True:
        k = len(clusters)
        if k in ks:
            lab = np.empty(len(x), int)
            for j, key in enumerate(sorted(clusters, key=lambda q: min(clusters[q]))):
                lab[clusters[key]] = j
            labels[k] = lab
        if k == 1:
            return labels
        keys = sorted(clusters)
        cen, w = np.array([c[q] for q in keys]), np.array([n[q] for q in keys])
        d = ((cen[:, None] - cen[None]) ** 2).sum(-1) * (w[:, None] * w[None] / (w[:, None] + w[None]))
        d[np.tril_indices(k)] = np.inf
        i, j = divmod(int(d.argmin()), k)
        a, b = keys[i], keys[j]
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n[b]
        clusters[a] += clusters.pop(b)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "pid long, x array<double>")


@pytest.mark.parametrize("local", [2048, 50])
def test_ward_equals_the_greedy_merges(spark, local):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1.0, (30, 3)) for c in (0, 4, 9, 20)])
    x = np.concatenate([x, x[:5], x[:5]])  # copies
    ks = [2, 3, 4, 7, 10]
    out, got = W.ward_labels(frame(spark, x).repartition(5).checkpoint(), ks, local=local, rows=64)
    rows = {r["pid"]: r for r in out.collect()}
    assert got == ks and len(rows) == len(x)
    expected = greedy_ward(x, ks)
    for k in ks:
        assert [rows[i][f"k_{k}"] for i in range(len(x))] == expected[k].tolist()


def test_ward_on_embeddings_in_rounds(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("pid"), F.col("embedding").cast("array<double>").alias("x")).checkpoint()
    rows = sorted(df.collect(), key=lambda r: r["pid"])
    ids, x = [r["pid"] for r in rows], np.array([r["x"] for r in rows])
    assert len(x) == 500
    expected = greedy_ward(x, list(range(2, 11)))
    out, ks = W.ward_labels(df, list(range(2, 11)), local=250, rows=256)
    got = {r["pid"]: r for r in out.collect()}
    assert ks == list(range(2, 11))
    for k in ks:
        assert [got[i][f"k_{k}"] for i in ids] == expected[k].tolist()


def test_merges_form_a_tree_with_rising_heights(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    merges = sorted(W.ward_merges(W.distinct_points(frame(spark, x)).checkpoint(), local=40, rows=40).collect(), key=lambda r: (r["height"], r["seq"]))
    assert len(merges) == 79 and len({r["b"] for r in merges}) == 79
    n, c = {i: 1.0 for i in range(80)}, {i: x[i] for i in range(80)}
    for r in merges:
        a, b = r["a"], r["b"]
        assert np.isclose(r["height"], n[a] * n[b] / (n[a] + n[b]) * ((c[a] - c[b]) ** 2).sum())
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n.pop(b)


def test_ward_of_few_points(spark):
    out, ks = W.ward_labels(frame(spark, [[1.0], [1.0], [5.0]]), [2, 3])
    assert ks == [2] and sorted((r["pid"], r["k_2"]) for r in out.collect()) == [(0, 0), (1, 0), (2, 1)]
    assert W.ward_labels(frame(spark, np.zeros((0, 2))), [2])[1] == []


def brute_silhouette(x, lab):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.array(out)


def labelled(spark, x, lab):
    rows = [(0, i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, lab))]
    return spark.createDataFrame(rows, "run int, pid long, x array<double>, label long").checkpoint()


@pytest.mark.parametrize("k", [2, 6, 30])
def test_silhouette_equals_all_pairs(spark, k):
    rng = np.random.default_rng(k)
    lab = rng.integers(0, k, 150)
    lab[0] = 1000  # alone in its cluster
    x = rng.normal(size=(150, 3)) + lab[:, None] % 7
    x[5:9], lab[5:9] = x[5], lab[5]
    got = {r["pid"]: r["silhouette"] for r in SI.silhouette_samples(labelled(spark, x, lab), rows=32).collect()}
    assert np.allclose([got[i] for i in range(150)], brute_silhouette(x, lab), atol=1e-9)


def test_metrics_with_a_cluster_for_every_fifth_point(spark):
    rng = np.random.default_rng(4)
    n = 300
    lab = np.arange(n) % (n // 5)
    x = rng.normal(size=(n, 3)) + lab[:, None]
    pts = labelled(spark, x, lab)
    cen = np.array([x[lab == c].mean(0) for c in range(n // 5)])
    s = np.array([np.sqrt(((x[lab == c] - cen[c]) ** 2).sum(1)).mean() for c in range(n // 5)])
    d = np.sqrt(((cen[:, None] - cen[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    stats = SI.statistics(pts).checkpoint()
    assert np.isclose(SI.davies_bouldin(pts, stats, rows=16).first()["davies_bouldin"], ((s[:, None] + s[None]) / d).max(1).mean())
    within = sum(((x[lab == c] - cen[c]) ** 2).sum() for c in range(n // 5))
    between = (5 * ((cen - x.mean(0)) ** 2).sum(1)).sum()
    row = SI.quality(pts, rows=16).first()
    assert np.isclose(row["calinski_harabasz"], (between / (n // 5 - 1)) / (within / (n - n // 5)))
    assert np.isclose(row["inertia"], within) and row["n_clusters"] == n // 5 and row["n_points"] == n
    squared = ((x[:, None] - x[None]) ** 2).sum(-1)
    a = np.array([squared[i, lab == lab[i]].sum() / 4 for i in range(n)])
    b = np.array([min(squared[i, lab == c].mean() for c in set(lab) - {lab[i]}) for i in range(n)])
    assert np.isclose(row["silhouette"], ((b - a) / np.maximum(a, b)).mean())


def test_several_labellings_in_one_pass(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 2))
    rows = [(f"c{i}", [float(v) for v in r], i % 3, -1 if i < 10 else i % 4, 0) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "name string, x array<double>, a int, b int, c int")
    got = CM.metrics_of(df, "x", {"a": "a", "b": "b", "c": "c"}, "name", euclidean=True)
    lab = np.arange(90)
    assert np.isclose(got["a"].silhouette, brute_silhouette(x, lab % 3).mean())
    assert np.isclose(got["b"].silhouette, brute_silhouette(x[10:], lab[10:] % 4).mean()) and got["b"].n_points == 80
    assert got["c"].silhouette is None and got["c"].n_clusters == 1


def test_one_cluster_has_no_silhouette(spark):
    pts = labelled(spark, np.ones((4, 2)), [3, 3, 3, 3])
    assert SI.silhouette_samples(pts).collect() == []
    row = SI.quality(pts).first()
    assert row["davies_bouldin"] is None and row["calinski_harabasz"] is None and row["silhouette"] is None


def test_many_small_clusters_write_a_row_a_point(spark):
    rng = np.random.default_rng(6)
    n = 200
    lab = np.r_[np.arange(150) % 40, np.full(50, 77)]  # small ones, and one that is split
    x = rng.normal(size=(n, 8))
    pts = labelled(spark, x, lab)
    told = SI.mean_distances(pts, SI.statistics(pts), rows=16).collect()
    assert len(told) == n  # not one for each point and near cluster
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for r in told:
        i = r["pid"]
        assert np.isclose(r["total"], d[i, lab == lab[i]].sum())
        assert np.isclose(r["b"], min(d[i, lab == c].mean() for c in set(lab) - {lab[i]}))


def test_squared_metrics_agree_with_and_without_statistics_in_the_tasks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    lab = np.arange(120) % 7
    pts = labelled(spark, rng.normal(size=(120, 4)) + lab[:, None], lab)
    held = SI.quality(pts).first()
    monkeypatch.setattr(SI, "HELD", 0)
    assert np.allclose(tuple(held), tuple(SI.quality(pts).first()))


def test_ward_rounds_do_not_multiply_size_estimates(spark):
    x = np.random.default_rng(8).normal(size=(90, 3))
    merges = W.ward_merges(W.distinct_points(frame(spark, x)), local=10, rows=30)
    assert int(str(merges._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1_000_000


def test_nearest_cluster_by_weight_with_ties(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(70, 2)), 1) * 1000.0
    n = rng.integers(1, 9, 70).astype(float)
    df = spark.createDataFrame([(i, float(n[i]), x[i].tolist()) for i in range(70)], "id long, n double, x array<double>")
    got = {r["id"]: (r["nn"], r["d"]) for r in W.nearest(df, df, 70, 70, rows=16).collect()}
    for i in range(70):
        cost = W.merge_cost(x[i][None], n[i], x, n)
        cost[i] = np.inf
        j = min(range(70), key=lambda j: (cost[j], min(i, j), max(i, j)))
        assert got[i] == (j, cost[j])


def test_rounds_of_one_task_equal_pair_by_pair_merges():
    rng = np.random.default_rng(10)
    n = 1300  # more columns than a product holds
    x = np.r_[rng.normal(size=(n - 60, 4)), np.round(rng.normal(size=(60, 4)))]
    ids, w = rng.permutation(5 * n)[:n], rng.integers(1, 60, n).astype(float)
    one, other = (sorted(m, key=lambda r: r[2]) for m in (W.merge_here(ids, w, x), W.merge_rounds(ids, w, x, dense=20)))
    assert sorted(r[:2] for r in one) == sorted(r[:2] for r in other)
    assert np.allclose([r[2] for r in one], [r[2] for r in other], rtol=1e-12)


def test_thousands_of_clusters_are_merged_without_a_job_for_each_round(spark, monkeypatch):
    def nearest(*a):
        raise AssertionError("a round of jobs")

    monkeypatch.setattr(W, "nearest", nearest)
    x = np.random.default_rng(11).normal(size=(4500, 2))
    out, ks = W.ward_labels(frame(spark, np.r_[x, x[:20]]), [2, 5])
    rows = {r["pid"]: (r["k_2"], r["k_5"]) for r in out.collect()}
    assert ks == [2, 5] and len(rows) == 4520
    assert [rows[4500 + i] for i in range(20)] == [rows[i] for i in range(20)]
    assert {r[1] for r in rows.values()} == set(range(5)) and len(set(rows.values())) == 5


def test_points_meet_their_copies_by_a_narrow_key(spark):
    from segmint.operators.density import of_copies

    points = frame(spark, [[0.0, 1.0], [-0.0, 1.0], [2.0, 3.0]] * 2)
    singles = W.distinct_points(points).checkpoint()
    out = of_copies(points, singles, singles.select("id", "n"))
    assert {r["pid"]: (r["id"], r["n"]) for r in out.collect()} == {i: (0, 4.0) if i % 3 < 2 else (2, 2.0) for i in range(6)}
    assert "SortMergeJoin [x" not in out._jdf.queryExecution().toString()
    # hashes skip nulls: then the points themselves are compared
    odd = spark.createDataFrame([(0, [None, 1.0]), (1, [1.0, None]), (2, [None, 1.0]), (3, None)], "pid long, x array<double>")
    singles = W.distinct_points(odd).checkpoint()
    assert {r["pid"]: r["id"] for r in of_copies(odd, singles, singles.select("id")).collect()} == {0: 0, 1: 1, 2: 0}


def test_weighted_rows_count_as_copies(spark, monkeypatch):
    rng = np.random.default_rng(12)
    lab, w = np.arange(60) % 5, rng.integers(1, 9, 60)
    lab[0], w[0] = 9, 3  # a cluster of copies alone
    x = rng.normal(size=(60, 3)) + lab[:, None]
    once = spark.createDataFrame([(i, x[i].tolist(), int(lab[i]), int(lab[i] % 2), float(w[i])) for i in range(60)], "pid long, x array<double>, a int, b int, n double").checkpoint()
    every = once.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("pid", F.col("pid") * 100 + F.col("k")).checkpoint()
    names = {"a": "a", "b": "b"}
    for held in (SI.HELD, 0):
        monkeypatch.setattr(SI, "HELD", held)
        one, all_ = CM.metrics_of(once, "x", names, "pid", weight="n"), CM.metrics_of(every, "x", names, "pid")
        for k in names:
            assert (one[k].n_clusters, one[k].n_points) == (all_[k].n_clusters, all_[k].n_points)
            for what in ("silhouette", "davies_bouldin", "calinski_harabasz", "inertia"):
                assert np.isclose(getattr(one[k], what), getattr(all_[k], what), rtol=1e-12)
    with pytest.raises(ValueError):
        CM.metrics_of(once, "x", names, "pid", euclidean=True, weight="n")


def test_clusterings_are_measured_on_distinct_points(spark, monkeypatch):
    from segmint.operators import clustering as CL
    from segmint.plans import density as DN

    measured = []

    def metrics_of(df, *a, **k):
        measured.append((df.count(), k.get("weight")))
        return CM.metrics_of(df, *a, **k)

    x = np.random.default_rng(13).normal(size=(40, 2))
    points = frame(spark, np.r_[x, x, x]).checkpoint()
    for module in (CL, DN):
        monkeypatch.setattr(module, "metrics_of", metrics_of)
    sweep = CL.kmeans_sweep(points, "x", [2, 3], 2)
    runs, _, labels = CL.ward_hierarchical(points, "x", [2, 3])
    chosen = DN.choose(points)
    assert measured == [(40, "n")] * 3
    assert sweep.best.metrics.n_points == runs[0][1].n_points == labels.count() == chosen.labels.count() == 120
    plain = CM.metrics_of(labels, "x", {"l": "hierarchical_label"}, "pid")["l"]
    best = max((m for _, m in runs), key=lambda m: m.silhouette)
    assert np.isclose(plain.silhouette, best.silhouette) and np.isclose(plain.calinski_harabasz, best.calinski_harabasz)
    # a pid that comes twice counts as before
    twice = points.unionByName(points.where("pid = 0")).checkpoint()
    measured.clear()
    CL.kmeans_sweep(twice, "x", [2], 1)
    DN.choose(twice)
    assert [w for _, w in measured] == [None, None]
