"""The three clusterings of the comparison are fitted at the same time."""

from threading import Barrier
from types import SimpleNamespace

import pytest

from segmint.operators.cluster_metrics import ClusterMetrics
from segmint.plans import density, models


def test_comparison_fits_at_once(spark, monkeypatch):
    """Each fit waits for the others to have begun."""
    begun = Barrier(3, timeout=30)
    seen = {}

    def fit(name, result):
        def run(spark_, sf_dir):
            seen[name] = spark.sparkContext.getLocalProperty("segmint.test")
            begun.wait()
            return result

        return run

    metrics = [ClusterMetrics(0.1 * k, 1.0, 10.0 * k, k, 100) for k in (4, 2, 3)]
    monkeypatch.setattr(models, "features", lambda *a: None)
    monkeypatch.setattr(models, "kmeans", fit("kmeans", SimpleNamespace(best=SimpleNamespace(metrics=metrics[0]))))
    monkeypatch.setattr(density, "dbscan_best", fit("dbscan", SimpleNamespace(metrics=metrics[1])))
    monkeypatch.setattr(models, "ward", fit("ward", ([], (3, metrics[2]), None)))
    spark.sparkContext.setLocalProperty("segmint.test", "yes")
    try:
        rows = models.comparison(spark, "unused").collect()
    finally:
        spark.sparkContext.setLocalProperty("segmint.test", None)
    assert seen == dict.fromkeys(("kmeans", "dbscan", "ward"), "yes")
    assert [(r["algorithm"], r["n_clusters"]) for r in sorted(rows, key=lambda r: r["position"])] == [("K-Means", 4), ("DBSCAN", 2), ("Hierarchical", 3)]


def test_error_of_a_step_is_raised(spark):
    def bad():
        raise ArithmeticError("no")

    with pytest.raises(ArithmeticError):
        models.at_once(spark, lambda: 1, bad)
    assert models.at_once(spark, lambda: 1, lambda: 2) == (1, 2)


def test_refit_of_clv_does_not_wait_for_the_other_algorithms(spark, monkeypatch):
    """The others end only after the CLV model of the chosen one is fitted."""
    from threading import Event

    fitted = Event()
    seen = []
    customers = spark.createDataFrame([(str(i), i, 10 * i) for i in range(4)], "customer_id string, ingest_seq long, spend int")
    labels = spark.createDataFrame([(str(i), i % 2) for i in range(4)], "customer_id string, hierarchical_label int")

    def other(name):
        def run(*a):
            assert fitted.wait(60)
            seen.append(name)

        return run

    def clv_model(df):
        fitted.set()
        return df, None, 0.0

    monkeypatch.setattr(models, "features", lambda *a: None)
    monkeypatch.setattr(models.base, "scored", lambda *a: customers)
    monkeypatch.setattr(models, "kmeans", other("kmeans"))
    monkeypatch.setattr(density, "dbscan_best", other("dbscan"))
    monkeypatch.setattr(models, "ward", lambda *a: ([], None, labels))
    monkeypatch.setattr(models.CLV, "clv_model", clv_model)
    rows = models.refitted_clv(spark, "unused", "Hierarchical").collect()
    assert sorted((r["customer_id"], r["spend"], r["cluster_id"]) for r in rows) == [(str(i), 10 * i, i % 2) for i in range(4)]
    assert sorted(seen) == ["dbscan", "kmeans"]


def test_refit_of_clv_takes_all_labels_where_keys_repeat(spark, monkeypatch):
    customers = spark.createDataFrame([("1", 1), ("1", 1), ("2", 2)], "customer_id string, ingest_seq long")
    seen = []
    monkeypatch.setattr(models, "features", lambda *a: None)
    monkeypatch.setattr(models.base, "scored", lambda *a: customers)
    monkeypatch.setattr(models, "clustered", lambda spark_, sf_dir, algorithm: seen.append(algorithm) or customers)
    monkeypatch.setattr(models.CLV, "clv_model", lambda df: (df, None, 0.0))
    assert models.refitted_clv(spark, "unused", "DBSCAN").count() == 3 and seen == ["DBSCAN"]
