"""DBSCAN plan step: ε candidates from exact 5th-neighbour distances, one
exact DBSCAN per candidate, best by silhouette (first wins; a missing or
zero silhouette counts as −1, as in the reference's ``or -1``)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DBSCAN_MIN_SAMPLES, EPS_PERCENTILES
from ..operators import density as D
from ..operators.cluster_metrics import ClusterMetrics, metrics_of
from ..operators.tiles import unique_ids
from . import base

_CACHE: dict = {}


@dataclass
class DbscanChoice:
    eps: float
    labels: DataFrame
    metrics: ClusterMetrics
    history: list


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    from . import models

    fm, _ = models.features(spark, sf_dir)
    return fm.select(F.col("ingest_seq").alias("pid"), vector_to_array("features").alias("x"), "customer_id")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import table

    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("embedding").cast("array<double>").alias("x"))


def eps_for(points: DataFrame) -> list[float]:
    kd = D.kth_neighbor_distance(points, k=DBSCAN_MIN_SAMPLES)
    return D.eps_candidates(kd, EPS_PERCENTILES)


def choose(points: DataFrame) -> DbscanChoice:
    """All ε candidates in one DBSCAN sweep, the metrics of all ε in one set
    of passes; the first best silhouette wins."""
    pts = base.materialize(points.select("pid", "x"))
    results = D.dbscan_sweep(pts, eps_for(pts), DBSCAN_MIN_SAMPLES)
    names = {f"_l{i}": f"_l{i}" for i in range(len(results))}
    if unique_ids(pts):  # copies count by the weight of their distinct point
        labelled = results[0].singles.drop("dbscan_label")
        for name, r in zip(names, results):
            labelled = labelled.join(r.singles.select("id", F.col("dbscan_label").alias(name)), "id")
        found = metrics_of(labelled, "x", names, "id", weight="n")
    else:
        labelled = pts
        for name, r in zip(names, results):
            labelled = labelled.join(r.labels.select("pid", F.col("dbscan_label").alias(name)), "pid")
        found = metrics_of(labelled, "x", names, "pid")
    mets = list(found.values())
    history = [(r.eps, r.n_clusters, r.n_noise, m.silhouette) for r, m in zip(results, mets)]
    best = None
    for r, m in zip(results, mets):
        if best is None or (m.silhouette or -1) > (best.metrics.silhouette or -1):
            best = DbscanChoice(r.eps, r.labels, m, history)
    return best


def dbscan_best(spark: SparkSession, sf_dir: str) -> DbscanChoice:
    k = base._key(spark, sf_dir, "dbscan")
    if k not in _CACHE:
        _CACHE[k] = choose(customer_points(spark, sf_dir))
    return _CACHE[k]
