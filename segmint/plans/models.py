"""Model-backed plan steps (E1/E3): features → K-means sweep → Ward →
comparison → labels → CLV model → churn model. Cached per session and data
folder; every fitted step's input is materialised first so the many MLlib
passes read a checkpoint, not the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import KMEANS_RESTARTS
from ..operators import churn as CH
from ..operators import clustering as CL
from ..operators import clv as CLV
from ..operators.features import feature_matrix
from ..session import at_once
from . import base

_CACHE: dict = {}


def _k(spark, sf_dir, name):
    return base._key(spark, sf_dir, name)


def features(spark: SparkSession, sf_dir: str):
    k = _k(spark, sf_dir, "features")
    if k not in _CACHE:
        sc = base.scored(spark, sf_dir)
        fm, names, model = feature_matrix(sc)
        _CACHE[k] = (base.materialize(fm), names)
    return _CACHE[k]


def kmeans(spark: SparkSession, sf_dir: str, restarts: int = KMEANS_RESTARTS):
    """K-means sweep: all (k, restart) fits in one pass over the features a
    step."""
    k = _k(spark, sf_dir, f"kmeans{restarts}")
    if k not in _CACHE:
        fm, _ = features(spark, sf_dir)
        _CACHE[k] = CL.kmeans_sweep(fm.select("customer_id", "ingest_seq", "features"), restarts=restarts, ident="ingest_seq")
    return _CACHE[k]


def ward(spark: SparkSession, sf_dir: str):
    k = _k(spark, sf_dir, "ward")
    if k not in _CACHE:
        fm, _ = features(spark, sf_dir)
        _CACHE[k] = CL.ward_hierarchical(fm.select("customer_id", "ingest_seq", "features"), ident="ingest_seq")
    return _CACHE[k]


def fits(spark: SparkSession, sf_dir: str) -> dict:
    """algorithm -> the function that fits it, in the order of the comparison."""
    from . import density

    features(spark, sf_dir)  # shared: made before they start
    return {
        "K-Means": lambda: kmeans(spark, sf_dir),
        "DBSCAN": lambda: density.dbscan_best(spark, sf_dir),
        "Hierarchical": lambda: ward(spark, sf_dir),
    }


def all_fits(spark: SparkSession, sf_dir: str) -> tuple:
    """(K-means sweep, DBSCAN choice, Ward result). They need nothing of each
    other and are mostly short jobs, so all three are fitted at the same time."""
    return at_once(spark, *fits(spark, sf_dir).values())


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep, dbscan, (runs, best, _) = all_fits(spark, sf_dir)
    cands = [("K-Means", sweep.best.metrics), ("DBSCAN", dbscan.metrics), ("Hierarchical", best[1])]
    return CL.algorithm_comparison(spark, cands)


#: algorithm -> the column of ``labels`` that holds its clusters
LABEL_OF = {"K-Means": "kmeans_label", "DBSCAN": "dbscan_label", "Hierarchical": "hierarchical_label"}


def with_cluster_id(labels: DataFrame, algorithm: str) -> DataFrame:
    """The labels of one algorithm as ``cluster_id``."""
    return labels.withColumn("cluster_id", F.col(LABEL_OF[algorithm]).cast("int"))


def labels_of(spark: SparkSession, sf_dir: str, algorithm: str, fit) -> DataFrame:
    """(customer_id, the label column of one algorithm) from its fit."""
    if algorithm == "DBSCAN":
        ids = base.scored(spark, sf_dir).select("customer_id", F.col("ingest_seq").alias("pid"))
        found = ids.join(fit.labels, "pid")
    else:
        found = fit.labels if algorithm == "K-Means" else fit[2]
    name = LABEL_OF[algorithm]
    return found.select("customer_id", F.col(name).cast("int").alias(name))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer_id, kmeans_label, dbscan_label, hierarchical_label)."""
    k = _k(spark, sf_dir, "labels")
    if k not in _CACHE:
        sweep, dbscan, (_, _, hierarchical) = all_fits(spark, sf_dir)
        ids = base.scored(spark, sf_dir).select("customer_id", F.col("ingest_seq").alias("pid"))
        out = (
            ids.join(sweep.labels.select("customer_id", F.col("kmeans_label").cast("int").alias("kmeans_label")), "customer_id")
            .join(dbscan.labels.select("pid", F.col("dbscan_label").cast("int").alias("dbscan_label")), "pid")
            .join(hierarchical.select("customer_id", F.col("hierarchical_label").cast("int").alias("hierarchical_label")), "customer_id")
        )
        _CACHE[k] = base.materialize(out.drop("pid"))
    return _CACHE[k]


def winner(spark: SparkSession, sf_dir: str) -> str:
    return comparison(spark, sf_dir).where("is_best").first()["algorithm"]


def clustered(spark: SparkSession, sf_dir: str, algorithm: str | None = None) -> DataFrame:
    """Scored customers with the three labels and ``cluster_id`` from
    ``algorithm``, by default the winner of the comparison."""
    algorithm = algorithm or winner(spark, sf_dir)
    k = _k(spark, sf_dir, f"clustered-{algorithm}")
    if k not in _CACHE:
        _CACHE[k] = base.materialize(base.scored(spark, sf_dir).join(with_cluster_id(labels(spark, sf_dir), algorithm), "customer_id"))
    return _CACHE[k]


def clv(spark: SparkSession, sf_dir: str):
    k = _k(spark, sf_dir, "clv")
    if k not in _CACHE:
        scored, model, rmse = CLV.clv_model(clustered(spark, sf_dir))
        _CACHE[k] = (base.materialize(scored), model, rmse)
    return _CACHE[k]


def refitted_clv(spark: SparkSession, sf_dir: str, algorithm: str) -> DataFrame:
    """Customers as ``clv_model`` scores them when refitted on the labels of one
    algorithm. Where keys do not repeat, it needs no labels but those and is
    fitted while the other algorithms still are. Repeated keys multiply in the
    joins of all labels, so there it waits for them."""
    every = fits(spark, sf_dir)
    customers = base.scored(spark, sf_dir)
    n = customers.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("c"), F.count_distinct("ingest_seq").alias("s")).first()
    if not n["n"] == n["c"] == n["s"]:
        return CLV.clv_model(clustered(spark, sf_dir, algorithm))[0]

    def refit():
        told = labels_of(spark, sf_dir, algorithm, every[algorithm]())
        return CLV.clv_model(base.materialize(customers.join(with_cluster_id(told, algorithm).drop(LABEL_OF[algorithm]), "customer_id")))[0]

    return at_once(spark, refit, *[fit for name, fit in every.items() if name != algorithm])[0]


def churn(spark: SparkSession, sf_dir: str) -> CH.ChurnResult:
    k = _k(spark, sf_dir, "churn")
    if k not in _CACHE:
        res = CH.churn_model(clustered(spark, sf_dir))
        res.scored = base.materialize(res.scored)
        _CACHE[k] = res
    return _CACHE[k]
