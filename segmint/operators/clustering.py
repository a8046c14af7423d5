"""Clustering: K-means sweep with restarts, metric-weighted model selection,
exact Ward clustering, algorithm comparison.

K-means results differ numerically from scikit-learn (other random streams);
the selection rules are the reference's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import (
    COMPARISON_WEIGHTS,
    KMEANS_K_RANGE,
    KMEANS_RESTARTS,
    KMEANS_WEIGHTS,
    SEED,
    WARD_K_RANGE,
)
from ..session import written
from .cluster_metrics import ClusterMetrics, metrics_of
from .tiles import of_singles, unique_ids


# --------------------------------------------------------------------------- normalisation
def minmax_normalize(df: DataFrame, col: str, out: str, higher_better: bool = True) -> DataFrame:
    """Min-max to [0, 1] over a (small, already aggregated) frame: all missing
    → 0; all equal → 0.5; turned round when lower is better; missing → 0."""
    whole = Window.partitionBy()
    lo, hi = F.min(col).over(whole), F.max(col).over(whole)
    norm = F.when(hi.isNull(), F.lit(0.0)).when(lo == hi, F.lit(0.5)).otherwise((F.col(col) - lo) / (hi - lo))
    if not higher_better:
        norm = F.when(hi.isNull() | (lo == hi), norm).otherwise(F.lit(1.0) - norm)
    return df.withColumn(out, F.coalesce(norm, F.lit(0.0)))


def score_candidates(frame: DataFrame, weights: dict[str, float], lower_better: tuple[str, ...] = ("davies_bouldin", "inertia")) -> DataFrame:
    """Adds ``score``: the weighted sum of the min-max normalised columns, for
    a frame with one row a candidate."""
    total = F.lit(0.0)
    for c, w in weights.items():
        frame = minmax_normalize(frame, c, f"_{c}", c not in lower_better)
        total = total + F.lit(float(w)) * F.col(f"_{c}")
    return frame.withColumn("score", total).drop(*[f"_{c}" for c in weights])


# --------------------------------------------------------------------------- K-means
@dataclass
class KMeansRun:
    k: int
    fit: object  # kmeans.Run
    inertia: float
    metrics: ClusterMetrics
    score: float = 0.0


@dataclass
class SweepResult:
    runs: list
    best: KMeansRun
    labels: DataFrame = field(repr=False)
    skipped: list = field(default_factory=list)  # k values with too few rows


def kmeans_sweep(
    points: DataFrame,
    features: str = "features",
    k_range=KMEANS_K_RANGE,
    restarts: int = KMEANS_RESTARTS,
    seed: int = SEED,
    ident: str = "pid",
) -> SweepResult:
    """Fit K-means for each k (best of ``restarts`` by inertia), score each by
    0.45 silhouette + 0.2 CH + 0.2 DB + 0.15 inertia (min-max normalised,
    DB and inertia inverted) and keep the first maximum. All fits go through
    the points together (``kmeans.Balls``). ``points`` should be materialised;
    ``ident`` is a unique integer column."""
    from pyspark.ml.functions import vector_to_array

    from .density import of_copies
    from .kmeans import Balls

    is_vector = not points.schema[features].dataType.typeName().startswith("array")
    x = vector_to_array(features) if is_vector else F.col(features).cast("array<double>")
    balls = Balls(points.select(F.col(ident).cast("long").alias("pid"), x.alias("x")))
    ks = [k for k in k_range if k < balls.n] or [max(1, balls.n - 1)]
    skipped = [k for k in k_range if k not in ks]
    fits = balls.fit(balls.starts([(k, seed + r) for k in ks for r in range(restarts)]))
    best_of = {k: min((f for f in fits if f.k == k), key=lambda f: f.cost) for k in ks}  # restarts in seed order: first minimum wins
    near = balls.nearest({f"k_{k}": f for k, f in best_of.items()}).transform(written)
    labels = of_copies(balls.points, balls.singles, near).drop("id").transform(written)
    names = {f"k_{k}": f"k_{k}" for k in ks}
    if unique_ids(balls.points):  # copies count by the weight of their distinct point
        found = metrics_of(balls.singles.join(near, "id"), "x", names, "id", weight="n")
    else:
        found = metrics_of(balls.points.join(labels, "pid"), "x", names, "pid")
    runs = [KMeansRun(k, best_of[k], best_of[k].cost, found[f"k_{k}"]) for k in ks]
    for r, sc in zip(runs, selection_scores(points.sparkSession, [(r.k, r.metrics, r.inertia) for r in runs])):
        r.score = sc
    best = max(runs, key=lambda r: r.score)  # first maximum
    told = labels.select(F.col("pid").alias("_pid"), F.col(f"k_{best.k}").alias("kmeans_label"))
    return SweepResult(runs, best, points.join(told, F.col(ident) == F.col("_pid")).drop("_pid"), skipped)


def selection_scores(spark, candidates: list[tuple[object, ClusterMetrics, float]]) -> list[float]:
    """K-means selection score of each candidate (key, metrics, inertia), by
    the weights of ``KMEANS_WEIGHTS``."""
    rows = [(i, m.silhouette, m.davies_bouldin, m.calinski_harabasz, cost) for i, (_, m, cost) in enumerate(candidates)]
    frame = spark.createDataFrame(rows, "i int, silhouette double, davies_bouldin double, calinski_harabasz double, inertia double")
    return [r["score"] for r in score_candidates(frame, KMEANS_WEIGHTS).orderBy("i").collect()]  # one row a candidate


def sweep_frame(spark, sweep: SweepResult) -> DataFrame:
    rows = [
        (r.k, r.inertia, r.metrics.silhouette, r.metrics.davies_bouldin, r.metrics.calinski_harabasz, r.score, None)
        for r in sweep.runs
    ]
    rows += [(k, None, None, None, None, None, "k is not below the number of rows") for k in sweep.skipped]
    return spark.createDataFrame(
        rows,
        "k int, inertia double, silhouette double, davies_bouldin double, calinski_harabasz double, score double, skipped string",
    )


# --------------------------------------------------------------------------- Ward
def ward_hierarchical(points: DataFrame, features: str = "features", k_range=WARD_K_RANGE, ident: str = "pid"):
    """Exact Ward clustering (``ward.ward_labels``) for every k that the
    distinct points allow. Returns ([(k, metrics)], the first best by
    silhouette, points with ``hierarchical_label`` of that k). ``ident`` is a
    unique integer column."""
    from pyspark.ml.functions import vector_to_array

    from .ward import ward_clusters

    is_vector = not points.schema[features].dataType.typeName().startswith("array")
    x = vector_to_array(features) if is_vector else F.col(features).cast("array<double>")
    narrow = points.select(F.col(ident).cast("long").alias("pid"), x.alias("x"))
    singles, told, ks = ward_clusters(narrow, list(k_range))
    if not ks:
        raise ValueError("Ward needs at least as many distinct points as clusters")
    # copies count by the weight of their distinct point
    found = metrics_of(singles.join(told, "id"), "x", {f"k_{k}": f"k_{k}" for k in ks}, "id", weight="n")
    labels = of_singles(narrow, singles, told)
    runs = [(k, found[f"k_{k}"]) for k in ks]
    best = max(runs, key=lambda r: (r[1].silhouette or -1))  # first maximum
    told = labels.select(F.col("pid").alias("_pid"), F.col(f"k_{best[0]}").alias("hierarchical_label")).transform(written)
    return runs, best, points.join(told, F.col(ident) == F.col("_pid")).drop("_pid")


# --------------------------------------------------------------------------- comparison
def algorithm_comparison(spark, candidates: list[tuple[str, ClusterMetrics]]) -> DataFrame:
    """0.5 silhouette + 0.25 DB (inverted) + 0.25 CH, min-max normalised over
    the candidates; ``is_best`` marks the first maximum."""
    rows = [(i, name, m.n_clusters, m.silhouette, m.davies_bouldin, m.calinski_harabasz) for i, (name, m) in enumerate(candidates)]
    schema = "position int, algorithm string, n_clusters int, silhouette double, davies_bouldin double, calinski_harabasz double"
    scored = score_candidates(spark.createDataFrame(rows, schema), COMPARISON_WEIGHTS)
    order = Window.orderBy(F.col("score").desc(), F.col("position"))  # one row an algorithm
    return scored.withColumn("is_best", F.row_number().over(order) == 1)


def pca_projection(df: DataFrame, features: str = "features", k: int = 3):
    """Centre, then MLlib PCA; returns (frame with pca_x/y/z, explained
    variance ratios). The 2-D view is the first two components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = df.select(Summarizer.mean(F.col(features)).alias("m")).first()["m"].toArray()
    arr = vector_to_array(F.col(features))
    lit = F.array(*[F.lit(float(v)) for v in mean])
    centred = df.withColumn("_c", array_to_vector(F.zip_with(arr, lit, lambda a, b: a - b)))
    kk = min(k, len(mean))
    model = PCA(k=kk, inputCol="_c", outputCol="_p").fit(centred)
    out = model.transform(centred).withColumn("_pa", vector_to_array(F.col("_p")))
    names = ["pca_x", "pca_y", "pca_z"][:kk]
    out = out.withColumns({n: F.col("_pa")[i] for i, n in enumerate(names)}).drop("_c", "_p", "_pa")
    return out, list(model.explainedVariance.toArray())
