"""Cluster quality of labelled rows: silhouette, Davies-Bouldin and
Calinski-Harabasz, for one labelling or several at once.

The work is done by ``silhouette.quality``: cluster statistics stay a
DataFrame and meet points and each other in blocks, so the number of clusters
is not bounded by the driver. The default silhouette takes squared distances,
which need the statistics alone; over plain Euclidean distances it is exact
too, with work that grows with the square of a cluster's size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import silhouette


@dataclass
class ClusterMetrics:
    silhouette: float | None
    davies_bouldin: float | None
    calinski_harabasz: float | None
    n_clusters: int
    n_points: int
    inertia: float | None = None  # within-cluster sum of squared distances


def _as_array(c: Column, is_vector: bool) -> Column:
    if is_vector:
        from pyspark.ml.functions import vector_to_array

        return vector_to_array(c)
    return c.cast("array<double>")


def labelled_points(df: DataFrame, features: str, labels: dict[str, Column | str], ident: str, weight: str | None = None) -> DataFrame:
    """(run, pid, x, label, w if there is a ``weight``): every row once for each
    labelling, by number in the order of ``labels``; rows without a label and
    noise (-1) are left out."""
    is_vector = not df.schema[features].dataType.typeName().startswith("array")
    expr = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
    each = F.array(*[F.struct(F.lit(i).cast("int").alias("run"), expr(c).alias("label")) for i, c in enumerate(labels.values())])
    rows = df.select(F.col(ident).alias("pid"), _as_array(F.col(features), is_vector).alias("x"), F.explode(each).alias("_l"), *([F.col(weight).alias("w")] if weight else []))
    return rows.select("_l.run", "pid", "x", "_l.label", *(["w"] if weight else [])).where(F.col("label").isNotNull() & (F.col("label") != -1))


def metrics_of(df: DataFrame, features: str, labels: dict[str, Column | str], ident: str, euclidean: bool = False, weight: str | None = None) -> dict[str, ClusterMetrics]:
    """The quality of each labelling, by name, in one set of passes.
    ``ident`` must be unique. A row counts as ``weight`` equal points with the
    same labels. The result has one entry a labelling."""
    from ..session import ensure_checkpoint_dir, written

    ensure_checkpoint_dir(df.sparkSession)
    # each point is written once, with all its labels
    is_vector = not df.schema[features].dataType.typeName().startswith("array")
    each = [(F.col(c) if isinstance(c, str) else c).cast("long").alias(f"_l{i}") for i, c in enumerate(labels.values())]
    kept = df.select(F.col(ident).alias("_pid"), _as_array(F.col(features), is_vector).alias("_x"), *each, *([F.col(weight).alias("_w")] if weight else [])).transform(written)
    points = labelled_points(kept, "_x", {name: f"_l{i}" for i, name in enumerate(labels)}, "_pid", "_w" if weight else None)
    found = {r["run"]: r for r in silhouette.quality(points, euclidean).collect()}  # a row a labelling
    out = {}
    for i, name in enumerate(labels):
        r = found.get(i)
        if r is None:
            out[name] = ClusterMetrics(None, None, None, 0, 0)
        elif r["n_clusters"] < 2:
            out[name] = ClusterMetrics(None, None, None, r["n_clusters"], r["n_points"])
        else:
            out[name] = ClusterMetrics(r["silhouette"], r["davies_bouldin"], r["calinski_harabasz"], r["n_clusters"], r["n_points"], r["inertia"])
    return out


def cluster_metrics(df: DataFrame, features: str, label: str, ident: str | None = None, euclidean: bool = False) -> ClusterMetrics:
    """``metrics_of`` one labelling. Without ``ident`` the rows are numbered
    in a checkpoint."""
    if ident is None:
        from ..session import ensure_checkpoint_dir, written

        ensure_checkpoint_dir(df.sparkSession)
        ident = "_row"
        df = df.withColumn(ident, F.monotonically_increasing_id()).transform(written)
    return metrics_of(df, features, {label: label}, ident, euclidean)[label]


def count_clusters(df: DataFrame, label: str) -> Column:
    """Distinct labels without noise (−1), as an aggregate expression."""
    return F.count_distinct(F.when(F.col(label) >= 0, F.col(label)))
