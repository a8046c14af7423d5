"""Clustering feature matrix: z-scored numeric columns plus one-hot
categoricals, assembled into one ML vector column.

* z-score uses the population standard deviation (a zero deviation leaves
  the centred value, i.e. 0); means and deviations come from one aggregate.
* categoricals: ``StringIndexer`` in alphabetical order with an extra slot
  for unseen values, ``OneHotEncoder(dropLast=True)`` drops exactly that
  slot, so every seen category gets its own column and unseen values are
  all zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CLUSTER_CATEGORICAL_FEATURES, CLUSTER_NUMERIC_FEATURES, CLUSTER_OPTIONAL_NUMERIC


@dataclass
class FeatureSpec:
    numeric: list[str]
    categorical: list[str]


def select_features(df: DataFrame) -> FeatureSpec:
    numeric = list(CLUSTER_NUMERIC_FEATURES) + [c for c in CLUSTER_OPTIONAL_NUMERIC if c in df.columns]
    categorical = [c for c in CLUSTER_CATEGORICAL_FEATURES if c in df.columns]
    return FeatureSpec(numeric, categorical)


def zscore_columns(df: DataFrame, cols: list[str]) -> dict:
    """{col: z-score Column} from one aggregate (2 numbers per column)."""
    stats = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols],
    ).first()
    out = {}
    for c in cols:
        m = stats[f"m_{c}"] or 0.0
        s = stats[f"s_{c}"]
        scale = s if s not in (None, 0.0) else 1.0
        out[c] = (F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(m)) / F.lit(scale)
    return out


def feature_matrix(df: DataFrame, out: str = "features"):
    """Returns (frame with ``out`` vector, feature names, fitted indexer/encoder model)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    spec = select_features(df)
    missing = [c for c in spec.numeric if c not in df.columns]
    if missing:
        raise ValueError(f"missing numeric features: {missing}")
    z = zscore_columns(df, spec.numeric)
    scaled = df.withColumns({f"_z_{c}": e for c, e in z.items()})
    stages = []
    inputs = [f"_z_{c}" for c in spec.numeric]
    if spec.categorical:
        idx = [f"_i_{c}" for c in spec.categorical]
        oh = [f"_o_{c}" for c in spec.categorical]
        stages.append(
            StringIndexer(
                inputCols=spec.categorical, outputCols=idx, stringOrderType="alphabetAsc", handleInvalid="keep"
            )
        )
        stages.append(OneHotEncoder(inputCols=idx, outputCols=oh, dropLast=True, handleInvalid="keep"))
        inputs += oh
    stages.append(VectorAssembler(inputCols=inputs, outputCol=out))
    model = Pipeline(stages=stages).fit(scaled)
    result = model.transform(scaled)
    names = list(spec.numeric)
    if spec.categorical:
        labels = model.stages[0].labelsArray
        for c, labs in zip(spec.categorical, labels):
            names += [f"{c}_{v}" for v in labs]
    drop = [c for c in result.columns if c.startswith(("_z_", "_i_", "_o_"))]
    return result.drop(*drop), names, model
