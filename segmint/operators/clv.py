"""Customer lifetime value: historical value, tiers, the noisy training
target and the boosted-tree forecast (MLlib)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    CLV_DEPTH,
    CLV_FEATURES,
    CLV_LEARNING_RATE,
    CLV_NOISE_MEAN,
    CLV_NOISE_SD,
    CLV_ROUNDS,
    CLV_TIER_PROBS,
    CLV_TIERS,
    SEED,
    TEST_FRACTION,
)
from ..session import ensure_checkpoint_dir, written
from .ranking import exact_quantiles


def historical_clv(df: DataFrame) -> DataFrame:
    return df.withColumn("historical_clv", F.col("avg_order_value") * F.col("total_orders"))


def tier_column(value: Column, q10: float | None, q30: float | None, q60: float | None) -> Column:
    bronze, silver, gold, platinum = CLV_TIERS
    if q10 is None:
        return F.lit(bronze)
    return (
        F.when(value >= F.lit(q60), F.lit(platinum))
        .when(value >= F.lit(q30), F.lit(gold))
        .when(value >= F.lit(q10), F.lit(silver))
        .otherwise(F.lit(bronze))
    )


def assign_clv_tier(df: DataFrame, col: str = "clv_12m", out: str = "clv_tier") -> DataFrame:
    """≥q60 Platinum, ≥q30 Gold, ≥q10 Silver, else Bronze, with exact
    linear-interpolated quantiles (one range pass, 3 values kept)."""
    tb = "ingest_seq" if "ingest_seq" in df.columns else None
    q = exact_quantiles(df, [col], CLV_TIER_PROBS, tb)
    q10, q30, q60 = (q[(col, p)] for p in CLV_TIER_PROBS)
    return df.withColumn(out, tier_column(F.col(col), q10, q30, q60))


def _uniform(key: Column, salt: int) -> Column:
    """A U(0,1) draw from the first 52 bits of md5("key:salt"): the same for a
    row no matter how the data are partitioned or retried, and in any engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(salt)))), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def clv_target(df: DataFrame, seed: int = SEED, key: str = "customer_id") -> DataFrame:
    """historical_clv × N(1.05, 0.12) with a hash-seeded Box–Muller draw."""
    u1 = _uniform(F.col(key), seed * 2 + 1)
    u2 = _uniform(F.col(key), seed * 2 + 2)
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return df.withColumn("clv_target", F.col("historical_clv") * (F.lit(CLV_NOISE_MEAN) + F.lit(CLV_NOISE_SD) * z))


def random_split_flag(df: DataFrame, seed: int = SEED, key: str = "customer_id", test_fraction: float = TEST_FRACTION) -> DataFrame:
    """``is_test`` from a key hash: stable under repartitioning and retries
    (``randomSplit`` depends on partition layout)."""
    u = _uniform(F.col(key), seed)
    return df.withColumn("is_test", u < F.lit(test_fraction))


def training_rows(train: DataFrame) -> DataFrame:
    """(features, clv_target, clv_weight): rows of equal features as one, with
    their mean target and their number. Trees of squared loss see no more of
    them: their sums are the same, and what varies within equal features is the
    same on both sides of every split."""
    ensure_checkpoint_dir(train.sparkSession)
    whole = train.groupBy(*CLV_FEATURES).agg(F.avg("clv_target").alias("clv_target"), F.count(F.lit(1)).cast("double").alias("clv_weight"))
    return whole.transform(written)


def clv_model(df: DataFrame, seed: int = SEED, max_iter: int = CLV_ROUNDS):
    """Fit GBT regression on the training split, predict every row.
    Returns (scored frame with clv_12m / clv_tier, model, holdout_rmse)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = historical_clv(df)
    data = data.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in CLV_FEATURES})
    data = random_split_flag(clv_target(data, seed), seed)
    assembler = VectorAssembler(inputCols=CLV_FEATURES, outputCol="_clv_features")
    gbt = GBTRegressor(
        featuresCol="_clv_features",
        labelCol="clv_target",
        weightCol="clv_weight",
        predictionCol="clv_12m",
        maxIter=max_iter,
        maxDepth=CLV_DEPTH,
        stepSize=CLV_LEARNING_RATE,
        seed=seed,
    )
    train = data.where(~F.col("is_test") & F.col("clv_target").isNotNull())
    model = Pipeline(stages=[assembler, gbt]).fit(training_rows(train))
    scored = model.transform(data).drop("_clv_features")
    test = scored.where(F.col("is_test") & F.col("clv_target").isNotNull())
    rmse = RegressionEvaluator(labelCol="clv_target", predictionCol="clv_12m", metricName="rmse").evaluate(test)
    scored = assign_clv_tier(scored.drop("clv_target", "is_test"))
    return scored, model, rmse
