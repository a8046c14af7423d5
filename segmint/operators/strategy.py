"""Campaign strategy per (segment, cluster), budget allocation and lift.

Global medians are computed once (exact, one range pass for all three) and
enter the plan as literals; the segment profile is an 8-row dimension joined
by broadcast (fixed size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import (
    FALLBACK_SEGMENT,
    LIFT_BASE,
    LIFT_BUDGET_SCALE,
    LIFT_CAP,
    NURTURE_TONE,
    PREMIUM_BUDGET_BONUS,
    PREMIUM_OFFER,
    PREMIUM_TONE,
    SEGMENT_PROFILES,
    URGENT_CHANNEL,
    URGENT_TONE,
)
from .ranking import exact_medians

PROFILE_FIELDS = ["channel", "offer", "tone", "response_rate", "budget_pct"]


def profile_table(spark) -> DataFrame:
    rows = [(s, p["channel"], p["offer"], p["tone"], float(p["response_rate"]), int(p["budget_pct"])) for s, p in SEGMENT_PROFILES.items()]
    return spark.createDataFrame(
        rows, "rfm_segment string, channel string, offer string, tone string, response_rate double, budget_pct int"
    )


def lookup_profile(df: DataFrame) -> DataFrame:
    """Left-join the profile by segment; unknown segments take the fallback profile."""
    prof = F.broadcast(profile_table(df.sparkSession)).select(
        "rfm_segment", *[F.col(c).alias(f"p_{c}") for c in PROFILE_FIELDS]
    )
    fb = SEGMENT_PROFILES[FALLBACK_SEGMENT]
    joined = df.join(prof, "rfm_segment", "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(f"p_{c}"), F.lit(fb[c])) for c in PROFILE_FIELDS}
    ).drop(*[f"p_{c}" for c in PROFILE_FIELDS])


def strategy_base(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("rfm_segment").isNotNull() & F.col("cluster_id").isNotNull())
        .groupBy("rfm_segment", "cluster_id")
        .agg(
            F.count("customer_id").alias("customer_count"),
            F.avg("total_spend").alias("avg_spend"),
            F.avg("recency").alias("avg_recency"),
            F.avg("satisfaction_score").alias("avg_satisfaction"),
        )
    )


def strategy_table(df: DataFrame) -> DataFrame:
    """Profile lookup, then the overrides in order: above-median spend →
    premium offer/tone and +2 budget; above-median recency → sms, urgent;
    below-median satisfaction → nurturing (the last tone override wins)."""
    med = exact_medians(df, ["total_spend", "recency", "satisfaction_score"], "ingest_seq" if "ingest_seq" in df.columns else None)

    def lit_or_null(v):
        return F.lit(v).cast("double") if v is not None else F.lit(None).cast("double")

    spend_hi = F.col("avg_spend") > lit_or_null(med["total_spend"])
    rec_hi = F.col("avg_recency") > lit_or_null(med["recency"])
    sat_lo = F.col("avg_satisfaction") < lit_or_null(med["satisfaction_score"])
    base = lookup_profile(strategy_base(df))
    out = base.withColumns(
        {
            "offer": F.when(spend_hi, F.lit(PREMIUM_OFFER)).otherwise(F.col("offer")),
            "tone": F.when(sat_lo, F.lit(NURTURE_TONE))
            .when(rec_hi, F.lit(URGENT_TONE))
            .when(spend_hi, F.lit(PREMIUM_TONE))
            .otherwise(F.col("tone")),
            "budget_pct": F.when(spend_hi, F.col("budget_pct") + PREMIUM_BUDGET_BONUS).otherwise(F.col("budget_pct")),
            "channel": F.when(rec_hi, F.lit(URGENT_CHANNEL)).otherwise(F.col("channel")),
        }
    )
    return out.select(
        "rfm_segment",
        F.col("cluster_id").cast("int").alias("cluster_id"),
        "channel",
        "offer",
        "tone",
        "budget_pct",
        "response_rate",
        F.col("customer_count").cast("bigint").alias("customer_count"),
        (F.col("response_rate") * F.col("customer_count")).alias("expected_response"),
    )


def primary_strategy(strategies: DataFrame) -> DataFrame:
    """Per segment, the row with the most customers (ties → lowest cluster)."""
    pick = F.max_by(F.struct(*[c for c in strategies.columns if c != "rfm_segment"]), F.struct(F.col("customer_count"), -F.col("cluster_id")))
    return strategies.groupBy("rfm_segment").agg(pick.alias("p")).select("rfm_segment", "p.*")


def budget_allocation(strategies: DataFrame, total_budget: float) -> DataFrame:
    """Per segment, split the budget over its clusters by count × response
    rate (by count when all weights are 0). Window over the strategy table,
    bounded by segments × clusters."""
    seg = Window.partitionBy("rfm_segment")
    w = F.col("customer_count") * F.col("response_rate")
    weight = F.when(F.sum(w).over(seg) == 0, F.col("customer_count").cast("double")).otherwise(w)
    alloc = strategies.withColumn("_w", weight).withColumn("allocation_pct", F.col("_w") / F.sum("_w").over(seg) * 100.0)
    return alloc.select(
        "rfm_segment",
        "cluster_id",
        "customer_count",
        "allocation_pct",
        (F.col("allocation_pct") / 100.0 * F.lit(float(total_budget))).alias("allocation_amount"),
    )


def allocation_sorted(allocation: DataFrame) -> DataFrame:
    return allocation.orderBy(F.col("rfm_segment"), F.col("allocation_pct").desc(), F.col("cluster_id"))


def revenue_lift(strategies: DataFrame, customers: DataFrame, total_budget: float) -> DataFrame:
    """Per segment: Σ customers × primary response rate × segment mean order
    value × min(2, 0.6 + budget / 100000)."""
    mult = min(LIFT_CAP, LIFT_BASE + float(total_budget) / LIFT_BUDGET_SCALE)
    totals = strategies.groupBy("rfm_segment").agg(F.sum("customer_count").alias("segment_customers"))
    prim = primary_strategy(strategies).select("rfm_segment", F.col("response_rate").alias("primary_rate"))
    aov = (
        customers.where(F.col("rfm_segment").isNotNull())
        .groupBy("rfm_segment")
        .agg(F.avg("avg_order_value").alias("segment_aov"))
    )
    return (
        totals.join(prim, "rfm_segment")
        .join(aov, "rfm_segment", "left")
        .withColumn("expected_orders", F.col("segment_customers") * F.col("primary_rate"))
        .withColumn("expected_lift", F.col("expected_orders") * F.col("segment_aov") * F.lit(mult))
    )


def kpi_strategy(customers: DataFrame, strategies: DataFrame) -> DataFrame:
    s = strategies.agg(
        F.count_distinct("rfm_segment").cast("double").alias("active_segments"),
        F.avg("response_rate").alias("avg_response_rate"),
        F.avg("budget_pct").alias("avg_budget_split"),
    )
    aov = customers.select(F.avg("avg_order_value")).scalar()
    return s.select("*", aov.alias("avg_order_value"))
