"""Aggregations behind the dashboard: KPIs, counts, pivots, rollups,
histograms, per-cluster / per-segment profiles and the executive summary.

All are plain Catalyst aggregates (partial + final). Group keys that are
NULL are dropped, as pandas ``groupby`` / ``value_counts`` drop them.
Windows only ever run over already-aggregated frames whose size is bounded
by the number of segments / clusters / bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import (
    GAUGE_STEPS,
    HEALTHY_SEGMENTS,
    HIGH_RISK_PROBABILITY,
    PERSONAS,
    PROBABILITY_BINS,
    RADAR_FEATURES,
    SEGMENTS,
)
from ..functions.formatting import delta_color, delta_text, round_bucket


def _keyed(df: DataFrame, *keys: str) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)


# --------------------------------------------------------------------------- counts
def segment_counts(df: DataFrame) -> DataFrame:
    return _keyed(df, "rfm_segment").groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("count"))


def country_counts(df: DataFrame) -> DataFrame:
    return _keyed(df, "country").groupBy("country").agg(F.count(F.lit(1)).alias("count"))


def revenue_by_segment(df: DataFrame) -> DataFrame:
    return (
        _keyed(df, "rfm_segment")
        .groupBy("rfm_segment")
        .agg(F.sum(F.col("total_spend").cast("decimal(18,2)")).cast("double").alias("total_spend"))
        .orderBy(F.col("total_spend").desc_nulls_last(), F.col("rfm_segment"))
    )


def segment_share(df: DataFrame) -> DataFrame:
    """Count and percentage of all keyed rows per segment; the total is the
    sum of the segment counts."""
    whole = Window.partitionBy()  # over one row a segment
    return segment_counts(df).withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(whole))


def monthly_signups(df: DataFrame, date_col: str = "signup_date") -> DataFrame:
    """Month-end buckets of sign-ups from the first to the last month; empty
    months appear with 0. The month list comes from one (min, max) row."""
    keyed = _keyed(df, date_col).withColumn("month_end", F.last_day(F.col(date_col)))
    counts = keyed.groupBy("month_end").agg(F.count(F.lit(1)).alias("signups"))
    span = keyed.agg(F.min("month_end").alias("lo"), F.max("month_end").alias("hi"))
    months = span.select(
        F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("INTERVAL 1 MONTH"))).alias("m")
    ).select(F.last_day("m").alias("month_end"))
    return (
        months.join(counts, "month_end", "left")
        .select("month_end", F.coalesce(F.col("signups"), F.lit(0)).cast("bigint").alias("signups"))
    )


def spend_satisfaction_pivot(df: DataFrame) -> DataFrame:
    """Mean spend by segment × half-even-rounded satisfaction, in long form
    (rfm_segment, bucket, avg_spend): every segment with every bucket that
    occurs, 0 where a pair has no rows. The grid of pairs is built from the
    aggregate itself (segments × buckets rows)."""
    data = _keyed(df, "rfm_segment", "satisfaction_score").withColumn("bucket", round_bucket(F.col("satisfaction_score")))
    means = data.groupBy("rfm_segment", "bucket").agg(F.avg("total_spend").alias("avg_spend"))
    cells = means.groupBy().agg(F.collect_set("rfm_segment").alias("segments"), F.collect_set("bucket").alias("buckets"), F.collect_list(F.struct("rfm_segment", "bucket", "avg_spend")).alias("cells"))
    grid = cells.select(F.explode("segments").alias("rfm_segment"), "buckets", "cells").select("rfm_segment", F.explode("buckets").alias("bucket"), "cells")
    own = F.filter("cells", lambda c: (c["rfm_segment"] == F.col("rfm_segment")) & (c["bucket"] == F.col("bucket")))
    return grid.select("rfm_segment", "bucket", F.coalesce(F.get(own, F.lit(0))["avg_spend"], F.lit(0.0)).alias("avg_spend"))


def score_histogram(df: DataFrame) -> DataFrame:
    long = df.select("r_score", "f_score", "m_score").unpivot([], ["r_score", "f_score", "m_score"], "score_name", "score")
    return long.where(F.col("score").isNotNull()).groupBy("score_name", "score").agg(F.count(F.lit(1)).alias("count"))


def probability_histogram(df: DataFrame, col: str = "churn_probability", bins: int = PROBABILITY_BINS) -> DataFrame:
    """Equal-width bins on [0, 1], empty ones included; p = 1 joins the last
    bin."""
    p = F.col(col)
    b = F.least(F.floor(p * bins).cast("bigint") + 1, F.lit(bins))
    # one zero row a bin keeps empty bins in the result
    none = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"), F.lit(0).alias("one"))
    return (
        _keyed(df, col).select(b.alias("bin"), F.lit(1).alias("one")).unionByName(none)
        .groupBy("bin")
        .agg(F.sum("one").alias("count"))
        .withColumn("bin_lo", (F.col("bin") - 1) / F.lit(float(bins)))
        .withColumn("bin_hi", F.col("bin") / F.lit(float(bins)))
    )


# --------------------------------------------------------------------------- clusters
def cluster_profile(df: DataFrame) -> DataFrame:
    return _keyed(df, "cluster_id").groupBy("cluster_id").agg(
        F.avg("total_spend").alias("total_spend"),
        F.avg("frequency").alias("frequency"),
        F.avg("recency").alias("recency"),
        F.avg("satisfaction_score").alias("satisfaction_score"),
        F.avg("clv_12m").alias("clv_12m"),
        F.count(F.lit(1)).alias("cluster_size"),
    )


def cluster_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean of every numeric feature plus size per cluster (the reference's
    join of means with sizes is one aggregate here)."""
    return (
        _keyed(df, "cluster_id")
        .groupBy("cluster_id")
        .agg(*[F.avg(c).alias(c) for c in features], F.count(F.lit(1)).alias("cluster_size"))
        .orderBy("cluster_id")
    )


def top_clusters(df: DataFrame, n: int = 8) -> DataFrame:
    return cluster_profile(df).orderBy(F.col("cluster_size").desc(), F.col("cluster_id")).limit(n)


def radar_profile(df: DataFrame) -> DataFrame:
    """Cluster means divided by the largest mean over clusters (0 → 1)."""
    prof = cluster_profile(df)
    whole = Window.partitionBy()  # over ≤ #clusters aggregated rows
    out = prof
    for c in RADAR_FEATURES:
        mx = F.max(c).over(whole)
        out = out.withColumn(f"{c}_ratio", F.col(c) / F.when(mx == 0, F.lit(1.0)).otherwise(mx))
    return out.select("cluster_id", *[f"{c}_ratio" for c in RADAR_FEATURES])


def cluster_churn_gauge(df: DataFrame) -> DataFrame:
    lo, hi = GAUGE_STEPS
    g = (
        _keyed(df, "cluster_id")
        .groupBy("cluster_id")
        .agg((F.avg("churn_probability") * 100.0).alias("gauge_value"))
    )
    band = F.when(F.col("gauge_value") < lo, F.lit("low")).when(F.col("gauge_value") < hi, F.lit("medium")).otherwise(
        F.lit("high")
    )
    return g.withColumn("gauge_band", band).orderBy("cluster_id")


# --------------------------------------------------------------------------- segments
def segment_churn_summary(df: DataFrame) -> DataFrame:
    """Per segment size and means; ``is_top_risk`` marks the segment with the
    highest mean churn probability (ties by name)."""
    s = _keyed(df, "rfm_segment").groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("size"),
        F.avg("churn_probability").alias("churn_rate"),
        F.avg("recency").alias("avg_recency"),
        F.avg("satisfaction_score").alias("avg_satisfaction"),
        F.avg("clv_12m").alias("avg_clv"),
    )
    order = Window.orderBy(F.col("churn_rate").desc_nulls_last(), F.col("rfm_segment"))  # ≤ 8 rows
    return s.withColumn("is_top_risk", (F.row_number().over(order) == 1))


def persona_stats(df: DataFrame) -> DataFrame:
    return _keyed(df, "rfm_segment").groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("total_spend").alias("avg_spend"),
        F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
    )


def persona_table(spark) -> DataFrame:
    """The 8-row persona dimension (fixed size, safe to broadcast)."""
    rows = [(i, s, PERSONAS[s]["description"], PERSONAS[s]["health"]) for i, s in enumerate(SEGMENTS)]
    return spark.createDataFrame(rows, "segment_order int, rfm_segment string, description string, health string")


def lookup_persona(df: DataFrame) -> DataFrame:
    """All 8 personas with their stats; empty segments get zeros."""
    # stats has one row per segment name of the closed 8-name set: broadcast
    personas = persona_table(df.sparkSession)
    filled = (
        personas.join(F.broadcast(persona_stats(df)), "rfm_segment", "left")
        .na.fill({"count": 0, "avg_spend": 0.0, "avg_recency": 0.0, "avg_frequency": 0.0})
    )
    total = F.sum("count").over(Window.partitionBy())
    return filled.withColumn("pct", F.when(total > 0, F.col("count") * 100.0 / total).otherwise(F.lit(0.0)))


def segment_stats(df: DataFrame) -> DataFrame:
    """Size and five means for every segment (all 8, zeros when empty) and
    every cluster (compared as text), in one frame keyed by (scope, segment)."""
    aggs = [
        F.count(F.lit(1)).alias("size"),
        F.avg("total_spend").alias("avg_spend"),
        F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("churn_flag").alias("churn_rate"),
        F.avg("clv_12m").alias("avg_clv"),
    ]
    by_seg = _keyed(df, "rfm_segment").groupBy(F.col("rfm_segment").alias("segment")).agg(*aggs)
    all_segs = persona_table(df.sparkSession).select(F.col("rfm_segment").alias("segment"))
    # by_seg: one row per name of the closed 8-name segment set
    by_seg = all_segs.join(F.broadcast(by_seg), "segment", "left").withColumn("scope", F.lit("rfm_segment"))
    by_cluster = (
        _keyed(df, "cluster_id")
        .groupBy(F.col("cluster_id").cast("string").alias("segment"))
        .agg(*aggs)
        .withColumn("scope", F.lit("cluster_id"))
    )
    zero = {"size": 0, "avg_spend": 0.0, "avg_recency": 0.0, "avg_frequency": 0.0, "churn_rate": 0.0, "avg_clv": 0.0}
    return by_seg.unionByName(by_cluster).na.fill(zero).select(
        "scope", "segment", "size", "avg_spend", "avg_recency", "avg_frequency", "churn_rate", "avg_clv"
    )


def scope_segment(df: DataFrame, segment: str, by: str = "rfm_segment") -> DataFrame:
    if by == "rfm_segment":
        return df.where(F.col("rfm_segment") == segment)
    return df.where(F.col(by).cast("string") == segment)


def executive_summary(df: DataFrame) -> DataFrame:
    """All figures from one aggregate by (segment, cluster): counts and exact
    sums of at most segments × clusters rows. Ties take the smallest key."""
    dec = lambda c: F.sum(F.col(c).cast("decimal(28,10)"))
    cells = df.groupBy("rfm_segment", "cluster_id").agg(
        F.count(F.lit(1)).alias("n"), dec("churn_flag").alias("churn"), F.count("churn_flag").alias("n_churn"),
        dec("clv_12m").alias("clv"), F.count("clv_12m").alias("n_clv"), dec("total_spend").alias("spend"),
    )
    sums = [F.sum(c).alias(c) for c in ("n", "churn", "n_churn", "clv", "n_clv", "spend")]
    # the aggregate has three groupings: all rows, by segment, by cluster
    level = cells.groupingSets([[], [F.col("rfm_segment")], [F.col("cluster_id")]], "rfm_segment", "cluster_id").agg(*sums, F.grouping_id().alias("level"))
    is_all, is_seg, is_clu = F.col("level") == 3, (F.col("level") == 1) & F.col("rfm_segment").isNotNull(), (F.col("level") == 2) & F.col("cluster_id").isNotNull()
    rate = F.col("churn").cast("double") / F.col("n_churn")
    top = lambda key, by, where: F.min_by(F.when(where, F.col(key)), F.when(where, F.struct(-by, F.col(key))))
    return level.agg(
        F.max(F.when(is_all, F.col("n"))).alias("total_customers"),
        F.max(F.when(is_all, rate * 100.0)).alias("churn_rate_pct"),
        F.max(F.when(is_all, F.col("clv").cast("double") / F.col("n_clv"))).alias("avg_clv"),
        top("rfm_segment", F.col("n"), is_seg).alias("top_segment"),
        top("cluster_id", F.col("spend"), is_clu).alias("top_cluster"),
        top("rfm_segment", rate, is_seg).alias("riskiest_segment"),
    )


# --------------------------------------------------------------------------- CLV
def clv_by_cluster_tier(df: DataFrame) -> DataFrame:
    return (
        _keyed(df, "cluster_id", "clv_tier")
        .groupBy("cluster_id", "clv_tier")
        .agg(F.avg("clv_12m").alias("clv_12m"))
        .orderBy("cluster_id", "clv_tier")
    )


def clv_treemap(df: DataFrame) -> DataFrame:
    """Σ CLV by tier → cluster with subtotals (ROLLUP) and the grouping level."""
    return (
        _keyed(df, "clv_tier", "cluster_id")
        .rollup("clv_tier", "cluster_id")
        .agg(F.sum("clv_12m").alias("clv_12m"), F.grouping_id().alias("level"))
    )


def clv_by_segment_cluster(df: DataFrame) -> DataFrame:
    return (
        _keyed(df, "rfm_segment", "cluster_id")
        .groupBy("rfm_segment", "cluster_id")
        .agg(F.avg("clv_12m").alias("clv_12m"))
    )


# --------------------------------------------------------------------------- KPIs
def _kpi_frame(df: DataFrame, pred: Column, specs: list[tuple[str, Column, Column]]) -> DataFrame:
    """One aggregate pass computing each KPI on the filtered rows (FILTER
    aggregates) and on all rows; long output (kpi, value, baseline, delta)."""
    aggs = []
    for name, filtered, baseline in specs:
        aggs += [filtered.alias(f"{name}__v"), baseline.alias(f"{name}__b")]
    return _kpi_rows(df.agg(*aggs), [n for n, _, _ in specs])


def _kpi_rows(one: DataFrame, names: list[str]) -> DataFrame:
    """(kpi, value, baseline, delta, delta_color) from the row of
    ``<name>__v`` and ``<name>__b``."""
    items = ", ".join(f"'{n}', CAST(`{n}__v` AS DOUBLE), CAST(`{n}__b` AS DOUBLE)" for n in names)
    stacked = F.expr(f"stack({len(names)}, {items}) AS (kpi, value, baseline)")
    return one.select(stacked).withColumns(
        {
            "delta": delta_text(F.col("value"), F.col("baseline")),
            "delta_color": delta_color(F.col("value"), F.col("baseline")),
        }
    )


def mean(c: Column | str) -> Column:
    """Mean from an exact decimal sum, so that it does not depend on the order
    of the rows and equal sets of rows have equal means."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(28,10)")).cast("double") / F.count(c)


def _f(pred: Column, c: Column) -> Column:
    return F.when(pred, c)


def kpi_home(df: DataFrame, pred: Column) -> DataFrame:
    return _kpi_frame(
        df,
        pred,
        [
            ("customers", F.count_if(pred), F.count(F.lit(1))),
            ("active_segments", F.count_distinct(_f(pred, F.col("rfm_segment"))), F.count_distinct("rfm_segment")),
            ("avg_clv", mean(_f(pred, F.col("clv_12m"))), mean("clv_12m")),
            ("churn_rate", mean(_f(pred, F.col("churn_flag"))), mean("churn_flag")),
        ],
    )


def kpi_overview(df: DataFrame, pred: Column) -> DataFrame:
    return _kpi_frame(
        df,
        pred,
        [
            ("total_customers", F.count_if(pred), F.count(F.lit(1))),
            ("avg_clv", mean(_f(pred, F.col("clv_12m"))), mean("clv_12m")),
            ("churn_rate", mean(_f(pred, F.col("churn_flag"))), mean("churn_flag")),
            ("avg_satisfaction", mean(_f(pred, F.col("satisfaction_score"))), mean("satisfaction_score")),
        ],
    )


def kpi_rfm(df: DataFrame, pred: Column) -> DataFrame:
    """One scan: sums and counts per segment, all figures from those rows."""
    cols = {"avg_recency": "recency", "avg_frequency": "frequency", "avg_monetary": "monetary"}
    aggs = [F.count_if(pred).alias("n_v"), F.count(F.lit(1)).alias("n_b")]
    for name, c in cols.items():
        for tag, x in (("v", _f(pred, F.col(c))), ("b", F.col(c))):
            aggs += [F.sum(x.cast("decimal(28,10)")).alias(f"{name}__s{tag}"), F.count(x).alias(f"{name}__n{tag}")]
    by_segment = df.groupBy("rfm_segment").agg(*aggs)
    keyed = F.col("rfm_segment").isNotNull()
    whole = []
    for name in cols:
        whole += [(F.sum(f"{name}__s{t}").cast("double") / F.sum(f"{name}__n{t}")).alias(f"{name}__{t}") for t in "vb"]
    whole += [(F.max(F.when(keyed, F.col(f"n_{t}"))) / F.sum(F.when(keyed, F.col(f"n_{t}")))).alias(f"top_segment_share__{t}") for t in "vb"]
    return _kpi_rows(by_segment.agg(*whole), [*cols, "top_segment_share"])


def kpi_churn(df: DataFrame, pred: Column) -> DataFrame:
    high = F.col("churn_probability") >= HIGH_RISK_PROBABILITY
    return _kpi_frame(
        df,
        pred,
        [
            ("churn_rate", mean(_f(pred, F.col("churn_flag"))), mean("churn_flag")),
            ("avg_churn_probability", mean(_f(pred, F.col("churn_probability"))), mean("churn_probability")),
            ("high_risk_customers", F.count_if(pred & high), F.count_if(high)),
        ],
    )


def kpi_clv(df: DataFrame, pred: Column) -> DataFrame:
    plat = (F.col("clv_tier") == "Platinum").cast("double")
    return _kpi_frame(
        df,
        pred,
        [
            ("avg_clv", mean(_f(pred, F.col("clv_12m"))), mean("clv_12m")),
            ("platinum_share", mean(_f(pred, plat)), mean(plat)),
            (
                "clv_growth",
                mean(_f(pred, F.col("clv_12m"))) / mean(_f(pred, F.col("historical_clv"))) - 1,
                mean("clv_12m") / mean("historical_clv") - 1,
            ),
            ("top_clv", F.max(_f(pred, F.col("clv_12m"))), F.max("clv_12m")),
        ],
    )


def kpi_persona(df: DataFrame, pred: Column) -> DataFrame:
    healthy = F.col("rfm_segment").isin(HEALTHY_SEGMENTS).cast("double")
    return _kpi_frame(
        df,
        pred,
        [
            ("segments_covered", F.count_distinct(_f(pred, F.col("rfm_segment"))), F.count_distinct("rfm_segment")),
            ("avg_spend", mean(_f(pred, F.col("total_spend"))), mean("total_spend")),
            ("avg_recency", mean(_f(pred, F.col("recency"))), mean("recency")),
            ("healthy_share", mean(_f(pred, healthy)), mean(healthy)),
        ],
    )


def kpi_analyst(df: DataFrame, pred: Column) -> DataFrame:
    return _kpi_frame(
        df,
        pred,
        [
            ("customers", F.count_if(pred), F.count(F.lit(1))),
            ("avg_clv", mean(_f(pred, F.col("clv_12m"))), mean("clv_12m")),
            ("churn_rate", mean(_f(pred, F.col("churn_flag"))), mean("churn_flag")),
            ("avg_recency", mean(_f(pred, F.col("recency"))), mean("recency")),
        ],
    )
