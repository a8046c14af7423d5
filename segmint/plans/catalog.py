"""Registered queries: name -> fn(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or frames Spark derives from them)
over whole tables. SQL-checkable summaries run on ``base.labelled`` — scored
customers with rule-fixed labels — so model noise cannot enter a check.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as CF
from ..functions import formatting as FM
from ..operators import churn as CHN
from ..operators import clustering as CL
from ..operators import enrich as EN
from ..operators import evaluate as EV
from ..operators import filters as FL
from ..operators import quality as Q
from ..operators import strategy as ST
from ..operators import summaries as S
from ..operators.cluster_metrics import cluster_metrics as _metrics, metrics_of as _metrics_of
from . import base
from . import density as DN
from . import ingest as IN
from . import models as MD

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --------------------------------------------------------------------------- sources
@query
def customer_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.snapshot(spark, sf_dir).select(
        "customer_id", "ingest_seq", F.date_format("last_purchase_date", "yyyy-MM-dd").alias("last_purchase_date"),
        F.date_format("signup_date", "yyyy-MM-dd").alias("signup_date"), "total_orders", "total_spend", "country",
        "channel", "satisfaction_score", "support_tickets_raised", "loyalty_points",
    )


# --------------------------------------------------------------------------- RFM
@query
def rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.scored(spark, sf_dir).select(
        "customer_id", "recency", "frequency", "monetary", "r_score", "f_score", "m_score", "rfm_score", "rfm_segment"
    )


@query
def revenue_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.revenue_by_segment(base.scored(spark, sf_dir))


# --------------------------------------------------------------------------- shared filter
# The registered KPI / filter queries use one fixed selection: clusters 0, 1, 2.
FILTER_CLUSTERS = (0, 1, 2)


def _pred():
    return F.col("cluster_id").isin(list(FILTER_CLUSTERS))


def _lab(spark, sf_dir):
    return base.labelled(spark, sf_dir)


# --------------------------------------------------------------------------- counts & summaries
@query
def segment_counts(spark, sf_dir):
    return S.segment_counts(_lab(spark, sf_dir))


@query
def country_counts(spark, sf_dir):
    return S.country_counts(_lab(spark, sf_dir))


@query
def segment_share(spark, sf_dir):
    return S.segment_share(_lab(spark, sf_dir))


@query
def monthly_signups(spark, sf_dir):
    m = S.monthly_signups(_lab(spark, sf_dir))
    return m.select(F.date_format("month_end", "yyyy-MM-dd").alias("month_end"), "signups")


@query
def spend_satisfaction_pivot(spark, sf_dir):
    return S.spend_satisfaction_pivot(_lab(spark, sf_dir))


@query
def score_histogram(spark, sf_dir):
    return S.score_histogram(_lab(spark, sf_dir))


@query
def probability_histogram(spark, sf_dir):
    return S.probability_histogram(_lab(spark, sf_dir))


@query
def cluster_profile(spark, sf_dir):
    return S.cluster_profile(_lab(spark, sf_dir))


@query
def cluster_stats(spark, sf_dir):
    from ..functions.constants import CLUSTER_NUMERIC_FEATURES, CLUSTER_OPTIONAL_NUMERIC

    return S.cluster_stats(_lab(spark, sf_dir), CLUSTER_NUMERIC_FEATURES + CLUSTER_OPTIONAL_NUMERIC)


@query
def top_clusters_8(spark, sf_dir):
    return S.top_clusters(_lab(spark, sf_dir), 8)


@query
def radar_profile(spark, sf_dir):
    return S.radar_profile(_lab(spark, sf_dir))


@query
def cluster_churn_gauge(spark, sf_dir):
    return S.cluster_churn_gauge(_lab(spark, sf_dir))


@query
def segment_churn_summary(spark, sf_dir):
    return S.segment_churn_summary(_lab(spark, sf_dir))


@query
def persona_stats(spark, sf_dir):
    return S.persona_stats(_lab(spark, sf_dir))


@query
def lookup_persona(spark, sf_dir):
    return S.lookup_persona(_lab(spark, sf_dir))


@query
def segment_stats(spark, sf_dir):
    return S.segment_stats(_lab(spark, sf_dir))


@query
def executive_summary(spark, sf_dir):
    return S.executive_summary(_lab(spark, sf_dir))


@query
def clv_by_cluster_tier(spark, sf_dir):
    return S.clv_by_cluster_tier(_lab(spark, sf_dir))


@query
def clv_treemap(spark, sf_dir):
    return S.clv_treemap(_lab(spark, sf_dir))


@query
def clv_by_segment_cluster(spark, sf_dir):
    return S.clv_by_segment_cluster(_lab(spark, sf_dir))


# --------------------------------------------------------------------------- KPIs
@query
def kpi_home(spark, sf_dir):
    return S.kpi_home(_lab(spark, sf_dir), _pred())


@query
def kpi_overview(spark, sf_dir):
    return S.kpi_overview(_lab(spark, sf_dir), _pred())


@query
def kpi_rfm(spark, sf_dir):
    return S.kpi_rfm(_lab(spark, sf_dir), _pred())


@query
def kpi_churn(spark, sf_dir):
    return S.kpi_churn(_lab(spark, sf_dir), _pred())


@query
def kpi_clv(spark, sf_dir):
    return S.kpi_clv(_lab(spark, sf_dir), _pred())


@query
def kpi_persona(spark, sf_dir):
    return S.kpi_persona(_lab(spark, sf_dir), _pred())


@query
def kpi_analyst(spark, sf_dir):
    return S.kpi_analyst(_lab(spark, sf_dir), _pred())


# --------------------------------------------------------------------------- filters

SEARCH_PATTERN = "ion_1[0-4]"
COUNTRY_PICK = ("NATION_1", "NATION_7", "NATION_13")
SEGMENT_PICK = ("Champions", "At Risk")
DATE_LO, DATE_HI = "1996-01-01", "1998-12-31"
BUDGET = 50000.0


@query
def filter_facets(spark, sf_dir):
    return FL.filter_facets(_lab(spark, sf_dir))


@query
def filter_date_range(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    return lab.where(FL.date_range_predicate(lab, DATE_LO, DATE_HI)).select(
        "customer_id", F.date_format("signup_date", "yyyy-MM-dd").alias("signup_date")
    )


@query
def filter_isin(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    spec = FL.FilterSpec(countries=COUNTRY_PICK, clusters=FILTER_CLUSTERS)
    return FL.apply_filters(lab, spec).select("customer_id", "country", "cluster_id")


@query
def filter_segments(spark, sf_dir):
    return FL.filter_segments(_lab(spark, sf_dir), SEGMENT_PICK).select("customer_id", "rfm_segment")


@query
def search_customers(spark, sf_dir):
    return FL.search_customers(_lab(spark, sf_dir), SEARCH_PATTERN).select("customer_id", "city", "country")


@query
def scope_segment(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    a = S.scope_segment(lab, "Champions").select("customer_id", F.lit("rfm_segment").alias("scope"))
    b = S.scope_segment(lab, "2", by="cluster_id").select("customer_id", F.lit("cluster_id").alias("scope"))
    return a.unionByName(b)


# --------------------------------------------------------------------------- sorts / top-k
@query
def segment_explorer(spark, sf_dir):
    return (
        _lab(spark, sf_dir)
        .orderBy(F.col("rfm_score").desc(), F.col("customer_id"))
        .select("customer_id", "rfm_segment", "r_score", "f_score", "m_score", "rfm_score", "total_spend", "total_orders")
    )


def _top_risk(spark, sf_dir, n):
    return (
        _lab(spark, sf_dir)
        .orderBy(F.col("churn_probability").desc_nulls_last(), F.col("customer_id"))
        .limit(n)
        .select("customer_id", "rfm_segment", "cluster_id", "churn_probability", "total_spend", "satisfaction_score")
    )


@query
def top_risk_100(spark, sf_dir):
    return _top_risk(spark, sf_dir, 100)


@query
def top_risk_50(spark, sf_dir):
    return _top_risk(spark, sf_dir, 50)


@query
def top_clv_20(spark, sf_dir):
    return (
        _lab(spark, sf_dir)
        .orderBy(F.col("clv_12m").desc_nulls_last(), F.col("customer_id"))
        .limit(20)
        .select("customer_id", "clv_12m", "clv_tier", "total_spend", "total_orders", "rfm_segment")
    )


# --------------------------------------------------------------------------- strategy
def _strategies(spark, sf_dir):
    return ST.strategy_table(_lab(spark, sf_dir))


@query
def strategy_base(spark, sf_dir):
    return ST.strategy_base(_lab(spark, sf_dir))


@query
def strategy_table(spark, sf_dir):
    return _strategies(spark, sf_dir)


@query
def strategy_table_filtered(spark, sf_dir):
    """The strategy table of the filtered customers: counts, means and medians
    all come from the filtered rows."""
    return ST.strategy_table(_lab(spark, sf_dir).where(F.col("country").isin("NATION_1", "NATION_7", "NATION_13") & _pred()))


@query
def lookup_profile(spark, sf_dir):
    return ST.lookup_profile(ST.strategy_base(_lab(spark, sf_dir))).select(
        "rfm_segment", "cluster_id", *ST.PROFILE_FIELDS
    )


@query
def primary_strategy(spark, sf_dir):
    return ST.primary_strategy(_strategies(spark, sf_dir))


@query
def budget_allocation(spark, sf_dir):
    return ST.budget_allocation(_strategies(spark, sf_dir), BUDGET)


@query
def allocation_sorted(spark, sf_dir):
    return ST.allocation_sorted(ST.budget_allocation(_strategies(spark, sf_dir), BUDGET))


@query
def revenue_lift(spark, sf_dir):
    return ST.revenue_lift(_strategies(spark, sf_dir), _lab(spark, sf_dir), BUDGET)


@query
def kpi_strategy(spark, sf_dir):
    return ST.kpi_strategy(_lab(spark, sf_dir), _strategies(spark, sf_dir))


# --------------------------------------------------------------------------- ranks / flows
@query
def rank_first(spark, sf_dir):
    from ..operators.ranking import global_row_number

    sc = base.scored(spark, sf_dir).select("customer_id", "recency", "ingest_seq")
    return global_row_number(sc, ["recency", "ingest_seq"], "rank").drop("ingest_seq")


@query
def rfm_base(spark, sf_dir):
    return base.scored(spark, sf_dir).select("customer_id", "recency", "frequency", "monetary")


def _flow(spark, sf_dir):
    from ..operators.rfm import rfm as rfm_op

    lab = _lab(spark, sf_dir)
    filt = lab.where(_pred())
    shifted = filt.select(
        "customer_id",
        "ingest_seq",
        (F.col("last_purchase_date") - F.expr("INTERVAL 30 DAYS")).alias("last_purchase_date"),
        "total_orders",
        "total_spend",
        F.col("rfm_segment").alias("target"),
    )
    prev = rfm_op(shifted, base.as_of(spark, sf_dir))
    # the re-scoring is a projection of the same rows, so the two scorings
    # are aligned without a join
    return prev.groupBy(F.col("rfm_segment").alias("source"), "target").agg(F.count(F.lit(1)).alias("value"))


@query
def rfm_flow(spark, sf_dir):
    return _flow(spark, sf_dir)


@query
def node_labels(spark, sf_dir):
    f = _flow(spark, sf_dir)
    return f.select(F.col("source").alias("label")).union(f.select(F.col("target").alias("label"))).distinct().orderBy("label")


@query
def rfm_migration(spark, sf_dir):
    from ..operators.enrich import enrich as enrich_op
    from ..operators.rfm import rfm as rfm_op

    # both snapshots come from one pass over the fact tables
    snap_prior, snap_now, prior_at = base.snapshot_pair(spark, sf_dir, 30)
    at = base.as_of(spark, sf_dir)
    # each side is scored over the customers that had an order by then; who
    # had none at the first instant comes from "No orders yet"
    ordered = F.col("total_orders") > 0
    prior = rfm_op(enrich_op(snap_prior.where(ordered), prior_at, dedup=False), prior_at)
    current = rfm_op(enrich_op(snap_now.where(ordered), at, dedup=False), at)
    return (
        current.select("customer_id", F.col("rfm_segment").alias("target"))
        .join(prior.select("customer_id", F.col("rfm_segment").alias("source")), "customer_id", "left")
        .groupBy(F.coalesce("source", F.lit("No orders yet")).alias("source"), "target")
        .agg(F.count(F.lit(1)).alias("value"))
    )


# --------------------------------------------------------------------------- scalar functions
@query
def fmt_number(spark, sf_dir):
    r = S.revenue_by_segment(_lab(spark, sf_dir))
    return r.select("rfm_segment", "total_spend", FM.fmt_number(F.col("total_spend")).alias("display"))


@query
def bin_risk_band(spark, sf_dir):
    return _lab(spark, sf_dir).select("customer_id", "churn_probability", FM.risk_band(F.col("churn_probability")).alias("risk_band"))


@query
def clv_tier(spark, sf_dir):
    return _lab(spark, sf_dir).select("customer_id", "historical_clv", "clv_12m", "clv_tier")


@query
def date_shift(spark, sf_dir):
    return _lab(spark, sf_dir).select(
        "customer_id", F.date_format(F.col("last_purchase_date") - F.expr("INTERVAL 30 DAYS"), "yyyy-MM-dd").alias("shifted")
    )


@query
def round_bucket(spark, sf_dir):
    return _lab(spark, sf_dir).select("customer_id", FM.round_bucket(F.col("satisfaction_score")).alias("satisfaction_bucket"))


@query
def chart_projection(spark, sf_dir):
    return _lab(spark, sf_dir).select(
        "customer_id", "recency", "frequency", "monetary", "rfm_segment", "clv_12m", "churn_probability", "total_orders", "cluster_id"
    )


@query
def preview_head(spark, sf_dir):
    """The first ten rows of the mapped upload, all columns."""
    return IN.uploaded_file(spark, sf_dir).orderBy("ingest_seq").limit(10)


# --------------------------------------------------------------------------- upload path


@query
def enrich(spark, sf_dir):
    e = IN.upload_enriched(spark, sf_dir)
    whole = ["total_orders", "support_tickets_raised", "loyalty_points", "days_since_last_purchase"]
    e = e.withColumns({c: F.col(c).cast("double") for c in whole}).withColumn("customer_id", F.col("customer_id").cast("string"))
    return e.select(
        "customer_id",
        F.date_format("last_purchase_date", "yyyy-MM-dd").alias("last_purchase_date"),
        F.date_format("signup_date", "yyyy-MM-dd").alias("signup_date"),
        "total_orders", "total_spend", "satisfaction_score", "country", "channel", "support_tickets_raised",
        "loyalty_points", "days_since_last_purchase", "avg_order_value", "churn_flag", "age", "gender", "city",
        "referral_count",
    )


@query
def validation_report(spark, sf_dir):
    return Q.validation_report(IN.uploaded_file(spark, sf_dir))


@query
def null_summary(spark, sf_dir):
    return Q.null_summary(IN.uploaded_file(spark, sf_dir))


@query
def type_issues(spark, sf_dir):
    return Q.type_issues(IN.uploaded_file(spark, sf_dir))


@query
def scan_active(spark, sf_dir):
    from ..sources.files import scan_active as choose

    c = choose(None, base.customers(spark, sf_dir))
    days = F.col("days_since_last_purchase").cast("double").alias("days_since_last_purchase")
    return c.select("customer_id", "total_orders", "total_spend", days, "avg_order_value", "churn_flag")


@query
def dedup_keep_last(spark, sf_dir):
    from ..sources.tables import table

    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return EN.dedup_keep_last(ev, key="user_id", order="event_id")


@query
def clean_currency(spark, sf_dir):
    from ..sources.tables import table

    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("amount")
    )
    return o.select("o_orderkey", CF.clean_currency(o, "amount").alias("amount"))


@query
def parse_dates(spark, sf_dir):
    from ..sources.tables import table

    o = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
        .alias("text"),
    )
    return o.select("o_orderkey", F.date_format(CF.parse_dates(o, "text"), "yyyy-MM-dd").alias("parsed"))


@query
def coerce_numeric(spark, sf_dir):
    from ..sources.tables import table

    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("string")
    text = (
        F.when(F.col("l_linenumber") % 4 == 0, q)
        .when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("  "), q, F.lit(" ")))
        .when(F.col("l_linenumber") % 4 == 2, F.concat(q, F.lit("d")))
        .otherwise(F.lit("n/a"))
    )
    t = li.select("l_orderkey", "l_linenumber", text.alias("text"))
    return t.select("l_orderkey", "l_linenumber", CF.to_numeric(t, "text").alias("quantity"))


# --------------------------------------------------------------------------- ML: features, clustering, metrics


@query
def feature_zscores(spark, sf_dir):
    from ..operators.features import select_features, zscore_columns

    sc = base.scored(spark, sf_dir)
    z = zscore_columns(sc, select_features(sc).numeric)
    return sc.select("customer_id", *[e.alias(f"z_{c}") for c, e in z.items()])


@query
def cluster_metrics(spark, sf_dir):
    from ..sources.tables import table

    emb = table(spark, sf_dir, "embeddings")
    m = _metrics(emb, "embedding", "label", "vec_id")
    return spark.createDataFrame(
        [(m.silhouette, m.davies_bouldin, m.calinski_harabasz, m.n_clusters)],
        "silhouette double, davies_bouldin double, calinski_harabasz double, n_clusters int",
    )


@query
def silhouette_euclidean(spark, sf_dir):
    """The silhouette of every embedding over plain Euclidean distances,
    exactly, under its own label."""
    from ..operators.cluster_metrics import labelled_points
    from ..operators.silhouette import silhouette_samples
    from ..sources.tables import table

    points = base.materialize(labelled_points(table(spark, sf_dir, "embeddings"), "embedding", {"label": "label"}, "vec_id"))
    return silhouette_samples(points).select(F.col("pid").alias("vec_id"), "label", "silhouette")


@query
def cluster_metrics_many(spark, sf_dir):
    """The cluster metrics with a cluster for every five embeddings, so that
    the number of clusters grows with the table."""
    from ..sources.tables import table

    m = _metrics_of(table(spark, sf_dir, "embeddings"), "embedding", {"fives": F.expr("vec_id div 5")}, "vec_id", euclidean=True)["fives"]
    return spark.createDataFrame(
        [(m.silhouette, m.davies_bouldin, m.calinski_harabasz, m.n_clusters)],
        "silhouette double, davies_bouldin double, calinski_harabasz double, n_clusters int",
    )


@query
def count_clusters(spark, sf_dir):
    from ..operators.cluster_metrics import count_clusters as cc
    from ..sources.tables import table

    return table(spark, sf_dir, "embeddings").agg(cc(None, "label").alias("n_clusters"))


@query
def minmax_normalize(spark, sf_dir):
    prof = S.cluster_profile(_lab(spark, sf_dir))
    out = CL.minmax_normalize(prof, "total_spend", "spend_norm", higher_better=True)
    out = CL.minmax_normalize(out, "recency", "recency_norm", higher_better=False)
    return out.select("cluster_id", "spend_norm", "recency_norm")


@query
def kmeans_sweep(spark, sf_dir):
    return CL.sweep_frame(spark, MD.kmeans(spark, sf_dir))


#: K-means with fixed starts: numbers of clusters and steps.
FIXED_KS, FIXED_STEPS = (2, 3, 5), 3


@query
def kmeans_fixed_steps(spark, sf_dir):
    """Three steps of K-means on ``embeddings`` for several k at once, from
    the vectors with the smallest ids as starts: size of every cluster and
    inertia under the last centres."""
    from ..operators.kmeans import Balls, Run

    points = base.materialize(DN.embedding_points(spark, sf_dir))
    first = np.array([r["x"] for r in points.orderBy("pid").limit(max(FIXED_KS)).collect()])
    balls = Balls(points)
    runs = balls.fit([Run(k, 0, first[:k].copy()) for k in FIXED_KS], FIXED_STEPS)
    labels = balls.labels({f"k{r.k}": r for r in runs})
    each = F.explode(F.array(*[F.struct(F.lit(r.k).alias("k"), F.col(f"k{r.k}").alias("c"), F.lit(r.cost).alias("inertia")) for r in runs]))
    return labels.select(each.alias("l")).groupBy("l.k", F.col("l.c").alias("cluster"), "l.inertia").agg(F.count(F.lit(1)).alias("n"))


@query
def kmeans_select(spark, sf_dir):
    sw = MD.kmeans(spark, sf_dir)
    return CL.sweep_frame(spark, sw).where(F.col("k") == sw.best.k)


@query
def kmeans_labels(spark, sf_dir):
    return MD.kmeans(spark, sf_dir).labels.select("customer_id", "kmeans_label")


@query
def ward_hierarchical(spark, sf_dir):
    runs, best, labels = MD.ward(spark, sf_dir)
    return labels.select("customer_id", "hierarchical_label")


@query
def algorithm_comparison(spark, sf_dir):
    return MD.comparison(spark, sf_dir)


def _kpi_clustering(comp, algorithm: str | None):
    """The KPIs of one algorithm (default: the winner) against the best of all,
    from the three rows of the comparison."""
    whole = Window.partitionBy()
    out = comp.withColumns({
        "best_score": F.max("score").over(whole), "max_clusters": F.max("n_clusters").over(whole),
        "best_silhouette": F.max("silhouette").over(whole), "best_davies_bouldin": F.min("davies_bouldin").over(whole),
    })
    chosen = F.col("is_best") if algorithm is None else F.col("algorithm") == algorithm
    return out.where(chosen).select(
        "algorithm", "score", "n_clusters", "silhouette", "davies_bouldin",
        "best_score", "max_clusters", "best_silhouette", "best_davies_bouldin",
    )


@query
def kpi_clustering(spark, sf_dir, algorithm=None):
    return _kpi_clustering(MD.comparison(spark, sf_dir), algorithm)


@query
def clustering_labels(spark, sf_dir):
    """The labels of all three algorithms and ``cluster_id`` of the winner."""
    return MD.clustered(spark, sf_dir).select("customer_id", "kmeans_label", "dbscan_label", "hierarchical_label", "cluster_id")


@query
def choose_algorithm_labels(spark, sf_dir, algorithm="Hierarchical"):
    """Replace ``cluster_id`` by another algorithm's labels and refit the CLV
    model on them, as choosing an algorithm does."""
    scored = MD.refitted_clv(spark, sf_dir, algorithm)
    return scored.select("customer_id", "cluster_id", "rfm_segment", "clv_12m", "clv_tier")


@query
def pca_2d_3d(spark, sf_dir):
    fm, _ = MD.features(spark, sf_dir)
    out, ratios = CL.pca_projection(fm.select("customer_id", "features"))
    return out.select("customer_id", "pca_x", "pca_y", "pca_z")


# --------------------------------------------------------------------------- ML: churn and CLV
@query
def stratified_split(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    s = CHN.stratified_split(lab, "churn_flag")
    return s.groupBy("churn_flag", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query
def random_split(spark, sf_dir):
    from ..operators.clv import random_split_flag

    return random_split_flag(_lab(spark, sf_dir)).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


@query
def balanced_class_weight(spark, sf_dir):
    w = CHN.balanced_weights(_lab(spark, sf_dir), "churn_flag")
    return w.groupBy("churn_flag").agg(F.count(F.lit(1)).alias("n"), F.first("class_weight").alias("class_weight"))


@query
def classification_report(spark, sf_dir):
    lab = _lab(spark, sf_dir).select(
        F.col("churn_flag").alias("label"), (F.col("churn_probability") >= 0.5).cast("int").alias("prediction")
    )
    return EV.classification_report(lab)


@query
def roc_curve(spark, sf_dir):
    lab = _lab(spark, sf_dir).select(F.col("churn_flag").alias("label"), F.col("churn_probability").alias("score"))
    return EV.roc_curve(lab)


@query
def roc_auc(spark, sf_dir):
    lab = _lab(spark, sf_dir).select(F.col("churn_flag").alias("label"), F.col("churn_probability").alias("score"))
    return EV.roc_auc(lab)


@query
def clv_target(spark, sf_dir):
    from ..operators.clv import clv_target as target, historical_clv

    return target(historical_clv(base.scored(spark, sf_dir))).select("customer_id", "historical_clv", "clv_target")


@query
def clv_model(spark, sf_dir):
    scored, model, rmse = MD.clv(spark, sf_dir)
    return scored.select("customer_id", "cluster_id", "historical_clv", "clv_12m", "clv_tier")


@query
def churn_model(spark, sf_dir):
    return MD.churn(spark, sf_dir).scored.select("customer_id", "churn_flag", "churn_probability")


@query
def churn_holdout_auc(spark, sf_dir):
    return EV.roc_auc(MD.churn(spark, sf_dir).test)


@query
def feature_importance(spark, sf_dir):
    return CHN.importance_frame(spark, MD.churn(spark, sf_dir).feature_importance)


@query
def importance_sorted(spark, sf_dir):
    return feature_importance(spark, sf_dir).orderBy(F.col("importance").desc(), F.col("feature"))


@query
def scenario_scoring(spark, sf_dir):
    """What-if per segment: the segment's mean recency, satisfaction and
    tickets over the population medians, scored by the churn model."""
    res = MD.churn(spark, sf_dir)
    cust = res.scored
    scen = cust.groupBy("rfm_segment").agg(
        F.avg("recency").alias("recency"),
        F.avg("satisfaction_score").alias("satisfaction_score"),
        F.avg("support_tickets_raised").alias("support_tickets_raised"),
    )
    inputs = CHN.scenario_inputs(cust, scen)
    return CHN.score_scenarios(res, inputs).select(
        "rfm_segment", "recency", "satisfaction_score", "support_tickets_raised", "churn_probability"
    )


# --------------------------------------------------------------------------- density


@query
def kdistance_eps(spark, sf_dir):
    """ε candidates on ``embeddings``: exact 5th-neighbour distances (self
    counted), percentiles 70..95, rounded to 4 places, distinct."""
    eps = DN.eps_for(DN.embedding_points(spark, sf_dir))
    return spark.createDataFrame([(float(e),) for e in eps], "eps double")


@query
def kdistance(spark, sf_dir):
    from ..operators.density import kth_neighbor_distance

    return kth_neighbor_distance(DN.embedding_points(spark, sf_dir), k=5).select(F.col("pid").alias("vec_id"), "kd")


@query
def dbscan(spark, sf_dir):
    ch = DN.dbscan_best(spark, sf_dir)
    pts = DN.customer_points(spark, sf_dir)
    return pts.join(ch.labels, "pid").select("customer_id", "dbscan_label")


@query
def dbscan_sweep(spark, sf_dir):
    ch = DN.dbscan_best(spark, sf_dir)
    return spark.createDataFrame(
        [(float(e), int(k), int(nz), s) for e, k, nz, s in ch.history],
        "eps double, n_clusters int, n_noise int, silhouette double",
    )


# --------------------------------------------------------------------------- streaming, CSV source and sink
@query
def snapshot_stream(spark, sf_dir):
    """Per-customer order aggregates maintained by a streaming query."""
    from ..streaming.snapshot_stream import run_order_aggregates

    agg = run_order_aggregates(spark, sf_dir, "orders.parquet")
    return agg.select(
        "o_custkey", "total_orders", "total_spend",
        F.date_format("last_purchase_date", "yyyy-MM-dd").alias("last_purchase_date"),
        F.date_format("signup_date", "yyyy-MM-dd").alias("signup_date"),
    )


@query
def scan_csv(spark, sf_dir):
    """The CRM-style export written as CSV, scanned back and typed (ids shown
    as text)."""
    up = IN.uploaded_file(spark, sf_dir)
    return up.select(F.col("customer_id").cast("string").alias("customer_id"), F.col("total_orders").cast("bigint").alias("total_orders"), "total_spend", "ingest_seq")


@query
def sink_rows_csv(spark, sf_dir):
    """The nation rows written as CSV, scanned back and typed."""
    from ..session import scratch_path
    from ..sources.files import infer_numeric, scan_csv as scan, write_csv
    from ..sources.tables import table

    path = write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), scratch_path(spark, "nation_csv"))
    return infer_numeric(scan(spark, path)).drop("ingest_seq")


@query
def auto_map_columns(spark, sf_dir):
    """The columns of all given tables mapped onto the standard names."""
    from ..operators.schema_map import auto_map_catalog, columns_catalog
    from ..sources.tables import TABLES, table

    catalog = columns_catalog(spark, {t: table(spark, sf_dir, t) for t in TABLES})
    return auto_map_catalog(catalog).select("source", "column", "standard")


@query
def mapping_status(spark, sf_dir):
    """Status of each column when every unmapped one is skipped."""
    from ..functions.constants import SKIP_OPTION
    from ..operators.schema_map import mapping_status as status

    mapped = auto_map_columns(spark, sf_dir)
    return mapped.withColumn("status", status(F.coalesce("standard", F.lit(SKIP_OPTION)), F.col("standard")))


@query
def sink_segment_csv(spark, sf_dir):
    """One segment written as CSV (the segment download) and read back."""
    from ..session import scratch_path
    from ..sources.files import scan_csv as scan, sink_segment_csv as sink

    seg = FL.filter_segments(_lab(spark, sf_dir), ["Champions"]).select(
        "customer_id", "rfm_segment", "rfm_score", "total_spend", "total_orders"
    )
    path = scratch_path(spark, "segment_csv")
    sink(seg, path)
    back = scan(spark, path)
    return back.select(
        "customer_id", "rfm_segment", F.col("rfm_score").cast("int").alias("rfm_score"),
        F.col("total_spend").cast("double").alias("total_spend"), F.col("total_orders").cast("bigint").alias("total_orders"),
    )


@query
def overview_models(spark, sf_dir):
    """Overview KPIs with model outputs: K-means clusters, boosted-tree CLV
    and the churn forest's labels (rows-only check: model numbers)."""
    scored, _, _ = MD.clv(spark, sf_dir)
    return S.kpi_home(scored, F.col("cluster_id").isin(list(FILTER_CLUSTERS)))


@query
def dbscan_embeddings(spark, sf_dir):
    """Exact DBSCAN on ``embeddings`` at ε = the 30th percentile of the
    5th-neighbour distance (4 places): several clusters, border points and
    noise, so the check exercises every rule."""
    from ..operators.density import dbscan as run, eps_candidates, kth_neighbor_distance

    pts = base.materialize(DN.embedding_points(spark, sf_dir))
    eps = eps_candidates(kth_neighbor_distance(pts, 5), [30])[0]
    return run(pts, eps, 5).labels.select(F.col("pid").alias("vec_id"), "dbscan_label")


# --------------------------------------------------------------------------- model selection on fixed labelings
FIXED_LABELINGS = [("label", "label"), ("label_mod3", "label % 3"), ("vec_mod4", "vec_id % 4")]


def _fixed_metrics(spark, sf_dir):
    from ..sources.tables import table

    emb = table(spark, sf_dir, "embeddings")
    return list(_metrics_of(emb, "embedding", {name: F.expr(expr) for name, expr in FIXED_LABELINGS}, "vec_id").items())


@query
def algorithm_comparison_fixed(spark, sf_dir):
    """The comparison rule (0.5 silhouette + 0.25 DB + 0.25 CH, min-max
    normalised, first maximum) over three fixed labelings of ``embeddings``."""
    return CL.algorithm_comparison(spark, _fixed_metrics(spark, sf_dir)).drop("position")


@query
def kmeans_select_fixed(spark, sf_dir):
    """The K-means selection rule (0.45 silhouette + 0.2 CH + 0.2 DB + 0.15
    inertia) over three fixed labelings of ``embeddings``."""
    cands = [(n, m, m.inertia) for n, m in _fixed_metrics(spark, sf_dir)]
    scores = CL.selection_scores(spark, cands)
    best = max(range(len(scores)), key=lambda i: scores[i])
    rows = [(n, m.n_clusters, m.inertia, scores[i], i == best) for i, (n, m, _) in enumerate(cands)]
    return spark.createDataFrame(rows, "labeling string, n_clusters int, inertia double, score double, is_best boolean")


@query
def pca_explained_variance(spark, sf_dir):
    """Explained-variance ratio of the 3 principal components (the 2-D
    view's ratios are the first two)."""
    fm, _ = MD.features(spark, sf_dir)
    _, ratios = CL.pca_projection(fm.select("customer_id", "features"))
    return spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(ratios)], "component int, ratio double")


@query
def clv_holdout_rmse(spark, sf_dir):
    """Hold-out RMSE of the CLV model (the reference makes the split but
    never evaluates it)."""
    _, _, rmse = MD.clv(spark, sf_dir)
    return spark.createDataFrame([(float(rmse),)], "rmse double")


@query
def churn_holdout_report(spark, sf_dir):
    """Classification report of the churn forest on its stratified hold-out."""
    return EV.classification_report(MD.churn(spark, sf_dir).test)


@query
def kpi_clustering_fixed(spark, sf_dir):
    """The clustering KPI row (selected labeling vs the best of all) over the
    fixed labelings of ``embeddings``; the selected one is ``label``."""
    return _kpi_clustering(CL.algorithm_comparison(spark, _fixed_metrics(spark, sf_dir)), "label")


@query
def scenario_inputs(spark, sf_dir):
    """What-if inputs before scoring: each segment's mean recency,
    satisfaction and tickets over the exact population medians of the
    other churn features (rule-labelled customers)."""
    lab = _lab(spark, sf_dir)
    scen = lab.groupBy("rfm_segment").agg(
        F.avg("recency").alias("recency"),
        F.avg("satisfaction_score").alias("satisfaction_score"),
        F.avg("support_tickets_raised").alias("support_tickets_raised"),
    )
    return CHN.scenario_inputs(lab, scen)
