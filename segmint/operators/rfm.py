"""RFM scoring: recency / frequency / monetary, exact quantile scores 1..5
and the named segment.

Scores use exact ranks with ties broken by ``ingest_seq`` (the input row
order), so they equal pandas ``qcut(rank(method="first"), 5)`` on the same
row order. The customer table itself is never shuffled: the 12 boundary keys
come from one range-partitioned pass over a narrow (metric, value, id) frame,
and the scores are a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_column, floor_days_between
from ..functions.constants import SCORE_BINS, SEGMENT_ELSE, SEGMENT_RULES
from .ranking import quantile_bin_columns

RFM_COLUMNS = ["recency", "frequency", "monetary", "r_score", "f_score", "m_score", "rfm_score", "rfm_segment"]


def rfm_base(df: DataFrame, as_of) -> DataFrame:
    """recency = whole days from last purchase to ``as_of`` (missing date → 0);
    frequency = orders or 0; monetary = spend or 0.0."""
    as_of_col = as_column(as_of)
    last = F.coalesce(F.col("last_purchase_date").cast("timestamp_ntz"), as_of_col)
    return df.withColumns(
        {
            "recency": floor_days_between(last, as_of_col),
            "frequency": F.coalesce(F.col("total_orders"), F.lit(0)),
            "monetary": F.coalesce(F.col("total_spend").cast("double"), F.lit(0.0)),
        }
    )


def _in_range(c: Column, rng) -> Column:
    lo, hi = rng
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c >= F.lit(lo))
    if hi is not None:
        cond = cond & (c <= F.lit(hi))
    return cond


def segment_column(r: Column, f: Column, m: Column) -> Column:
    """Ordered rule chain → segment name (first matching rule wins)."""
    expr = None
    for name, rr, fr, mr in SEGMENT_RULES:
        cond = _in_range(r, rr) & _in_range(f, fr) & _in_range(m, mr)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(SEGMENT_ELSE))


def score_columns(base: DataFrame, tiebreak: str = "ingest_seq") -> dict:
    """r/f/m score expressions for a frame that already has recency,
    frequency and monetary (one range shuffle for all three)."""
    bins = quantile_bin_columns(base, ["recency", "frequency", "monetary"], tiebreak, SCORE_BINS)
    return {
        "r_score": (F.lit(SCORE_BINS + 1) - bins["recency"]).cast("int"),
        "f_score": bins["frequency"].cast("int"),
        "m_score": bins["monetary"].cast("int"),
    }


def apply_scores(base: DataFrame, scores: dict) -> DataFrame:
    scored = base.withColumns(scores)
    return scored.withColumns(
        {
            "rfm_score": F.col("r_score") + F.col("f_score") + F.col("m_score"),
            "rfm_segment": segment_column(F.col("r_score"), F.col("f_score"), F.col("m_score")),
        }
    )


def rfm(df: DataFrame, as_of, tiebreak: str | None = None) -> DataFrame:
    """Full RFM scoring of a customer table. Ties rank by ``tiebreak``
    (default: ``ingest_seq`` when present, else ``customer_id``)."""
    tiebreak = tiebreak or ("ingest_seq" if "ingest_seq" in df.columns else "customer_id")
    base = rfm_base(df, as_of)
    return apply_scores(base, score_columns(base, tiebreak))
