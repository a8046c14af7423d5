"""Sidebar-style filters as Column predicates.

Filters always apply *after* scoring and model fitting (scores refer to the
whole population); Catalyst keeps them above the rank/aggregate steps.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_column


@dataclass(frozen=True)
class FilterSpec:
    date_range: tuple | None = None  # (start, end), both inclusive; end at midnight
    countries: tuple = field(default_factory=tuple)
    clusters: tuple = field(default_factory=tuple)


def date_column(df: DataFrame) -> str:
    return "signup_date" if "signup_date" in df.columns else "last_purchase_date"


def filter_facets(df: DataFrame, fallback_today: _dt.date | None = None) -> DataFrame:
    """Long frame (facet, value): date_min / date_max of the filter date
    (signup, else purchase), then sorted distinct countries and clusters."""
    d = date_column(df)
    sets = [[]] + [[F.col(c)] for c in ("country", "cluster_id") if c in df.columns]
    keys = [c for c in ("country", "cluster_id") if c in df.columns]
    # one scan: the whole table and each facet's values are groupings of it
    one = df.select(d, *keys).groupingSets(sets, *keys).agg(F.min(d).alias("lo"), F.max(d).alias("hi"), F.grouping_id().alias("g"))
    lo, hi = F.col("lo"), F.col("hi")
    if fallback_today is not None:
        today, gone = as_column(fallback_today), lo.isNull() | hi.isNull()
        lo, hi = F.when(gone, today - F.expr("INTERVAL 365 DAYS")).otherwise(lo), F.when(gone, today).otherwise(hi)
    whole = (1 << len(keys)) - 1
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    rows = F.when(F.col("g") == whole, F.array(F.struct(F.lit("date_min").alias("facet"), day(lo).alias("value")), F.struct(F.lit("date_max").alias("facet"), day(hi).alias("value"))))
    for i, c in enumerate(keys):
        own = whole - (1 << (len(keys) - 1 - i))
        facet = F.array(F.struct(F.lit("country" if c == "country" else "cluster").alias("facet"), F.col(c).cast("string").alias("value")))
        rows = rows.when((F.col("g") == own) & F.col(c).isNotNull(), facet)
    return one.select(F.explode(rows).alias("r")).select("r.facet", "r.value")


def date_range_predicate(df: DataFrame, start, end) -> Column:
    """Inclusive on both ends; NULL dates drop out."""
    c = F.col(date_column(df))
    return c.between(as_column(start), as_column(end))


def isin_predicate(column: str, values) -> Column:
    """Empty selection means no filter."""
    values = list(values or [])
    return F.col(column).isin(values) if values else F.lit(True)


def filter_predicate(df: DataFrame, spec: FilterSpec) -> Column:
    pred = F.lit(True)
    if spec.date_range is not None:
        pred = pred & date_range_predicate(df, *spec.date_range)
    if spec.countries and "country" in df.columns:
        pred = pred & isin_predicate("country", spec.countries)
    if spec.clusters:
        pred = pred & isin_predicate("cluster_id", spec.clusters)
    return pred


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    return df.where(filter_predicate(df, spec))


def filter_segments(df: DataFrame, segments) -> DataFrame:
    return df.where(isin_predicate("rfm_segment", segments))


def search_customers(df: DataFrame, pattern: str) -> DataFrame:
    """Case-insensitive regular-expression match in id, city or country."""
    if not pattern:
        return df
    p = pattern.lower()
    hit = F.lit(False)
    for c in ["customer_id", "city", "country"]:
        hit = hit | F.coalesce(F.lower(F.col(c)).rlike(p), F.lit(False))
    return df.where(hit)
