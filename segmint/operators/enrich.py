"""Cleaning and enrichment of a mapped customer table.

Each step is a ``DataFrame -> DataFrame`` function; ``enrich`` applies them in
the reference order with ``DataFrame.transform``. Everything is lazy except
the exact median imputation, which runs one range-partitioned pass for all
numeric columns together (see ``ranking.exact_quantiles``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.constants import (
    CHURN_DAYS,
    CURRENCY_COLUMNS,
    DAYFIRST_RETRY_SHARE,
    DEFAULT_VALUES,
    NUMERIC_COERCE_COLUMNS,
)
from .ranking import exact_medians, exact_quantiles

ROW_ORDER = "ingest_seq"


def with_row_order(df: DataFrame) -> DataFrame:
    """Ensure ``ingest_seq`` (input row order) exists; it is assigned straight
    after a scan, where partition order equals file order."""
    if ROW_ORDER in df.columns:
        return df
    return df.withColumn(ROW_ORDER, F.monotonically_increasing_id())


def dedup_keep_last(df: DataFrame, key: str = "customer_id", order: str = ROW_ORDER) -> DataFrame:
    """Key as text; one row per key, the last by row order. NULL keys are
    dropped. ``max_by`` is a partial aggregate, so a key repeated across a
    third of the input is combined map-side before the shuffle."""
    if order not in df.columns:
        df = df.withColumn(order, F.monotonically_increasing_id())
    df = df.withColumn(key, F.col(key).cast("string")).where(F.col(key).isNotNull())
    others = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_last"))
    return last.select(*[F.col(key) if c == key else F.col(f"_last.{c}").alias(c) for c in df.columns])


def rejected_keys(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """The rows that ``dedup_keep_last`` leaves out because they have no key."""
    return df.where(F.col(key).isNull())


def clean_currency_columns(df: DataFrame) -> DataFrame:
    present = [c for c in CURRENCY_COLUMNS if c in df.columns]
    return df.withColumns({c: C.clean_currency(df, c) for c in present}) if present else df


def coerce_numeric(df: DataFrame) -> DataFrame:
    present = [c for c in ["total_orders"] + NUMERIC_COERCE_COLUMNS if c in df.columns]
    return df.withColumns({c: C.to_numeric(df, c) for c in present}) if present else df


def parse_purchase_dates(df: DataFrame) -> DataFrame:
    if "last_purchase_date" not in df.columns:
        return df
    return df.withColumn("last_purchase_date", C.parse_dates(df, "last_purchase_date", DAYFIRST_RETRY_SHARE))


def derive_days_since(df: DataFrame, as_of) -> DataFrame:
    if "days_since_last_purchase" in df.columns:
        df = df.withColumn("days_since_last_purchase", C.to_numeric(df, "days_since_last_purchase"))
    else:
        df = df.withColumn("days_since_last_purchase", F.lit(None).cast("bigint"))
    if "last_purchase_date" in df.columns:
        derived = C.floor_days_between(F.col("last_purchase_date"), C.as_column(as_of))
        df = df.withColumn("days_since_last_purchase", F.coalesce(F.col("days_since_last_purchase"), derived))
    return df


def derive_aov(df: DataFrame) -> DataFrame:
    if "avg_order_value" not in df.columns:
        df = df.withColumn("avg_order_value", F.lit(None).cast("double"))
    orders = F.col("total_orders") if "total_orders" in df.columns else F.lit(None).cast("double")
    spend = F.col("total_spend") if "total_spend" in df.columns else F.lit(None).cast("double")
    per_order = spend.cast("double") / F.nullif(orders.cast("double"), F.lit(0.0))
    return df.withColumn("avg_order_value", F.coalesce(F.col("avg_order_value").cast("double"), per_order))


def derive_churn_flag(df: DataFrame) -> DataFrame:
    if "churn_flag" in df.columns:
        return df
    flag = F.coalesce((F.col("days_since_last_purchase") > F.lit(CHURN_DAYS)).cast("int"), F.lit(0))
    return df.withColumn("churn_flag", flag)


def default_columns(df: DataFrame) -> DataFrame:
    absent = {c: F.lit(v) for c, v in DEFAULT_VALUES.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def derive_signup(df: DataFrame) -> DataFrame:
    if "signup_date" not in df.columns and "last_purchase_date" in df.columns:
        return df.withColumn("signup_date", F.col("last_purchase_date"))
    return df


def numeric_columns(df: DataFrame, exclude=(ROW_ORDER,)) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def impute_median(df: DataFrame, tiebreak: str | None = ROW_ORDER) -> DataFrame:
    """Every numeric column: NULL → exact median (0 when all NULL). Columns
    without NULLs keep their type; imputed columns become double."""
    cols = numeric_columns(df)
    if not cols:
        return df
    tb = tiebreak if tiebreak in df.columns else None
    # one count pass first: only columns with gaps are ranked
    gaps = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in cols]).first()
    cols = [c for c in cols if gaps[c]]
    if not cols:
        return df
    q = exact_quantiles(df, cols, [0.5], tb)
    fills = {}
    for c in cols:
        med = q[(c, 0.5)]
        fills[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0 if med is None else float(med)))
    return df.withColumns(fills) if fills else df


def fill_unknown(df: DataFrame) -> DataFrame:
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.na.fill("Unknown", subset=strings) if strings else df


def enrich(df: DataFrame, as_of, dedup: bool = True) -> DataFrame:
    """All enrichment steps in order. ``dedup=False`` skips the key shuffle for
    inputs unique by construction (the customer snapshot)."""
    df = with_row_order(df)
    if "customer_id" in df.columns:
        df = dedup_keep_last(df) if dedup else df.withColumn("customer_id", F.col("customer_id").cast("string"))
    df = (
        df.transform(clean_currency_columns)
        .transform(coerce_numeric)
        .transform(parse_purchase_dates)
        .transform(lambda d: derive_days_since(d, as_of))
        .transform(derive_aov)
        .transform(derive_churn_flag)
        .transform(default_columns)
        .transform(derive_signup)
    )
    return df.transform(impute_median).transform(fill_unknown)


__all__ = [
    "with_row_order", "dedup_keep_last", "clean_currency_columns", "coerce_numeric", "parse_purchase_dates",
    "derive_days_since", "derive_aov", "derive_churn_flag", "default_columns", "derive_signup",
    "impute_median", "fill_unknown", "enrich", "exact_medians",
]
