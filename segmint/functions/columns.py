"""Column-level helpers: literal coercion, lenient parsing, day arithmetic.

All helpers return ``Column`` expressions built from built-in functions so
they stay inside whole-stage code generation (no Python UDFs).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECONDS_PER_DAY = 86400


def as_column(value) -> Column:
    """A Column for an as-of instant: Column passthrough, else a timestamp_ntz literal."""
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        return F.lit(value).cast(T.TimestampNTZType())
    if isinstance(value, _dt.date):
        return F.lit(_dt.datetime(value.year, value.month, value.day)).cast(T.TimestampNTZType())
    if isinstance(value, str):
        return F.lit(value).cast(T.TimestampNTZType())
    raise TypeError(f"unsupported as_of value: {value!r}")


def to_ntz(c: Column) -> Column:
    return c.cast(T.TimestampNTZType())


def floor_days_between(start: Column, end: Column) -> Column:
    """Whole elapsed 24-hour periods from ``start`` to ``end`` (negative for
    future ``start``), as pandas ``Timedelta.days`` counts them."""
    secs = F.timestamp_diff("SECOND", to_ntz(start), to_ntz(end))
    return F.floor(secs / F.lit(SECONDS_PER_DAY)).cast("bigint")


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


# Accepted by pandas.to_numeric: optional blanks, sign, decimal or exponent
# form, inf / infinity / nan words.
_NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def to_numeric(df: DataFrame, name: str) -> Column:
    """Lenient number parsing: bad values become NULL, never errors.

    String columns are guarded with a numeric pattern before ``try_cast`` so
    Spark-only spellings such as ``1d`` do not parse. NaN becomes NULL.
    """
    c = F.col(name)
    if is_string(df, name):
        parsed = F.when(c.rlike(_NUMERIC_TEXT), F.trim(c).try_cast("double"))
        return nan_to_null(parsed)
    if is_numeric(df, name):
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            return nan_to_null(c.cast("double"))
        return c
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return c.cast("int")
    return c.cast("string").try_cast("double")


def clean_currency(df: DataFrame, name: str) -> Column:
    """Strip everything except digits, '.', '-' and parse; only string
    columns are stripped (a double rendered as text may carry an exponent)."""
    c = F.col(name)
    if is_string(df, name):
        stripped = F.regexp_replace(c, r"[^0-9.\-]", "")
        return nan_to_null(stripped.try_cast("double"))
    if is_numeric(df, name):
        return nan_to_null(c.cast("double"))
    return c.cast("string").try_cast("double")


# FIXED VALUES: accepted date layouts. Month-first layouts are tried first;
# day-first layouts only fill values the month-first pass left NULL.
MONTH_FIRST_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "M/d/yyyy HH:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "M-d-yyyy",
    "MMM d, yyyy",
    "d MMM yyyy",
]
DAY_FIRST_FORMATS = [
    "d/M/yyyy HH:mm:ss",
    "d/M/yyyy H:mm",
    "d/M/yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
]


def _try_formats(c: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast(T.TimestampNTZType()) for f in formats])


def parse_dates(df: DataFrame, name: str, retry_share: float = 0.3) -> Column:
    """Lenient date parsing with a gated day-first retry.

    The month-first pass runs on every value. When more than ``retry_share``
    of the values fail it, the day-first layouts fill the failures only, so
    ambiguous dates stay month-first. The failure share is one scalar
    subquery over the same input (computed once, broadcast as a literal).
    """
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast(T.TimestampNTZType())
    text = c.cast("string") if not isinstance(dtype, T.StringType) else c
    month_first = _try_formats(F.trim(text), MONTH_FIRST_FORMATS)
    fail_share = df.select(F.avg(month_first.isNull().cast("double"))).scalar()
    day_first = _try_formats(F.trim(text), DAY_FIRST_FORMATS)
    return F.when(F.coalesce(fail_share, F.lit(0.0)) > F.lit(retry_share), F.coalesce(month_first, day_first)).otherwise(
        month_first
    )
