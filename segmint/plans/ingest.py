"""The upload path on data derived from the driver tables.

``raw_customer_export`` renders the customer snapshot the way a CRM export
looks: user column names, text values, currency symbols and thousands
separators, US dates, and deterministic gaps / junk (every 10th revenue
"n/a", every 7th satisfaction empty, every 13th date empty). The upload
pipeline then writes it as CSV to the shared scratch folder, scans it back
as text, auto-maps the columns, validates and enriches — the same steps a
user file goes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrich import enrich
from ..operators.quality import require_valid
from ..operators.schema_map import apply_mapping, auto_map_columns
from ..session import scratch_path
from ..sources.files import infer_numeric, reject_empty, scan_csv, write_csv
from . import base

_CACHE: dict = {}


def raw_customer_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = base.snapshot(spark, sf_dir)
    seq = F.col("ingest_seq")
    return s.select(
        F.col("customer_id").alias("Cust ID"),
        F.when(seq % 13 == 0, F.lit(None)).otherwise(F.date_format("last_purchase_date", "MM/dd/yyyy")).alias("Order Date"),
        F.col("total_orders").cast("string").alias("Num Orders"),
        F.when(seq % 10 == 0, F.lit("n/a"))
        .otherwise(F.concat(F.lit("$"), F.format_number("total_spend", 2)))
        .alias("Revenue"),
        F.when(seq % 7 == 0, F.lit(None)).otherwise(F.col("satisfaction_score").cast("string")).alias("CSAT"),
        F.col("country").alias("Country"),
        F.col("channel").alias("Channel"),
        F.col("support_tickets_raised").cast("string").alias("Support Tickets"),
        F.col("loyalty_points").cast("string").alias("Loyalty Points"),
        seq.alias("_order"),
    )


def uploaded_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the export as CSV (rows sorted by the export's own order) and
    scan it back as text, map the columns and type them."""
    k = base._key(spark, sf_dir)
    if k not in _CACHE:
        path = scratch_path(spark, "upload")
        raw = raw_customer_export(spark, sf_dir)
        write_csv(raw.sortWithinPartitions("_order"), path)
        scanned = reject_empty(scan_csv(spark, path))
        # the export's own order (its files are not written in that order)
        scanned = scanned.withColumn("ingest_seq", F.col("_order").cast("bigint")).drop("_order")
        mapping = auto_map_columns(scanned.drop("ingest_seq"))
        # materialised once: later steps scan it several times (validation,
        # exact medians) and must all see the same rows
        _CACHE[k] = base.materialize(infer_numeric(apply_mapping(scanned, mapping)))
    return _CACHE[k]


def upload_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = require_valid(uploaded_file(spark, sf_dir))
    return enrich(mapped, base.as_of(spark, sf_dir))
