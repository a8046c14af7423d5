"""Customer snapshot: one row per customer as of an explicit instant, built
from the order/line/event fact tables.

The application this library mirrors starts from an already aggregated
customer table; the driver's data are facts, so the snapshot is the
upstream step. Column rules (ours, documented in FIXTURES.md §B):

* ``customer_id``            – ``c_custkey`` as text; ``ingest_seq`` keeps the key
                               as the row order used for tie-breaks.
* ``last_purchase_date`` / ``signup_date`` – max / min order date up to ``as_of``;
                               NULL for a customer without orders.
* ``total_orders``           – number of orders; ``total_spend`` – exact decimal sum;
                               both 0 without orders.
* ``country`` / ``channel``  – nation name / market segment.
* ``satisfaction_score``     – 10 − 9 × share of returned lines.
* ``support_tickets_raised`` – error events of the customer up to ``events_until``
                               (the event log runs on its own clock, so it has a
                               bound of its own; default: its last event).
* ``loyalty_points``         – truncated ``spend × 0.05 + orders × 8``.

Plan shape: lines are pre-aggregated per order (map-side partial aggregate,
one row per order), joined to orders on the order key (the aggregate's hash
partitioning is reused by the join), re-aggregated per customer with partial
aggregation (a customer holding a third of all orders is combined map-side
before the shuffle), then joined 1:1 with customers. Dimension joins
(nation) are left to Spark's size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_column
from .tables import Tables

# FIXED VALUES: loyalty points rule weights
LOYALTY_SPEND_RATE = 0.05
LOYALTY_PER_ORDER = 8


def default_as_of(orders: DataFrame) -> Column:
    """Day after the last order date: a lazy scalar subquery."""
    return orders.select(F.max("o_orderdate") + F.expr("INTERVAL 1 DAY")).scalar()


def last_event(events: DataFrame) -> Column:
    """The event log's last instant: a lazy scalar subquery."""
    return events.select(F.max("ts")).scalar()


def customer_snapshot(t: Tables, as_of=None, events_until=None) -> DataFrame:
    as_of_col = default_as_of(t.orders) if as_of is None else as_column(as_of)
    until = last_event(t.events) if events_until is None else as_column(events_until)

    orders = t.orders.where(F.col("o_orderdate") <= as_of_col).select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"
    )
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_returned"),
    )
    per_order = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    per_customer = per_order.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_spend"),
        F.max("o_orderdate").alias("last_purchase_date"),
        F.min("o_orderdate").alias("signup_date"),
        F.sum(F.coalesce(F.col("n_lines"), F.lit(0))).alias("n_lines"),
        F.sum(F.coalesce(F.col("n_returned"), F.lit(0))).alias("n_returned"),
    )
    errors = (
        t.events.where((F.col("event_type") == "error") & (F.col("ts") <= until))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n_errors"))
    )
    customers = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = t.nation.select("n_nationkey", "n_name")

    joined = (
        customers.join(per_customer, customers["c_custkey"] == per_customer["o_custkey"], "left")
        .na.fill({"total_orders": 0, "total_spend": 0.0})
        .join(nation, customers["c_nationkey"] == nation["n_nationkey"], "left")
        .join(errors, customers["c_custkey"] == errors["user_id"], "left")
    )
    satisfaction = F.when(
        F.col("n_lines") > 0,
        F.lit(10.0) - F.lit(9.0) * F.col("n_returned").cast("double") / F.col("n_lines").cast("double"),
    )
    return joined.select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_custkey").alias("ingest_seq"),
        F.col("last_purchase_date"),
        F.col("signup_date"),
        F.col("total_orders"),
        F.col("total_spend"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("channel"),
        satisfaction.alias("satisfaction_score"),
        F.coalesce(F.col("n_errors"), F.lit(0)).cast("bigint").alias("support_tickets_raised"),
        (F.col("total_spend") * F.lit(LOYALTY_SPEND_RATE) + F.col("total_orders") * F.lit(LOYALTY_PER_ORDER))
        .cast("bigint")
        .alias("loyalty_points"),
    )


def customer_snapshots(t: Tables, as_of_list: list, events_until: list | None = None) -> DataFrame:
    """Snapshots at several as-of instants from **one** scan and shuffle of
    the fact tables: every per-customer measure is a conditional aggregate
    per instant; the result is long, keyed by (``as_of``, customer), with
    every customer at every instant (0 orders where it has none yet).
    ``events_until`` bounds the tickets of each instant; by default all end
    with the event log."""
    cols = [as_column(a) for a in as_of_list]
    untils = [last_event(t.events) if events_until is None else as_column(e) for e in (events_until or as_of_list)]
    latest = cols[0] if len(cols) == 1 else F.greatest(*cols)
    orders = t.orders.where(F.col("o_orderdate") <= latest).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_returned"),
    )
    per_order = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    aggs = []
    for i, a in enumerate(cols):
        on = F.col("o_orderdate") <= a
        aggs += [
            F.count_if(on).alias(f"total_orders_{i}"),
            F.sum(F.when(on, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias(f"total_spend_{i}"),
            F.max(F.when(on, F.col("o_orderdate"))).alias(f"last_purchase_date_{i}"),
            F.min(F.when(on, F.col("o_orderdate"))).alias(f"signup_date_{i}"),
            F.sum(F.when(on, F.coalesce(F.col("n_lines"), F.lit(0))).otherwise(0)).alias(f"n_lines_{i}"),
            F.sum(F.when(on, F.coalesce(F.col("n_returned"), F.lit(0))).otherwise(0)).alias(f"n_returned_{i}"),
        ]
    per_customer = per_order.groupBy("o_custkey").agg(*aggs)
    fields = ["total_orders", "total_spend", "last_purchase_date", "signup_date", "n_lines", "n_returned"]
    errors = (
        t.events.where(F.col("event_type") == "error")
        .groupBy("user_id")
        .agg(*[F.count_if(F.col("ts") <= u).alias(f"n_errors_{i}") for i, u in enumerate(untils)])
    )
    customers = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = t.nation.select("n_nationkey", "n_name")
    wide = (
        customers.join(per_customer, customers["c_custkey"] == per_customer["o_custkey"], "left")
        .join(nation, customers["c_nationkey"] == nation["n_nationkey"], "left")
        .join(errors, customers["c_custkey"] == errors["user_id"], "left")
    )
    each = [F.struct(a.alias("as_of"), *[F.col(f"{f}_{i}").alias(f) for f in [*fields, "n_errors"]]) for i, a in enumerate(cols)]
    joined = (
        wide.select("c_custkey", "n_name", "c_mktsegment", F.explode(F.array(*each)).alias("s"))
        .select("c_custkey", "n_name", "c_mktsegment", "s.*")
        .na.fill({"total_orders": 0, "total_spend": 0.0})
    )
    satisfaction = F.when(
        F.col("n_lines") > 0,
        F.lit(10.0) - F.lit(9.0) * F.col("n_returned").cast("double") / F.col("n_lines").cast("double"),
    )
    return joined.select(
        "as_of",
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_custkey").alias("ingest_seq"),
        "last_purchase_date",
        "signup_date",
        "total_orders",
        "total_spend",
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("channel"),
        satisfaction.alias("satisfaction_score"),
        F.coalesce(F.col("n_errors"), F.lit(0)).cast("bigint").alias("support_tickets_raised"),
        (F.col("total_spend") * F.lit(LOYALTY_SPEND_RATE) + F.col("total_orders") * F.lit(LOYALTY_PER_ORDER))
        .cast("bigint")
        .alias("loyalty_points"),
    )
