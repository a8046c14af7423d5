"""Independent DuckDB SQL for every SQL-checkable query.

Written directly in SQL (window ``row_number()`` for ranks, ``median`` /
``quantile_cont`` for exact quantiles) so that the Spark operators are
checked against a different formulation, not against themselves.
Views ``customer orders lineitem events nation embeddings ...`` are
registered by the checker.
"""

from __future__ import annotations

# --------------------------------------------------------------------------- CTE chain
_SNAPSHOT = """
params{s} AS (SELECT {as_of} AS as_of),
line_agg{s} AS (
  SELECT l_orderkey, count(*) AS n_lines,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned
  FROM lineitem GROUP BY l_orderkey),
cust_agg{s} AS (
  SELECT o_custkey, count(*) AS total_orders,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spend,
         max(o_orderdate) AS last_purchase_date, min(o_orderdate) AS signup_date,
         sum(coalesce(n_lines, 0)) AS n_lines, sum(coalesce(n_returned, 0)) AS n_returned
  FROM orders LEFT JOIN line_agg{s} ON o_orderkey = l_orderkey
  WHERE o_orderdate <= (SELECT as_of FROM params{s})
  GROUP BY o_custkey),
err{s} AS (SELECT user_id, count(*) AS n_errors FROM events
  WHERE event_type = 'error' AND ts <= (SELECT max(ts) FROM events) - {events_back} GROUP BY user_id),
snapshot{s} AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS customer_id, c.c_custkey AS ingest_seq,
         a.last_purchase_date, a.signup_date, coalesce(a.total_orders, 0) AS total_orders, coalesce(a.total_spend, 0.0) AS total_spend,
         n.n_name AS country, c.c_mktsegment AS channel,
         CASE WHEN a.n_lines > 0
              THEN CAST(10.0 AS DOUBLE) - CAST(9.0 AS DOUBLE) * CAST(a.n_returned AS DOUBLE) / CAST(a.n_lines AS DOUBLE)
         END AS satisfaction_score,
         CAST(coalesce(e.n_errors, 0) AS BIGINT) AS support_tickets_raised,
         CAST(trunc(coalesce(a.total_spend, 0.0) * CAST(0.05 AS DOUBLE) + coalesce(a.total_orders, 0) * 8) AS BIGINT) AS loyalty_points
  FROM customer c
  LEFT JOIN cust_agg{s} a ON c.c_custkey = a.o_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN err{s} e ON c.c_custkey = e.user_id)
"""

_CUSTOMERS = """
enriched0{s} AS (
  SELECT s.*,
         CAST(floor(date_diff('second', last_purchase_date, (SELECT as_of FROM params{s})) / 86400) AS BIGINT)
           AS days_since_last_purchase,
         total_spend / nullif(CAST(total_orders AS DOUBLE), 0) AS avg_order_value
  FROM snapshot{s} s),
customers{s} AS (
  SELECT customer_id, ingest_seq, last_purchase_date, signup_date, total_orders, total_spend,
         coalesce(country, 'Unknown') AS country, coalesce(channel, 'Unknown') AS channel,
         coalesce(satisfaction_score, (SELECT coalesce(median(satisfaction_score), 0) FROM enriched0{s})) AS satisfaction_score,
         support_tickets_raised, loyalty_points,
         CASE WHEN days_since_last_purchase IS NULL THEN (SELECT median(days_since_last_purchase) FROM enriched0{s})
              ELSE days_since_last_purchase END AS days_since_last_purchase,
         coalesce(avg_order_value, (SELECT coalesce(median(avg_order_value), 0) FROM enriched0{s})) AS avg_order_value,
         CASE WHEN days_since_last_purchase > 180 THEN 1 ELSE 0 END AS churn_flag,
         35 AS age, 'Unknown' AS gender, 'Unknown' AS city, 0 AS referral_count
  FROM enriched0{s})
"""

_SCORED = """
rfm_base{s} AS (
  SELECT c.*,
         CAST(floor(date_diff('second', coalesce(last_purchase_date, (SELECT as_of FROM params{s})),
                                (SELECT as_of FROM params{s})) / 86400) AS BIGINT) AS recency,
         coalesce(total_orders, 0) AS frequency,
         coalesce(total_spend, 0.0) AS monetary
  FROM customers{s} c),
ranked{s} AS (
  SELECT *,
         row_number() OVER (ORDER BY recency, ingest_seq) AS rn_r,
         row_number() OVER (ORDER BY frequency, ingest_seq) AS rn_f,
         row_number() OVER (ORDER BY monetary, ingest_seq) AS rn_m,
         count(*) OVER () AS n_rows
  FROM rfm_base{s}),
binned{s} AS (
  SELECT *,
         CASE WHEN n_rows < 2 THEN 3 ELSE greatest(1, (5 * (rn_r - 1) + n_rows - 2) // (n_rows - 1)) END AS bin_r,
         CASE WHEN n_rows < 2 THEN 3 ELSE greatest(1, (5 * (rn_f - 1) + n_rows - 2) // (n_rows - 1)) END AS bin_f,
         CASE WHEN n_rows < 2 THEN 3 ELSE greatest(1, (5 * (rn_m - 1) + n_rows - 2) // (n_rows - 1)) END AS bin_m
  FROM ranked{s}),
scored0{s} AS (
  SELECT * EXCLUDE (rn_r, rn_f, rn_m, n_rows, bin_r, bin_f, bin_m),
         CAST(6 - bin_r AS INTEGER) AS r_score, CAST(bin_f AS INTEGER) AS f_score, CAST(bin_m AS INTEGER) AS m_score
  FROM binned{s}),
scored{s} AS (
  SELECT *, r_score + f_score + m_score AS rfm_score,
         CASE
           WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
           WHEN r_score >= 3 AND f_score >= 4 AND m_score >= 3 THEN 'Loyal Customers'
           WHEN r_score >= 4 AND f_score >= 2 AND m_score >= 2 THEN 'Potential Loyalists'
           WHEN r_score >= 4 AND f_score <= 2 AND m_score <= 2 THEN 'New Customers'
           WHEN r_score <= 2 AND f_score >= 4 AND m_score >= 4 THEN 'Can''t Lose Them'
           WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'At Risk'
           WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Hibernating'
           ELSE 'Lost Customers'
         END AS rfm_segment
  FROM scored0{s})
"""

_LABELLED = """
labels0{s} AS (
  SELECT *, avg_order_value * total_orders AS historical_clv,
         CAST(ingest_seq % 4 AS INTEGER) AS cluster_id,
         CAST(recency AS DOUBLE) / (CAST(recency AS DOUBLE) + 365.0) AS churn_probability
  FROM scored{s}),
labels1{s} AS (SELECT *, historical_clv * 1.05 AS clv_12m FROM labels0{s}),
tiers{s} AS (
  SELECT quantile_cont(clv_12m, 0.1) AS q10, quantile_cont(clv_12m, 0.3) AS q30,
         quantile_cont(clv_12m, 0.6) AS q60 FROM labels1{s}),
labelled{s} AS (
  SELECT l.*,
         CASE WHEN clv_12m >= (SELECT q60 FROM tiers{s}) THEN 'Platinum'
              WHEN clv_12m >= (SELECT q30 FROM tiers{s}) THEN 'Gold'
              WHEN clv_12m >= (SELECT q10 FROM tiers{s}) THEN 'Silver'
              ELSE 'Bronze' END AS clv_tier
  FROM labels1{s} l)
"""


AS_OF = "(SELECT max(o_orderdate) + INTERVAL 1 DAY FROM orders)"
AS_OF_PRIOR = "(SELECT max(o_orderdate) + INTERVAL 1 DAY - INTERVAL 30 DAY FROM orders)"
_LEVELS = {"snapshot": [_SNAPSHOT], "customers": [_SNAPSHOT, _CUSTOMERS], "scored": [_SNAPSHOT, _CUSTOMERS, _SCORED],
           "labelled": [_SNAPSHOT, _CUSTOMERS, _SCORED, _LABELLED]}


def chain(level: str, suffix: str = "", as_of: str = AS_OF, events_back: str = "INTERVAL 0 DAY") -> str:
    """CTE text up to ``level``; every CTE name carries ``suffix`` so two
    chains (e.g. two as-of dates) can live in one WITH clause."""
    return ",\n".join(p.format(s=suffix, as_of=as_of, events_back=events_back).strip() for p in _LEVELS[level])


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


SNAPSHOT = with_ctes(chain("snapshot"))
CUSTOMERS = with_ctes(chain("customers"))
SCORED = with_ctes(chain("scored"))
LABELLED = with_ctes(chain("labelled"))


def on(prefix: str, body: str) -> str:
    return f"{prefix}\n{body}"
