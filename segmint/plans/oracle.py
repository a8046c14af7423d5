"""name -> DuckDB SQL for every SQL-checkable registered query."""

from __future__ import annotations

from ..functions.constants import PERSONAS, SEGMENT_PROFILES, SEGMENTS, SYNONYMS
from ..sources.tables import TABLES
from .oracle_sql import LABELLED, SCORED, SNAPSHOT, on

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE[name] = text


sql(
    "customer_snapshot",
    on(
        SNAPSHOT,
        """SELECT customer_id, ingest_seq, strftime(last_purchase_date, '%Y-%m-%d') AS last_purchase_date,
       strftime(signup_date, '%Y-%m-%d') AS signup_date, total_orders, total_spend, country, channel,
       satisfaction_score, support_tickets_raised, loyalty_points FROM snapshot""",
    ),
)

sql(
    "rfm",
    on(
        SCORED,
        """SELECT customer_id, recency, frequency, monetary, r_score, f_score, m_score, rfm_score, rfm_segment
FROM scored""",
    ),
)

sql(
    "revenue_by_segment",
    on(SCORED, "SELECT rfm_segment, CAST(sum(CAST(total_spend AS DECIMAL(18,2))) AS DOUBLE) AS total_spend FROM scored GROUP BY rfm_segment"),
)

_ = LABELLED

L = LABELLED
PRED = "cluster_id IN (0, 1, 2)"

sql("segment_counts", on(L, "SELECT rfm_segment, count(*) AS count FROM labelled WHERE rfm_segment IS NOT NULL GROUP BY 1"))
sql("country_counts", on(L, "SELECT country, count(*) AS count FROM labelled WHERE country IS NOT NULL GROUP BY 1"))
sql(
    "segment_share",
    on(L, """SELECT rfm_segment, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM labelled WHERE rfm_segment IS NOT NULL) AS pct
FROM labelled WHERE rfm_segment IS NOT NULL GROUP BY 1"""),
)
sql(
    "monthly_signups",
    on(L, """, m AS (SELECT last_day(signup_date) AS month_end FROM labelled WHERE signup_date IS NOT NULL),
c AS (SELECT month_end, count(*) AS signups FROM m GROUP BY 1),
months AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(month_end)), date_trunc('month', max(month_end)), INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM m)
SELECT strftime(months.month_end, '%Y-%m-%d') AS month_end, CAST(coalesce(c.signups, 0) AS BIGINT) AS signups
FROM months LEFT JOIN c ON months.month_end = c.month_end"""),
)
sql(
    "spend_satisfaction_pivot",
    on(L, """, d AS (SELECT rfm_segment, CAST(round_even(satisfaction_score, 0) AS INTEGER) AS bucket, total_spend FROM labelled
  WHERE rfm_segment IS NOT NULL AND satisfaction_score IS NOT NULL),
m AS (SELECT rfm_segment, bucket, avg(total_spend) AS avg_spend FROM d GROUP BY 1, 2)
SELECT s.rfm_segment, b.bucket, coalesce(m.avg_spend, 0.0) AS avg_spend
FROM (SELECT DISTINCT rfm_segment FROM d) s CROSS JOIN (SELECT DISTINCT bucket FROM d) b
LEFT JOIN m ON m.rfm_segment = s.rfm_segment AND m.bucket = b.bucket"""),
)
sql(
    "score_histogram",
    on(L, """SELECT score_name, score, count(*) AS count FROM (
  SELECT 'r_score' AS score_name, r_score AS score FROM labelled UNION ALL
  SELECT 'f_score', f_score FROM labelled UNION ALL
  SELECT 'm_score', m_score FROM labelled) WHERE score IS NOT NULL GROUP BY 1, 2"""),
)
sql(
    "probability_histogram",
    on(L, """SELECT b.bin, CAST(coalesce(c.n, 0) AS BIGINT) AS count, (b.bin - 1) / 30.0 AS bin_lo, b.bin / 30.0 AS bin_hi
FROM (SELECT unnest(generate_series(1, 30)) AS bin) b LEFT JOIN (
  SELECT least(CAST(floor(churn_probability * 30) AS BIGINT) + 1, 30) AS bin, count(*) AS n FROM labelled
  WHERE churn_probability IS NOT NULL GROUP BY 1) c ON c.bin = b.bin"""),
)
CLUSTER_PROFILE = """SELECT cluster_id, avg(total_spend) AS total_spend, avg(frequency) AS frequency, avg(recency) AS recency,
  avg(satisfaction_score) AS satisfaction_score, avg(clv_12m) AS clv_12m, count(*) AS cluster_size
FROM labelled WHERE cluster_id IS NOT NULL GROUP BY cluster_id"""
sql("cluster_profile", on(L, CLUSTER_PROFILE))
_FEATS = ["age", "total_orders", "total_spend", "avg_order_value", "loyalty_points", "support_tickets_raised",
          "satisfaction_score", "referral_count", "days_since_last_purchase", "recency", "frequency", "monetary", "rfm_score"]
sql(
    "cluster_stats",
    on(L, "SELECT cluster_id, " + ", ".join(f"avg({c}) AS {c}" for c in _FEATS)
       + ", count(*) AS cluster_size FROM labelled WHERE cluster_id IS NOT NULL GROUP BY cluster_id"),
)
sql("top_clusters_8", on(L, f", p AS ({CLUSTER_PROFILE}) SELECT * FROM p ORDER BY cluster_size DESC, cluster_id LIMIT 8"))
sql(
    "radar_profile",
    on(L, f", p AS ({CLUSTER_PROFILE}) SELECT cluster_id, "
       + ", ".join(f"{c} / (CASE WHEN max({c}) OVER () = 0 THEN 1.0 ELSE max({c}) OVER () END) AS {c}_ratio"
                   for c in ["total_spend", "frequency", "recency", "satisfaction_score", "clv_12m"])
       + " FROM p"),
)
sql(
    "cluster_churn_gauge",
    on(L, """SELECT cluster_id, g AS gauge_value, CASE WHEN g < 30 THEN 'low' WHEN g < 60 THEN 'medium' ELSE 'high' END AS gauge_band
FROM (SELECT cluster_id, avg(churn_probability) * 100.0 AS g FROM labelled WHERE cluster_id IS NOT NULL GROUP BY 1)"""),
)
sql(
    "segment_churn_summary",
    on(L, """SELECT *, row_number() OVER (ORDER BY churn_rate DESC NULLS LAST, rfm_segment) = 1 AS is_top_risk FROM (
  SELECT rfm_segment, count(*) AS size, avg(churn_probability) AS churn_rate, avg(recency) AS avg_recency,
         avg(satisfaction_score) AS avg_satisfaction, avg(clv_12m) AS avg_clv
  FROM labelled WHERE rfm_segment IS NOT NULL GROUP BY 1)"""),
)
PERSONA_STATS = """SELECT rfm_segment, count(*) AS count, avg(total_spend) AS avg_spend, avg(recency) AS avg_recency,
  avg(frequency) AS avg_frequency FROM labelled WHERE rfm_segment IS NOT NULL GROUP BY 1"""
sql("persona_stats", on(L, PERSONA_STATS))
def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The fixed dimension tables come from functions/constants.py (one copy of
# the values); the rules that use them are written out in SQL below.
PERSONA_DIM = "(VALUES\n" + ",\n".join(
    f" ({i}, {_q(seg)}, {_q(PERSONAS[seg]['description'])}, {_q(PERSONAS[seg]['health'])})" for i, seg in enumerate(SEGMENTS)
) + "\n) AS p(segment_order, rfm_segment, description, health)"
sql(
    "lookup_persona",
    on(L, f""", st AS ({PERSONA_STATS}), tot AS (SELECT count(*) AS n FROM labelled WHERE rfm_segment IS NOT NULL)
SELECT p.rfm_segment, p.segment_order, p.description, p.health, coalesce(st.count, 0) AS count,
  coalesce(st.avg_spend, 0.0) AS avg_spend, coalesce(st.avg_recency, 0.0) AS avg_recency,
  coalesce(st.avg_frequency, 0.0) AS avg_frequency,
  CASE WHEN (SELECT n FROM tot) > 0 THEN coalesce(st.count, 0) * 100.0 / (SELECT n FROM tot) ELSE 0.0 END AS pct
FROM {PERSONA_DIM} LEFT JOIN st ON p.rfm_segment = st.rfm_segment"""),
)
_SEG_AGGS = """count(*) AS size, avg(total_spend) AS avg_spend, avg(recency) AS avg_recency, avg(frequency) AS avg_frequency,
  avg(churn_flag) AS churn_rate, avg(clv_12m) AS avg_clv"""
sql(
    "segment_stats",
    on(L, f""", bs AS (SELECT rfm_segment AS segment, {_SEG_AGGS} FROM labelled WHERE rfm_segment IS NOT NULL GROUP BY 1)
SELECT 'rfm_segment' AS scope, p.rfm_segment AS segment, coalesce(size, 0) AS size, coalesce(avg_spend, 0.0) AS avg_spend,
  coalesce(avg_recency, 0.0) AS avg_recency, coalesce(avg_frequency, 0.0) AS avg_frequency,
  coalesce(churn_rate, 0.0) AS churn_rate, coalesce(avg_clv, 0.0) AS avg_clv
FROM {PERSONA_DIM} LEFT JOIN bs ON p.rfm_segment = bs.segment
UNION ALL
SELECT 'cluster_id', CAST(cluster_id AS VARCHAR), {_SEG_AGGS} FROM labelled WHERE cluster_id IS NOT NULL GROUP BY cluster_id"""),
)
sql(
    "executive_summary",
    on(L, """, seg AS (SELECT rfm_segment, count(*) AS n, avg(churn_flag) AS churn FROM labelled WHERE rfm_segment IS NOT NULL GROUP BY 1),
clus AS (SELECT cluster_id, sum(total_spend) AS spend FROM labelled WHERE cluster_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS total_customers, avg(churn_flag) * 100.0 AS churn_rate_pct, avg(clv_12m) AS avg_clv,
  (SELECT rfm_segment FROM seg ORDER BY n DESC NULLS LAST, rfm_segment LIMIT 1) AS top_segment,
  (SELECT cluster_id FROM clus ORDER BY spend DESC NULLS LAST, cluster_id LIMIT 1) AS top_cluster,
  (SELECT rfm_segment FROM seg ORDER BY churn DESC NULLS LAST, rfm_segment LIMIT 1) AS riskiest_segment
FROM labelled"""),
)
sql("clv_by_cluster_tier", on(L, """SELECT cluster_id, clv_tier, avg(clv_12m) AS clv_12m FROM labelled
WHERE cluster_id IS NOT NULL AND clv_tier IS NOT NULL GROUP BY 1, 2"""))
sql("clv_treemap", on(L, """SELECT clv_tier, cluster_id, sum(clv_12m) AS clv_12m, grouping(clv_tier, cluster_id) AS level
FROM labelled WHERE clv_tier IS NOT NULL AND cluster_id IS NOT NULL GROUP BY ROLLUP (clv_tier, cluster_id)"""))
sql("clv_by_segment_cluster", on(L, """SELECT rfm_segment, cluster_id, avg(clv_12m) AS clv_12m FROM labelled
WHERE rfm_segment IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1, 2"""))


def _kpi(specs: list[tuple[str, str, str]], extra_ctes: str = "") -> str:
    aggs = ", ".join(f"CAST({v} AS DOUBLE) AS {n}__v, CAST({b} AS DOUBLE) AS {n}__b" for n, v, b in specs)
    rows = " UNION ALL ".join(f"SELECT '{n}' AS kpi, {n}__v AS value, {n}__b AS baseline FROM one" for n, _, _ in specs)
    return on(L, f"""{extra_ctes}, one AS (SELECT {aggs} FROM labelled), k AS ({rows})
SELECT kpi, value, baseline,
  CASE WHEN baseline = 0 THEN '0%' ELSE printf('%+.1f%%', pct) END AS delta,
  CASE WHEN baseline = 0 THEN 'yellow' WHEN pct >= 0 THEN 'green' ELSE 'red' END AS delta_color
FROM (SELECT *, (value - baseline) / nullif(abs(baseline), 0) * 100.0 AS pct FROM k)""")


def _mean(x: str) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(28,10))) AS DOUBLE) / count({x}))"


def _fa(expr: str) -> str:
    return f"CASE WHEN {PRED} THEN {expr} END"


sql("kpi_home", _kpi([
    ("customers", f"count(*) FILTER (WHERE {PRED})", "count(*)"),
    ("active_segments", f"count(DISTINCT {_fa('rfm_segment')})", "count(DISTINCT rfm_segment)"),
    ("avg_clv", _mean(_fa('clv_12m')), _mean("clv_12m")),
    ("churn_rate", _mean(_fa('churn_flag')), _mean("churn_flag")),
]))
sql("kpi_overview", _kpi([
    ("total_customers", f"count(*) FILTER (WHERE {PRED})", "count(*)"),
    ("avg_clv", _mean(_fa('clv_12m')), _mean("clv_12m")),
    ("churn_rate", _mean(_fa('churn_flag')), _mean("churn_flag")),
    ("avg_satisfaction", _mean(_fa('satisfaction_score')), _mean("satisfaction_score")),
]))
sql("kpi_rfm", _kpi([
    ("avg_recency", _mean(_fa('recency')), _mean("recency")),
    ("avg_frequency", _mean(_fa('frequency')), _mean("frequency")),
    ("avg_monetary", _mean(_fa('monetary')), _mean("monetary")),
    ("top_segment_share",
     f"(SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM labelled WHERE {PRED} AND rfm_segment IS NOT NULL GROUP BY rfm_segment))",
     "(SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM labelled WHERE rfm_segment IS NOT NULL GROUP BY rfm_segment))"),
]))
sql("kpi_churn", _kpi([
    ("churn_rate", _mean(_fa('churn_flag')), _mean("churn_flag")),
    ("avg_churn_probability", _mean(_fa('churn_probability')), _mean("churn_probability")),
    ("high_risk_customers", f"count(*) FILTER (WHERE {PRED} AND churn_probability >= 0.7)", "count(*) FILTER (WHERE churn_probability >= 0.7)"),
]))
_PLAT = "CASE WHEN clv_tier = 'Platinum' THEN 1.0 ELSE 0.0 END"
sql("kpi_clv", _kpi([
    ("avg_clv", _mean(_fa('clv_12m')), _mean("clv_12m")),
    ("platinum_share", _mean(_fa(_PLAT)), _mean(_PLAT)),
    ("clv_growth", f"{_mean(_fa('clv_12m'))} / {_mean(_fa('historical_clv'))} - 1", f"{_mean('clv_12m')} / {_mean('historical_clv')} - 1"),
    ("top_clv", f"max({_fa('clv_12m')})", "max(clv_12m)"),
]))
_HEALTHY = "CASE WHEN rfm_segment IN ('Champions', 'Loyal Customers') THEN 1.0 ELSE 0.0 END"
sql("kpi_persona", _kpi([
    ("segments_covered", f"count(DISTINCT {_fa('rfm_segment')})", "count(DISTINCT rfm_segment)"),
    ("avg_spend", _mean(_fa('total_spend')), _mean("total_spend")),
    ("avg_recency", _mean(_fa('recency')), _mean("recency")),
    ("healthy_share", _mean(_fa(_HEALTHY)), _mean(_HEALTHY)),
]))
sql("kpi_analyst", _kpi([
    ("customers", f"count(*) FILTER (WHERE {PRED})", "count(*)"),
    ("avg_clv", _mean(_fa('clv_12m')), _mean("clv_12m")),
    ("churn_rate", _mean(_fa('churn_flag')), _mean("churn_flag")),
    ("avg_recency", _mean(_fa('recency')), _mean("recency")),
]))

from .oracle_sql import AS_OF_PRIOR, chain, with_ctes  # noqa: E402

sql("filter_facets", on(L, """SELECT 'date_min' AS facet, strftime(min(signup_date), '%Y-%m-%d') AS value FROM labelled
UNION ALL SELECT 'date_max', strftime(max(signup_date), '%Y-%m-%d') FROM labelled
UNION ALL SELECT DISTINCT 'country', country FROM labelled WHERE country IS NOT NULL
UNION ALL SELECT DISTINCT 'cluster', CAST(cluster_id AS VARCHAR) FROM labelled WHERE cluster_id IS NOT NULL"""))
sql("filter_date_range", on(L, """SELECT customer_id, strftime(signup_date, '%Y-%m-%d') AS signup_date FROM labelled
WHERE signup_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'"""))
sql("filter_isin", on(L, f"""SELECT customer_id, country, cluster_id FROM labelled
WHERE country IN ('NATION_1', 'NATION_7', 'NATION_13') AND {PRED}"""))
sql("filter_segments", on(L, "SELECT customer_id, rfm_segment FROM labelled WHERE rfm_segment IN ('Champions', 'At Risk')"))
sql("search_customers", on(L, """SELECT customer_id, city, country FROM labelled
WHERE coalesce(regexp_matches(lower(customer_id), 'ion_1[0-4]'), false)
   OR coalesce(regexp_matches(lower(city), 'ion_1[0-4]'), false)
   OR coalesce(regexp_matches(lower(country), 'ion_1[0-4]'), false)"""))
sql("scope_segment", on(L, """SELECT customer_id, 'rfm_segment' AS scope FROM labelled WHERE rfm_segment = 'Champions'
UNION ALL SELECT customer_id, 'cluster_id' FROM labelled WHERE CAST(cluster_id AS VARCHAR) = '2'"""))
sql("segment_explorer", on(L, """SELECT customer_id, rfm_segment, r_score, f_score, m_score, rfm_score, total_spend, total_orders
FROM labelled ORDER BY rfm_score DESC, customer_id"""))
for _n in (100, 50):
    sql(f"top_risk_{_n}", on(L, f"""SELECT customer_id, rfm_segment, cluster_id, churn_probability, total_spend, satisfaction_score
FROM labelled ORDER BY churn_probability DESC NULLS LAST, customer_id LIMIT {_n}"""))
sql("top_clv_20", on(L, """SELECT customer_id, clv_12m, clv_tier, total_spend, total_orders, rfm_segment
FROM labelled ORDER BY clv_12m DESC NULLS LAST, customer_id LIMIT 20"""))

PROFILE_DIM = "(VALUES\n" + ",\n".join(
    f" ({_q(seg)}, {_q(p['channel'])}, {_q(p['offer'])}, {_q(p['tone'])}, {p['response_rate']}, {p['budget_pct']})"
    for seg, p in SEGMENT_PROFILES.items()
) + "\n) AS pr(rfm_segment, channel, offer, tone, response_rate, budget_pct)"
STRAT_BASE = """SELECT rfm_segment, cluster_id, count(customer_id) AS customer_count, avg(total_spend) AS avg_spend,
  avg(recency) AS avg_recency, avg(satisfaction_score) AS avg_satisfaction
FROM labelled WHERE rfm_segment IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1, 2"""
_FB = SEGMENT_PROFILES["New Customers"]
LOOKUP = f"""SELECT b.*, coalesce(pr.channel, {_q(_FB['channel'])}) AS channel, coalesce(pr.offer, {_q(_FB['offer'])}) AS offer,
  coalesce(pr.tone, {_q(_FB['tone'])}) AS tone, CAST(coalesce(pr.response_rate, {_FB['response_rate']}) AS DOUBLE) AS response_rate,
  CAST(coalesce(pr.budget_pct, {_FB['budget_pct']}) AS INTEGER) AS budget_pct
FROM ({STRAT_BASE}) b LEFT JOIN {PROFILE_DIM} ON b.rfm_segment = pr.rfm_segment"""
STRATEGY = f""", med AS (SELECT median(total_spend) AS ms, median(recency) AS mr, median(satisfaction_score) AS mq FROM labelled),
lk AS ({LOOKUP}),
strategy AS (
  SELECT rfm_segment, CAST(cluster_id AS INTEGER) AS cluster_id,
    CASE WHEN avg_recency > (SELECT mr FROM med) THEN 'sms' ELSE channel END AS channel,
    CASE WHEN avg_spend > (SELECT ms FROM med) THEN 'exclusive access' ELSE offer END AS offer,
    CASE WHEN avg_satisfaction < (SELECT mq FROM med) THEN 'nurturing'
         WHEN avg_recency > (SELECT mr FROM med) THEN 'urgent'
         WHEN avg_spend > (SELECT ms FROM med) THEN 'premium' ELSE tone END AS tone,
    CASE WHEN avg_spend > (SELECT ms FROM med) THEN budget_pct + 2 ELSE budget_pct END AS budget_pct,
    response_rate, CAST(customer_count AS BIGINT) AS customer_count, response_rate * customer_count AS expected_response
  FROM lk)"""
sql("strategy_base", on(L, STRAT_BASE))
sql("strategy_table", on(L, STRATEGY + " SELECT * FROM strategy"))
sql("strategy_table_filtered", on(L, f""", kept AS (SELECT * FROM labelled WHERE country IN ('NATION_1', 'NATION_7', 'NATION_13') AND {PRED})"""
    + STRATEGY.replace("FROM labelled", "FROM kept") + " SELECT * FROM strategy"))
sql("lookup_profile", on(L, f"SELECT rfm_segment, cluster_id, channel, offer, tone, response_rate, budget_pct FROM ({LOOKUP})"))
PRIMARY = """SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY rfm_segment ORDER BY customer_count DESC, cluster_id) AS _r
FROM strategy) WHERE _r = 1"""
sql("primary_strategy", on(L, STRATEGY + " " + PRIMARY))
ALLOC = """SELECT rfm_segment, cluster_id, customer_count, w / sum(w) OVER (PARTITION BY rfm_segment) * 100.0 AS allocation_pct,
  w / sum(w) OVER (PARTITION BY rfm_segment) * 100.0 / 100.0 * 50000.0 AS allocation_amount
FROM (SELECT *, CASE WHEN sum(customer_count * response_rate) OVER (PARTITION BY rfm_segment) = 0
                     THEN CAST(customer_count AS DOUBLE) ELSE customer_count * response_rate END AS w FROM strategy)"""
sql("budget_allocation", on(L, STRATEGY + " " + ALLOC))
sql("allocation_sorted", on(L, STRATEGY + " " + ALLOC + " ORDER BY rfm_segment, allocation_pct DESC, cluster_id"))
sql("revenue_lift", on(L, STRATEGY + f""", prim AS ({PRIMARY}),
tot AS (SELECT rfm_segment, CAST(sum(customer_count) AS BIGINT) AS segment_customers FROM strategy GROUP BY 1),
aov AS (SELECT rfm_segment, avg(avg_order_value) AS segment_aov FROM labelled WHERE rfm_segment IS NOT NULL GROUP BY 1)
SELECT tot.rfm_segment, tot.segment_customers, prim.response_rate AS primary_rate, aov.segment_aov,
  tot.segment_customers * prim.response_rate AS expected_orders,
  tot.segment_customers * prim.response_rate * aov.segment_aov * {min(2.0, 0.6 + 50000.0 / 100000.0)} AS expected_lift
FROM tot JOIN prim ON tot.rfm_segment = prim.rfm_segment LEFT JOIN aov ON tot.rfm_segment = aov.rfm_segment"""))
sql("kpi_strategy", on(L, STRATEGY + """ SELECT CAST(count(DISTINCT rfm_segment) AS DOUBLE) AS active_segments,
  avg(response_rate) AS avg_response_rate, avg(budget_pct) AS avg_budget_split,
  (SELECT avg(avg_order_value) FROM labelled) AS avg_order_value FROM strategy"""))

sql("rank_first", on(SCORED, "SELECT customer_id, recency, row_number() OVER (ORDER BY recency, ingest_seq) AS rank FROM scored"))
sql("rfm_base", on(SCORED, "SELECT customer_id, recency, frequency, monetary FROM scored"))
FLOW = f""", f AS (
  SELECT *, CAST(floor(date_diff('second', coalesce(last_purchase_date - INTERVAL 30 DAY, (SELECT as_of FROM params)),
                         (SELECT as_of FROM params)) / 86400) AS BIGINT) AS rec2
  FROM labelled WHERE {PRED}),
fr AS (SELECT *, row_number() OVER (ORDER BY rec2, ingest_seq) AS a, row_number() OVER (ORDER BY frequency, ingest_seq) AS b,
  row_number() OVER (ORDER BY monetary, ingest_seq) AS c, count(*) OVER () AS n FROM f),
fb AS (SELECT rfm_segment AS target,
  6 - CASE WHEN n < 2 THEN 3 ELSE greatest(1, (5 * (a - 1) + n - 2) // (n - 1)) END AS r,
  CASE WHEN n < 2 THEN 3 ELSE greatest(1, (5 * (b - 1) + n - 2) // (n - 1)) END AS fq,
  CASE WHEN n < 2 THEN 3 ELSE greatest(1, (5 * (c - 1) + n - 2) // (n - 1)) END AS m FROM fr),
flow AS (SELECT CASE
   WHEN r >= 4 AND fq >= 4 AND m >= 4 THEN 'Champions'
   WHEN r >= 3 AND fq >= 4 AND m >= 3 THEN 'Loyal Customers'
   WHEN r >= 4 AND fq >= 2 AND m >= 2 THEN 'Potential Loyalists'
   WHEN r >= 4 AND fq <= 2 AND m <= 2 THEN 'New Customers'
   WHEN r <= 2 AND fq >= 4 AND m >= 4 THEN 'Can''t Lose Them'
   WHEN r <= 2 AND fq >= 3 AND m >= 3 THEN 'At Risk'
   WHEN r <= 2 AND fq <= 2 AND m <= 2 THEN 'Hibernating'
   ELSE 'Lost Customers' END AS source, target, count(*) AS value FROM fb GROUP BY 1, 2)"""
sql("rfm_flow", on(L, FLOW + " SELECT * FROM flow"))
sql("node_labels", on(L, FLOW + " SELECT DISTINCT label FROM (SELECT source AS label FROM flow UNION SELECT target FROM flow) ORDER BY label"))
# each side is scored over the customers that had an order by then
sql("rfm_migration", with_ctes(
    chain("scored", "_p", AS_OF_PRIOR, "INTERVAL 30 DAY").replace("FROM customer c\n  LEFT JOIN cust_agg_p", "FROM customer c\n  JOIN cust_agg_p"),
    chain("scored").replace("FROM customer c\n  LEFT JOIN cust_agg a", "FROM customer c\n  JOIN cust_agg a")) + """
SELECT coalesce(p.rfm_segment, 'No orders yet') AS source, c.rfm_segment AS target, count(*) AS value
FROM scored c LEFT JOIN scored_p p ON p.customer_id = c.customer_id GROUP BY 1, 2""")


def _fmt(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL OR isnan({x}) THEN '0'
  WHEN abs({x}) >= 1000000 THEN printf('%.2fM', {x} / 1000000)
  WHEN abs({x}) >= 1000 THEN printf('%.2fK', {x} / 1000)
  ELSE printf('%.2f', {x}) END"""


sql("fmt_number", on(L, f"""SELECT rfm_segment, total_spend, {_fmt('total_spend')} AS display FROM (
  SELECT rfm_segment, sum(total_spend) AS total_spend FROM labelled WHERE rfm_segment IS NOT NULL GROUP BY 1)"""))
sql("bin_risk_band", on(L, """SELECT customer_id, churn_probability,
  CASE WHEN churn_probability < 0.3 THEN 'green' WHEN churn_probability < 0.6 THEN 'yellow' ELSE 'red' END AS risk_band FROM labelled"""))
sql("clv_tier", on(L, "SELECT customer_id, historical_clv, clv_12m, clv_tier FROM labelled"))
sql("date_shift", on(L, "SELECT customer_id, strftime(last_purchase_date - INTERVAL 30 DAY, '%Y-%m-%d') AS shifted FROM labelled"))
sql("round_bucket", on(L, "SELECT customer_id, CAST(round_even(satisfaction_score, 0) AS INTEGER) AS satisfaction_bucket FROM labelled"))
sql("chart_projection", on(L, """SELECT customer_id, recency, frequency, monetary, rfm_segment, clv_12m, churn_probability, total_orders, cluster_id
FROM labelled"""))

from .oracle_sql import SNAPSHOT, CUSTOMERS  # noqa: E402

RAW = """, raw AS (
  SELECT customer_id, ingest_seq, signup_date,
    CASE WHEN ingest_seq % 13 = 0 THEN NULL ELSE last_purchase_date END AS last_purchase_date,
    CAST(total_orders AS DOUBLE) AS total_orders,
    CASE WHEN ingest_seq % 10 = 0 THEN NULL ELSE total_spend END AS total_spend,
    CASE WHEN ingest_seq % 7 = 0 THEN NULL ELSE satisfaction_score END AS satisfaction_score,
    country, channel, CAST(support_tickets_raised AS DOUBLE) AS support_tickets_raised,
    CAST(loyalty_points AS DOUBLE) AS loyalty_points
  FROM snapshot),
e0 AS (SELECT *, CAST(floor(date_diff('second', last_purchase_date, (SELECT as_of FROM params)) / 86400) AS BIGINT) AS days,
  total_spend / nullif(total_orders, 0) AS aov FROM raw)"""
sql("enrich", on(SNAPSHOT, RAW + """
SELECT customer_id, strftime(last_purchase_date, '%Y-%m-%d') AS last_purchase_date,
  strftime(last_purchase_date, '%Y-%m-%d') AS signup_date, total_orders,
  coalesce(total_spend, (SELECT median(total_spend) FROM e0)) AS total_spend,
  coalesce(satisfaction_score, (SELECT median(satisfaction_score) FROM e0)) AS satisfaction_score,
  country, channel, support_tickets_raised, loyalty_points,
  coalesce(CAST(days AS DOUBLE), (SELECT median(days) FROM e0)) AS days_since_last_purchase,
  coalesce(aov, (SELECT median(aov) FROM e0)) AS avg_order_value,
  CASE WHEN days > 180 THEN 1 ELSE 0 END AS churn_flag,
  35 AS age, 'Unknown' AS gender, 'Unknown' AS city, 0 AS referral_count
FROM e0"""))

sql("preview_head", on(SNAPSHOT, RAW + """
SELECT CAST(customer_id AS BIGINT) AS customer_id, strftime(last_purchase_date, '%m/%d/%Y') AS last_purchase_date, CAST(total_orders AS BIGINT) AS total_orders,
  '$' || format('{:,.2f}', CAST(total_spend AS DOUBLE)) AS total_spend, satisfaction_score, country, channel,
  CAST(support_tickets_raised AS BIGINT) AS support_tickets_raised, CAST(loyalty_points AS BIGINT) AS loyalty_points, ingest_seq
FROM raw ORDER BY ingest_seq LIMIT 10"""))


def draw(salt: int) -> str:
    return f"((('0x' || substr(md5(customer_id || ':{salt}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


sql("random_split", on(L, f"SELECT {draw(42)} < 0.2 AS is_test, count(*) AS n FROM labelled GROUP BY 1"))
sql("clv_target", on(SCORED, f"""SELECT customer_id, avg_order_value * total_orders AS historical_clv,
  avg_order_value * total_orders * (1.05 + 0.12 * sqrt(-2.0 * ln({draw(85)})) * cos(2.0 * pi() * {draw(86)})) AS clv_target FROM scored"""))
VALIDATION = RAW + """, agg AS (SELECT count(*) AS n,
  count(last_purchase_date) AS nn_date, count(satisfaction_score) AS nn_sat, count(total_spend) AS nn_spend,
  avg(CASE WHEN last_purchase_date IS NULL THEN 1.0 ELSE 0.0 END) AS bad_date,
  avg(CASE WHEN total_spend IS NULL THEN 1.0 ELSE 0.0 END) AS bad_spend,
  avg(CASE WHEN satisfaction_score IS NULL THEN 1.0 ELSE 0.0 END) AS bad_sat FROM raw),
report AS (
  SELECT 'derived_column' AS "check", 'days_since_last_purchase' AS "column", CAST(NULL AS DOUBLE) AS value, 'warning' AS status
  UNION ALL SELECT 'all_null_required', 'customer_id', n, 'ok' FROM agg
  UNION ALL SELECT 'all_null_required', 'last_purchase_date', nn_date, CASE WHEN nn_date = 0 THEN 'error' ELSE 'ok' END FROM agg
  UNION ALL SELECT 'all_null_required', 'total_orders', n, 'ok' FROM agg
  UNION ALL SELECT 'all_null_required', 'total_spend', nn_spend, 'ok' FROM agg
  UNION ALL SELECT 'missing_optional', c, NULL, 'warning' FROM (VALUES ('age'), ('gender'), ('city'), ('churn_flag'), ('avg_order_value'), ('referral_count')) t(c)
  UNION ALL SELECT 'all_null_optional', 'country', n, 'ok' FROM agg
  UNION ALL SELECT 'all_null_optional', 'satisfaction_score', nn_sat, CASE WHEN nn_sat = 0 THEN 'warning' ELSE 'ok' END FROM agg
  UNION ALL SELECT 'all_null_optional', 'channel', n, 'ok' FROM agg
  UNION ALL SELECT 'all_null_optional', 'loyalty_points', n, 'ok' FROM agg
  UNION ALL SELECT 'all_null_optional', 'support_tickets_raised', n, 'ok' FROM agg
  UNION ALL SELECT 'row_count', NULL, n, CASE WHEN n < 3 THEN 'warning' ELSE 'ok' END FROM agg
  UNION ALL SELECT 'null_count', 'customer_id', 0, 'info'
  UNION ALL SELECT 'null_count', 'last_purchase_date', n - nn_date, 'info' FROM agg
  UNION ALL SELECT 'null_count', 'total_orders', 0, 'info'
  UNION ALL SELECT 'null_count', 'total_spend', n - nn_spend, 'info' FROM agg
  UNION ALL SELECT 'null_count', 'country', 0, 'info'
  UNION ALL SELECT 'null_count', 'satisfaction_score', n - nn_sat, 'info' FROM agg
  UNION ALL SELECT 'null_count', 'channel', 0, 'info'
  UNION ALL SELECT 'null_count', 'loyalty_points', 0, 'info'
  UNION ALL SELECT 'null_count', 'support_tickets_raised', 0, 'info'
  UNION ALL SELECT 'type_issue', 'last_purchase_date', bad_date, CASE WHEN bad_date > 0.4 THEN 'issue' ELSE 'ok' END FROM agg
  UNION ALL SELECT 'type_issue', 'total_orders', 0.0, 'ok'
  UNION ALL SELECT 'type_issue', 'loyalty_points', 0.0, 'ok'
  UNION ALL SELECT 'type_issue', 'support_tickets_raised', 0.0, 'ok'
  UNION ALL SELECT 'type_issue', 'total_spend', bad_spend, CASE WHEN bad_spend > 0.4 THEN 'issue' ELSE 'ok' END FROM agg
  UNION ALL SELECT 'type_issue', 'satisfaction_score', bad_sat, CASE WHEN bad_sat > 0.6 THEN 'issue' ELSE 'ok' END FROM agg
  UNION ALL SELECT 'is_valid', NULL, CASE WHEN nn_date > 0 AND n > 0 THEN 1 ELSE 0 END, 'info' FROM agg)"""
sql("validation_report", on(SNAPSHOT, VALIDATION + ' SELECT "check", "column", CAST(value AS DOUBLE) AS value, status FROM report'))
sql("null_summary", on(SNAPSHOT, VALIDATION + """ SELECT "column", CAST(value AS BIGINT) AS null_count FROM report WHERE "check" = 'null_count'"""))
sql("type_issues", on(SNAPSHOT, VALIDATION + """ SELECT "column", CAST(value AS DOUBLE) AS bad_share, status = 'issue' AS flagged
FROM report WHERE "check" = 'type_issue'"""))
sql("scan_active", on(CUSTOMERS, """SELECT customer_id, total_orders, total_spend, CAST(days_since_last_purchase AS DOUBLE) AS days_since_last_purchase, avg_order_value, churn_flag
FROM customers"""))
sql("dedup_keep_last", """SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE user_id IS NOT NULL) WHERE r = 1""")
sql("clean_currency", "SELECT o_orderkey, o_totalprice AS amount FROM orders")
sql("parse_dates", """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                                            ELSE strftime(o_orderdate, '%d/%m/%Y') END AS text FROM orders),
mf AS (SELECT *, coalesce(try_strptime(text, '%Y-%m-%d'), try_strptime(text, '%m/%d/%Y')) AS m FROM t),
share AS (SELECT avg(CASE WHEN m IS NULL THEN 1.0 ELSE 0.0 END) AS s FROM mf)
SELECT o_orderkey, strftime(CASE WHEN (SELECT s FROM share) > 0.3 THEN coalesce(m, try_strptime(text, '%d/%m/%Y')) ELSE m END, '%Y-%m-%d') AS parsed
FROM mf""")
sql("coerce_numeric", """WITH t AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_quantity AS VARCHAR)
       WHEN l_linenumber % 4 = 1 THEN '  ' || CAST(l_quantity AS VARCHAR) || ' '
       WHEN l_linenumber % 4 = 2 THEN CAST(l_quantity AS VARCHAR) || 'd'
       ELSE 'n/a' END AS text FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN regexp_full_match(text, '\\s*[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)\\s*') THEN TRY_CAST(trim(text) AS DOUBLE) END AS quantity
FROM t""")

_Z = ["age", "total_orders", "total_spend", "avg_order_value", "loyalty_points", "support_tickets_raised",
      "satisfaction_score", "referral_count", "days_since_last_purchase", "recency", "frequency", "monetary", "rfm_score"]
sql("feature_zscores", on(SCORED, "SELECT customer_id, " + ", ".join(
    f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / (CASE WHEN coalesce(stddev_pop({c}) OVER (), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) OVER () END) AS z_{c}"
    for c in _Z) + " FROM scored"))

EMB = """WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
               WHERE label IS NOT NULL AND label <> -1),
dims AS (SELECT label, i, avg(v) AS c FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e) GROUP BY 1, 2),
cent AS (SELECT label, list(c ORDER BY i) AS mu FROM dims GROUP BY 1),
sizes AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
pairs AS (SELECT a.vec_id, a.label AS la, b.label AS lb, pow(list_distance(a.x, b.x), 2) AS d2
          FROM e a JOIN e b ON a.vec_id <> b.vec_id),
per AS (SELECT vec_id, la, lb, avg(d2) AS md FROM pairs GROUP BY 1, 2, 3),
ab AS (SELECT e.vec_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b
       FROM e LEFT JOIN per ON e.vec_id = per.vec_id GROUP BY e.vec_id),
sil AS (SELECT avg(CASE WHEN a IS NULL THEN 0.0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END) AS silhouette FROM ab),
spread AS (SELECT e.label, avg(list_distance(e.x, cent.mu)) AS s, sum(pow(list_distance(e.x, cent.mu), 2)) AS w
           FROM e JOIN cent ON e.label = cent.label GROUP BY 1),
db AS (SELECT avg(worst) AS davies_bouldin FROM (
         SELECT a.label, max(CASE WHEN list_distance(a.mu, b.mu) = 0 THEN 0.0 ELSE (sa.s + sb.s) / list_distance(a.mu, b.mu) END) AS worst
         FROM cent a JOIN cent b ON a.label <> b.label JOIN spread sa ON sa.label = a.label JOIN spread sb ON sb.label = b.label
         GROUP BY a.label)),
odims AS (SELECT i, avg(v) AS c FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e) GROUP BY 1),
overall AS (SELECT list(c ORDER BY i) AS mu FROM odims),
ch AS (SELECT (sum(sizes.n * pow(list_distance(cent.mu, (SELECT mu FROM overall)), 2)) / (count(*) - 1))
            / ((SELECT sum(w) FROM spread) / ((SELECT count(*) FROM e) - count(*))) AS calinski_harabasz
       FROM cent JOIN sizes ON cent.label = sizes.label)"""
sql("cluster_metrics", EMB + """
SELECT (SELECT silhouette FROM sil) AS silhouette, (SELECT davies_bouldin FROM db) AS davies_bouldin,
  (SELECT calinski_harabasz FROM ch) AS calinski_harabasz, CAST((SELECT count(*) FROM cent) AS INTEGER) AS n_clusters""")
PLAIN = """, plain AS (SELECT vec_id, la, lb, avg(sqrt(d2)) AS md FROM pairs GROUP BY 1, 2, 3),
pab AS (SELECT e.vec_id, e.label, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b
        FROM e LEFT JOIN plain ON e.vec_id = plain.vec_id GROUP BY 1, 2),
psil AS (SELECT vec_id, label, CASE WHEN a IS NULL THEN 0.0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END AS silhouette FROM pab)"""
sql("silhouette_euclidean", EMB + PLAIN + " SELECT vec_id, label, silhouette FROM psil")
sql("cluster_metrics_many", EMB.replace("CAST(label AS BIGINT) AS label", "vec_id // 5 AS label") + PLAIN + """
SELECT (SELECT avg(silhouette) FROM psil) AS silhouette, (SELECT davies_bouldin FROM db) AS davies_bouldin,
  (SELECT calinski_harabasz FROM ch) AS calinski_harabasz, CAST((SELECT count(*) FROM cent) AS INTEGER) AS n_clusters""")


def _steps(k: int, steps: int) -> str:
    """Lloyd's steps from the k vectors of smallest id, as a chain of CTEs."""
    out = f"""c{k}_0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, x AS mu FROM e ORDER BY vec_id LIMIT {k})"""
    for i in range(steps + 1):
        out += f""", a{k}_{i} AS (SELECT vec_id, x, arg_min(c, d * 1000 + c * 1e-9) AS c, min(d) AS d FROM (
  SELECT vec_id, x, c, pow(list_distance(x, mu), 2) AS d FROM e JOIN c{k}_{i} ON TRUE) GROUP BY vec_id, x)"""
        if i < steps:
            out += f""", c{k}_{i + 1} AS (SELECT c, list(m ORDER BY i) AS mu FROM (
  SELECT c, i, avg(v) AS m FROM (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k}_{i}) GROUP BY c, i) GROUP BY c)"""
    return out


sql("kmeans_fixed_steps", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), "
    + ", ".join(_steps(k, 3) for k in (2, 3, 5)) + " " + " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS k, CAST(c AS INTEGER) AS cluster, (SELECT sum(d) FROM a{k}_3) AS inertia, count(*) AS n FROM a{k}_3 GROUP BY c" for k in (2, 3, 5)))
sql("count_clusters", "SELECT count(DISTINCT CASE WHEN label >= 0 THEN label END) AS n_clusters FROM embeddings")
sql("minmax_normalize", on(L, f""", p AS ({CLUSTER_PROFILE})
SELECT cluster_id,
  coalesce(CASE WHEN max(total_spend) OVER () IS NULL THEN 0.0 WHEN min(total_spend) OVER () = max(total_spend) OVER () THEN 0.5
       ELSE (total_spend - min(total_spend) OVER ()) / (max(total_spend) OVER () - min(total_spend) OVER ()) END, 0.0) AS spend_norm,
  coalesce(CASE WHEN max(recency) OVER () IS NULL THEN 0.0 WHEN min(recency) OVER () = max(recency) OVER () THEN 0.5
       ELSE 1.0 - (recency - min(recency) OVER ()) / (max(recency) OVER () - min(recency) OVER ()) END, 0.0) AS recency_norm
FROM p"""))
sql("balanced_class_weight", on(L, """SELECT churn_flag, count(*) AS n,
  (SELECT count(*) FROM labelled) / (CAST((SELECT count(DISTINCT churn_flag) FROM labelled) AS DOUBLE) * count(*)) AS class_weight
FROM labelled GROUP BY churn_flag"""))
CONF = """, cm AS (SELECT CAST(churn_flag AS VARCHAR) AS y, CAST(CAST(churn_probability >= 0.5 AS INTEGER) AS VARCHAR) AS p FROM labelled),
cls AS (SELECT y AS cls FROM cm UNION SELECT p FROM cm),
per AS (SELECT cls.cls,
   (SELECT count(*) FROM cm WHERE y = cls.cls AND p = cls.cls) AS tp,
   (SELECT count(*) FROM cm WHERE y = cls.cls) AS support,
   (SELECT count(*) FROM cm WHERE p = cls.cls) AS predicted FROM cls),
pr AS (SELECT cls, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
   CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, CAST(support AS DOUBLE) AS support, tp FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score FROM pr)"""
sql("classification_report", on(L, CONF + """
SELECT cls, precision, recall, f1_score, support FROM f
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1_score * support) / sum(support), sum(support) FROM f"""))
HIST = """, h AS (SELECT CAST(churn_probability AS DOUBLE) AS score, sum(churn_flag) AS pos, sum(1 - churn_flag) AS neg
  FROM labelled GROUP BY 1)"""
sql("roc_curve", on(L, HIST + """
SELECT score AS threshold, sum(neg) OVER (ORDER BY score DESC) / (SELECT sum(neg) FROM h) AS fpr,
  sum(pos) OVER (ORDER BY score DESC) / (SELECT sum(pos) FROM h) AS tpr FROM h"""))
sql("roc_auc", on(L, HIST + """, c AS (SELECT *, sum(pos + neg) OVER (ORDER BY score) AS cum FROM h)
SELECT (sum(pos * (cum - pos - neg + (pos + neg + 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(neg)) AS auc FROM c"""))

KNN = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT a.vec_id, list_distance(a.x, b.x) AS dist FROM e a JOIN e b ON TRUE),
r AS (SELECT vec_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS rk FROM d),
kd AS (SELECT vec_id, dist AS kd FROM r WHERE rk = 5)"""
sql("kdistance", KNN + " SELECT vec_id, kd FROM kd")
sql("kdistance_eps", KNN + """, q AS (SELECT unnest([
  quantile_cont(kd, 0.70), quantile_cont(kd, 0.75), quantile_cont(kd, 0.80), quantile_cont(kd, 0.85),
  quantile_cont(kd, 0.90), quantile_cont(kd, 0.92), quantile_cont(kd, 0.95)]) AS v FROM kd)
SELECT DISTINCT round(v, 4) AS eps FROM q""")

sql("snapshot_stream", """SELECT o_custkey, count(*) AS total_orders,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spend,
  strftime(max(o_orderdate), '%Y-%m-%d') AS last_purchase_date, strftime(min(o_orderdate), '%Y-%m-%d') AS signup_date
FROM orders GROUP BY o_custkey""")
sql("scan_csv", on(SNAPSHOT, """SELECT customer_id, total_orders,
  CASE WHEN ingest_seq % 10 = 0 THEN NULL ELSE '$' || format('{:,.2f}', total_spend) END AS total_spend, ingest_seq
FROM snapshot"""))
sql("sink_rows_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
_SYN = ", ".join(f"({i}, '{k}', '{std}')" for i, (k, std) in enumerate((k, std) for std, ks in SYNONYMS.items() for k in ks))
_TABS = ", ".join(f"'{t}'" for t in TABLES)
_MAPPED = f"""WITH syn(pos, key, standard) AS (VALUES {_SYN}),
cols AS (SELECT DISTINCT table_name AS source, column_name AS "column" FROM information_schema.columns WHERE table_name IN ({_TABS})),
hit AS (SELECT source, "column", standard, row_number() OVER (PARTITION BY source, "column" ORDER BY length(key) DESC, pos) AS r
  FROM cols JOIN syn ON key <> '' AND contains(regexp_replace(lower("column"), '[^\\p{{L}}\\p{{N}}]', '', 'g'), key)),
mapped AS (SELECT c.source, c."column", h.standard FROM cols c LEFT JOIN hit h ON h.source = c.source AND h."column" = c."column" AND h.r = 1)
"""
sql("auto_map_columns", _MAPPED + """SELECT source, "column", standard FROM mapped""")
sql("mapping_status", _MAPPED + """SELECT source, "column", standard, CASE WHEN standard IS NULL THEN 'skipped' ELSE 'matched' END AS status FROM mapped""")
sql("sink_segment_csv", on(L, """SELECT customer_id, rfm_segment, rfm_score, total_spend, total_orders
FROM labelled WHERE rfm_segment = 'Champions'"""))

sql("stratified_split", on(L, """, c AS (SELECT churn_flag, count(*) AS n FROM labelled GROUP BY 1)
SELECT churn_flag, true AS is_test, CAST(ceil(n * 0.2) AS BIGINT) AS n FROM c WHERE ceil(n * 0.2) > 0
UNION ALL SELECT churn_flag, false, CAST(n - ceil(n * 0.2) AS BIGINT) FROM c WHERE n - ceil(n * 0.2) > 0"""))

sql("dbscan_embeddings", KNN.replace("WITH ", "WITH RECURSIVE ", 1) + """,
eps AS (SELECT round(quantile_cont(kd, 0.30), 4) AS eps FROM kd),
nb AS (SELECT a.vec_id AS u, b.vec_id AS v, list_distance(a.x, b.x) AS dist FROM e a JOIN e b ON list_distance(a.x, b.x) <= (SELECT eps FROM eps)),
core AS (SELECT u AS vec_id FROM nb GROUP BY u HAVING count(*) >= 5),
cedge AS (SELECT u, v FROM nb WHERE u IN (SELECT vec_id FROM core) AND v IN (SELECT vec_id FROM core)),
reach(src, dst) AS (
  SELECT u, v FROM cedge
  UNION
  SELECT r.src, c.v FROM reach r JOIN cedge c ON r.dst = c.u),
comp AS (SELECT core.vec_id, least(core.vec_id, coalesce(min(r.dst), core.vec_id)) AS comp
         FROM core LEFT JOIN reach r ON r.src = core.vec_id GROUP BY core.vec_id),
num AS (SELECT comp, dense_rank() OVER (ORDER BY comp) - 1 AS cluster FROM (SELECT DISTINCT comp FROM comp)),
core_lab AS (SELECT comp.vec_id, num.cluster FROM comp JOIN num ON comp.comp = num.comp),
border AS (SELECT nb.u AS vec_id, arg_min(nb.v, (nb.dist, nb.v)) AS core_id FROM nb
           WHERE nb.u NOT IN (SELECT vec_id FROM core) AND nb.v IN (SELECT vec_id FROM core) GROUP BY nb.u)
SELECT e.vec_id, CAST(coalesce(cl.cluster, bl.cluster, -1) AS BIGINT) AS dbscan_label
FROM e LEFT JOIN core_lab cl ON e.vec_id = cl.vec_id
LEFT JOIN border b ON e.vec_id = b.vec_id LEFT JOIN core_lab bl ON b.core_id = bl.vec_id""")


def _emb_metrics(label_expr: str, sfx: str) -> str:
    """CTEs computing silhouette (squared Euclidean, brute force over all
    pairs), Davies–Bouldin, Calinski–Harabasz and inertia for one labeling."""
    return f"""
e{sfx} AS (SELECT vec_id, CAST({label_expr} AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
dims{sfx} AS (SELECT label, i, avg(v) AS c FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e{sfx}) GROUP BY 1, 2),
cent{sfx} AS (SELECT label, list(c ORDER BY i) AS mu FROM dims{sfx} GROUP BY 1),
sizes{sfx} AS (SELECT label, count(*) AS n FROM e{sfx} GROUP BY 1),
per{sfx} AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg(pow(list_distance(a.x, b.x), 2)) AS md
             FROM e{sfx} a JOIN e{sfx} b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
ab{sfx} AS (SELECT e.vec_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b
            FROM e{sfx} e LEFT JOIN per{sfx} p ON e.vec_id = p.vec_id GROUP BY e.vec_id),
spread{sfx} AS (SELECT e.label, avg(list_distance(e.x, c.mu)) AS s, sum(pow(list_distance(e.x, c.mu), 2)) AS w
                FROM e{sfx} e JOIN cent{sfx} c ON e.label = c.label GROUP BY 1),
odims{sfx} AS (SELECT i, avg(v) AS c FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e{sfx}) GROUP BY 1),
m{sfx} AS (SELECT
  (SELECT avg(CASE WHEN a IS NULL THEN 0.0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END) FROM ab{sfx}) AS silhouette,
  (SELECT avg(worst) FROM (SELECT a.label, max(CASE WHEN list_distance(a.mu, b.mu) = 0 THEN 0.0
       ELSE (sa.s + sb.s) / list_distance(a.mu, b.mu) END) AS worst
     FROM cent{sfx} a JOIN cent{sfx} b ON a.label <> b.label JOIN spread{sfx} sa ON sa.label = a.label
     JOIN spread{sfx} sb ON sb.label = b.label GROUP BY a.label)) AS davies_bouldin,
  (SELECT (sum(z.n * pow(list_distance(c.mu, (SELECT list(c ORDER BY i) FROM odims{sfx})), 2)) / (count(*) - 1))
          / ((SELECT sum(w) FROM spread{sfx}) / ((SELECT count(*) FROM e{sfx}) - count(*)))
     FROM cent{sfx} c JOIN sizes{sfx} z ON c.label = z.label) AS calinski_harabasz,
  CAST((SELECT count(*) FROM cent{sfx}) AS INTEGER) AS n_clusters,
  (SELECT sum(w) FROM spread{sfx}) AS inertia)"""


_FIXED = [("label", "label"), ("label_mod3", "label % 3"), ("vec_mod4", "vec_id % 4")]
_CANDS = "WITH " + ",".join(_emb_metrics(expr, f"_{i}") for i, (_, expr) in enumerate(_FIXED)) + """,
cands AS (""" + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{n}' AS name, * FROM m_{i}" for i, (n, _) in enumerate(_FIXED)) + ")"


def _norm(col: str, higher_better: bool) -> str:
    base = (f"CASE WHEN max({col}) OVER () IS NULL THEN 0.0 WHEN min({col}) OVER () = max({col}) OVER () THEN 0.5 "
            f"ELSE ({col} - min({col}) OVER ()) / (max({col}) OVER () - min({col}) OVER ()) END")
    if not higher_better:
        base = (f"CASE WHEN max({col}) OVER () IS NULL THEN 0.0 WHEN min({col}) OVER () = max({col}) OVER () THEN 0.5 "
                f"ELSE 1.0 - ({col} - min({col}) OVER ()) / (max({col}) OVER () - min({col}) OVER ()) END")
    return f"coalesce(CASE WHEN {col} IS NULL THEN 0.0 ELSE {base} END, 0.0)"


sql("algorithm_comparison_fixed", _CANDS + f""",
scored AS (SELECT *, 0.5 * {_norm('silhouette', True)} + 0.25 * {_norm('davies_bouldin', False)}
                     + 0.25 * {_norm('calinski_harabasz', True)} AS score FROM cands)
SELECT name AS algorithm, n_clusters, silhouette, davies_bouldin, calinski_harabasz, score,
  row_number() OVER (ORDER BY score DESC, pos) = 1 AS is_best FROM scored""")
sql("kmeans_select_fixed", _CANDS + f""",
scored AS (SELECT *, 0.45 * {_norm('silhouette', True)} + 0.2 * {_norm('calinski_harabasz', True)}
                     + 0.2 * {_norm('davies_bouldin', False)} + 0.15 * {_norm('inertia', False)} AS score FROM cands)
SELECT name AS labeling, n_clusters, inertia, score, row_number() OVER (ORDER BY score DESC, pos) = 1 AS is_best FROM scored""")

sql("kpi_clustering_fixed", _CANDS + f""",
scored AS (SELECT *, 0.5 * {_norm('silhouette', True)} + 0.25 * {_norm('davies_bouldin', False)}
                     + 0.25 * {_norm('calinski_harabasz', True)} AS score FROM cands)
SELECT name AS algorithm, score, n_clusters, silhouette, davies_bouldin,
  (SELECT max(score) FROM scored) AS best_score, (SELECT max(n_clusters) FROM scored) AS max_clusters,
  (SELECT max(silhouette) FROM scored) AS best_silhouette, (SELECT min(davies_bouldin) FROM scored) AS best_davies_bouldin
FROM scored WHERE name = 'label'""")
sql("scenario_inputs", on(L, """, med AS (SELECT median(recency) AS recency, median(frequency) AS frequency, median(monetary) AS monetary,
  median(satisfaction_score) AS satisfaction_score, median(support_tickets_raised) AS support_tickets_raised,
  median(days_since_last_purchase) AS days_since_last_purchase, median(cluster_id) AS cluster_id FROM labelled),
scen AS (SELECT rfm_segment, avg(recency) AS recency, avg(satisfaction_score) AS satisfaction_score,
  avg(support_tickets_raised) AS support_tickets_raised FROM labelled GROUP BY rfm_segment)
SELECT s.rfm_segment, coalesce(s.recency, m.recency) AS recency, CAST(m.frequency AS DOUBLE) AS frequency,
  CAST(m.monetary AS DOUBLE) AS monetary, coalesce(s.satisfaction_score, m.satisfaction_score) AS satisfaction_score,
  coalesce(s.support_tickets_raised, m.support_tickets_raised) AS support_tickets_raised,
  CAST(m.days_since_last_purchase AS DOUBLE) AS days_since_last_purchase, CAST(m.cluster_id AS DOUBLE) AS cluster_id
FROM scen s, med m"""))
