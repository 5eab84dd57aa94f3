"""The named queries written out in plain SQL, as an independent statement of their results.

Nothing here is used by the library. Rounding goes through a decimal, as in the
library, so that ties agree.
"""

from __future__ import annotations

from auditflow.plans import methods
from auditflow.plans.queries import BASELINE, CHANNELS, CURRENT, DIRTY_CUTOFF, EVENT_TRANSITIONS, PLAN_DEPENDENCIES, SECRETS, TABLES

# Trigger words, keywords and statuses, written out once more so that a slip in the library shows.
class q:
    UNANSWERABLE_TRIGGERS = (
        "competitor", "competition", "inflation", "competitor price", "weather", "rating", "television", "external stockout",
        "customer satisfaction", "nps", "competidor", "competencia", "inflación", "precio de la competencia", "clima",
    )
    NEW_ANALYSIS_TRIGGERS = (
        "new analysis", "predictive model", "cluster", "clustering", "decision tree", "predict the future", "price optimization",
        "price elasticity", "nuevo análisis", "modelo predictivo", "predecir",
    )
    RECALCULATE_TRIGGERS = (
        "how much did", "how much was sold", "calculate", "recalculate", "filter by", "filtered by", "only in", "region",
        "channel", "cuánto vendió", "cuanto vendio", "calcular", "recalcular", "si filtramos", "filtrar por", "sólo en",
        "solo en", "región",
    )
    QUANTITY_PHRASES = (
        "how much", "cuánto", "cuanto", "sales in", "ventas en",
    )
    UNANSWERABLE = "unanswerable_by_data"
    NEW_ANALYSIS = "request_new_analysis"
    RECALCULATE = "recalculate_with_filters"
    EXPLAIN = "explain_existing_result"
    REGION_KEYWORDS = {
        "metropolitana": "Metropolitan",
        "metropolitan": "Metropolitan",
        "norte": "North",
        "north": "North",
        "centro": "Central",
        "central": "Central",
        "sur": "South",
        "south": "South",
    }
    CHANNEL_KEYWORDS = {
        "mayorista": "Wholesale / B2B",
        "wholesale": "Wholesale / B2B",
        "retail": "Retail / Stores",
        "tiendas": "Retail / Stores",
        "stores": "Retail / Stores",
        "online": "Online / Direct",
        "directo": "Online / Direct",
        "direct": "Online / Direct",
    }


EXCLUDED_STATUSES = ("CANCELLED", "REFUNDED", "CANCELADO", "DEVUELTO",)


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _round(expr: str, places: int = 2) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {places}) AS DOUBLE)"


def _ratio(num: str, den: str, places: int = 2, factor: str = "") -> str:
    quotient = f"CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE){factor}"
    return f"CASE WHEN ({den}) <> 0 THEN {_round(quotient, places)} ELSE 0.0 END"


def _pct(num: str, den: str, places: int = 2) -> str:
    return _ratio(num, den, places, " * 100")


# ---------------------------------------------------------------------------
# Views
# ---------------------------------------------------------------------------
SALES = """
sales AS (
  SELECT o.o_orderkey AS order_id, o.o_orderdate AS order_date, o.o_custkey AS customer_id,
         l.l_partkey AS product_id, o.o_orderpriority AS channel, CAST(l.l_quantity AS BIGINT) AS units,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS gross_sales,
         CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS discount_amount,
         CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS net_sales,
         CASE l.l_returnflag WHEN 'R' THEN 'REFUNDED' ELSE 'COMPLETED' END AS status
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""

LAST_MONTH = """
last_month AS (
  SELECT date_trunc('month', o_orderdate) AS m, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, count(*) AS n
  FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 1
),
closed AS (
  SELECT CASE WHEN days < 15 AND days < day(last_day(m)) THEN CAST(m AS DATE) - 1 ELSE last_day(m) END AS cutoff FROM last_month
)"""

PREPARED = f"""{SALES},{LAST_MONTH},
prepared AS (
  SELECT *, CAST(order_date AS DATE) AS day FROM sales
  WHERE status NOT IN ({_list(EXCLUDED_STATUSES)}) AND CAST(order_date AS DATE) <= (SELECT cutoff FROM closed)
)"""

CUSTOMERS = """
customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, n_name AS nation, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

WITH_CUSTOMERS = f"""{PREPARED},{CUSTOMERS},
enriched AS (
  SELECT p.*, c.segment, c.region FROM prepared p LEFT JOIN customers c ON p.customer_id = c.customer_id
)"""

DIRTY_ORDERS = """
dirty_orders AS (
  SELECT o_orderkey AS order_id, lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS customer_id,
         CAST(o_totalprice AS DECIMAL(18,4)) AS net_sales,
         CASE WHEN o_orderkey % 211 = 0 THEN '2001-02-30' WHEN o_orderkey % 503 = 0 THEN 'CORRUPT_DATE'
              WHEN o_orderkey % 701 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
         CASE o_orderstatus WHEN 'P' THEN 'CANCELLED' ELSE 'COMPLETED' END AS status
  FROM orders
),
parsed_orders AS (
  SELECT *, CASE WHEN regexp_matches(order_date, '^\\d{4}-\\d{2}-\\d{2}$')
                 THEN CAST(try_strptime(order_date, '%Y-%m-%d') AS DATE) END AS day
  FROM dirty_orders
)"""

DIRTY_CUSTOMERS = """
dirty_customers AS (
  SELECT CASE WHEN c_custkey % 97 = 0 THEN 'X' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')
              ELSE lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS customer_id,
         c_name || branch AS customer_name, c_mktsegment AS segment, c_nationkey AS nation_id
  FROM (SELECT *, unnest(CASE WHEN c_custkey % 50 = 0 THEN ['', ' (Secondary Branch)'] ELSE [''] END) AS branch FROM customer)
)"""

TEXT_TABLES = """
text_orders AS (
  SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, o_orderpriority AS channel FROM orders
),
text_parts AS (
  SELECT lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS part_no, p_name AS part_name,
         CASE WHEN p_size > 40 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size,
         replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') AS price FROM part
)"""

LABELLED = f"""{WITH_CUSTOMERS},
labelled AS (
  SELECT order_id, net_sales,
         CASE region WHEN 'AFRICA' THEN 'South' WHEN 'EUROPE' THEN 'North' WHEN 'ASIA' THEN 'Central' ELSE 'Metropolitan' END AS region,
         CASE WHEN channel IN ('1-URGENT', '2-HIGH') THEN 'Wholesale / B2B'
              WHEN channel IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'Retail / Stores' ELSE 'Online / Direct' END AS channel
  FROM enriched
)"""

CUSTOMER_QUESTIONS = """
customer_questions AS (
  SELECT 'customer-' || CAST(c_custkey AS VARCHAR) AS question_id,
         CASE c_custkey % 6
           WHEN 0 THEN 'How much did the ' || place || ' region sell via ' || way || '?'
           WHEN 1 THEN '¿Cuánto vendió la región ' || place || '?'
           WHEN 2 THEN 'Which competitor lowered prices for ' || c_mktsegment || '?'
           WHEN 3 THEN 'Build a predictive model of ' || c_mktsegment || ' sales'
           WHEN 4 THEN 'Filter by ' || way || ' and tell me how much it was'
           ELSE 'Why did ' || c_mktsegment || ' fall?' END AS question
  FROM (SELECT *, (['North', 'sur', 'Central', 'Metropolitan', 'Norte'])[c_custkey % 5 + 1] AS place,
               (['wholesale', 'stores', 'online', 'mayorista', 'any'])[c_custkey % 7 % 5 + 1] AS way FROM customer)
)"""

QUESTIONS = f"""{CUSTOMER_QUESTIONS},
questions AS (
  SELECT * FROM customer_questions
  UNION ALL SELECT 'turn-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations
  UNION ALL SELECT 'document-' || CAST(doc_id AS VARCHAR), text FROM documents
)"""

FIGURES = """
figures AS (
  SELECT o_custkey AS result_id, o_orderkey AS item,
         CASE WHEN o_orderkey % 499 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 883 = 0 THEN 'Infinity'::DOUBLE ELSE o_totalprice END AS value
  FROM orders
),
finite AS (
  SELECT result_id, count(*) AS figures, count(*) FILTER (WHERE isnan(value) OR isinf(value)) AS bad FROM figures GROUP BY 1
),
statuses AS (
  SELECT c_custkey AS result_id, c_mktsegment AS run_id, CASE WHEN coalesce(bad, 0) > 0 THEN 1 ELSE 0 END AS failed_checks,
         CASE WHEN coalesce(bad, 0) > 0 THEN 'rejected' WHEN c_acctbal < 0 THEN 'approved_with_warnings' ELSE 'approved' END AS validation_status
  FROM customer LEFT JOIN finite ON c_custkey = result_id
)"""

RUN_LOG = """
run_log AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS run_id, event_type AS stage, ts AS created_at, value, props,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'R' || CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) AS result_id
  FROM events
),
event_results AS (
  SELECT run_id, result_id, CASE WHEN value > 100 THEN 'rejected' ELSE 'approved' END AS validation_status
  FROM run_log WHERE stage IN ('signup', 'view')
),
components AS (
  SELECT run_id, event_id AS component_id, CASE WHEN stage = 'purchase' THEN 'card' ELSE 'chart' END AS kind, result_id,
         CASE WHEN value > 10 THEN 'Total Net Change' ELSE 'Baseline' END AS title,
         CASE WHEN value > 5 THEN '2024-01' ELSE '2023-12' END AS period, stage = 'error' AS is_primary, k % 5 AS points
  FROM run_log WHERE stage NOT IN ('signup', 'view')
)"""

COMPONENT_CHECKS = f"""{RUN_LOG},
result_states AS (SELECT run_id, result_id, bool_or(validation_status = 'rejected') AS is_rejected FROM event_results GROUP BY ALL),
component_checks AS (
  SELECT c.*, CASE WHEN is_rejected IS NULL THEN 'cites an unknown result' WHEN is_rejected THEN 'cites a rejected result'
                   WHEN kind = 'chart' AND coalesce(points, 0) = 0 THEN 'is empty' END AS problem
  FROM components c LEFT JOIN result_states r ON c.run_id = r.run_id AND c.result_id = r.result_id
)"""

PLAN_STEPS = f"""{RUN_LOG},
steps AS (
  SELECT run_id AS plan_id, event_id AS step_order,
         CASE stage WHEN 'signup' THEN '{methods.SUMMARY}' WHEN 'click' THEN '{methods.TREND}' WHEN 'purchase' THEN '{methods.COMPARISON}'
                    WHEN 'view' THEN '{methods.BREAKDOWN_CHANNEL}' ELSE 'OP_99_UNREGISTERED' END AS step_id,
         value > 60 AS names_unknown_column
  FROM run_log
),
gated AS (
  SELECT plan_id, step_order, step_id,
         CASE WHEN step_id = 'OP_99_UNREGISTERED' THEN 'unregistered_step' WHEN names_unknown_column THEN 'unknown_column' END AS rejection
  FROM steps
)"""


# ---------------------------------------------------------------------------
# Shared pieces
# ---------------------------------------------------------------------------
def _in_month(period: str, c: str = "order_date") -> str:
    return f"strftime({c}, '%Y-%m') = '{period}'"


def _members(source: str, dimensions: dict[str, str]) -> str:
    """One SELECT per dimension with the sums of both months."""
    parts = [
        f"""SELECT '{name}' AS dimension, {expr} AS dimension_value,
              coalesce(sum(net_sales) FILTER (WHERE {_in_month(BASELINE)}), 0) AS b,
              coalesce(sum(net_sales) FILTER (WHERE {_in_month(CURRENT)}), 0) AS c
            FROM {source} WHERE {_in_month(BASELINE)} OR {_in_month(CURRENT)} GROUP BY 2"""
        for name, expr in dimensions.items()
    ]
    union = " UNION ALL ".join(parts)
    return f"""
members AS ({union}),
base AS (
  SELECT coalesce(sum(net_sales) FILTER (WHERE {_in_month(BASELINE)}), 0) AS tb,
         coalesce(sum(net_sales) FILTER (WHERE {_in_month(CURRENT)}), 0) AS tc FROM prepared
),
totals AS (SELECT dimension, any_value(tb) AS tb, any_value(tc) AS tc, sum(c - b) AS spread FROM members, base GROUP BY 1),
breakdown AS (
  SELECT m.dimension, dimension_value, 'net_sales' AS metric, '{BASELINE}' AS baseline_period, '{CURRENT}' AS current_period,
         {_round('b')} AS baseline_value, {_round('c')} AS current_value, {_round('c - b')} AS absolute_change,
         {_pct('c - b', 'b')} AS percentage_change, {_pct('c - b', 'tc - tb')} AS contribution_to_total_change,
         {_round('tb')} AS total_baseline, {_round('tc')} AS total_current, {_round('tc - tb')} AS total_change,
         {_pct('tc - tb', 'tb')} AS total_percentage_change, {_round('abs(tc - tb - spread)', 4)} AS reconciliation_diff,
         abs(tc - tb - spread) < 0.01 AS is_reconciled
  FROM members m JOIN totals t ON m.dimension = t.dimension
)"""


COMPARISON = f"""
monthly AS (
  SELECT coalesce(round(sum(net_sales) FILTER (WHERE {_in_month(BASELINE)}), 2), 0) AS b,
         coalesce(round(sum(net_sales) FILTER (WHERE {_in_month(CURRENT)}), 2), 0) AS c FROM prepared
),
comparison AS (
  SELECT 'net_sales' AS metric, '{BASELINE}' AS baseline_period, '{CURRENT}' AS current_period, CAST(b AS DOUBLE) AS baseline_value,
         CAST(c AS DOUBLE) AS current_value, CAST(c - b AS DOUBLE) AS absolute_change, {_pct('c - b', 'b')} AS percentage_change
  FROM monthly
)"""

CHANNEL = {"channel": "channel"}
SEGMENT = {"segment": "coalesce(segment, 'Unclassified')"}
REGION = {"region": "coalesce(region, 'Unclassified')"}
MULTI = {**CHANNEL, **SEGMENT, **REGION, "campaign": "'Unclassified'"}

TREND = f"""
trend AS (
  SELECT strftime(day, '%Y-%m') AS period, {_round('sum(net_sales)')} AS net_sales, {_round('sum(gross_sales)')} AS gross_sales,
         CAST(sum(units) AS BIGINT) AS units, count(*) AS order_count, {_ratio('sum(net_sales)', 'count(*)')} AS avg_order_value
  FROM prepared GROUP BY 1
)"""


def _dynamics(is_new: str, name: str = "dynamics") -> str:
    return f"""
firsts AS (SELECT customer_id, min(day) AS first_day FROM prepared GROUP BY 1),
{name} AS (
  SELECT strftime(day, '%Y-%m') AS period,
         {_round(f"sum(CASE WHEN {is_new} THEN net_sales ELSE 0 END)")} AS new_customers_sales,
         {_round(f"sum(CASE WHEN {is_new} THEN 0 ELSE net_sales END)")} AS recurring_customers_sales,
         count(*) FILTER (WHERE {is_new}) AS new_customers_orders,
         count(*) FILTER (WHERE NOT ({is_new})) AS recurring_customers_orders,
         {_round('sum(net_sales)')} AS total_sales
  FROM prepared p JOIN firsts f ON p.customer_id = f.customer_id GROUP BY 1
)"""


def _forecast(source: str, day: str, ctes: str = "") -> str:
    months = f"months AS (SELECT DISTINCT date_trunc('month', {day}) AS m FROM {source})"
    return f"""WITH {ctes + ',' if ctes else ''} {months}
SELECT count(*) AS periods, strftime(min(m), '%Y-%m') AS first_period, strftime(max(m), '%Y-%m') AS last_period,
       date_diff('month', min(m), max(m)) + 1 - count(*) AS missing_periods, count(*) >= 12 AS eligible,
       CASE WHEN count(*) < 12 THEN 'History has ' || CAST(count(*) AS VARCHAR) || ' months; a forecast needs 12.' END AS reason
FROM months"""


def _pareto(source: str, key: str, amount: str, ctes: str = "") -> str:
    return f"""WITH {ctes + ',' if ctes else ''}
per_key AS (SELECT {key} AS k, sum({amount}) AS v FROM {source} GROUP BY 1),
ranked AS (SELECT k, v, sum(v) OVER (ORDER BY v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                  sum(v) OVER (PARTITION BY v) AS peers, sum(v) OVER () AS total FROM per_key)
SELECT k AS {key}, {_round('v')} AS value, {_pct('v', 'total', 4)} AS share, {_pct('cum', 'total', 4)} AS cumulative_share,
       CASE WHEN CAST(cum - peers AS DOUBLE) / CAST(total AS DOUBLE) * 100 < 80 THEN 'A'
            WHEN CAST(cum - peers AS DOUBLE) / CAST(total AS DOUBLE) * 100 < 95 THEN 'B' ELSE 'C' END AS abc_class
FROM ranked"""


def _join_counts(name: str, left: str, right: str, left_key: str, right_key: str, metric: str = "0") -> str:
    return f"""
{name} AS (
  SELECT f.k AS lk, d.k AS rk, f.n AS ln, d.n AS rn, f.m AS m
  FROM (SELECT {left_key} AS k, count(*) AS n, sum({metric}) AS m FROM {left} GROUP BY 1) f
  FULL OUTER JOIN (SELECT {right_key} AS k, count(*) AS n FROM {right} GROUP BY 1) d ON f.k = d.k
)"""


def _join_check(rn: str) -> str:
    return f"""WITH {DIRTY_ORDERS},{DIRTY_CUSTOMERS},
naive AS (SELECT o.net_sales, o.order_id FROM dirty_orders o LEFT JOIN {rn} c ON o.customer_id = c.customer_id),
counts AS (
  SELECT (SELECT count(*) FROM dirty_orders) AS l, (SELECT count(*) FROM {rn}) AS r, (SELECT count(*) FROM naive) AS j,
         (SELECT CAST(sum(net_sales) AS DOUBLE) FROM dirty_orders) AS before, (SELECT CAST(sum(net_sales) AS DOUBLE) FROM naive) AS after
)
SELECT 'orders' AS left_table, 'customers' AS right_table, 'customer_id = customer_id' AS join_keys, l AS left_rows, r AS right_rows,
       j AS result_rows, {_ratio('j', 'l', 4)} AS multiplication_factor,
       (SELECT count(*) FROM dirty_orders WHERE customer_id NOT IN (SELECT customer_id FROM dirty_customers)) AS orphans_left,
       (SELECT count(DISTINCT customer_id) FROM dirty_customers WHERE customer_id NOT IN (SELECT customer_id FROM dirty_orders)) AS orphans_right,
       before AS metric_before, after AS metric_after, abs(after - before) < 0.01 AS metric_reconciled,
       abs(after - before) < 0.01 AND j = l AS is_safe
FROM counts"""


def _first_contained(needles, text: str = "t") -> str:
    cases = " ".join(f"WHEN contains({text}, '{n}') THEN '{n}'" for n in needles)
    return f"CASE {cases} END"


def _any(needles, text: str = "t") -> str:
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"


def _label(keyword: str, keywords) -> str:
    return f"CASE {keyword} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in keywords.items()) + " END"


WANTS_FIGURE = f"({_any(q.RECALCULATE_TRIGGERS)} AND {_any(q.QUANTITY_PHRASES)})"


def _routed(source: str) -> str:
    return f"""
routed AS (
  SELECT question_id, t, CASE WHEN {_any(q.UNANSWERABLE_TRIGGERS)} THEN '{q.UNANSWERABLE}' WHEN {_any(q.NEW_ANALYSIS_TRIGGERS)} THEN '{q.NEW_ANALYSIS}'
              WHEN {WANTS_FIGURE} THEN '{q.RECALCULATE}' ELSE '{q.EXPLAIN}' END AS query_type,
         CASE WHEN {_any(q.UNANSWERABLE_TRIGGERS)} THEN {_first_contained(q.UNANSWERABLE_TRIGGERS)}
              WHEN {_any(q.NEW_ANALYSIS_TRIGGERS)} THEN {_first_contained(q.NEW_ANALYSIS_TRIGGERS)}
              WHEN {WANTS_FIGURE} THEN {_first_contained(q.RECALCULATE_TRIGGERS)} END AS matched_term
  FROM (SELECT *, lower(question) AS t FROM {source})
)"""


NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
TEXT_COLUMNS = {
    "orders": ("text_orders", ("order_id", "order_date", "amount", "channel")),
    "customers": ("dirty_customers", ("customer_id", "customer_name", "segment", "nation_id")),
    "parts": ("text_parts", ("part_no", "part_name", "size", "price")),
}


def _profiles(tables: dict[str, tuple[str, tuple[str, ...]]]) -> str:
    """A profile per column: one SELECT each over its cells, then the type rules."""
    cells = " UNION ALL ".join(
        f"SELECT '{t}' AS table_id, '{c}' AS name, CAST({c} AS VARCHAR) AS cell FROM {view}"
        for t, (view, columns) in tables.items()
        for c in columns
    )
    return f"""
cells AS ({cells}),
typed AS (
  SELECT table_id, name, nullif(cell, '') AS v,
         CASE WHEN regexp_full_match(replace(cell, ',', '.'), '{NUMBER}') THEN CAST(trim(replace(cell, ',', '.')) AS DOUBLE) END AS num,
         CASE WHEN regexp_matches(cell, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN CAST(try_strptime(cell, '%Y-%m-%d') AS DATE) END AS d
  FROM cells
),
stats AS (
  SELECT table_id, name, count(*) AS total_count, count(v) AS present, count(DISTINCT v) AS unique_count,
         coalesce(bool_or(regexp_full_match(v, '0[0-9]+')), FALSE) AS has_leading_zeros, count(num) AS nums, count(d) AS dates,
         bool_and(num % 1 = 0) AS whole, min(num) AS min_num, max(num) AS max_num, avg(num) AS mean_value,
         CASE WHEN count(num) = 1 THEN 0.0 ELSE stddev_samp(num) END AS std_dev, min(d) AS min_date, max(d) AS max_date
  FROM typed GROUP BY 1, 2
),
kinds AS (
  SELECT *, has_leading_zeros OR contains(lower(name), 'id') OR contains(lower(name), 'code') AS is_id,
         CASE WHEN has_leading_zeros OR contains(lower(name), 'id') OR contains(lower(name), 'code') THEN 'string'
              WHEN present > 0 AND nums = present THEN CASE WHEN whole THEN 'integer' ELSE 'float' END
              WHEN present > 0 AND dates = present AND (contains(lower(name), 'date') OR contains(lower(name), 'fecha') OR dates > 5) THEN 'date'
              ELSE 'string' END AS inferred_type
  FROM stats
),
profile AS (
  SELECT table_id, name, inferred_type, total_count, total_count - present AS null_count,
         {_pct('total_count - present', 'greatest(total_count, 1)')} AS null_percentage, unique_count, has_leading_zeros,
         CASE WHEN is_id THEN 'id' WHEN inferred_type IN ('integer', 'float') THEN 'numeric' WHEN inferred_type = 'date' THEN 'date'
              WHEN unique_count < 50 THEN 'categorical' END AS column_role,
         CASE WHEN inferred_type IN ('integer', 'float') THEN {_round('min_num')} END AS min_num,
         CASE WHEN inferred_type IN ('integer', 'float') THEN {_round('max_num')} END AS max_num,
         CASE WHEN inferred_type IN ('integer', 'float') THEN {_round('mean_value')} END AS mean_value,
         CASE WHEN inferred_type IN ('integer', 'float') THEN {_round('std_dev')} END AS std_dev,
         CASE WHEN inferred_type = 'date' THEN strftime(min_date, '%Y-%m-%d') END AS min_date,
         CASE WHEN inferred_type = 'date' THEN strftime(max_date, '%Y-%m-%d') END AS max_date
  FROM kinds
)"""


def _issue(issue_type: str, severity: str, issue_id: str, table: str, column: str, affected: str, total: str, source: str,
           pct: str | None = None) -> str:
    return f"""SELECT {issue_id} AS id, '{issue_type}' AS issue_type, '{severity}' AS severity, {table} AS table_id, {column} AS "column",
  CAST({affected} AS BIGINT) AS affected_rows, CAST({total} AS BIGINT) AS total_rows, {pct or _pct(affected, total)} AS affected_percentage FROM {source}"""


DUPLICATES = _issue(
    "duplicate_keys", "warning", "'DUP_KEY_customers_customer_id'", "'customers'", "'customer_id'",
    "sum(n) FILTER (WHERE n > 1)", "sum(n)",
    "(SELECT customer_id, count(*) AS n FROM dirty_customers GROUP BY 1)",
)
STATUS_ISSUE = _issue(
    "returns_cancellations", "info", "'RETURNS_CANCELLATIONS_orders'", "'orders'", "'status'",
    "count(*) FILTER (WHERE status = 'CANCELLED')", "count(*)", "dirty_orders",
)
AUDIT_COLUMNS = {
    "orders": ("dirty_orders", ("order_id", "customer_id", "net_sales", "order_date", "status")),
    "customers": TEXT_COLUMNS["customers"],
    "parts": TEXT_COLUMNS["parts"],
}
LEADING_ZEROS = _issue(
    "leading_zeros_preserved", "info", "'LEADING_ZEROS_' || table_id || '_' || name", "table_id", "name",
    "total_count - null_count", "total_count", "profile WHERE has_leading_zeros", pct=_round("100.0 - null_percentage"),
)
ISSUES = " UNION ALL ".join(
    [
        DUPLICATES,
        STATUS_ISSUE,
        LEADING_ZEROS,
        _issue("invalid_date", "warning", "'INVALID_DATE_orders_order_date'", "'orders'", "'order_date'",
               "count(*) FILTER (WHERE order_date <> '' AND day IS NULL)", "count(*)", "parsed_orders"),
        """SELECT * FROM (""" + _issue(
            "incomplete_period", "warning", "'INCOMPLETE_PERIOD_orders_order_date'", "'orders'", "'order_date'", "n", "total",
            """(SELECT last(n ORDER BY m) AS n, last(days ORDER BY m) AS days, max(m) AS m, (SELECT count(*) FROM dirty_orders) AS total
              FROM (SELECT date_trunc('month', day) AS m, count(*) AS n, count(DISTINCT day) AS days FROM parsed_orders WHERE day IS NOT NULL GROUP BY 1))
             WHERE days < 15 AND days < day(last_day(m))""") + ")",
        _issue("orphan_records", "warning", "'ORPHAN_orders_customers_customer_id'", "'orders'", "'customer_id'",
               "count(*) FILTER (WHERE customer_id NOT IN (SELECT customer_id FROM dirty_customers))", "count(*)", "dirty_orders"),
        _issue("many_to_many", "warning", "'M2M_orders_customers_customer_id'", "'customers'", "'customer_id'",
               "count(*) - count(DISTINCT customer_id)", "count(*)", "dirty_customers"),
    ]
)

DRIVERS = """
drivers AS (
  SELECT dimension, dimension_value, baseline_value, current_value, absolute_change, percentage_change, contribution_to_total_change,
         baseline_period, current_period, total_change
  FROM breakdown QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY abs(absolute_change) DESC, dimension_value) = 1
)"""

_MONEY = "CASE WHEN round({0}, 0) < 0 THEN '-' ELSE '' END || '$' || format('{{:,.0f}}', abs({0}))"


def _money(expr: str) -> str:
    return _MONEY.format(expr)


def _percent_text(expr: str) -> str:
    return f"format('{{:,.1f}}', {expr}) || '%'"


_DIRECTION = "CASE WHEN absolute_change < 0 THEN 'down' WHEN absolute_change > 0 THEN 'up' ELSE 'flat' END"
COMPARISON_CARDS = f"""
SELECT 'CARD_BASELINE' AS id, 'Baseline (' || baseline_period || ')' AS title, {_money('baseline_value')} AS value, 'Reference level' AS comparison_text,
       'flat' AS trend_direction, 'RES_{methods.COMPARISON}' AS result_id, baseline_period AS period FROM comparison
UNION ALL SELECT 'CARD_CURRENT', 'Current (' || current_period || ')', {_money('current_value')},
       {_percent_text('percentage_change')} || ' vs ' || baseline_period, {_DIRECTION}, 'RES_{methods.COMPARISON}', current_period FROM comparison
UNION ALL SELECT 'CARD_TOTAL_CHANGE', 'Total Net Change', {_money('absolute_change')},
       {_percent_text('abs(percentage_change)')} || CASE WHEN absolute_change < 0 THEN ' decrease' ELSE ' increase' END, {_DIRECTION},
       'RES_{methods.COMPARISON}', baseline_period || ' vs ' || current_period FROM comparison"""

RECONCILED = f"""
parts AS (
  SELECT 'RES_' || upper(dimension) AS result_id, * FROM breakdown
  UNION ALL SELECT 'RES_CHANNEL_PARTIAL', * FROM breakdown WHERE dimension = 'channel' AND dimension_value <> '5-LOW'
),
reconciled AS (
  SELECT result_id, p.metric, p.baseline_period, p.current_period, {_round('sum(CAST(p.absolute_change AS DECIMAL(28,4)))')} AS sum_of_changes,
         {_round('CAST(max(k.absolute_change) AS DECIMAL(28,4))')} AS expected_change,
         {_round('abs(sum(CAST(p.absolute_change AS DECIMAL(28,4))) - CAST(max(k.absolute_change) AS DECIMAL(28,4)))', 4)} AS difference,
         abs(sum(CAST(p.absolute_change AS DECIMAL(28,4))) - CAST(max(k.absolute_change) AS DECIMAL(28,4))) <= 0.05 AS is_reconciled
  FROM parts p, comparison k GROUP BY ALL
)"""

LEDGER = f"""
steps AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE day IS NULL) AS x1,
         count(*) FILTER (WHERE day IS NOT NULL AND status = 'CANCELLED') AS x2,
         count(*) FILTER (WHERE day IS NOT NULL AND status <> 'CANCELLED' AND day > DATE '{DIRTY_CUTOFF}') AS x3
  FROM parsed_orders
),
ledger AS (
  SELECT 1 AS step_index, 'TRF_01_CLEAN_DATES' AS transformation_id, 'filter_invalid_dates' AS operation, total AS rows_before,
         total - x1 AS rows_after, x1 AS rows_excluded, 'Date is missing or not a date' AS exclusion_reason FROM steps
  UNION ALL SELECT 2, 'TRF_02_FILTER_STATUS', 'filter_completed_orders', total - x1, total - x1 - x2, x2, 'Status is excluded' FROM steps
  UNION ALL SELECT 3, 'TRF_03_CUTOFF_INCOMPLETE_PERIOD', 'filter_date_range', total - x1 - x2, total - x1 - x2 - x3, x3,
         'After the cutoff ({DIRTY_CUTOFF})' FROM steps WHERE x3 > 0
)"""

UNTIDY = """
untidy AS (
  SELECT o_orderkey AS order_id,
         CASE WHEN o_orderkey % 7 = 0 THEN replace(a, '.', ',') WHEN o_orderkey % 11 = 0 THEN '1,' || a WHEN o_orderkey % 13 = 0 THEN a || 'd'
              WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'NaN' WHEN o_orderkey % 23 = 0 THEN '-' || a ELSE a END AS amount,
         CASE WHEN o_orderkey % 7 = 0 THEN substr(d, 1, 7) WHEN o_orderkey % 11 = 0 THEN '2001-02-30' WHEN o_orderkey % 13 = 0 THEN '' ELSE d END AS order_date
  FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS a, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
)"""
IS_NUMBER = f"regexp_full_match(replace(amount, ',', '.'), '{NUMBER}')"

_REGION_CASES = " ".join(f"WHEN contains(t, '{k}') THEN '{k}'" for k in q.REGION_KEYWORDS)


def _step_violations() -> str:
    allowed = " OR ".join(f"(p = '{s}' AND stage IN ({_list(t)}))" for s, t in EVENT_TRANSITIONS.items() if t)
    return f"""WITH {RUN_LOG}
SELECT run_id, event_id, p AS from_stage, stage AS to_stage
FROM (SELECT *, lag(stage) OVER (PARTITION BY run_id ORDER BY event_id) AS p FROM run_log) WHERE p IS NOT NULL AND NOT ({allowed})"""


RUN_STATUS = f"""{RUN_LOG},
run_states AS (
  SELECT run_id, last(stage ORDER BY event_id) AS current_stage,
         last(CASE WHEN stage = 'error' AND value > 5 THEN props END ORDER BY event_id) AS failure_reason,
         min(created_at) AS started, max(CASE WHEN stage IN ('purchase', 'error') THEN created_at END) AS completed,
         count(*) FILTER (WHERE stage = 'click') AS repair_attempts, count(*) AS events
  FROM run_log GROUP BY 1
)"""


def _redact() -> str:
    hits, cleaned = [], "text"
    for s in SECRETS:
        hits.append(f"CAST((length({cleaned}) - length(replace({cleaned}, '{s}', ''))) / {len(s)} AS BIGINT)")
        cleaned = f"replace({cleaned}, '{s}', '[REDACTED_API_KEY]')"
    return f"SELECT doc_id, {' + '.join(hits)} AS redaction_hits, {cleaned} AS text FROM documents"


_PIVOT = ", ".join(
    f"{_round(f'coalesce(sum(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (WHERE o_orderpriority = {chr(39)}{c}{chr(39)}), 0)')} AS {c[2:].lower().replace(' ', '_')}"
    for c in CHANNELS
)
_PIVOT += ", " + ", ".join(
    f"{_round(f'coalesce(sum(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (WHERE {test}), 0)')} AS {name}"
    for name, test in (
        ("other", f"o_orderpriority <> '' AND o_orderpriority NOT IN ({_list(CHANNELS)})"), ("unclassified", "coalesce(o_orderpriority, '') = ''"),
    )
)


def _match_rate(name: str, left: str, right: str, left_name: str, right_name: str) -> str:
    return f"""SELECT '{left_name}' AS left_table, '{right_name}' AS right_table, CAST(sum(ln) AS BIGINT) AS left_rows, count(rk) AS right_keys,
  CAST(coalesce(sum(ln) FILTER (WHERE rk IS NULL), 0) AS BIGINT) AS orphans_left, count(rk) FILTER (WHERE lk IS NULL) AS orphans_right,
  {_pct('coalesce(sum(ln) FILTER (WHERE rk IS NOT NULL), 0)', 'sum(ln)')} AS match_rate_left,
  {_pct('count(rk) FILTER (WHERE lk IS NOT NULL)', 'count(rk)')} AS match_rate_right FROM {name}"""


def _relationship(name: str, right_name: str, key: str) -> str:
    return f"""SELECT 'REL_orders_{right_name}_{key}' AS id, left_table, '{key}' AS left_key, right_table, '{key}' AS right_key,
  (SELECT CASE WHEN max(rn) <= 1 THEN 'many_to_one' ELSE 'many_to_many' END FROM {name} WHERE rk IS NOT NULL) AS cardinality,
  match_rate_left, orphans_left AS orphan_count_left, match_rate_right, orphans_right AS orphan_count_right,
  CASE WHEN (SELECT max(rn) FROM {name} WHERE rk IS NOT NULL) > 1 THEN 'high' WHEN orphans_left > 0 THEN 'medium' ELSE 'low' END AS risk_level
FROM ({_match_rate(name, '', '', 'orders', right_name)})"""


def _by_branch(pick: str) -> str:
    return f"""WITH {DIRTY_ORDERS},{DIRTY_CUSTOMERS},
one AS (SELECT customer_id, {pick}(customer_name) AS customer_name FROM dirty_customers GROUP BY 1)
SELECT coalesce(customer_name, 'Unclassified') AS customer_name, count(*) AS orders, CAST(sum(net_sales) AS DOUBLE) AS net_sales
FROM dirty_orders o LEFT JOIN one c ON o.customer_id = c.customer_id GROUP BY 1"""


CHARTS = f"""{WITH_CUSTOMERS},{_members('enriched', {**CHANNEL, **SEGMENT})},{TREND},{_dynamics('day = first_day')},
charts AS (
  SELECT 'CHART_TIME_SERIES' AS chart_id, period AS label, 'net_sales' AS measure, net_sales AS value FROM trend
  UNION ALL SELECT 'CHART_TIME_SERIES', period, 'order_count', CAST(order_count AS DOUBLE) FROM trend
  UNION ALL SELECT 'CHART_' || upper(dimension), dimension_value, 'absolute_change', absolute_change FROM breakdown
  UNION ALL SELECT 'CHART_CUSTOMER_DYNAMICS', period, 'new_customers_sales', new_customers_sales FROM dynamics
  UNION ALL SELECT 'CHART_CUSTOMER_DYNAMICS', period, 'recurring_customers_sales', recurring_customers_sales FROM dynamics
)"""

_MOMENT = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"

LINEAGE = f"""{WITH_CUSTOMERS},{_members('enriched', {**CHANNEL, **SEGMENT, **REGION})},{COMPARISON},{RECONCILED},{DIRTY_ORDERS},{DIRTY_CUSTOMERS},{LEDGER},
cards AS (SELECT id, result_id FROM ({COMPARISON_CARDS}) UNION ALL
          SELECT DISTINCT 'CARD_TOP_' || upper(dimension), CASE dimension WHEN 'channel' THEN 'RES_CHANNEL_PARTIAL' ELSE 'RES_' || upper(dimension) END FROM breakdown),
nodes AS (
  SELECT 'orders' AS node_id, 'raw_table' AS kind, CAST(NULL AS VARCHAR) AS parent_id, '' AS detail
  UNION ALL SELECT 'customers', 'raw_table', NULL, ''
  UNION ALL SELECT transformation_id, 'transformation', coalesce(lag(transformation_id) OVER (ORDER BY step_index), 'orders'), '' FROM ledger
  UNION ALL SELECT 'TRF_JOIN_CUSTOMERS', 'join', (SELECT arg_max(transformation_id, step_index) FROM ledger), ''
  UNION ALL SELECT result_id, 'result', 'TRF_JOIN_CUSTOMERS', CASE WHEN is_reconciled THEN 'approved' ELSE 'rejected' END FROM reconciled
  UNION ALL SELECT id, 'card', result_id, '' FROM cards
),
edges AS (SELECT node_id, parent_id FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT 'TRF_JOIN_CUSTOMERS', 'customers'),
above(node, ancestor, distance) AS (
  SELECT node_id, parent_id, 1 FROM edges UNION ALL SELECT a.node, e.parent_id, a.distance + 1 FROM above a JOIN edges e ON e.node_id = a.ancestor
)"""

PLAN_EDGES = ", ".join(f"('{step}', '{other}')" for step, others in PLAN_DEPENDENCIES.items() for other in others)

def _findings(driver_result: str) -> str:
    return f"""SELECT 'FINDING_TOTAL_CHANGE' AS id, metric || CASE WHEN absolute_change < 0 THEN ' decreased' ELSE ' increased' END || ' by '
       || format('{{:,.2f}}', abs(absolute_change)) || ' (' || {_percent_text('percentage_change')} || ') between ' || baseline_period || ' ('
       || format('{{:,.2f}}', baseline_value) || ') and ' || current_period || ' (' || format('{{:,.2f}}', current_value) || ').' AS claim,
       'RES_{methods.COMPARISON}' AS result_id, 'net_sales_delta' AS metric_name, absolute_change AS observed_value FROM comparison
UNION ALL SELECT 'FINDING_TOP_' || upper(dimension), 'The largest change by ' || dimension || ' is ''' || dimension_value || ''' with '
       || format('{{:,.2f}}', absolute_change) || ' (' || {_percent_text('contribution_to_total_change')} || ' of the total change).',
       {driver_result}, dimension || '_contribution', absolute_change FROM drivers"""


EXPLAINED = f"""{WITH_CUSTOMERS},{_members('enriched', {**CHANNEL, **SEGMENT, **REGION})},{DRIVERS},{COMPARISON},{RECONCILED},{QUESTIONS},{_routed('questions')},
found AS ({_findings("CASE dimension WHEN 'channel' THEN 'RES_CHANNEL_PARTIAL' ELSE 'RES_' || upper(dimension) END")}),
shown AS (SELECT * FROM found WHERE observed_value IS NOT NULL AND result_id NOT IN (SELECT result_id FROM reconciled WHERE NOT is_reconciled))"""


ORACLE: dict[str, str] = {
    "metric_summary": f"""WITH {PREPARED}
SELECT {_round('sum(net_sales)')} AS net_sales, {_round('sum(gross_sales)')} AS gross_sales, CAST(sum(units) AS BIGINT) AS total_units,
       count(*) AS total_orders, {_round('sum(discount_amount)')} AS total_discounts, {_ratio('sum(net_sales)', 'greatest(count(*), 1)')} AS avg_order_value
FROM prepared""",
    "monthly_trend": f"WITH {PREPARED},{TREND} SELECT * FROM trend",
    "period_comparison": f"WITH {PREPARED},{COMPARISON} SELECT * FROM comparison",
    "breakdown_channel": f"WITH {PREPARED},{_members('prepared', CHANNEL)} SELECT * FROM breakdown",
    "breakdown_segment": f"WITH {WITH_CUSTOMERS},{_members('enriched', SEGMENT)} SELECT * FROM breakdown",
    "breakdown_multi": f"WITH {WITH_CUSTOMERS},{_members('enriched', MULTI)} SELECT * FROM breakdown",
    "customer_dynamics_day": f"WITH {PREPARED},{_dynamics('day = first_day')} SELECT * FROM dynamics",
    "customer_dynamics_month": (
        f"""WITH {PREPARED},{_dynamics("date_trunc('month', day) = date_trunc('month', first_day)")} SELECT * FROM dynamics"""
    ),
    "forecast_eligibility": _forecast("prepared", "day", PREPARED),
    "forecast_ineligible": _forecast("events", "ts"),
    "pareto_customers": _pareto("orders", "o_custkey", "CAST(o_totalprice AS DECIMAL(18,4))"),
    "pareto_channels": _pareto("prepared", "channel", "net_sales", PREPARED),
    "month_channel_pivot": f"SELECT strftime(o_orderdate, '%Y-%m') AS period, {_PIVOT} FROM orders GROUP BY 1",
    "filtered_totals": f"""WITH {LABELLED} SELECT {_round('coalesce(sum(net_sales), 0)')} AS total_value, count(*) AS row_count
FROM labelled WHERE lower(region) IN ('norte', 'north') AND contains(lower(channel), 'wholesale')""",
    "amount_statistics": f"""SELECT o_orderpriority AS channel, count(DISTINCT o_custkey) AS customers, count(*) AS orders, min(o_totalprice) AS min_amount,
  max(o_totalprice) AS max_amount, {_round('avg(o_totalprice)')} AS mean_amount, {_round('stddev_samp(o_totalprice)')} AS std_amount FROM orders GROUP BY 1""",
    "lenient_parsing": f"""WITH {UNTIDY},
read AS (SELECT *, CASE WHEN {IS_NUMBER} THEN CAST(TRY_CAST(trim(replace(amount, ',', '.')) AS DECIMAL(18,4)) AS DOUBLE) END AS n FROM untidy)
SELECT order_id, n AS amount, coalesce(n, 0.0) AS amount_or_zero,
       CASE WHEN regexp_matches(order_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN strftime(try_strptime(order_date, '%Y-%m-%d'), '%Y-%m-%d') END AS order_date,
       order_date = '' AS date_is_missing FROM read""",
    "amount_cast_counts": f"""WITH {UNTIDY} SELECT 'amount' AS "column", count(*) FILTER (WHERE amount = '') AS missing_cells,
  count(*) FILTER (WHERE amount <> '' AND NOT {IS_NUMBER}) AS unreadable_cells, count(*) FILTER (WHERE amount = 'NaN') AS non_finite_cells FROM untidy""",
    "exclusion_ledger": f"WITH {DIRTY_ORDERS},{LEDGER} SELECT * FROM ledger",
    "written_ledger": f"""WITH {DIRTY_ORDERS},{LEDGER},
excluded AS (
  SELECT order_id, CASE WHEN day IS NULL THEN 1 WHEN status = 'CANCELLED' THEN 2 WHEN day > DATE '{DIRTY_CUTOFF}' THEN 3 END AS step_index,
         CASE WHEN day IS NULL THEN order_date WHEN status = 'CANCELLED' THEN status ELSE strftime(day, '%Y-%m-%d') END AS detail FROM parsed_orders
),
samples AS (
  SELECT step_index, string_agg(order_id || '=' || detail, '; ' ORDER BY order_id) AS samples
  FROM (SELECT *, row_number() OVER (PARTITION BY step_index ORDER BY order_id) AS place FROM excluded WHERE step_index IS NOT NULL)
  WHERE place <= 5 GROUP BY step_index
)
SELECT ledger.*, coalesce(samples, '') AS samples FROM ledger LEFT JOIN samples USING (step_index)""",
    "written_rows": f"""WITH {DIRTY_ORDERS}
SELECT CASE WHEN day IS NULL THEN 'Date is missing or not a date' WHEN status = 'CANCELLED' THEN 'Status is excluded'
            WHEN day > DATE '{DIRTY_CUTOFF}' THEN 'After the cutoff ({DIRTY_CUTOFF})' ELSE 'usable' END AS outcome,
       count(*) AS orders, CAST(sum(net_sales) AS DOUBLE) AS net_sales FROM parsed_orders GROUP BY 1""",
    "written_amount_counts": f"""WITH {UNTIDY} SELECT 'amount' AS "column", count(*) FILTER (WHERE amount = '') AS missing_cells,
  count(*) FILTER (WHERE amount <> '' AND NOT {IS_NUMBER}) AS unreadable_cells, count(*) FILTER (WHERE amount = 'NaN') AS non_finite_cells
FROM untidy WHERE regexp_matches(order_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND try_strptime(order_date, '%Y-%m-%d') IS NOT NULL""",
    "quarantine_rows": f"""WITH {DIRTY_ORDERS}
SELECT order_id, order_date, status, CASE WHEN day IS NULL THEN 'Date is missing or not a date' WHEN status = 'CANCELLED' THEN 'Status is excluded'
       ELSE 'After the cutoff ({DIRTY_CUTOFF})' END AS exclusion_reason
FROM parsed_orders WHERE day IS NULL OR status = 'CANCELLED' OR day > DATE '{DIRTY_CUTOFF}'""",
    "incomplete_period": f"""WITH {LAST_MONTH}
SELECT strftime(m, '%Y-%m') AS last_month, days AS days_recorded, CAST(day(last_day(m)) AS BIGINT) AS days_in_month, n AS rows_in_month,
       (SELECT count(*) FROM orders) AS total_rows, days < 15 AND days < day(last_day(m)) AS is_incomplete,
       strftime((SELECT cutoff FROM closed), '%Y-%m-%d') AS cutoff FROM last_month""",
    "time_coverage": f"""WITH {DIRTY_ORDERS} SELECT strftime(min(day), '%Y-%m-%d') AS coverage_start, strftime(max(day), '%Y-%m-%d') AS coverage_end,
  count(day) AS dated_rows, count(*) AS total_rows FROM parsed_orders""",
    "unsafe_join_inflation": _join_check("dirty_customers"),
    "safe_join_check": _join_check("(SELECT DISTINCT customer_id FROM dirty_customers)"),
    "safe_join_rows": _by_branch("max"),
    "safe_join_salted": _by_branch("min"),
    "join_chain": f"""WITH {SALES},{DIRTY_CUSTOMERS},
one AS (SELECT customer_id, arg_min(segment, customer_name) AS segment, arg_min(nation_id, customer_name) AS nation_id FROM dirty_customers GROUP BY 1)
SELECT coalesce(segment, 'Unclassified') AS segment, coalesce(p_brand, 'Unclassified') AS category_id, coalesce(n_name, 'Unclassified') AS nation,
       count(*) AS order_lines, CAST(sum(net_sales) AS DOUBLE) AS net_sales
FROM sales s LEFT JOIN one c ON lpad(CAST(s.customer_id AS VARCHAR), 7, '0') = c.customer_id LEFT JOIN part ON product_id = p_partkey
     LEFT JOIN nation ON nation_id = n_nationkey GROUP BY 1, 2, 3""",
    "orphans_left": f"""WITH {DIRTY_ORDERS},{DIRTY_CUSTOMERS} SELECT customer_id AS orphan_key, count(*) AS fact_rows FROM dirty_orders
WHERE customer_id NOT IN (SELECT customer_id FROM dirty_customers) GROUP BY 1""",
    "orphans_right": f"""WITH {DIRTY_ORDERS},{DIRTY_CUSTOMERS} SELECT DISTINCT customer_id AS unused_key FROM dirty_customers
WHERE customer_id NOT IN (SELECT customer_id FROM dirty_orders)""",
    "match_rates": f"""WITH {DIRTY_ORDERS},{DIRTY_CUSTOMERS},{_join_counts('a', 'dirty_orders', 'dirty_customers', 'customer_id', 'customer_id')},
{_join_counts('b', 'documents', 'labels', 'doc_id', 'doc_id')},{_join_counts('c', 'orders', 'lineitem', 'o_orderkey', 'l_orderkey')}
{_match_rate('a', '', '', 'orders', 'customers')} UNION ALL {_match_rate('b', '', '', 'documents', 'labels')}
UNION ALL {_match_rate('c', '', '', 'order_headers', 'order_lines')}""",
    "relationship_inference": f"""WITH {SALES},{DIRTY_CUSTOMERS},
{_join_counts('a', 'sales', 'dirty_customers', "lpad(CAST(customer_id AS VARCHAR), 7, '0')", 'customer_id')},
{_join_counts('b', 'sales', 'part', 'product_id', 'p_partkey')}
{_relationship('a', 'customers', 'customer_id')} UNION ALL {_relationship('b', 'products', 'product_id')}""",
    "column_profile": f"WITH {DIRTY_CUSTOMERS},{TEXT_TABLES},{_profiles(TEXT_COLUMNS)} SELECT * FROM profile",
    "column_samples": f"""WITH {DIRTY_CUSTOMERS},{TEXT_TABLES},{_profiles(TEXT_COLUMNS)}
SELECT table_id, name, coalesce(array_to_string(list_sort(list_distinct(list(v)))[1:4], '|'), '') AS samples FROM typed GROUP BY 1, 2""",
    "merged_profile": f"""WITH {DIRTY_CUSTOMERS},{TEXT_TABLES},{_profiles(TEXT_COLUMNS)},
firsts AS (SELECT table_id, name, coalesce(array_to_string(list_sort(list_distinct(list(v)))[1:4], '|'), '') AS samples FROM typed GROUP BY 1, 2)
SELECT profile.*, samples FROM profile JOIN firsts USING (table_id, name)""",
    "table_profiles": f"""WITH {DIRTY_CUSTOMERS},{TEXT_TABLES},{_profiles(TEXT_COLUMNS)}
SELECT table_id, upper(table_id[1]) || table_id[2:] AS display_name, max(total_count) AS row_count, count(*) AS column_count,
       CASE table_id WHEN 'orders' THEN 'Sales fact: a row is an order or an order line'
                     WHEN 'customers' THEN 'Customer dimension: a row is a customer' ELSE 'Other table' END AS row_semantic_meaning,
       coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE column_role = 'date'), '') AS date_columns,
       coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE column_role = 'id'), '') AS id_columns,
       coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE column_role = 'numeric'), '') AS numeric_columns,
       coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE column_role = 'categorical'), '') AS categorical_columns
FROM profile GROUP BY 1""",
    "catalog_summary": f"""WITH {DIRTY_CUSTOMERS},{TEXT_TABLES},{_profiles(TEXT_COLUMNS)}
SELECT table_id, max(total_count) AS row_count, count(*) AS column_count,
       '[' || string_agg('{{"name":"' || name || '","type":"' || inferred_type || '","null_pct":' || CAST(null_percentage AS VARCHAR)
         || ',"unique_count":' || CAST(unique_count AS VARCHAR) || ',"has_leading_zeros":' || CAST(has_leading_zeros AS VARCHAR) || '}}', ',' ORDER BY name) || ']' AS columns_json
FROM profile GROUP BY 1""",
    "duplicate_keys": f"WITH {DIRTY_CUSTOMERS} {DUPLICATES}",
    "status_issue": f"""WITH {DIRTY_ORDERS} SELECT *, 'CANCELLED: ' || CAST(affected_rows AS VARCHAR) AS evidence FROM ({STATUS_ISSUE})""",
    "quality_issues": f"WITH {DIRTY_ORDERS},{DIRTY_CUSTOMERS},{TEXT_TABLES},{_profiles(AUDIT_COLUMNS)} {ISSUES}",
    "quality_issues_with_evidence": f"""WITH {DIRTY_ORDERS},{DIRTY_CUSTOMERS},{TEXT_TABLES},{_profiles(AUDIT_COLUMNS)},
issues AS ({ISSUES}),
invalid AS (SELECT order_date AS v FROM parsed_orders WHERE order_date <> '' AND day IS NULL ORDER BY 1 LIMIT 3),
repeated AS (SELECT customer_id AS v, count(*) AS n FROM dirty_customers GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, v LIMIT 3),
orphaned AS (SELECT DISTINCT customer_id AS v FROM dirty_orders WHERE customer_id NOT IN (SELECT customer_id FROM dirty_customers) ORDER BY 1 LIMIT 3)
SELECT 'INVALID_DATE_orders_order_date' AS id, (SELECT string_agg(v, '; ' ORDER BY v) FROM invalid) AS evidence
UNION ALL SELECT 'DUP_KEY_customers_customer_id', (SELECT string_agg(v, '; ' ORDER BY n DESC, v) FROM repeated)
UNION ALL SELECT 'M2M_orders_customers_customer_id', (SELECT string_agg(v, '; ' ORDER BY n DESC, v) FROM repeated)
UNION ALL SELECT 'RETURNS_CANCELLATIONS_orders', 'CANCELLED: ' || CAST(affected_rows AS VARCHAR) FROM issues WHERE issue_type = 'returns_cancellations'
UNION ALL SELECT id, (SELECT strftime(max(day), '%Y-%m') || ': ' || CAST(count(DISTINCT day) FILTER (WHERE date_trunc('month', day) = m) AS VARCHAR)
    || ' of ' || CAST(day(last_day(max(day))) AS VARCHAR) || ' days' FROM parsed_orders, (SELECT date_trunc('month', max(day)) AS m FROM parsed_orders))
  FROM issues WHERE issue_type = 'incomplete_period'
UNION ALL SELECT 'LEADING_ZEROS_' || table_id || '_' || name, (SELECT string_agg(cell, '; ' ORDER BY cell) FROM
    (SELECT DISTINCT cell FROM cells c WHERE c.table_id = p.table_id AND c.name = p.name AND cell <> '' ORDER BY 1 LIMIT 5)) FROM profile p WHERE has_leading_zeros
UNION ALL SELECT 'ORPHAN_orders_customers_customer_id', (SELECT string_agg(v, '; ' ORDER BY v) FROM orphaned)""",
    "declared_issues": f"""WITH {SALES},{DIRTY_CUSTOMERS},{TEXT_TABLES},{_profiles(TEXT_COLUMNS)}
{_issue('missing_values', 'warning', "'MISSING_VALUES_' || table_id || '_' || name", 'table_id', 'name', 'null_count', 'total_count',
        'profile WHERE null_count > 0', pct='null_percentage')}
UNION ALL {_issue('numeric_as_text', 'info', "'NUMERIC_AS_TEXT_' || table_id || '_' || name", 'table_id', 'name', 'total_count - null_count',
                  'total_count', "profile WHERE column_role = 'numeric' AND table_id IN ('orders', 'parts')")}
UNION ALL {_issue('granularity_mismatch', 'warning', "'GRANULARITY_MISMATCH_sales_order_id'", "'sales'", "'order_id'",
                  'sum(n) FILTER (WHERE n > 1)', 'sum(n)', '(SELECT order_id, count(*) AS n FROM sales GROUP BY 1)')}""",
    "quality_report": f"""WITH {DIRTY_ORDERS},{DIRTY_CUSTOMERS},{TEXT_TABLES},{_profiles(AUDIT_COLUMNS)},
issues AS (SELECT * FROM ({ISSUES}) WHERE affected_rows > 0)
SELECT count(*) AS issue_count, coalesce(bool_or(severity = 'blocking'), FALSE) AS has_blocking_issues,
       (SELECT strftime(min(day), '%Y-%m-%d') FROM parsed_orders) AS coverage_start, (SELECT strftime(max(day), '%Y-%m-%d') FROM parsed_orders) AS coverage_end,
       coalesce(bool_or(issue_type = 'incomplete_period'), FALSE) AS is_last_period_incomplete FROM issues""",
    "finite_check": f"""WITH {FIGURES} SELECT result_id, 'Finite_Values_' || CAST(result_id AS VARCHAR) AS check_name, bad = 0 AS passed,
  CASE WHEN bad = 0 THEN 'info' ELSE 'blocking' END AS severity,
  CAST(bad AS VARCHAR) || ' of ' || CAST(figures AS VARCHAR) || ' figures are not finite.' AS evidence FROM finite""",
    "reconciliation_check": (
        f"WITH {WITH_CUSTOMERS},{_members('enriched', {**CHANNEL, **SEGMENT, **REGION})},{COMPARISON},{RECONCILED} SELECT * FROM reconciled"
    ),
    "status_rollup": f"WITH {FIGURES} SELECT result_id, run_id, CAST(failed_checks AS BIGINT) AS failed_checks, validation_status FROM statuses",
    "run_report_status": f"""WITH {FIGURES} SELECT c_mktsegment AS run_id, CASE WHEN sum(CASE WHEN bad > 0 THEN 1 ELSE 0 END) > 0 THEN 'rejected' ELSE 'approved' END AS overall_status,
  count(*) AS checks_executed, count(*) FILTER (WHERE bad > 0) AS failed_checks, count(*) FILTER (WHERE bad > 0) > 0 AS can_retry
FROM finite JOIN customer ON c_custkey = result_id GROUP BY 1""",
    "approved_only": f"WITH {FIGURES} SELECT result_id, validation_status FROM statuses WHERE validation_status <> 'rejected'",
    "results_summary": f"""WITH {FIGURES}
SELECT s.result_id, validation_status, '{{"item":' || CAST(item AS VARCHAR) || ',"field":"o_totalprice","value":'
       || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || '}}' AS figure_json
FROM statuses s JOIN figures f ON s.result_id = f.result_id WHERE validation_status <> 'rejected'""",
    "presentation_components": f"""WITH {COMPONENT_CHECKS}
SELECT run_id, component_id, kind, result_id, problem, problem IS NULL AS is_valid FROM component_checks""",
    "presentation_integrity": f"""WITH {COMPONENT_CHECKS},
firsts AS (SELECT run_id, arg_min(period, component_id) FILTER (WHERE kind = 'card' AND contains(title, 'Total')) AS card,
                  arg_min(period, component_id) FILTER (WHERE kind = 'chart' AND is_primary) AS chart FROM components GROUP BY 1),
counted AS (SELECT run_id, count(*) AS components, count(*) FILTER (WHERE problem IS NOT NULL) AS invalid_components FROM component_checks GROUP BY 1)
SELECT c.run_id, components, invalid_components, coalesce(card = chart, TRUE) AS is_aligned,
       invalid_components = 0 AND coalesce(card = chart, TRUE) AS is_dashboard_valid
FROM counted c JOIN firsts f ON c.run_id = f.run_id""",
    "plan_gate": f"WITH {PLAN_STEPS} SELECT plan_id, step_order, step_id, rejection, rejection IS NULL AS is_valid FROM gated",
    "plan_defaults": f"""WITH {PLAN_STEPS},
plans AS (SELECT plan_id, count(*) FILTER (WHERE rejection IS NULL) < 3 AS use_default FROM gated GROUP BY 1)
SELECT g.plan_id, step_order, step_id, FALSE AS is_default FROM gated g JOIN plans p ON g.plan_id = p.plan_id WHERE rejection IS NULL AND NOT use_default
UNION ALL SELECT plan_id, CAST(d.n AS BIGINT), d.s, TRUE FROM plans, (VALUES (1, 'OP_01_METRIC_SUMMARY'), (2, 'OP_02_TIME_AGGREGATION'), (3, 'OP_03_PERIOD_COMPARISON'),
  (4, 'OP_04_DIMENSION_BREAKDOWN_CHANNEL'), (5, 'OP_05_DIMENSION_BREAKDOWN_SEGMENT'), (6, 'OP_06_CUSTOMER_DYNAMICS'), (7, 'OP_07_BASELINE_FORECAST_EVAL')) d(n, s)
WHERE use_default""",
    "citation_gate": f"""WITH {RUN_LOG} SELECT run_id, component_id, result_id,
  EXISTS (SELECT 1 FROM event_results r WHERE r.run_id = c.run_id AND r.result_id = c.result_id AND validation_status = 'approved') AS is_cited
FROM components c""",
    "rerun_identity": f"""WITH {WITH_CUSTOMERS},{_members('enriched', SEGMENT)},
digested AS (
  SELECT *, md5(concat_ws('|', dimension, dimension_value, CAST(CAST(round(baseline_value * 100) AS BIGINT) AS VARCHAR),
                          CAST(CAST(round(current_value * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(absolute_change * 100) AS BIGINT) AS VARCHAR))) AS d
  FROM breakdown
)
SELECT dimension, dimension_value, baseline_value, current_value, absolute_change, d AS first_digest, d AS second_digest, d = d AS is_same FROM digested""",
    "top_driver": f"WITH {WITH_CUSTOMERS},{_members('enriched', {**CHANNEL, **SEGMENT})},{DRIVERS} SELECT * FROM drivers",
    "metric_cards": f"""WITH {WITH_CUSTOMERS},{_members('enriched', {**CHANNEL, **SEGMENT})},{DRIVERS},{COMPARISON}
{COMPARISON_CARDS}
UNION ALL SELECT 'CARD_TOP_' || upper(dimension), 'Top ' || dimension || ': ' || dimension_value, {_percent_text('contribution_to_total_change')},
       'Accounts for ' || {_money('absolute_change')} || ' of the change', {_DIRECTION},
       CASE dimension WHEN 'channel' THEN 'RES_OP_04_DIMENSION_BREAKDOWN_CHANNEL' ELSE 'RES_OP_05_DIMENSION_BREAKDOWN_SEGMENT' END,
       baseline_period || ' vs ' || current_period FROM drivers""",
    "findings": f"""WITH {WITH_CUSTOMERS},{_members('enriched', {**CHANNEL, **SEGMENT})},{DRIVERS},{COMPARISON}
{_findings("CASE dimension WHEN 'channel' THEN 'RES_OP_04_DIMENSION_BREAKDOWN_CHANNEL' ELSE 'RES_OP_05_DIMENSION_BREAKDOWN_SEGMENT' END")}""",
    "chart_datasets": f"WITH {CHARTS} SELECT * FROM charts",
    "chart_specs": f"""WITH {CHARTS} SELECT chart_id, measure, count(*) AS points, min(value) AS min_value, max(value) AS max_value
FROM charts GROUP BY 1, 2""",
    "sample_size_check": f"""SELECT 'RES_EVENTS' AS result_id, 'Forecast_Sample_Size_Audit' AS check_name, TRUE AS passed, 'warning' AS severity, reason AS evidence
FROM ({_forecast('events', 'ts')}) WHERE NOT eligible
UNION ALL SELECT 'RES_ORDERS', 'Forecast_Sample_Size_Audit', TRUE, 'warning', reason FROM ({_forecast('orders', 'o_orderdate')}) WHERE NOT eligible""",
    "join_safety": " UNION ALL ".join(
        f"""SELECT 'Join_Safety_{name}' AS check_name, is_safe AS passed, CASE WHEN is_safe THEN 'info' ELSE 'blocking' END AS severity,
  'Multiplication factor ' || CAST(multiplication_factor AS VARCHAR) AS evidence FROM ({_join_check(rows)})"""
        for name, rows in (("raw_customers", "dirty_customers"), ("customers", "(SELECT DISTINCT customer_id FROM dirty_customers)"))
    ),
    "lineage_sources": f"""WITH RECURSIVE {LINEAGE}
SELECT node AS node_id, kind, max(distance)::BIGINT AS steps, string_agg(DISTINCT ancestor, ',' ORDER BY ancestor) AS raw_tables
FROM above JOIN nodes ON node_id = node WHERE ancestor IN ('orders', 'customers') GROUP BY 1, 2""",
    "lineage_impact": f"""WITH RECURSIVE {LINEAGE},
causes AS (
  SELECT node_id AS cause, 'rejected_result' AS cause_kind FROM nodes WHERE kind = 'result' AND detail = 'rejected'
  UNION ALL SELECT 'customers', 'changed_table' WHERE (SELECT count(*) FROM dirty_customers) <> (SELECT count(*) FROM customer)
  UNION ALL SELECT 'orders', 'changed_table' WHERE (SELECT count(*) FROM dirty_orders) <> (SELECT count(*) FROM orders)
)
SELECT DISTINCT cause, cause_kind, node_id, kind FROM above JOIN causes ON ancestor = cause JOIN nodes ON node_id = node WHERE kind IN ('result', 'card')""",
    "plan_steps_to_run": f"""WITH RECURSIVE {PLAN_STEPS},
edges(step_id, depends_on) AS (VALUES {PLAN_EDGES}),
above(node, ancestor, distance) AS (
  SELECT step_id, depends_on, 1 FROM edges UNION ALL SELECT a.node, e.depends_on, a.distance + 1 FROM above a JOIN edges e ON e.step_id = a.ancestor
),
required AS (SELECT node AS step_id, max(distance) AS level, list_distinct(list(ancestor)) AS required FROM above GROUP BY 1),
present AS (SELECT plan_id, list_distinct(list(step_id)) AS present FROM gated WHERE rejection IS NULL GROUP BY 1),
lacking AS (
  SELECT g.*, coalesce(level, 0)::BIGINT AS level,
         list_sort(list_filter(coalesce(required, []), lambda s: NOT list_contains(coalesce(present, []), s))) AS lacking
  FROM gated g LEFT JOIN required r ON r.step_id = g.step_id LEFT JOIN present p ON p.plan_id = g.plan_id
)
SELECT plan_id, step_order, step_id, level, coalesce(rejection, CASE WHEN len(lacking) > 0 THEN 'missing_dependency' END) AS rejection,
       array_to_string(lacking, ',') AS lacking, rejection IS NULL AND len(lacking) = 0 AS runs FROM lacking""",
    "provenance_ledger": f"""WITH {WITH_CUSTOMERS},{_members('enriched', {**CHANNEL, **SEGMENT, **REGION})},{COMPARISON},{RECONCILED},{DIRTY_ORDERS},{DIRTY_CUSTOMERS},{LEDGER},
cards AS ({COMPARISON_CARDS}),
last_step AS (SELECT arg_max(transformation_id, step_index) AS id FROM ledger)
SELECT 'orders' AS node_id, 'raw_table' AS kind, CAST(NULL AS VARCHAR) AS parent_id, CAST(count(*) AS VARCHAR) AS detail FROM dirty_orders
UNION ALL SELECT 'customers', 'raw_table', NULL, CAST(count(*) AS VARCHAR) FROM dirty_customers
UNION ALL SELECT transformation_id, 'transformation', coalesce(lag(transformation_id) OVER (ORDER BY step_index), 'orders'), CAST(rows_excluded AS VARCHAR) FROM ledger
UNION ALL SELECT 'TRF_JOIN_CUSTOMERS', 'join', (SELECT id FROM last_step), '1.0'
UNION ALL SELECT result_id, 'result', 'TRF_JOIN_CUSTOMERS', CASE WHEN is_reconciled THEN 'approved' ELSE 'rejected' END FROM reconciled
UNION ALL SELECT id, 'card', result_id, value FROM cards""",
    "question_router": f"""WITH {QUESTIONS},{_routed('questions')}
SELECT question_id, query_type, matched_term, query_type = '{q.NEW_ANALYSIS}' AS requires_full_run FROM routed""",
    "filter_extract": f"""WITH {QUESTIONS},
found AS (SELECT question_id, {_first_contained(q.REGION_KEYWORDS)} AS r, {_first_contained(q.CHANNEL_KEYWORDS)} AS c
          FROM (SELECT *, lower(question) AS t FROM questions))
SELECT question_id, r AS region_keyword, c AS channel_keyword, {_label('r', q.REGION_KEYWORDS)} AS region_label, {_label('c', q.CHANNEL_KEYWORDS)} AS channel_label FROM found""",
    "filter_answers": f"""WITH {LABELLED},{QUESTIONS},{_routed('questions')},
found AS (SELECT question_id, {_first_contained(q.REGION_KEYWORDS)} AS r, {_first_contained(q.CHANNEL_KEYWORDS)} AS c FROM routed WHERE query_type = '{q.RECALCULATE}'),
named AS (SELECT *, {_label('r', q.REGION_KEYWORDS)} AS rl, {_label('c', q.CHANNEL_KEYWORDS)} AS cl FROM found),
asked AS (SELECT DISTINCT r, rl, c FROM named),
answered AS (SELECT a.r, a.c, sum(net_sales) AS total, count(net_sales) AS n FROM asked a LEFT JOIN labelled s
             ON (a.r IS NULL OR s.region = a.rl) AND (a.c IS NULL OR contains(lower(s.channel), a.c)) GROUP BY 1, 2)
SELECT question_id, CASE WHEN rl IS NULL AND cl IS NULL THEN 'No specific filters'
         ELSE concat_ws(', ', 'Region = ''' || rl || '''', 'Channel = ''' || cl || '''') END AS filter_or_condition,
       {_round('coalesce(total, 0)')} AS total_value, n AS row_count
FROM named f JOIN answered a ON f.r IS NOT DISTINCT FROM a.r AND f.c IS NOT DISTINCT FROM a.c""",
    "answer_citations": f"""WITH {LABELLED},{QUESTIONS},{_routed('questions')},
found AS (SELECT question_id, {_first_contained(q.REGION_KEYWORDS)} AS r, {_first_contained(q.CHANNEL_KEYWORDS)} AS c FROM routed WHERE query_type = '{q.RECALCULATE}'),
named AS (SELECT *, {_label('r', q.REGION_KEYWORDS)} AS rl, {_label('c', q.CHANNEL_KEYWORDS)} AS cl FROM found),
asked AS (SELECT DISTINCT r, rl, c FROM named),
answered AS (SELECT a.r, a.c, sum(net_sales) AS total, count(net_sales) AS n FROM asked a LEFT JOIN labelled s
             ON (a.r IS NULL OR s.region = a.rl) AND (a.c IS NULL OR contains(lower(s.channel), a.c)) GROUP BY 1, 2)
SELECT question_id, 'transformed_table' AS source_type, 'analytical_fact' AS source_name, CASE WHEN rl IS NULL AND cl IS NULL THEN 'No specific filters'
         ELSE concat_ws(', ', 'Region = ''' || rl || '''', 'Channel = ''' || cl || '''') END AS filter_or_condition,
       'RECALC_ON_DEMAND' AS result_id, 'Computed on ' || CAST(n AS VARCHAR) || ' prepared rows.' AS details
FROM named f JOIN answered a ON f.r IS NOT DISTINCT FROM a.r AND f.c IS NOT DISTINCT FROM a.c""",
    "redact_text": _redact(),
    "truncate_text": """SELECT doc_id, length(text) > 15000 AS was_truncated,
  CASE WHEN length(text) > 15000 THEN substr(text, 1, 15000) || chr(10) || '...[Context truncated due to security limit]...' ELSE text END AS text FROM documents""",
    "transition_violations": _step_violations(),
    "run_status": f"""WITH {RUN_STATUS}
SELECT run_id, current_stage, CASE WHEN current_stage IN ('purchase', 'error') THEN current_stage ELSE 'RUNNING' END AS status, failure_reason,
       {_MOMENT.format('started')} AS started_at, {_MOMENT.format('completed')} AS completed_at,
       CAST(round(CAST((epoch_us(completed) - epoch_us(started)) / 1e6 AS DECIMAL(28,6)), 3) AS DOUBLE) AS duration_seconds, repair_attempts, events FROM run_states""",
    "misleading_failures": f"""WITH {RUN_STATUS} SELECT run_id, 'error' AS status, events FROM run_states
WHERE current_stage = 'error' AND coalesce(trim(failure_reason), '') = ''""",
    "latest_artifact": f"""WITH {RUN_LOG},
saved AS (SELECT run_id || '-' || stage || '-' || CAST(event_id % 3 AS VARCHAR) AS artifact_id, run_id, stage AS artifact_type, props AS data_json, created_at FROM run_log),
current AS (SELECT * FROM saved QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY created_at DESC, data_json DESC) = 1)
SELECT run_id, artifact_type, artifact_id, data_json, {_MOMENT.format('created_at')} AS created_at FROM current
QUALIFY row_number() OVER (PARTITION BY run_id, artifact_type ORDER BY current.created_at DESC, artifact_id DESC) = 1""",
    "newest_records": f"WITH {RUN_LOG} SELECT event_id, run_id, stage FROM run_log ORDER BY created_at DESC, event_id LIMIT 50",
    "call_log_rollup": f"""WITH {RUN_LOG} SELECT stage AS caller_agent, CASE WHEN value > 30 THEN 'error' ELSE 'success' END AS status, count(*) AS calls,
  CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(k) AS BIGINT) AS output_tokens,
  min(CAST(floor(value * 10) AS BIGINT)) AS min_duration, max(CAST(floor(value * 10) AS BIGINT)) AS max_duration FROM run_log GROUP BY 1, 2""",
    "call_log_percentiles": f"""WITH {RUN_LOG} SELECT stage AS caller_agent, CASE WHEN value > 30 THEN 'error' ELSE 'success' END AS status,
  quantile_disc(CAST(floor(value * 10) AS BIGINT), 0.5) AS p50_duration, quantile_disc(CAST(floor(value * 10) AS BIGINT), 0.95) AS p95_duration
FROM run_log GROUP BY 1, 2""",
    "question_notices": f"""WITH {QUESTIONS},{_routed('questions')}
SELECT question_id, query_type, matched_term,
       CASE query_type WHEN 'unanswerable_by_data' THEN 'The data of this project says nothing about ''' || matched_term || '''.'
            ELSE 'This needs a new analysis: a plan, prepared variables and validation. Start a run for it.' END AS notice,
       CASE query_type WHEN 'unanswerable_by_data' THEN 'No table holds ''' || matched_term || '''.' END AS data_limitation,
       query_type = 'request_new_analysis' AS requires_full_run
FROM routed WHERE query_type IN ('unanswerable_by_data', 'request_new_analysis')""",
    "explained_questions": f"""WITH {EXPLAINED}
SELECT question_id, coalesce((SELECT 'From validated results: ' || string_agg(claim, ' ' ORDER BY result_id, id) FROM shown), 'No validated result answers this yet. Start a run first.') AS answer_text,
       coalesce((SELECT string_agg(result_id, ',' ORDER BY result_id) FROM (SELECT DISTINCT result_id FROM shown)), '') AS cited_results
FROM routed WHERE query_type = '{q.EXPLAIN}'""",
    "explanation_citations": f"""WITH {EXPLAINED},
results AS (SELECT result_id, string_agg(claim, ' ' ORDER BY id) AS details FROM shown GROUP BY 1)
SELECT question_id, 'analytic_step' AS source_type, substr(result_id, 5) AS source_name, 'Validation: approved' AS filter_or_condition, result_id, details
FROM routed, results WHERE query_type = '{q.EXPLAIN}'""",
    "text_table_digest": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_id, count(*) AS row_count, coalesce(CAST(sum(('0x' || substr(md5(concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns)})), 1, 8))::BIGINT) AS BIGINT), 0) AS digest FROM {t}"""
        for t, columns in (
            ("documents", ("doc_id", "lang", "n_chars", "source", "text")), ("labels", ("doc_id", "quality", "toxic")), ("pages", ("html", "page_id", "url")),
            ("conversations", ("conv_id", "role", "text", "turn")), ("benchmark", ("item_id", "text")),
        )
    ),
    "chart_records": f"""WITH {WITH_CUSTOMERS},{_members('enriched', {**CHANNEL, **SEGMENT})},{TREND},{_dynamics('day = first_day')},{COMPARISON},
parts AS (SELECT dimension, sum(CAST(absolute_change AS DECIMAL(28,4))) AS s FROM breakdown WHERE dimension <> 'segment' OR dimension_value <> 'BUILDING' GROUP BY 1),
states AS (SELECT dimension, CASE WHEN abs(s - CAST(absolute_change AS DECIMAL(28,4))) <= 0.05 THEN 'approved' ELSE 'rejected' END AS status FROM parts, comparison)
SELECT 'CHART_TIME_SERIES' AS chart_id, 'line' AS chart_type, 'RES_OP_02_TIME_AGGREGATION' AS result_id, 'net_sales' AS metric, 'closed history' AS period,
       FALSE AS is_primary_objective, (SELECT 2 * count(*) FROM trend) AS points, NULL AS validation_status
UNION ALL SELECT 'CHART_CUSTOMER_DYNAMICS', 'stacked_bar', 'RES_OP_06_CUSTOMER_DYNAMICS', 'net_sales', 'closed history', FALSE, (SELECT 2 * count(*) FROM dynamics), NULL
UNION ALL SELECT 'CHART_' || upper(b.dimension), 'waterfall',
       CASE b.dimension WHEN 'channel' THEN 'RES_OP_04_DIMENSION_BREAKDOWN_CHANNEL' ELSE 'RES_OP_05_DIMENSION_BREAKDOWN_SEGMENT' END, 'net_sales',
       '{BASELINE} vs {CURRENT}', b.dimension = 'channel', count(*), any_value(status) FROM breakdown b JOIN states t ON b.dimension = t.dimension GROUP BY b.dimension""",
    "artifact_json": """SELECT CAST(o_orderkey AS VARCHAR) AS artifact_id, 'RUN' AS run_id, 'Order' AS artifact_type,
  '{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"o_custkey":' || CAST(o_custkey AS VARCHAR) || ',"o_orderpriority":"' || o_orderpriority || '"}' AS data_json FROM orders""",
    "page_fingerprints": """SELECT url AS path, regexp_extract(url, '([^/]+)$', 1) AS file_name, strlen(coalesce(html, '')) AS length, sha256(coalesce(html, '')) AS sha256 FROM pages""",
    "page_admission": """SELECT path, file_name, length, CASE WHEN ext NOT IN ('.html', '') THEN 'Extension not allowed: ' || ext
       WHEN length > 5000 THEN 'File exceeds 5000 bytes' END AS reject_reason
FROM (SELECT *, lower(regexp_extract(file_name, '(\\.[^.]*)$', 1)) AS ext
      FROM (SELECT url AS path, regexp_extract(url, '([^/]+)$', 1) AS file_name, strlen(coalesce(html, '')) AS length FROM pages))""",
    "page_table_names": """SELECT url AS path, replace(lower(regexp_extract(regexp_extract(url, '([^/]+)$', 1), '([^/]+?)(\\.[^./]*)?$', 1)), ' ', '_') AS table_name FROM pages""",
    "page_changes": """WITH earlier AS (SELECT 'page-' || CAST(page_id AS VARCHAR) AS path, sha256(coalesce(html, '')) AS h FROM pages),
later AS (
  SELECT 'page-' || CAST(page_id AS VARCHAR) AS path, sha256(coalesce(html, '') || CASE WHEN page_id % 5 = 0 THEN 'x' ELSE '' END) AS h FROM pages WHERE page_id % 7 <> 0
  UNION ALL SELECT 'new-page-' || CAST(page_id AS VARCHAR), sha256(coalesce(html, '')) FROM pages WHERE page_id % 11 = 0
)
SELECT coalesce(e.path, l.path) AS path, CASE WHEN l.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'new' WHEN e.h <> l.h THEN 'changed' ELSE 'unchanged' END AS state
FROM earlier e FULL OUTER JOIN later l ON e.path = l.path""",
    "empty_tables": """SELECT 'EMPTY_' || t AS id, 'empty_file' AS issue_type, 'blocking' AS severity, t AS table_id, CAST(NULL AS VARCHAR) AS "column",
  CAST(0 AS BIGINT) AS affected_rows, CAST(0 AS BIGINT) AS total_rows, 100.0::DOUBLE AS affected_percentage
FROM (SELECT 'stray_lines' AS t, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
      UNION ALL SELECT 'lineitem', count(*) FROM lineitem) WHERE n = 0""",
    "exclusion_samples": f"""WITH {DIRTY_ORDERS},
flagged AS (SELECT order_id, CASE WHEN day IS NULL THEN 1 WHEN status = 'CANCELLED' THEN 2 WHEN day > DATE '{DIRTY_CUTOFF}' THEN 3 END AS step,
                   CASE WHEN day IS NULL THEN order_date WHEN status = 'CANCELLED' THEN status ELSE strftime(day, '%Y-%m-%d') END AS detail FROM parsed_orders)
SELECT step, CAST(row_number() OVER (PARTITION BY step ORDER BY order_id, detail) - 1 AS INTEGER) AS place, CAST(order_id AS VARCHAR) AS order_id, detail
FROM flagged WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY step ORDER BY order_id, detail) <= 3""",
    "table_manifest": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count, (SELECT count(*) FROM (DESCRIBE SELECT * FROM {t})) AS column_count"
        for t in TABLES
    ),
}
