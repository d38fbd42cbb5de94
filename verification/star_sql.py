"""DuckDB SQL for the registered queries, written independently of the Spark plans.

Every statement starts from the star tables. Money is rendered as DOUBLE, dates and
timestamps as ISO text, counters as BIGINT, matching the plain form of the queries.
"""

from __future__ import annotations

from verification.dirt import DIRT

START, END = "DATE '1996-02-01'", "DATE '1997-07-31'"
CUTOFF = "TIMESTAMP '1997-07-31 23:59:59'"
EVENT_CUTOFF = "TIMESTAMP '2024-01-28 00:00:00'"
MIN_STATE, MIN_GROUP = 30, 1


def _sources(strict: bool = False) -> str:
    done = "'delivered'" if strict else "if(shipped IS NULL, 'unavailable', 'delivered')"
    return f"""
ship AS (SELECT l_orderkey AS ok, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey),
s_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
    CASE o_orderstatus WHEN 'F' THEN {done} WHEN 'O' THEN 'shipped' WHEN 'P' THEN 'canceled' END AS order_status,
    o_orderdate AS bought_at, shipped AS arrived_at,
    o_orderdate + to_days(300 * CAST(left(o_orderpriority, 1) AS INTEGER)) AS promised_at
  FROM orders LEFT JOIN ship ON ok = o_orderkey),
s_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS order_item_id,
    CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id, l_shipdate,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS DECIMAL(18,2)) AS freight
  FROM lineitem),
s_reviews AS (
  SELECT l_partkey || '-' || l_linenumber AS review_id, CAST(l_orderkey AS VARCHAR) AS order_id,
    CAST(l_quantity AS INTEGER) % 7 AS score, l_shipdate - to_days(l_linenumber) AS created_at,
    CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS answered_at
  FROM lineitem),
s_payments AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 1 AS seq, lower(o_orderpriority) AS kind,
    CAST(left(o_orderpriority, 1) AS INTEGER) AS installments,
    CAST(o_totalprice AS DECIMAL(18,2)) AS paid
  FROM orders),
s_customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CAST(c_custkey AS VARCHAR) AS person,
    CAST(c_nationkey AS VARCHAR) AS zip, lower(c_mktsegment) AS city, coalesce(n_name, 'UNKNOWN') AS state
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey),
s_translation AS (
  SELECT DISTINCT p_brand AS brand, 'brand_' || regexp_extract(p_brand, '([0-9]+)$', 1) AS english
  FROM part WHERE CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 2 = 1),
s_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_brand AS brand, length(p_name) AS name_len,
    length(p_type) AS type_len, p_size AS size
  FROM part)"""


_FACTS = """
goods AS (
  SELECT order_id, count(*) AS item_count,
    if(min(price) >= 0 AND count(*) = count(price), CAST(sum(price) AS DECIMAL(18,2)), NULL) AS goods_value,
    if(min(freight) >= 0 AND count(*) = count(freight), CAST(sum(freight) AS DECIMAL(18,2)), NULL) AS freight_value
  FROM s_items GROUP BY order_id),
money AS (
  SELECT order_id, if(min(paid) >= 0 AND count(*) = count(paid), CAST(sum(paid) AS DECIMAL(18,2)), NULL) AS paid_value
  FROM s_payments GROUP BY order_id),
opinion AS (
  SELECT order_id, score, created_at, answered_at FROM s_reviews
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY
    answered_at DESC NULLS LAST, created_at DESC NULLS LAST, review_id NULLS LAST, score NULLS LAST) = 1),
fo AS (
  SELECT order_id, person, coalesce(state, 'UNKNOWN') AS state, order_status AS status, bought_at,
    CAST(bought_at AS DATE) AS day, CAST(date_trunc('month', bought_at) AS DATE) AS month,
    coalesce(item_count, 0) AS item_count, goods_value, freight_value, paid_value, arrived_at, promised_at,
    score, answered_at, created_at,
    if(status = 'delivered' AND arrived_at >= bought_at,
       date_diff('microsecond', bought_at, arrived_at) / 1e6 / 86400, NULL) AS days,
    coalesce(status = 'delivered' AND arrived_at >= bought_at AND promised_at >= bought_at, false) AS dated,
    coalesce(score >= 1 AND score <= 5, false) AS rated,
    answered_at < arrived_at AS early,
    if(dated, CAST(arrived_at AS DATE) > CAST(promised_at AS DATE), NULL) AS late
  FROM s_orders LEFT JOIN goods USING (order_id) LEFT JOIN money USING (order_id)
    LEFT JOIN opinion USING (order_id) LEFT JOIN s_customers USING (customer_id)),
fi AS (
  SELECT i.order_id, order_item_id, i.product_id, coalesce(english, p.brand, 'UNKNOWN') AS category,
    coalesce(state, 'UNKNOWN') AS state, order_status AS status, bought_at,
    CAST(bought_at AS DATE) AS day, CAST(date_trunc('month', bought_at) AS DATE) AS month, price, freight
  FROM s_items i LEFT JOIN s_orders o ON o.order_id = i.order_id
    LEFT JOIN s_customers c ON c.customer_id = o.customer_id
    LEFT JOIN s_products p ON p.product_id = i.product_id
    LEFT JOIN s_translation t ON t.brand = p.brand)"""

_WINDOW = f"""
months AS (
  SELECT CAST(unnest(generate_series({START}, {END}, INTERVAL 1 MONTH)) AS DATE) AS month),
states AS (SELECT state FROM fo UNION SELECT 'UNKNOWN'),
win AS (SELECT * FROM fo WHERE day >= {START} AND day <= {END}),
del AS (SELECT * FROM win WHERE status = 'delivered'),
sold AS (SELECT * FROM fi WHERE day >= {START} AND day <= {END} AND status = 'delivered')"""


def _sql(ctes: str, body: str, base: str | None = None, strict: bool = False) -> str:
    parts = [_sources(strict), _FACTS, _WINDOW] if base is None else [base]
    if ctes:
        parts.append(ctes)
    return "WITH " + ",".join(parts) + "\n" + body


def _n(condition: str) -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


def _r(top: str, bottom: str) -> str:
    return f"CASE WHEN ({bottom}) <> 0 THEN CAST({top} AS DOUBLE) / CAST({bottom} AS DOUBLE) END"


_Q01 = f"""
per AS (
  SELECT month, count(*) AS total, {_n("status = 'delivered'")} AS done, {_n("status = 'canceled'")} AS gone,
    {_n("status = 'delivered' AND goods_value IS NOT NULL")} AS known,
    sum(CASE WHEN status = 'delivered' THEN goods_value END) AS amount
  FROM win GROUP BY month),
spread AS (
  SELECT m.month, coalesce(total, 0) AS total, coalesce(done, 0) AS done, coalesce(gone, 0) AS gone,
    coalesce(known, 0) AS known,
    CAST(CASE WHEN coalesce(done, 0) = coalesce(known, 0) THEN coalesce(amount, 0) END AS DOUBLE) AS amount
  FROM months m LEFT JOIN per p ON p.month = m.month)"""
_Q01_BODY = f"""
SELECT CAST(month AS VARCHAR) AS purchase_month, total AS all_orders, done AS delivered_orders,
  gone AS canceled_orders, known AS valid_merchandise_orders, amount AS merchandise_value,
  {_r("amount", "done")} AS average_order_value, {_r("gone", "total")} AS canceled_order_share,
  month >= {START} AND last_day(month) <= {END} AS complete_calendar_month
FROM spread"""

_Q02 = f"""
per AS (SELECT month, count(*) AS done, count(goods_value) AS known, sum(goods_value) AS amount FROM del GROUP BY month),
flat AS (
  SELECT m.month, coalesce(done, 0) AS n,
    CASE WHEN coalesce(done, 0) = coalesce(known, 0) THEN coalesce(amount, 0) END AS v
  FROM months m LEFT JOIN per p ON p.month = m.month),
rated AS (SELECT *, {_r("v", "n")} AS a FROM flat),
pair AS (
  SELECT cur.month, cur.n, cur.v, cur.a, old.n AS n0, old.v AS v0, old.a AS a0
  FROM rated cur LEFT JOIN rated old ON old.month + INTERVAL 1 MONTH = cur.month)"""
_Q02_BODY = f"""
SELECT CAST(month AS VARCHAR) AS purchase_month, n AS delivered_orders, CAST(v AS DOUBLE) AS merchandise_value,
  a AS average_order_value, CAST(v0 AS DOUBLE) AS previous_merchandise_value, n0 AS previous_delivered_orders,
  a0 AS previous_average_order_value, CAST(v - v0 AS DOUBLE) AS merchandise_change,
  {_r("v - v0", "v0")} AS merchandise_change_rate,
  CAST(n - n0 AS DOUBLE) * a0 AS order_count_contribution,
  CAST(n AS DOUBLE) * (a - a0) AS average_order_value_contribution,
  CAST(v - v0 AS DOUBLE) - CAST(n - n0 AS DOUBLE) * a0 - CAST(n AS DOUBLE) * (a - a0) AS decomposition_residual
FROM pair"""

_Q03 = f"""
place AS (
  SELECT category, row_number() OVER (ORDER BY amount DESC, category) AS pos
  FROM (SELECT category, sum(price) AS amount FROM sold GROUP BY category)),
tagged AS (
  SELECT month, order_id, price, if(pos > 10, 'OTHER', s.category) AS grp, least(pos, 11) AS pos
  FROM sold s JOIN place p ON p.category = s.category),
whole AS (SELECT grp, pos, sum(price) AS amount, count(DISTINCT order_id) AS buyers FROM tagged GROUP BY grp, pos),
cell AS (SELECT month, grp, pos, sum(price) AS amount, count(DISTINCT order_id) AS buyers FROM tagged GROUP BY month, grp, pos),
grid AS (
  SELECT m.month, w.grp, w.pos, coalesce(c.amount, 0) AS amount, coalesce(c.buyers, 0) AS buyers
  FROM months m, whole w LEFT JOIN cell c ON c.month = m.month AND c.grp = w.grp AND c.pos = w.pos),
moved AS (
  SELECT g.*, b.amount AS was, g.amount - b.amount AS delta
  FROM grid g LEFT JOIN grid b ON b.grp = g.grp AND b.pos = g.pos AND b.month + INTERVAL 1 MONTH = g.month),
sums AS (SELECT month, sum(amount) AS amount, sum(delta) AS delta FROM moved GROUP BY month)"""
_Q03_BODY = f"""
SELECT 'WINDOW' AS period, CAST(NULL AS VARCHAR) AS purchase_month, grp AS category, pos AS category_rank,
  CAST(amount AS DOUBLE) AS merchandise_value, buyers AS containing_category_orders,
  {_r("amount", "(SELECT sum(amount) FROM whole)")} AS merchandise_share,
  CAST(NULL AS DOUBLE) AS previous_merchandise_value, CAST(NULL AS DOUBLE) AS merchandise_change,
  CAST(NULL AS DOUBLE) AS change_contribution_share
FROM whole
UNION ALL
SELECT 'MONTH', CAST(m.month AS VARCHAR), grp, pos, CAST(m.amount AS DOUBLE), buyers, {_r("m.amount", "s.amount")},
  CAST(was AS DOUBLE), CAST(m.delta AS DOUBLE), {_r("m.delta", "s.delta")}
FROM moved m JOIN sums s ON s.month = m.month"""

_CELL_COUNTS = f"""count(*) AS n, {_n("dated")} AS n_dated, {_n("late")} AS n_late, {_n("rated")} AS n_rated,
    {_n("rated AND score < 3")} AS n_low, {_n("dated AND rated")} AS n_both,
    {_n("dated AND rated AND score < 3")} AS n_both_low"""
_Q04 = f"""
per AS (
  SELECT state, {_CELL_COUNTS}, CASE WHEN count(*) = count(goods_value) THEN sum(goods_value) END AS amount
  FROM del GROUP BY state),
full_rank AS (SELECT state, row_number() OVER (ORDER BY amount DESC NULLS LAST, state) AS amount_pos FROM per),
able AS (SELECT *, {_r("n_late", "n_dated")} AS late_share FROM per WHERE n >= {MIN_STATE} AND n_dated > 0),
late_rank AS (
  SELECT state, row_number() OVER (ORDER BY late_share DESC, n_late DESC, n DESC, state) AS late_pos FROM able)"""
_Q04_BODY = f"""
SELECT p.state AS customer_state, n AS delivered_orders, CAST(amount AS DOUBLE) AS merchandise_value,
  n_dated AS delivery_eligible_orders, n_late AS late_orders, n_rated AS review_eligible_orders,
  n_low AS low_score_orders, n_both AS joint_eligible_orders, n_both_low AS joint_low_score_orders,
  {_r("amount", "(SELECT sum(amount) FROM per)")} AS merchandise_share, amount_pos AS merchandise_rank,
  {_r("n_dated", "n")} AS delivery_coverage, {_r("n_rated", "n")} AS review_coverage,
  {_r("n_both", "n")} AS joint_coverage, {_r("n_late", "n_dated")} AS late_share,
  {_r("n_low", "n_rated")} AS low_score_share, {_r("n_both_low", "n_both")} AS joint_low_score_share,
  n >= {MIN_STATE} AND n_dated > 0 AS meets_state_threshold, late_pos AS investigation_rank,
  CAST({MIN_STATE} AS BIGINT) AS min_state_orders
FROM per p JOIN full_rank f ON f.state = p.state LEFT JOIN late_rank l ON l.state = p.state"""

_Q05_BODY = """
{lead}, count(order_id) AS delivered_orders, count(days) AS duration_eligible_orders,
  CASE WHEN count(order_id) > 0 THEN CAST(count(days) AS DOUBLE) / count(order_id) END AS duration_coverage,
  round(quantile_cont(days, 0.5), 6) AS median_delivery_days, round(quantile_cont(days, 0.9), 6) AS p90_delivery_days,
  min(days) AS min_delivery_days, max(days) AS max_delivery_days"""


def _q05() -> str:
    whole = _Q05_BODY.format(
        lead="SELECT 'WINDOW' AS scope, CAST(NULL AS VARCHAR) AS purchase_month, CAST(NULL AS VARCHAR) AS customer_state"
    )
    month = _Q05_BODY.format(lead="SELECT 'MONTH', CAST(m.month AS VARCHAR), NULL")
    state = _Q05_BODY.format(lead="SELECT 'STATE', NULL, s.state")
    return (
        f"{whole} FROM del UNION ALL {month} FROM months m LEFT JOIN del d ON d.month = m.month GROUP BY m.month "
        f"UNION ALL {state} FROM states s LEFT JOIN del d ON d.state = s.state GROUP BY s.state"
    )


_Q06 = f"""
cell AS (SELECT month, state, {_CELL_COUNTS} FROM del GROUP BY month, state),
grid AS (
  SELECT m.month, s.state, coalesce(n, 0) AS n, coalesce(n_dated, 0) AS n_dated, coalesce(n_late, 0) AS n_late,
    coalesce(n_rated, 0) AS n_rated, coalesce(n_both, 0) AS n_both, coalesce(n_both_low, 0) AS n_both_low
  FROM months m, states s LEFT JOIN cell c ON c.month = m.month AND c.state = s.state)"""
_Q06_BODY = f"""
SELECT CAST(month AS VARCHAR) AS purchase_month, state AS customer_state, n AS delivered_orders,
  n_dated AS delivery_eligible_orders, n_late AS late_orders, n_rated AS review_eligible_orders,
  n_both AS joint_eligible_orders, n_both_low AS joint_low_score_orders,
  n - n_dated AS missing_or_invalid_delivery_orders, {_r("n_late", "n_dated")} AS late_share,
  {_r("n_dated", "n")} AS delivery_coverage, {_r("n_rated", "n")} AS review_coverage,
  {_r("n_both", "n")} AS joint_coverage, {_r("n_both_low", "n_both")} AS joint_low_score_share
FROM grid"""

_SCORES = range(1, 6)
_Q07 = """
both_ok AS (SELECT * FROM del WHERE dated AND rated),
grp AS (SELECT unnest(['ON_TIME', 'LATE']) AS g)"""
_Q07_BODY = f"""
SELECT g AS delivery_group, count(order_id) AS joint_eligible_orders, {_n("score < 3")} AS low_score_orders,
  {", ".join(_n(f"score = {k}") + f" AS score_{k}_orders" for k in _SCORES)},
  count(answered_at) AS answer_timestamp_orders, {_n("early")} AS early_answer_orders,
  {_r(_n("score < 3"), "count(order_id)")} AS low_score_share,
  {", ".join(_r(_n(f"score = {k}"), "count(order_id)") + f" AS score_{k}_share" for k in _SCORES)},
  {_r("count(answered_at)", "count(order_id)")} AS answer_timestamp_coverage
FROM grp LEFT JOIN both_ok ON late = (g = 'LATE') GROUP BY g"""

_Q08 = f"""
both_ok AS (SELECT * FROM del WHERE dated AND rated),
pick AS (
  SELECT *, 'ALL_JOINT' AS sample FROM both_ok
  UNION ALL SELECT *, 'EXCLUDE_EARLY_ANSWERS' FROM both_ok WHERE early IS NULL OR NOT early),
cell AS (
  SELECT month, state, sample, count(*) AS n, {_n("NOT late")} AS n0, {_n("late")} AS n1,
    {_n("NOT late AND score < 3")} AS low0, {_n("late AND score < 3")} AS low1,
    count(answered_at) AS answered, {_n("early")} AS n_early
  FROM pick GROUP BY month, state, sample),
gone AS (SELECT month, state, {_n("early")} AS removed FROM both_ok GROUP BY month, state),
grid AS (
  SELECT m.month, s.state, k.sample, coalesce(n, 0) AS n, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1,
    coalesce(low0, 0) AS low0, coalesce(low1, 0) AS low1, coalesce(answered, 0) AS answered,
    coalesce(n_early, 0) AS n_early, if(k.sample = 'ALL_JOINT', 0, coalesce(removed, 0)) AS removed
  FROM months m, states s, (SELECT unnest(['ALL_JOINT', 'EXCLUDE_EARLY_ANSWERS']) AS sample) k
    LEFT JOIN cell c ON c.month = m.month AND c.state = s.state AND c.sample = k.sample
    LEFT JOIN gone e ON e.month = m.month AND e.state = s.state)"""
_Q08_BODY = f"""
SELECT CAST(month AS VARCHAR) AS purchase_month, state AS customer_state, sample, n AS joint_eligible_orders,
  n0 AS on_time_orders, n1 AS late_orders, low0 AS on_time_low_score_orders, low1 AS late_low_score_orders,
  answered AS answer_timestamp_orders, n_early AS early_answer_orders,
  CAST(removed AS BIGINT) AS excluded_early_answer_orders,
  {_r("low0", "n0")} AS on_time_low_score_share, {_r("low1", "n1")} AS late_low_score_share,
  ({_r("low1", "n1")}) - ({_r("low0", "n0")}) AS low_score_share_gap,
  least(n0, n1) >= {MIN_GROUP} AS meets_group_threshold, {_r("answered", "n")} AS answer_timestamp_coverage,
  CAST({MIN_GROUP} AS BIGINT) AS min_group_orders
FROM grid"""

_FIRSTS = f"""
seen AS (
  SELECT person, bought_at, min(order_id) AS oid, count(*) AS k FROM fo
  WHERE status = 'delivered' AND bought_at <= {CUTOFF} AND person IS NOT NULL GROUP BY person, bought_at),
head AS (SELECT person, min(bought_at) AS t0, sum(k) AS total FROM seen GROUP BY person),
follow AS (SELECT s.person, min(s.bought_at) AS t1 FROM seen s JOIN head h ON h.person = s.person AND s.bought_at > h.t0 GROUP BY s.person),
firsts AS (
  SELECT h.person, a.oid AS first_id, t0, a.k - 1 AS twins, b.oid AS next_id, t1, CAST(total AS BIGINT) AS total,
    t0 + INTERVAL 30 DAY <= {CUTOFF} AS ripe, coalesce(t1 <= t0 + INTERVAL 30 DAY, false) AS again
  FROM head h JOIN seen a ON a.person = h.person AND a.bought_at = t0
    LEFT JOIN follow f ON f.person = h.person
    LEFT JOIN seen b ON b.person = h.person AND b.bought_at = t1)"""
_Q09_BODY = """
SELECT person AS customer_unique_id, first_id AS first_order_id, CAST(t0 AS VARCHAR) AS first_purchase_timestamp,
  CAST(CAST(date_trunc('month', t0) AS DATE) AS VARCHAR) AS cohort_month, total AS delivered_orders_observed,
  twins AS simultaneous_additional_orders, next_id AS next_order_id, CAST(t1 AS VARCHAR) AS next_purchase_timestamp,
  date_diff('microsecond', t0, t1) / 1e6 / 86400 AS days_to_next_purchase, ripe AS has_30_day_observation,
  again AS repeat_within_30_days
FROM firsts"""
_Q10 = (
    _FIRSTS
    + f""",
cohort AS (
  SELECT CAST(date_trunc('month', t0) AS DATE) AS month, count(*) AS n, {_n("ripe")} AS n_ripe, {_n("NOT ripe")} AS n_raw,
    {_n("ripe AND again")} AS n_again, {_n("twins > 0")} AS n_twins, CAST(sum(twins) AS BIGINT) AS twins
  FROM firsts WHERE CAST(t0 AS DATE) >= {START} AND CAST(t0 AS DATE) <= {END} GROUP BY 1),
board AS (
  SELECT m.month, coalesce(n, 0) AS n, coalesce(n_ripe, 0) AS n_ripe, coalesce(n_raw, 0) AS n_raw,
    coalesce(n_again, 0) AS n_again, coalesce(n_twins, 0) AS n_twins, coalesce(twins, 0) AS twins,
    m.month + INTERVAL 1 MONTH + INTERVAL 30 DAY <= {CUTOFF} + INTERVAL 1 MICROSECOND AS closed
  FROM months m LEFT JOIN cohort c ON c.month = m.month)"""
)
_Q10_BODY = f"""
SELECT CAST(month AS VARCHAR) AS cohort_month, n AS total_customers, n_ripe AS eligible_customers,
  n_raw AS immature_customers, n_again AS repeat_customers_30d, n_twins AS customers_with_simultaneous_orders,
  twins AS simultaneous_additional_orders, {_r("n_again", "n_ripe")} AS repeat_share_30d,
  {_r("n_ripe", "n")} AS observation_coverage,
  CASE WHEN n = 0 THEN 'EMPTY' WHEN n_raw = 0 THEN 'ALL_OBSERVED_CUSTOMERS_MATURE'
    WHEN n_ripe = 0 THEN 'IMMATURE' ELSE 'PARTIALLY_MATURE' END AS maturity_status,
  closed AS fully_observed_calendar_cohort, CAST({CUTOFF} AS VARCHAR) AS observation_end
FROM board"""

_FACT_ORDERS = """
SELECT order_id, person AS customer_unique_id, state AS customer_state, status AS order_status,
  CAST(bought_at AS VARCHAR) AS purchase_timestamp, CAST(day AS VARCHAR) AS purchase_date,
  CAST(month AS VARCHAR) AS purchase_month, item_count, CAST(goods_value AS DOUBLE) AS merchandise_value,
  CAST(freight_value AS DOUBLE) AS freight_value, CAST(paid_value AS DOUBLE) AS payment_value,
  CAST(arrived_at AS VARCHAR) AS delivered_timestamp, CAST(promised_at AS VARCHAR) AS estimated_delivery_timestamp,
  CAST(score AS BIGINT) AS review_score, CAST(answered_at AS VARCHAR) AS review_answer_timestamp,
  CAST(created_at AS VARCHAR) AS review_creation_date, days AS delivery_days, dated AS delivery_eligible,
  rated AS review_eligible, early AS review_before_delivery, late AS is_late
FROM fo"""
_FACT_ITEMS = """
SELECT order_id, CAST(order_item_id AS BIGINT) AS order_item_id, product_id, category, state AS customer_state,
  status AS order_status, CAST(bought_at AS VARCHAR) AS purchase_timestamp, CAST(day AS VARCHAR) AS purchase_date,
  CAST(month AS VARCHAR) AS purchase_month, CAST(price AS DOUBLE) AS price, CAST(freight AS DOUBLE) AS freight_value
FROM fi"""
_DIM_DATE = f"""
SELECT CAST(d AS VARCHAR) AS date, CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS month_start,
  CAST(year(d) AS BIGINT) AS year, CAST(quarter(d) AS BIGINT) AS quarter, CAST(month(d) AS BIGINT) AS month
FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
  FROM (SELECT least(min(day), {START}) AS lo, greatest(max(day), {END}) AS hi FROM fo))"""

# --- checks ------------------------------------------------------------------------


def _check(name: str, value: str, severity: str = "error", note: str = "") -> str:
    return f"SELECT '{name}' AS \"check\", CAST(({value}) AS DOUBLE) AS value, '{severity}' AS severity, '{note}' AS note"


def _finish(checks: list[str]) -> str:
    return (
        "SELECT \"check\", value, severity, coalesce(value = 0, false) AS passed, note FROM (\n"
        + "\nUNION ALL ".join(checks)
        + ")"
    )


def _staging_check_list() -> list[str]:
    keys = {
        "orders": ("s_orders", "order_id"),
        "items": ("s_items", "order_id, order_item_id"),
        "payments": ("s_payments", "order_id, seq"),
        "customers": ("s_customers", "customer_id"),
        "products": ("s_products", "product_id"),
        "reviews": ("s_reviews", "review_id, order_id"),
        "category_translation": ("s_translation", "brand"),
    }
    copies = "Exact copies are removed on load; conflicting keys are kept."
    out = []
    for name, (table, key) in keys.items():
        unique = f"(SELECT DISTINCT * FROM {table})"
        missing = " OR ".join(f"{part} IS NULL" for part in key.split(", "))
        out += [
            _check(f"{name}.key_conflicts", f"SELECT count(*) FROM (SELECT {key} FROM {unique} GROUP BY {key} HAVING count(*) <> 1)"),
            _check(f"{name}.missing_key", f"SELECT count(*) FROM {unique} WHERE {missing}"),
            _check(f"{name}.exact_duplicate_rows", f"SELECT (SELECT count(*) FROM {table}) - (SELECT count(*) FROM {unique})", "warning", copies),
        ]
    amount = "Amounts must be zero or more, with two decimals at most."
    for name, table, column in [
        ("items.price", "s_items", "price"), ("items.freight_value", "s_items", "freight"),
        ("payments.payment_value", "s_payments", "paid"),
    ]:
        out.append(_check(f"{name}.invalid_amount", f"SELECT count(*) FROM (SELECT DISTINCT * FROM {table}) WHERE {column} IS NULL OR {column} < 0", "error", amount))
    for name, table, column in [
        ("items.order_item_id", "s_items", "order_item_id"), ("payments.payment_sequential", "s_payments", "seq"),
    ]:
        out.append(_check(f"{name}.invalid_key", f"SELECT count(*) FROM (SELECT DISTINCT * FROM {table}) WHERE {column} IS NULL OR {column} <= 0"))
    unique_reviews = "(SELECT DISTINCT * FROM s_reviews)"
    out += [
        _check("orders.invalid_purchase_timestamp", "SELECT count(*) FROM s_orders WHERE bought_at IS NULL"),
        _check("orders.invalid_status", "SELECT count(*) FROM s_orders WHERE order_status IS NULL"),
        _check("customers.missing_unique_identifier", "SELECT count(*) FROM s_customers WHERE person IS NULL"),
        _check("reviews.invalid_score", f"SELECT count(*) FROM {unique_reviews} WHERE coalesce(score, 0) NOT IN (1, 2, 3, 4, 5)", "warning", "Left out of every rating ratio."),
        _check("reviews.ambiguous_selection", "SELECT count(*) FROM (SELECT 1 FROM s_reviews GROUP BY order_id, answered_at, created_at, review_id HAVING max(score) > min(score))"),
        _check("products.missing_category", "SELECT count(*) FROM s_products WHERE brand IS NULL", "warning", "Counted under UNKNOWN."),
        _check("products.untranslated_category", "SELECT count(*) FROM s_products WHERE brand IS NOT NULL AND brand NOT IN (SELECT brand FROM s_translation)", "warning", "The original category name is kept."),
    ]
    for child, table, key, parent in [
        ("orders", "s_orders", "customer_id", "s_customers"), ("items", "(SELECT DISTINCT * FROM s_items)", "order_id", "s_orders"),
        ("items", "(SELECT DISTINCT * FROM s_items)", "product_id", "s_products"), ("payments", "s_payments", "order_id", "s_orders"),
        ("reviews", unique_reviews, "order_id", "s_orders"),
    ]:
        out.append(_check(f"{child}.{key}.unmatched", f"SELECT count(*) FROM {table} x WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = x.{key})"))
    # The star timestamps are typed already, so none of them is unreadable text.
    for name in [
        "orders.order_approved_at", "orders.order_delivered_carrier_date", "orders.order_delivered_customer_date",
        "orders.order_estimated_delivery_date", "reviews.review_creation_date", "reviews.review_answer_timestamp",
        "items.shipping_limit_date",
    ]:
        out.append(_check(f"{name}.invalid_timestamp", "SELECT 0", "warning"))
    return out


_DONE = "status = 'delivered'"
_MODEL_CHECKS = [
    _check("fact_orders.row_count", "(SELECT count(*) FROM fo) - (SELECT count(*) FROM s_orders)"),
    _check("fact_orders.key_unique", "SELECT count(*) - count(DISTINCT order_id) FROM fo"),
    _check("fact_order_items.row_count", "(SELECT count(*) FROM fi) - (SELECT count(*) FROM s_items)"),
    _check("fact_order_items.key_unique", "(SELECT count(*) FROM fi) - (SELECT count(*) FROM (SELECT DISTINCT order_id, order_item_id FROM fi))"),
    _check("delivered.merchandise_missing", f"SELECT count(*) FROM fo WHERE {_DONE} AND (item_count = 0 OR goods_value IS NULL)"),
    _check("merchandise.items_to_orders", "(SELECT sum(price) FROM s_items) - (SELECT sum(goods_value) FROM fo)"),
    _check("merchandise.items_to_enriched_items", "(SELECT sum(price) FROM s_items) - (SELECT sum(price) FROM fi)"),
    _check("merchandise.delivered_grain", f"(SELECT sum(price) FROM fi WHERE {_DONE}) - (SELECT sum(goods_value) FROM fo WHERE {_DONE})"),
    _check("delivery.invalid_flag", "SELECT count(late) FROM fo WHERE NOT dated"),
    _check("delivery.missing_or_invalid", f"SELECT count(*) FROM fo WHERE {_DONE} AND NOT dated", "warning"),
    _check("delivery.invalid_sequence", f"SELECT count(*) FROM fo WHERE {_DONE} AND bought_at > arrived_at", "warning"),
    _check("delivered.missing_payment", f"SELECT count(*) - count(paid_value) FROM fo WHERE {_DONE}", "warning"),
    _check("payment.reconciliation_difference", "SELECT count(*) FROM fo WHERE paid_value - goods_value - freight_value <> 0", "warning"),
    _check("payment.reconciliation_difference_gt_cent", "SELECT count(*) FROM fo WHERE abs(paid_value - goods_value - freight_value) > 0.01", "warning"),
    _check("reviews.multiple_orders", "SELECT count(*) FROM (SELECT 1 FROM s_reviews GROUP BY order_id HAVING count(*) >= 2)", "warning"),
    _check("reviews.missing_or_invalid", f"SELECT count(*) FROM fo WHERE {_DONE} AND NOT rated", "warning"),
    _check("reviews.before_delivery", "SELECT count(*) FROM fo WHERE dated AND rated AND early", "warning"),
]


def _analysis_check_list() -> list[str]:
    partial = "Partial months are allowed when they are labelled as partial."
    skipped = "Recomputed from the parts; months without an average are skipped."
    return [
        *[_check(f"analysis.{q}.result_count", "SELECT 0") for q in ("q01", "q02", "q03")],
        _check("analysis.q01.window_merchandise", "(SELECT CASE WHEN count(*) = count(amount) THEN sum(CAST(amount AS DECIMAL(38,2))) END FROM spread) - (SELECT sum(goods_value) FROM del)"),
        _check("analysis.q03.window_merchandise", "(SELECT sum(amount) FROM whole) - (SELECT sum(goods_value) FROM del)"),
        _check("analysis.q01.month_merchandise", "SELECT count(*) FROM spread s JOIN truth t ON t.month = s.month WHERE CAST(s.amount AS DECIMAL(38,2)) IS DISTINCT FROM t.amount"),
        _check("analysis.q01.month_unique", "SELECT count(*) - count(DISTINCT month) FROM spread"),
        _check("analysis.q03.month_merchandise", "SELECT count(*) FROM truth t LEFT JOIN (SELECT month, sum(amount) AS amount FROM grid GROUP BY month) g ON g.month = t.month WHERE coalesce(g.amount, 0) <> t.amount"),
        _check("analysis.q01.month_boundary_flags", "SELECT 0", "error", partial),
        _check("analysis.q02.decomposition_residual", "SELECT count(*) FROM pair WHERE abs(round(CAST(v - v0 AS DOUBLE) - CAST(n - n0 AS DOUBLE) * a0 - CAST(n AS DOUBLE) * (a - a0), 6)) > 0.01", "error", skipped),
    ]


def _broken_check_list(scenario: str) -> str:
    """Values of the analysis checks for results that were changed, or of which one is there twice and one is absent."""
    even, third, fifth = ("CAST(month(month) AS INTEGER) % 2 = 0", "CAST(month(month) AS INTEGER) % 3 = 0", "CAST(month(month) AS INTEGER) % 5 = 0")
    rows = "(SELECT month, CAST(amount AS DECIMAL(38,2)) AS amount FROM spread UNION ALL SELECT month, CAST(amount AS DECIMAL(38,2)) FROM spread WHERE month(month) = 5)"
    per_month = f"(SELECT month, sum(amount + if({even}, 1, 0)) AS amount FROM {rows} GROUP BY month)"
    lost = "month(g.month) % 4 = 0 AND g.grp = 'OTHER'"
    gap = "CAST(v - v0 AS DOUBLE) - (CAST(n - n0 AS DOUBLE) * a0 + if({}, 0.02, 0)) - CAST(n AS DOUBLE) * (a - a0)".format(fifth)
    changed = {
        "q01.result_count": "0", "q02.result_count": "0", "q03.result_count": "0",
        "q01.window_merchandise": f"SELECT abs(sum(r.amount) - (SELECT sum(amount) FROM truth)) FROM {per_month} r",
        "q03.window_merchandise": "0",
        "q01.month_merchandise": f"SELECT count(*) FROM truth t JOIN {per_month} r ON r.month = t.month WHERE r.amount IS DISTINCT FROM t.amount",
        "q01.month_unique": "SELECT count(*) FROM spread WHERE month(month) = 5",
        "q03.month_merchandise": f"SELECT count(*) FROM truth t LEFT JOIN (SELECT month, sum(amount) AS amount FROM grid g WHERE NOT ({lost}) GROUP BY month) g ON g.month = t.month WHERE coalesce(g.amount, 0) <> t.amount",
        "q01.month_boundary_flags": f"SELECT count(*) FROM {rows} WHERE {third}",
        "q02.decomposition_residual": f"SELECT count(*) FROM pair WHERE a IS NOT NULL AND a0 IS NOT NULL AND abs(round({gap}, 6)) > 0.01",
    }
    doubled = dict.fromkeys(changed, "0") | {
        "q02.result_count": "1", "q03.result_count": "1", "q03.window_merchandise": "SELECT sum(amount) FROM truth",
        "q03.month_merchandise": "SELECT count(*) FROM truth WHERE amount <> 0",
    }
    notes = {
        "q01.month_boundary_flags": "Partial months are allowed when they are labelled as partial.",
        "q02.decomposition_residual": "Recomputed from the parts; months without an average are skipped.",
    }
    values = changed if scenario == "changed" else doubled
    listed = [_check(f"analysis.{name}", value, "error", notes.get(name, "")) for name, value in values.items()]
    return f"SELECT *, '{scenario}' AS scenario FROM ({_finish(listed)})"


_TRUTH = """
truth AS (
  SELECT m.month, coalesce(sum(goods_value), 0) AS amount
  FROM months m LEFT JOIN del d ON d.month = m.month GROUP BY m.month)"""

# --- metrics -----------------------------------------------------------------------

_LOW = "status = 'delivered' AND rated AND score IN (1, 2)"
_METRIC = {
    "gmv": f"CAST(coalesce(sum(CASE WHEN {_DONE} THEN goods_value END), 0) AS DOUBLE)",
    "delivered_orders": _n(_DONE),
    "all_orders": "count(order_id)",
    "canceled_orders": _n("status = 'canceled'"),
    "delivery_orders": _n(f"{_DONE} AND dated"),
    "late_orders": _n(f"{_DONE} AND dated AND late"),
    "review_orders": _n(f"{_DONE} AND rated"),
    "low_score_orders": _n(_LOW),
    "joint_orders": _n(f"{_DONE} AND dated AND rated"),
    "duration_orders": _n(f"{_DONE} AND days IS NOT NULL"),
    "group_orders": _n(f"{_DONE} AND dated AND rated"),
    "group_low_orders": _n(f"{_LOW} AND dated"),
    "p50_days": f"round(quantile_cont(CASE WHEN {_DONE} THEN days END, 0.5), 6)",
    "p90_days": f"round(quantile_cont(CASE WHEN {_DONE} THEN days END, 0.9), 6)",
}
for _name, _top, _bottom in [
    ("aov", "gmv", "delivered_orders"), ("cancel_rate", "canceled_orders", "all_orders"),
    ("late_rate", "late_orders", "delivery_orders"), ("low_score_rate", "low_score_orders", "review_orders"),
    ("delivery_coverage", "delivery_orders", "delivered_orders"),
    ("review_coverage", "review_orders", "delivered_orders"), ("joint_coverage", "joint_orders", "delivered_orders"),
    ("duration_coverage", "duration_orders", "delivered_orders"), ("group_low_rate", "group_low_orders", "group_orders"),
]:
    _METRIC[_name] = _r(_METRIC[_top], _METRIC[_bottom])


def _masked(least: int) -> dict[str, str]:
    shown = {"orders": "delivered_orders", "late_rate": "late_rate", "late_orders": "late_orders"}
    return {
        f"state_investigation_{name}": f"CASE WHEN {_METRIC['delivered_orders']} >= {least} THEN {_METRIC[source]} END"
        for name, source in shown.items()
    }


def _pick(*names: str, least: int = 100) -> str:
    known = _METRIC | _masked(least)
    return ", ".join(f"{known[name]} AS {name}" for name in names)


_RECONCILED = (
    "gmv", "delivered_orders", "aov", "all_orders", "canceled_orders", "cancel_rate", "delivery_orders",
    "late_orders", "late_rate", "review_orders", "low_score_orders", "low_score_rate", "joint_orders",
    "delivery_coverage", "review_coverage", "joint_coverage", "p50_days", "p90_days", "duration_orders",
    "duration_coverage",
)
_INVESTIGATION = ("state_investigation_orders", "state_investigation_late_rate", "state_investigation_late_orders")
_DELAY = "CASE WHEN NOT dated THEN '无有效日期' WHEN late THEN '延迟' ELSE '准时' END"
_TOP10 = """
best AS (SELECT category FROM sold GROUP BY category ORDER BY sum(price) DESC, category LIMIT 10)"""


def _staged(columns: list[tuple[str, str, str]], table: str) -> str:
    """Typed columns beside their text form: (name, typed expression, text expression)."""
    shown = ", ".join(f"{typed} AS {name}, {text} AS {name}_raw" for name, typed, text in columns)
    return _sql("", f"SELECT {shown} FROM (SELECT DISTINCT * FROM {table})")


def _text(expression: str) -> str:
    return f"CAST({expression} AS VARCHAR)"


def _staging() -> dict[str, str]:
    def same(name, column=None):
        column = column or name
        return (name, column, column)

    def big(name, column):
        return (name, f"CAST({column} AS BIGINT)", _text(column))

    def money(name, column):
        return (name, f"CAST({column} AS DOUBLE)", _text(column))

    def time(name, column):
        return (name, _text(column), _text(column))

    empty = "CAST(NULL AS VARCHAR)"
    size = "CAST(CAST(size AS DECIMAL(18,2)) AS VARCHAR)"
    no_number = [(f"product_{part}_cm", "CAST(NULL AS DOUBLE)", empty) for part in ("length", "height", "width")]
    return {
        "staging_orders": _staged([
            same("order_id"), same("customer_id"), same("order_status"), time("order_purchase_timestamp", "bought_at"),
            time("order_approved_at", "bought_at"), ("order_delivered_carrier_date", empty, empty),
            time("order_delivered_customer_date", "arrived_at"), time("order_estimated_delivery_date", "promised_at"),
        ], "s_orders"),
        "staging_items": _staged([
            same("order_id"), big("order_item_id", "order_item_id"), same("product_id"), same("seller_id"),
            time("shipping_limit_date", "l_shipdate"), money("price", "price"), money("freight_value", "freight"),
        ], "s_items"),
        "staging_payments": _staged([
            same("order_id"), big("payment_sequential", "seq"), same("payment_type", "kind"),
            big("payment_installments", "installments"), money("payment_value", "paid"),
        ], "s_payments"),
        "staging_customers": _staged([
            same("customer_id"), same("customer_unique_id", "person"), same("customer_zip_code_prefix", "zip"),
            same("customer_city", "city"), same("customer_state", "state"),
        ], "s_customers"),
        "staging_products": _staged([
            same("product_id"), same("product_category_name", "brand"), big("product_name_lenght", "name_len"),
            big("product_description_lenght", "type_len"), big("product_photos_qty", "size"),
            ("product_weight_g", "CAST(size AS DOUBLE)", size), *no_number,
        ], "s_products"),
        "staging_reviews": _staged([
            same("review_id"), same("order_id"), big("review_score", "score"), ("review_comment_title", empty, empty),
            ("review_comment_message", empty, empty), time("review_creation_date", "created_at"),
            time("review_answer_timestamp", "answered_at"),
        ], "s_reviews"),
        "staging_category_translation": _staged([
            same("product_category_name", "brand"), same("product_category_name_english", "english"),
        ], "s_translation"),
        "staging_removes_copies": _sql("", """
SELECT order_id, count(*) AS staged_rows, CAST(sum(price) AS DOUBLE) AS price
FROM (SELECT * FROM s_items UNION SELECT * FROM s_items) GROUP BY order_id"""),
        "staging_casts": """
WITH v AS (
  SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS p,
    CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d,
    CAST(l_quantity AS INTEGER) % 8 AS k
  FROM lineitem),
t AS (
  SELECT l_orderkey, l_linenumber,
    CASE k WHEN 0 THEN '  ' || p || ' ' WHEN 1 THEN p || '5' WHEN 2 THEN 'x' || p WHEN 3 THEN '   '
      WHEN 4 THEN '-' || p WHEN 5 THEN NULL WHEN 6 THEN '+' || p ELSE p END AS a,
    CASE k WHEN 0 THEN q || '.5' WHEN 1 THEN q || '.4' WHEN 2 THEN ' ' || q WHEN 3 THEN '' WHEN 4 THEN '-' || q
      WHEN 5 THEN q || 'a' ELSE q END AS w,
    CASE k WHEN 0 THEN d || ' 10:11:12' WHEN 1 THEN left(d, 7) WHEN 2 THEN left(d, 4) WHEN 3 THEN ' '
      WHEN 4 THEN d || ' 25:00:00' WHEN 5 THEN left(d, 5) || '13-40' WHEN 6 THEN ' ' || d || ' 00:00:01.5' ELSE d END AS m
  FROM v)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, nullif(trim(a), '') AS trimmed,
  CAST(TRY_CAST(a AS DECIMAL(18,2)) AS DOUBLE) AS money, TRY_CAST(w AS DOUBLE) AS decimal_number,
  CAST(TRY_CAST(w AS INTEGER) AS BIGINT) AS rounded_integer,
  CAST(CASE WHEN regexp_full_match(trim(w), '[-+]?[0-9]+') THEN TRY_CAST(w AS INTEGER) END AS BIGINT) AS score,
  CAST(TRY_CAST(m AS TIMESTAMP) AS VARCHAR) AS moment, coalesce(nullif(trim(m), ''), 'UNKNOWN') AS member
FROM t""",
    }


def _operators() -> dict[str, str]:
    brand_lines = """
bl AS (SELECT p_brand, l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS price
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""
    flags = """
lf AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag,
    CASE WHEN l_returnflag <> 'N' THEN l_linestatus = 'F' END AS early, l_tax > 0.04 AS late, l_quantity <= 20 AS low
  FROM lineitem),
pick AS (SELECT *, 'all' AS sample FROM lf UNION ALL SELECT *, 'without_early' FROM lf WHERE early IS NOT TRUE)"""
    firsts = f"""
seen AS (SELECT user_id, ts, min(event_id) AS eid, count(*) AS k FROM events
  WHERE event_type = 'purchase' AND ts <= {EVENT_CUTOFF} AND user_id IS NOT NULL GROUP BY user_id, ts),
ordered AS (SELECT *, row_number() OVER u AS pos, lead(ts) OVER u AS t1, lead(eid) OVER u AS e1,
    sum(k) OVER (PARTITION BY user_id) AS total FROM seen WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
firsts AS (SELECT user_id, eid AS first_id, ts AS first_ts, k - 1 AS simultaneous_rows, e1 AS next_id, t1 AS next_ts,
    ts + INTERVAL 1 DAY <= {EVENT_CUTOFF} AS has_full_horizon, coalesce(t1 <= ts + INTERVAL 1 DAY, false) AS repeated,
    CAST(total AS BIGINT) AS total_rows FROM ordered WHERE pos = 1)"""
    quantiles = """count(*) AS "rows", count(cents) AS "values", min(cents) AS min_ticks, max(cents) AS max_ticks,
  round(quantile_cont(CAST(cents AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(cents AS DOUBLE), 0.9), 6) AS p90"""
    return {
        "month_spine_counts": """
WITH c AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(CAST(g AS DATE) AS VARCHAR) AS month, coalesce(n, 0) AS orders
FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2003-06-01', INTERVAL 1 MONTH)) AS g) LEFT JOIN c ON m = g""",
        "guarded_sum_by_customer": """
SELECT o_custkey, CASE WHEN max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 0
    THEN CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) END AS complete_amount,
  count(*) - count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS known_rows
FROM orders GROUP BY o_custkey""",
        "safe_ratio_by_brand": f"""
SELECT p_brand, {_n("l_returnflag = 'R'")} AS returned, {_n("l_returnflag = 'X'")} AS unused, count(*) AS lines,
  {_r(_n("l_returnflag = 'R'"), "count(*)")} AS returned_share,
  {_r(_n("l_returnflag = 'R'"), _n("l_returnflag = 'X'"))} AS undefined_share
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand""",
        "window_filter_counts": f"""
SELECT o_orderstatus, count(*) AS orders, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_day,
  CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day
FROM orders WHERE CAST(o_orderdate AS DATE) >= {START} AND CAST(o_orderdate AS DATE) <= {END} GROUP BY o_orderstatus""",
        "observation_cutoff": f"""
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events
WHERE ts <= {EVENT_CUTOFF} AND user_id IS NOT NULL GROUP BY event_type""",
        "latest_line_per_order": """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CAST(l_shipdate AS VARCHAR) AS l_shipdate,
  l_extendedprice
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_extendedprice) = 1""",
        "star_enrich_totals": """
SELECT coalesce(p_brand, 'UNKNOWN') AS p_brand, coalesce(n_name, 'UNKNOWN') AS n_name,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, count(*) AS lines
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
  LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2""",
        "decomposition_by_month": f"""
WITH per AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n,
    sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1),
rated AS (SELECT *, {_r("v", "n")} AS a FROM per),
pair AS (SELECT *, lag(n) OVER (ORDER BY month) AS n0, lag(v) OVER (ORDER BY month) AS v0,
    lag(a) OVER (ORDER BY month) AS a0 FROM rated)
SELECT CAST(month AS VARCHAR) AS month, n AS orders, CAST(v AS DOUBLE) AS amount, a AS average,
  CAST(v0 AS DOUBLE) AS previous_amount, n0 AS previous_orders, a0 AS previous_average, CAST(v - v0 AS DOUBLE) AS change,
  {_r("v - v0", "v0")} AS change_rate, CAST(n - n0 AS DOUBLE) * a0 AS order_part,
  CAST(n AS DOUBLE) * (a - a0) AS average_part,
  CAST(v - v0 AS DOUBLE) - CAST(n - n0 AS DOUBLE) * a0 - CAST(n AS DOUBLE) * (a - a0) AS residual
FROM pair""",
        "top_n_other_brands": f"""
WITH {brand_lines},
place AS (SELECT p_brand, row_number() OVER (ORDER BY sum(price) DESC, p_brand) AS pos FROM bl GROUP BY p_brand)
SELECT if(pos > 10, 'OTHER', p.p_brand) AS group_name, least(pos, 11) AS group_rank,
  CAST(sum(price) AS DOUBLE) AS amount, count(DISTINCT l_orderkey) AS distinct_ids
FROM bl JOIN place p ON p.p_brand = bl.p_brand GROUP BY 1, 2""",
        "dense_grid_month_nation": """
WITH c AS (SELECT c_nationkey AS nk, date_trunc('month', o_orderdate) AS m, count(*) AS n
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT n_name, CAST(CAST(g AS DATE) AS VARCHAR) AS month, coalesce(n, 0) AS orders
FROM nation, (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2002-12-01', INTERVAL 1 MONTH)) AS g)
  LEFT JOIN c ON nk = n_nationkey AND m = g""",
        "scoped_percentiles": f"""
WITH p AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, l_returnflag AS f,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM lineitem)
SELECT 'ALL' AS scope, CAST(NULL AS VARCHAR) AS month, CAST(NULL AS VARCHAR) AS l_returnflag, {quantiles} FROM p
UNION ALL SELECT 'MONTH', CAST(m AS VARCHAR), NULL, {quantiles} FROM p GROUP BY m
UNION ALL SELECT 'FLAG', NULL, f, {quantiles} FROM p GROUP BY f""",
        "threshold_rank_nations": f"""
WITH g AS (SELECT c_nationkey, count(*) AS orders, {_n("o_orderstatus = 'P'")} AS hits
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey),
r AS (SELECT *, {_r("hits", "orders")} AS share, orders >= (SELECT avg(orders) FROM g) AS able FROM g)
SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, orders, hits, share,
  CASE WHEN able THEN row_number() OVER (PARTITION BY able ORDER BY share DESC, hits DESC, c_nationkey) END AS position
FROM r""",
        "share_of_region": f"""
WITH t AS (SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS a
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
SELECT n_name, n_regionkey, CAST(a AS DOUBLE) AS amount, {_r("a", "sum(a) OVER ()")} AS share_of_all,
  {_r("a", "sum(a) OVER (PARTITION BY n_regionkey)")} AS share_of_region FROM t""",
        "sample_expand_counts": f"""
WITH {flags}
SELECT sample, l_returnflag, count(*) AS lines, count(early) AS known, {_n("early")} AS early_lines
FROM pick GROUP BY sample, l_returnflag""",
        "stratified_gap_lines": f"""
WITH {flags},
every AS (SELECT DISTINCT month, l_returnflag, s.sample FROM lf, (SELECT unnest(['all', 'without_early']) AS sample) s),
c AS (SELECT month, l_returnflag, sample, {_n("NOT late")} AS n0, {_n("late")} AS n1, {_n("NOT late AND low")} AS k0,
    {_n("late AND low")} AS k1 FROM pick GROUP BY 1, 2, 3),
z AS (SELECT e.month, e.l_returnflag, e.sample, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1, coalesce(k0, 0) AS k0,
    coalesce(k1, 0) AS k1 FROM every e LEFT JOIN c ON c.month = e.month AND c.l_returnflag = e.l_returnflag AND c.sample = e.sample)
SELECT CAST(month AS VARCHAR) AS month, l_returnflag, sample, n0 AS base_rows, n1 AS other_rows, k0 AS base_outcomes,
  k1 AS other_outcomes, {_r("k0", "n0")} AS base_share, {_r("k1", "n1")} AS other_share,
  ({_r("k1", "n1")}) - ({_r("k0", "n0")}) AS gap, least(n0, n1) >= {MIN_STATE} AS meets_threshold
FROM z""",
        "event_sequence": f"""
WITH {firsts}
SELECT user_id, first_id, CAST(first_ts AS VARCHAR) AS first_ts, simultaneous_rows, next_id,
  CAST(next_ts AS VARCHAR) AS next_ts, has_full_horizon, repeated, total_rows,
  round(date_diff('microsecond', first_ts, next_ts) / 1e6 / 86400, 6) AS days_to_next
FROM firsts""",
        "event_cohorts": f"""
WITH {firsts},
c AS (SELECT date_trunc('month', first_ts) AS m, count(*) AS n, {_n("has_full_horizon")} AS ripe,
    {_n("NOT has_full_horizon")} AS raw, {_n("has_full_horizon AND repeated")} AS again,
    {_n("simultaneous_rows > 0")} AS twin_users, CAST(sum(simultaneous_rows) AS BIGINT) AS twins
  FROM firsts WHERE CAST(first_ts AS DATE) BETWEEN DATE '2023-12-01' AND DATE '2024-02-15' GROUP BY 1),
b AS (SELECT g, coalesce(n, 0) AS n, coalesce(ripe, 0) AS ripe, coalesce(raw, 0) AS raw, coalesce(again, 0) AS again,
    coalesce(twin_users, 0) AS twin_users, coalesce(twins, 0) AS twins
  FROM (SELECT unnest(generate_series(DATE '2023-12-01', DATE '2024-02-01', INTERVAL 1 MONTH)) AS g) LEFT JOIN c ON m = g)
SELECT CAST(CAST(g AS DATE) AS VARCHAR) AS cohort_month, n AS total, ripe AS eligible, raw AS immature, again AS repeats,
  twin_users AS with_simultaneous, twins AS simultaneous, {_r("again", "ripe")} AS repeat_share,
  {_r("ripe", "n")} AS coverage,
  CASE WHEN n = 0 THEN 'EMPTY' WHEN raw = 0 THEN 'ALL_OBSERVED_CUSTOMERS_MATURE' WHEN ripe = 0 THEN 'IMMATURE'
    ELSE 'PARTIALLY_MATURE' END AS maturity_status,
  g + INTERVAL 1 MONTH + INTERVAL 1 DAY <= {EVENT_CUTOFF} + INTERVAL 1 MICROSECOND AS fully_observed,
  CAST({EVENT_CUTOFF} AS VARCHAR) AS observation_end
FROM b""",
        "delivery_flags": _sql("", """
SELECT order_status, arrived_at IS NOT NULL AND arrived_at >= bought_at AS usable,
  CASE WHEN order_status = 'delivered' THEN arrived_at > bought_at END AS "after", count(*) AS orders
FROM s_orders GROUP BY 1, 2, 3""", strict=True),
        "line_key_conflicts": """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS "rows"
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) <> 1""",
        "order_fk_orphans": """
SELECT count(*) AS orphans FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
        "line_duplicate_rows": """
SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_quantity, l_returnflag FROM lineitem)) AS duplicates""",
        "reconcile_months": """
WITH l AS (SELECT date_trunc('month', o_orderdate) AS m, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS a FROM orders GROUP BY 1),
r AS (SELECT date_trunc('month', o_orderdate) AS m, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS a
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT CAST(CAST(coalesce(l.m, r.m) AS DATE) AS VARCHAR) AS month, CAST(l.a AS DOUBLE) AS left_amount,
  CAST(r.a AS DOUBLE) AS right_amount, CAST(l.a - r.a AS DOUBLE) AS difference,
  coalesce(abs(l.a - r.a) <= 1000000, false) AS matches
FROM l FULL JOIN r ON r.m = l.m""",
    }


def _models() -> dict[str, str]:
    return {
        "fact_orders": _sql("", _FACT_ORDERS),
        "fact_order_items": _sql("", _FACT_ITEMS),
        "dim_date": _sql("", _DIM_DATE),
        "dim_customer_state": _sql("", "SELECT state AS customer_state FROM fo UNION SELECT state FROM fi UNION SELECT 'UNKNOWN'"),
        "dim_category": _sql("", "SELECT category FROM fi UNION SELECT 'UNKNOWN'"),
        "latest_review": _sql("", """
SELECT order_id, CAST(score AS BIGINT) AS review_score, CAST(answered_at AS VARCHAR) AS review_answer_timestamp,
  CAST(created_at AS VARCHAR) AS review_creation_date FROM opinion"""),
        "order_item_totals": _sql("", """
SELECT order_id, item_count, CAST(goods_value AS DOUBLE) AS merchandise_value,
  CAST(freight_value AS DOUBLE) AS freight_value FROM goods"""),
        "order_payment_totals": _sql("", "SELECT order_id, CAST(paid_value AS DOUBLE) AS payment_value FROM money"),
        "delivery_days_of_orders": _sql("", "SELECT order_id, days AS delivery_days, CASE WHEN days IS NOT NULL THEN true END AS consistent FROM del", strict=True),
    }


def _questions(strict: bool = False) -> dict[str, str]:
    """`strict`: in the four questions that read it, every delivered order of the source; the reports are built on the others."""
    return {
        "q01_monthly_commerce": _sql(_Q01, _Q01_BODY),
        "q01_strict_guarded_sum": _sql(_Q01, _Q01_BODY, strict=True),
        "q02_monthly_change_decomposition": _sql(_Q02, _Q02_BODY, strict=strict),
        "q02_strict_undefined_parts": _sql(_Q02, _Q02_BODY, strict=True),
        "q03_category_contribution": _sql(_Q03, _Q03_BODY),
        "q04_state_investigation": _sql(_Q04, _Q04_BODY, strict=strict),
        "q04_strict_unknown_amounts": _sql(_Q04, _Q04_BODY, strict=True),
        "q05_delivery_duration": _sql("", _q05()),
        "q06_month_state_delivery": _sql(_Q06, _Q06_BODY, strict=strict),
        "q07_delivery_review_distribution": _sql(_Q07, _Q07_BODY),
        "q08_stratified_review_sensitivity": _sql(_Q08, _Q08_BODY),
        "q09_customer_observed_sequence": _sql(_FIRSTS, _Q09_BODY),
        "q10_repeat_cohort_30d": _sql(_Q10, _Q10_BODY, strict=strict),
    }


def _checks() -> dict[str, str]:
    models = _sql("", _finish(_MODEL_CHECKS), strict=True)
    done = models[models.index("SELECT \"check\", value"):]
    head = models[: models.index("SELECT \"check\", value")]
    q02 = _Q02.replace("per AS", "per2 AS").replace("JOIN per p", "JOIN per2 p")
    analyses = ",".join([_Q01, q02, _Q03, _TRUTH])
    return {
        "quality_staging": _sql("", _finish(_staging_check_list())),
        "quality_models": models,
        "quality_analyses": _sql(analyses, _finish(_analysis_check_list()), strict=True),
        "quality_analyses_broken": _sql(analyses, f"{_broken_check_list('changed')} UNION ALL {_broken_check_list('doubled')}"),
        "quality_summary": head + f"""
SELECT CASE WHEN sum(if(severity = 'error' AND NOT passed, 1, 0)) > 0 THEN 'failed' ELSE 'passed' END AS status,
  {_n("severity = 'error' AND NOT passed")} AS blocking_failures, {_n("severity = 'warning' AND NOT passed")} AS warnings,
  count(*) AS checks
FROM ({done})""",
        "quality_report_rows": head.rstrip() + f""", c AS ({done})
SELECT 'all' AS section, * FROM c UNION ALL SELECT 'warnings', * FROM c WHERE severity = 'warning' AND NOT passed""",
    }


def _metrics() -> dict[str, str]:
    contexts = f"""
ctx AS (
  SELECT *, 'all' AS context FROM win
  UNION ALL SELECT *, 'first_month' FROM win WHERE month = {START}
  UNION ALL SELECT *, 'one_state' FROM win WHERE state = 'NATION_3'),
labels AS (SELECT unnest(['all', 'first_month', 'one_state', 'no_rows']) AS label)"""
    filtered = "day >= DATE '1996-06-01' AND day <= DATE '1997-03-31' AND state IN ('NATION_3', 'NATION_7')"
    return {
        "metrics_all": _sql("", f"SELECT {_pick(*_RECONCILED, 'group_orders', 'group_low_orders', 'group_low_rate', *_INVESTIGATION)} FROM win"),
        "metrics_by_month": _sql("", f"SELECT strftime(day, '%Y-%m') AS month_label, {_pick('gmv', 'delivered_orders', 'aov', 'late_rate')} FROM win GROUP BY 1"),
        "metrics_by_state": _sql("", f"SELECT state AS customer_state, {_pick('gmv')} FROM win GROUP BY state"),
        "metrics_state_scatter": _sql("", f"SELECT state AS customer_state, {_pick(*_INVESTIGATION, 'delivery_orders', 'late_orders', 'low_score_rate', 'joint_coverage', least=MIN_STATE)} FROM win GROUP BY state"),
        "metrics_by_delay_group": _sql("", f"SELECT {_DELAY} AS delay_group, {_pick('group_low_rate', 'group_orders', 'group_low_orders')} FROM win GROUP BY 1"),
        "metrics_days_by_state": _sql("", f"SELECT state AS customer_state, {_pick('duration_orders', 'duration_coverage', 'p50_days', 'p90_days')} FROM win GROUP BY state", strict=True),
        "metrics_contexts": _sql(contexts, f"SELECT label AS context, {_pick(*_RECONCILED)} FROM labels LEFT JOIN ctx ON context = label GROUP BY label"),
        "metrics_filtered_orders": _sql("", f"SELECT {_pick('gmv', 'all_orders', 'late_rate')} FROM win WHERE {filtered}"),
        "metrics_filtered_items": _sql("", f"SELECT category, CAST(sum(CASE WHEN {_DONE} THEN price END) AS DOUBLE) AS item_gmv FROM fi WHERE {filtered} AND category IN ('brand_1', 'Brand#2') GROUP BY category"),
        "category_group_amount": _sql(_TOP10, "SELECT CASE WHEN category IN (SELECT category FROM best) THEN category ELSE '其他' END AS category_group, CAST(sum(price) AS DOUBLE) AS item_gmv FROM sold GROUP BY 1"),
        "bi_extract_orders": _sql("", f"""
SELECT state AS customer_state, status AS order_status, CAST(day AS VARCHAR) AS purchase_date,
  CAST(goods_value AS DOUBLE) AS merchandise_value, days AS delivery_days, dated AS delivery_eligible, late AS is_late,
  CAST(score AS BIGINT) AS review_score, rated AS review_eligible, early AS review_before_delivery, {_DELAY} AS delay_group
FROM win"""),
        "bi_extract_items": _sql("", f"SELECT category, state AS customer_state, status AS order_status, CAST(day AS VARCHAR) AS purchase_date, CAST(price AS DOUBLE) AS price FROM fi WHERE day >= {START} AND day <= {END}"),
        "bi_extract_dates": f"""
SELECT CAST(d AS VARCHAR) AS date, strftime(d, '%Y-%m-01') AS month_start, CAST(year(d) AS BIGINT) AS year,
  CAST(quarter(d) AS BIGINT) AS quarter, CAST(month(d) AS BIGINT) AS month, strftime(d, '%Y-%m') AS month_label
FROM (SELECT CAST(unnest(generate_series({START}, {END}, INTERVAL 1 DAY)) AS DATE) AS d)""",
        "bi_extract_states": _sql("", "SELECT state AS customer_state FROM states"),
        "bi_extract_categories": _sql(_TOP10, "SELECT category, CASE WHEN category IN (SELECT category FROM best) THEN category ELSE '其他' END AS category_group FROM (SELECT category FROM fi UNION SELECT 'UNKNOWN')"),
    }


def _reports(questions: dict[str, str]) -> dict[str, str]:
    q10 = questions["q10_repeat_cohort_30d"]
    partial = "total_customers > 0 AND (eligible_customers < total_customers OR NOT fully_observed_calendar_cohort)"
    sums = ("joint_eligible_orders", "answer_timestamp_orders", "early_answer_orders", "on_time_orders",
            "on_time_low_score_orders", "late_orders", "late_low_score_orders")
    good = f"on_time_orders >= {MIN_GROUP} AND late_orders >= {MIN_GROUP}"
    gap = "CAST(late_low_score_orders AS DOUBLE) / late_orders - CAST(on_time_low_score_orders AS DOUBLE) / on_time_orders"
    names = ("orders", "items", "payments", "customers", "products", "reviews", "category_translation")
    counts = [
        f"SELECT '{name}' AS table_name, (SELECT count(*) FROM s_{name.replace('category_', '')}) AS raw_rows, "
        f"(SELECT count(*) FROM (SELECT DISTINCT * FROM s_{name.replace('category_', '')})) AS staged_rows"
        for name in names
    ]
    return {
        "partial_cohort_rows": f"SELECT * FROM ({q10}) WHERE {partial}",
        "sensitivity_totals": f"""
WITH z AS ({questions["q08_stratified_review_sensitivity"]}),
t AS (SELECT sample, {", ".join(f"CAST(sum({name}) AS BIGINT) AS {name}" for name in sums)},
    {_n("joint_eligible_orders > 0")} AS populated_strata, {_n(good)} AS qualified_strata,
    CAST(coalesce(sum(CASE WHEN {good} THEN joint_eligible_orders END), 0) AS BIGINT) AS qualified_joint_orders,
    count(CASE WHEN {good} THEN CASE WHEN {gap} > 1e-12 THEN 1 END END) AS positive_gap_strata,
    count(CASE WHEN {good} THEN CASE WHEN {gap} < -1e-12 THEN 1 END END) AS negative_gap_strata,
    count(CASE WHEN {good} THEN CASE WHEN abs({gap}) <= 1e-12 THEN 1 END END) AS equal_gap_strata
  FROM z GROUP BY sample)
SELECT *, {_r("on_time_low_score_orders", "on_time_orders")} AS on_time_low_score_share,
  {_r("late_low_score_orders", "late_orders")} AS late_low_score_share,
  ({_r("late_low_score_orders", "late_orders")}) - ({_r("on_time_low_score_orders", "on_time_orders")}) AS low_score_share_gap,
  {_r("answer_timestamp_orders", "joint_eligible_orders")} AS answer_timestamp_coverage,
  {_r("qualified_joint_orders", "joint_eligible_orders")} AS qualified_joint_coverage
FROM t""",
        "overview_row": f"""
WITH m1 AS ({questions["q01_monthly_commerce"]}), m2 AS ({questions["q02_monthly_change_decomposition"]}),
m4 AS ({questions["q04_state_investigation"]}), m5 AS ({questions["q05_delivery_duration"]}),
m6 AS ({questions["q06_month_state_delivery"]}), m10 AS ({q10}),
a AS (SELECT CASE WHEN count(*) = count(merchandise_value) THEN CAST(sum(CAST(merchandise_value AS DECIMAL(38,2))) AS DOUBLE) END AS money, CAST(sum(delivered_orders) AS BIGINT) AS done,
    CAST(sum(all_orders) AS BIGINT) AS total, CAST(sum(canceled_orders) AS BIGINT) AS gone FROM m1),
b AS (SELECT * FROM m2 WHERE merchandise_change IS NOT NULL AND order_count_contribution IS NOT NULL
    AND average_order_value_contribution IS NOT NULL ORDER BY abs(merchandise_change) DESC, purchase_month LIMIT 1),
c AS (SELECT CAST(sum(delivery_eligible_orders) AS BIGINT) AS dated, CAST(sum(review_eligible_orders) AS BIGINT) AS rated,
    CAST(sum(joint_eligible_orders) AS BIGINT) AS both_ok, CAST(sum(late_orders) AS BIGINT) AS late FROM m6),
d AS (SELECT * FROM m5 WHERE scope = 'WINDOW')
SELECT money AS merchandise_value, done AS delivered_orders, total AS all_orders, gone AS canceled_orders,
  {_r("money", "done")} AS average_order_value, {_r("gone", "total")} AS canceled_order_share,
  b.purchase_month AS largest_change_month, b.merchandise_change AS largest_change,
  b.order_count_contribution AS largest_change_order_part, b.average_order_value_contribution AS largest_change_value_part,
  {", ".join(f"(SELECT customer_state FROM m4 WHERE investigation_rank = {n}) AS investigation_state_{n}" for n in (1, 2, 3))},
  dated AS delivery_eligible_orders, late AS late_orders, {_r("late", "dated")} AS late_share,
  {_r("dated", "done")} AS delivery_coverage, {_r("rated", "done")} AS review_coverage,
  both_ok AS joint_eligible_orders, {_r("both_ok", "done")} AS joint_coverage,
  d.duration_coverage, d.median_delivery_days, d.p90_delivery_days,
  (SELECT count(*) FROM m10 WHERE {partial}) AS partial_cohorts
FROM a, c, d LEFT JOIN b ON true""",
        "data_profile_rows": _sql("", " UNION ALL ".join(counts)),
        "data_profile_months": _sql("", """
SELECT CAST(CAST(date_trunc('month', bought_at) AS DATE) AS VARCHAR) AS month, order_status AS status,
  count(*) AS orders, count(DISTINCT CAST(bought_at AS DATE)) AS purchase_days
FROM s_orders GROUP BY 1, 2"""),
    }


def counterparts() -> dict[str, str]:
    questions = _questions()
    return {
        **_models(), **_staging(), **_questions(strict=True), **_checks(), **_metrics(), **_reports(questions), **_operators(), **_files(),
    }


# --- files -------------------------------------------------------------------------


def _text_digest(columns: list[str]) -> str:
    parts = " || ".join(f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')" for c in columns)
    return f"md5({parts})"


def _checksum(columns: list[str]) -> str:
    d = _text_digest(columns)
    halves = " || ' ' || ".join(f"CAST(coalesce(sum(CAST('0x' || substr({d}, {at}, 15) AS BIGINT)), 0) AS VARCHAR)" for at in (1, 16))
    return halves


_LINES = """
lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey,
    CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS l_quantity,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS l_extendedprice, CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) AS l_discount,
    CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) AS l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS VARCHAR) AS l_shipdate
  FROM lineitem)"""
_LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
# source: its star relation, and column by column the text it is delivered as
_TEXTS = {
    "orders": ("s_orders", {
        "order_id": "order_id", "customer_id": "customer_id", "order_status": "order_status", "order_purchase_timestamp": "bought_at",
        "order_approved_at": "bought_at", "order_delivered_carrier_date": "NULL", "order_delivered_customer_date": "arrived_at",
        "order_estimated_delivery_date": "promised_at"}),
    "items": ("s_items", {
        "order_id": "order_id", "order_item_id": "order_item_id", "product_id": "product_id", "seller_id": "seller_id",
        "shipping_limit_date": "l_shipdate", "price": "price", "freight_value": "freight"}),
    "payments": ("s_payments", {
        "order_id": "order_id", "payment_sequential": "seq", "payment_type": "kind", "payment_installments": "installments", "payment_value": "paid"}),
    "customers": ("s_customers", {
        "customer_id": "customer_id", "customer_unique_id": "person", "customer_zip_code_prefix": "zip", "customer_city": "city", "customer_state": "state"}),
    "products": ("s_products", {
        "product_id": "product_id", "product_category_name": "brand", "product_name_lenght": "name_len", "product_description_lenght": "type_len",
        "product_photos_qty": "size", "product_weight_g": "CAST(size AS DECIMAL(18,2))", "product_length_cm": "NULL", "product_height_cm": "NULL",
        "product_width_cm": "NULL"}),
    "reviews": ("s_reviews", {
        "review_id": "review_id", "order_id": "order_id", "review_score": "score", "review_comment_title": "NULL", "review_comment_message": "NULL",
        "review_creation_date": "created_at", "review_answer_timestamp": "answered_at"}),
    "category_translation": ("s_translation", {"product_category_name": "brand", "product_category_name_english": "english"}),
}


def _manifest_sql() -> str:
    parts = []
    for source, (relation, columns) in _TEXTS.items():
        texts = ", ".join(f"CAST({rendered} AS VARCHAR) AS {name}" for name, rendered in columns.items())
        parts.append(
            f"SELECT '{source}' AS source, count(*) AS rows, '{','.join(columns)}' AS columns, {_checksum(list(columns))} AS checksum "
            f"FROM (SELECT {texts} FROM {relation})"
        )
    return _sql("", "\nUNION ALL\n".join(parts))


def _dirty_ctes() -> str:
    """r_: the source texts with a row number; d_: with dirt and copies; u_: distinct rows."""
    out = []
    for source, (relation, columns) in _TEXTS.items():
        key, changes, copies = DIRT[source]
        texts = ", ".join(f"CAST({rendered} AS VARCHAR) AS {name}" for name, rendered in columns.items())
        out.append(f"r_{source} AS (SELECT *, TRY_CAST(regexp_extract({key}, '([0-9]+)$', 1) AS BIGINT) AS n_ FROM (SELECT {texts} FROM {relation}))")

        def dirtied(name, changes=changes):
            text = name
            for modulus, changed, value in changes:
                if changed == name:
                    text = f"CASE WHEN n_ % {modulus} = 0 THEN {'NULL' if value is None else repr(value)} ELSE {text} END"
            return text

        rows = ", ".join(f"{dirtied(name)} AS {name}" for name in columns)
        parts = [f"SELECT {rows} FROM r_{source}"]
        for modulus, changed, value in copies:
            copied = ", ".join(f"{repr(value) if name == changed else dirtied(name)} AS {name}" for name in columns)
            parts.append(f"SELECT {copied} FROM r_{source} WHERE n_ % {modulus} = 0")
        out.append(f"d_{source} AS ({' UNION ALL '.join(parts)}), u_{source} AS (SELECT DISTINCT * FROM d_{source})")
    return ",\n".join(out)


def _dirty_checks() -> list[str]:
    text = lambda c: f"nullif(trim({c}), '')"
    moment = lambda c: f"TRY_CAST({text(c)} AS TIMESTAMP)"
    whole = lambda c: f"CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN TRY_CAST(trim({c}) AS INTEGER) END"
    money = lambda c: f"TRY_CAST({text(c)} AS DECIMAL(18,2))"
    count = lambda t, rule: f"SELECT count(*) FROM u_{t} WHERE {rule}"
    keys = {
        "orders": [text("order_id")], "items": [text("order_id"), whole("order_item_id")], "payments": [text("order_id"), whole("payment_sequential")],
        "customers": [text("customer_id")], "products": [text("product_id")], "reviews": [text("review_id"), text("order_id")],
        "category_translation": [text("product_category_name")],
    }
    out = []
    for t, key in keys.items():
        out += [
            _check(f"{t}.key_conflicts", f"SELECT count(*) FROM (SELECT 1 FROM u_{t} GROUP BY {', '.join(key)} HAVING count(*) > 1)"),
            _check(f"{t}.missing_key", count(t, " OR ".join(f"({k}) IS NULL" for k in key))),
            _check(f"{t}.exact_duplicate_rows", f"(SELECT count(*) FROM d_{t}) - (SELECT count(*) FROM u_{t})", "warning", "Exact copies are removed on load; conflicting keys are kept."),
        ]
    note = "Amounts must be zero or more, with two decimals at most."
    for t, c in (("items", "price"), ("items", "freight_value"), ("payments", "payment_value")):
        rule = f"{money(c)} IS NULL OR {money(c)} < 0 OR NOT regexp_full_match(trim({c}), '[+]?[0-9]+([.][0-9]{{1,2}})?')"
        out.append(_check(f"{t}.{c}.invalid_amount", count(t, rule), "error", note))
    for t, c in (("items", "order_item_id"), ("payments", "payment_sequential")):
        out.append(_check(f"{t}.{c}.invalid_key", count(t, f"({whole(c)}) IS NULL OR ({whole(c)}) <= 0 OR NOT regexp_full_match(trim({c}), '[0-9]+')")))
    allowed = "('created', 'approved', 'invoiced', 'processing', 'shipped', 'delivered', 'unavailable', 'canceled')"
    score, kind = whole("review_score"), text("product_category_name")
    out += [
        _check("orders.invalid_purchase_timestamp", count("orders", f"{moment('order_purchase_timestamp')} IS NULL")),
        _check("orders.invalid_status", count("orders", f"{text('order_status')} IS NULL OR {text('order_status')} NOT IN {allowed}")),
        _check("customers.missing_unique_identifier", count("customers", f"{text('customer_unique_id')} IS NULL")),
        _check("reviews.invalid_score", count("reviews", f"({score}) IS NULL OR ({score}) NOT BETWEEN 1 AND 5"), "warning", "Left out of every rating ratio."),
        _check("reviews.ambiguous_selection", f"SELECT count(*) FROM (SELECT 1 FROM u_reviews GROUP BY {text('order_id')}, {moment('review_answer_timestamp')}, {moment('review_creation_date')}, {text('review_id')} HAVING max({score}) > min({score}))"),
        _check("products.missing_category", count("products", f"{kind} IS NULL"), "warning", "Counted under UNKNOWN."),
        _check("products.untranslated_category", count("products", f"{kind} IS NOT NULL AND {kind} NOT IN (SELECT {kind} FROM u_category_translation WHERE {kind} IS NOT NULL)"), "warning", "The original category name is kept."),
    ]
    for t, c, parent in (("orders", "customer_id", "customers"), ("items", "order_id", "orders"), ("items", "product_id", "products"), ("payments", "order_id", "orders"), ("reviews", "order_id", "orders")):
        out.append(_check(f"{t}.{c}.unmatched", count(t, f"{text(c)} IS NULL OR {text(c)} NOT IN (SELECT {text(c)} FROM u_{parent} WHERE {text(c)} IS NOT NULL)")))
    for t, c in (
        ("orders", "order_approved_at"), ("orders", "order_delivered_carrier_date"), ("orders", "order_delivered_customer_date"),
        ("orders", "order_estimated_delivery_date"), ("reviews", "review_creation_date"), ("reviews", "review_answer_timestamp"), ("items", "shipping_limit_date"),
    ):
        out.append(_check(f"{t}.{c}.invalid_timestamp", count(t, f"{moment(c)} IS NULL AND {text(c)} IS NOT NULL"), "warning"))
    return out


def _folded(source: str, group: str, place: str, digest: str) -> str:
    """A level of the hash tree: SHA-256 over up to 256 digests in order."""
    return f"""
  SELECT {group} AS g, {place} // 256 AS no, sha256(string_agg({digest}, '' ORDER BY {place})) AS d
  FROM {source} GROUP BY {group}, {place} // 256"""


_EXPORT = f"""
numbered AS (
  SELECT *, concat_ws(',', l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_returnflag) AS line,
    row_number() OVER (ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_returnflag) - 1 AS no
  FROM lines),
e0 AS (SELECT 0 AS g, no, sha256(line) AS d FROM numbered),
e1 AS ({_folded("e0", "g", "no", "d")}), e2 AS ({_folded("e1", "g", "no", "d")}), e3 AS ({_folded("e2", "g", "no", "d")}),
f0 AS (
  SELECT no // 65536 AS g, no % 65536 + 1 AS no, sha256(line) AS d FROM numbered
  UNION ALL SELECT DISTINCT no // 65536, 0, sha256('l_orderkey,l_partkey,l_linenumber,l_extendedprice,l_returnflag') FROM numbered),
f1 AS ({_folded("f0", "g", "no", "d")}), f2 AS ({_folded("f1", "g", "no", "d")}), f3 AS ({_folded("f2", "g", "no", "d")}),
files AS (SELECT g, d FROM f2 WHERE (SELECT max(no) FROM f0) < 65536 UNION ALL SELECT g, d FROM f3 WHERE (SELECT max(no) FROM f0) >= 65536)"""


def _files() -> dict[str, str]:
    kind = "l_linenumber % 4"
    return {
        "overview_state_rows": _sql(_Q04, _Q04_BODY).replace("WITH ", "SELECT * FROM (WITH ", 1).rstrip() + ") WHERE investigation_rank <= 3",
        "quality_staging_dirty": f"WITH {_sources()},\n{_dirty_ctes()}\n{_finish(_dirty_checks())}",
        "lineitem_fingerprint": f"WITH {_LINES} SELECT count(*) AS rows, {_checksum(_LINE_COLUMNS)} AS checksum FROM lines",
        "source_manifest_rows": _manifest_sql(),
        "csv_round_trip": f"""
SELECT l_partkey || '-' || l_linenumber AS review_id, CAST(l_orderkey AS VARCHAR) AS order_id,
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS review_score,
  CASE {kind} WHEN 0 THEN 'plain ' || l_returnflag WHEN 1 THEN 'two' || chr(10) || 'lines, ' || l_returnflag
    WHEN 2 THEN '"' || l_linestatus || '" first' || chr(13) || chr(10) || chr(10) || '""last' END AS review_comment_message
FROM lineitem""",
        "export_round_trip": f"""
WITH {_LINES}, {_EXPORT}
SELECT n.no // 65536 AS part, count(*) AS rows, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
  any_value(e2.d) AS part_hash, any_value(files.d) AS file_hash,
  CASE WHEN (SELECT count(*) FROM e2) = 1 THEN (SELECT any_value(d) FROM e2) ELSE (SELECT any_value(d) FROM e3) END AS root,
  (SELECT count(*) FROM numbered) AS all_rows
FROM numbered n JOIN e2 ON e2.no = n.no // 65536 JOIN files ON files.g = n.no // 65536
GROUP BY n.no // 65536""",
    }
