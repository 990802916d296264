"""Independent ANSI SQL for every registered query.

The statements derive the retail tables from the generic source tables by the
same formulas as `tillroll.sources.synthetic`, and answer each question the plain
way: unpartitioned windows, money in integer cents, percentages by integer
half-up division, so that no rounding depends on how an engine divides.
"""

from __future__ import annotations

BASE = """
r_lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS order_item_id,
         CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id,
         l_shipdate AS shipping_limit_date,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
         (CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) + 50) // 100
           AS freight
  FROM lineitem),
r_reviews AS (
  SELECT CAST(l_partkey AS VARCHAR) AS review_id, CAST(l_orderkey AS VARCHAR) AS order_id,
         l_partkey % 5 + 1 AS score,
         CASE WHEN l_partkey % 11 = 0 THEN l_returnflag END AS title
  FROM lineitem WHERE l_linestatus = 'F'),
r_shipped AS (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey),
r_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS person,
         o_orderdate AS ts, CAST(o_orderdate AS DATE) AS day, o_orderkey, o_orderpriority,
         o_orderstatus AS status,
         n_name AS state, c_mktsegment AS city,
         lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') AS zip,
         CASE WHEN o_orderkey % 97 <> 0 AND last_ship IS NOT NULL THEN
           1 + ((date_diff('day', CAST(o_orderdate AS DATE), CAST(last_ship AS DATE)) % 45) + 45) % 45 - 37
         END AS delay
  FROM orders
  LEFT JOIN r_shipped ON l_orderkey = o_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey),
r_scoped AS (
  SELECT *, CAST(date_trunc('month', day) AS DATE) AS month FROM r_orders
  WHERE status = 'F' AND ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-09-01'),
r_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
         CASE WHEN p_partkey % 53 <> 0 THEN p_type END AS raw_category,
         CASE WHEN p_partkey % 53 = 0 THEN 'unknown'
              WHEN p_type IN ('PROMO', 'STANDARD') THEN p_type ELSE lower(p_type) END AS category
  FROM part),
r_sellers AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, s_name AS city, n_name AS state,
         lpad(CAST(s_suppkey % 100000 AS VARCHAR), 5, '0') AS zip
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
r_translation AS (SELECT DISTINCT p_type FROM part WHERE p_type NOT IN ('PROMO', 'STANDARD')),
r_points AS (
  SELECT lpad(CAST(user_id % 100000 AS VARCHAR), 5, '0') AS zip, value AS lat,
         event_type AS city, upper(substr(event_type, 1, 2)) AS state
  FROM events),
r_scores AS (
  SELECT order_id, ((2 * sum(score) * 100000000000000 + count(*)) // (2 * count(*))) AS score14
  FROM r_reviews GROUP BY order_id),
r_delays AS (
  SELECT o.*, score14 FROM r_scoped o JOIN r_scores USING (order_id) WHERE delay IS NOT NULL),
r_pairs AS (
  SELECT seller_id, order_id, sum(price + freight) AS rev
  FROM r_lines JOIN r_scoped USING (order_id) GROUP BY ALL),
r_seller_rev AS (SELECT seller_id, count(*) AS orders, sum(rev) AS rev FROM r_pairs GROUP BY seller_id),
r_qualified AS (
  SELECT seller_id, count(*) AS orders, sum(rev) AS rev, count(score14) AS reviewed,
         {rating14} AS rating14
  FROM r_pairs LEFT JOIN r_scores USING (order_id)
  GROUP BY seller_id HAVING count(score14) >= 45),
r_ranked AS (
  SELECT *, rank() OVER (ORDER BY rev DESC) AS revenue_rank,
         rank() OVER (ORDER BY rating14 DESC) AS rating_rank, count(*) OVER () AS qualified
  FROM r_qualified),
r_known_ranked AS (
  SELECT q.*, s.state, rank() OVER (ORDER BY rev DESC) AS revenue_rank,
         rank() OVER (ORDER BY rating14 DESC) AS rating_rank
  FROM r_qualified q JOIN r_sellers s USING (seller_id)),
r_person_months AS (
  SELECT DISTINCT person, CAST(date_trunc('month', day) AS DATE) AS month
  FROM r_orders WHERE status = 'F'),
r_cohorts AS (
  SELECT person, month, min(month) OVER (PARTITION BY person) AS cohort FROM r_person_months),
r_activity AS (
  SELECT cohort, date_diff('month', cohort, month) AS k, count(*) AS active
  FROM r_cohorts WHERE cohort >= DATE '1997-01-01' AND cohort < DATE '1998-09-01'
  GROUP BY ALL),
r_monthly AS (
  SELECT month, count(DISTINCT order_id) AS orders, sum(price + freight) AS rev
  FROM r_scoped JOIN r_lines USING (order_id) GROUP BY month),
r_states AS (
  SELECT state, count(DISTINCT order_id) AS orders, sum(price + freight) AS rev,
         sum(freight) AS freight, count(*) AS lines
  FROM r_scoped JOIN r_lines USING (order_id) GROUP BY state),
r_grid AS (
  SELECT state, category, count(DISTINCT order_id) AS orders, sum(price + freight) AS rev
  FROM r_scoped JOIN r_lines USING (order_id) JOIN r_products USING (product_id) GROUP BY ALL)
"""


def half_up(numerator: str, denominator: str) -> str:
    """Integer quotient of non-negative integers, halves up."""
    return f"((2 * CAST({numerator} AS HUGEINT) + ({denominator})) // (2 * CAST({denominator} AS HUGEINT)))"


def pct(part: str, whole: str, digits: int) -> str:
    """100 * part / whole to some digits; a negative part rounds away from zero."""
    scale = 10**digits
    value = half_up(f"abs({part}) * {100 * scale}", whole)
    return (
        f"CASE WHEN ({whole}) > 0 THEN sign({part}) * CAST({value} AS DOUBLE) / {scale} END"
    )


def money(cents: str) -> str:
    return f"CAST({cents} AS DOUBLE) / 100"


def mean(total: str, n: str, digits: int, unit: int = 1) -> str:
    scale = 10**digits
    return f"CAST({half_up(f'({total}) * {scale}', f'({n}) * {unit}')} AS DOUBLE) / {scale}"


E14 = 10**14
RATING14 = half_up(half_up("sum(score14) * 10000", "count(score14)"), "10000")


def bucket(delay: str) -> str:
    return (
        f"CASE WHEN {delay} < 0 THEN '1. Early' WHEN {delay} = 0 THEN '2. On time' "
        f"WHEN {delay} <= 3 THEN '3. 1-3 days late' WHEN {delay} <= 7 THEN '4. 4-7 days late' "
        f"WHEN {delay} > 7 THEN '5. 8+ days late' END"
    )


def _cohort_matrix() -> str:
    months = ", ".join(
        f"CASE WHEN cohort + INTERVAL {k} MONTH < DATE '1998-09-01' THEN "
        f"{pct(f'coalesce(sum(active) FILTER (WHERE k = {k}), 0)', 'sum(active) FILTER (WHERE k = 0)', 2)} END AS m{k}"
        for k in range(1, 7)
    )
    return (
        "SELECT CAST(cohort AS VARCHAR) AS cohort_month, "
        f"CAST(sum(active) FILTER (WHERE k = 0) AS BIGINT) AS cohort_size, {months} "
        "FROM r_activity GROUP BY cohort"
    )


_COHORT_GRID = """(
  SELECT g.cohort, g.k, coalesce(a.active, 0) AS active, g.size
  FROM (SELECT cohort, active AS size, unnest(range(0, 13)) AS k FROM r_activity WHERE k = 0) g
  LEFT JOIN r_activity a ON a.cohort = g.cohort AND a.k = g.k
  WHERE g.cohort + to_months(CAST(g.k AS INTEGER)) < DATE '1998-09-01')"""

_FIRST_ORDERS = """
f_people AS (
  SELECT person, arg_min(day, {'t': ts, 'o': order_id}) AS day,
         arg_min(delay > 0, {'t': ts, 'o': order_id}) AS late, count(*) >= 2 AS again
  FROM r_scoped WHERE delay IS NOT NULL GROUP BY person),
f_samples AS (
  SELECT '1. All first orders' AS sample, late, again FROM f_people
  UNION ALL
  SELECT '2. First order before Mar 1998', late, again FROM f_people WHERE day < DATE '1998-03-01'),
f_rates AS (
  SELECT sample, count(*) FILTER (WHERE NOT late) AS n0, count(*) FILTER (WHERE NOT late AND again) AS h0,
         count(*) FILTER (WHERE late) AS n1, count(*) FILTER (WHERE late AND again) AS h1
  FROM f_samples GROUP BY sample),
f_z AS (
  SELECT *, (h0 / n0 - h1 / n1)
    / sqrt((h0 + h1) / (n0 + n1) * (1 - (h0 + h1) / (n0 + n1)) * (1.0 / n0 + 1.0 / n1)) AS z
  FROM (SELECT sample, CAST(n0 AS DOUBLE) AS n0, CAST(h0 AS DOUBLE) AS h0,
               CAST(n1 AS DOUBLE) AS n1, CAST(h1 AS DOUBLE) AS h1 FROM f_rates)),
f_p AS (
  -- two-sided tail of the normal law by Simpson's rule over 2000 panels of [0, |z|]
  SELECT sample, 1 - 2 / sqrt(2 * pi()) * sum(
    CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp(-0.5 * (abs(z) * i / 2000.0) * (abs(z) * i / 2000.0))) * abs(any_value(z)) / 6000 AS p
  FROM f_z, (SELECT unnest(range(0, 2001)) AS i) GROUP BY sample, abs(z))
"""


def _audit_keys() -> str:
    keys = [
        ("customers", "customer_id", "SELECT order_id AS k, 0 AS k2 FROM r_orders"),
        ("sellers", "seller_id", "SELECT seller_id AS k, 0 AS k2 FROM r_sellers"),
        ("category_translation", "product_category_name", "SELECT p_type AS k, 0 AS k2 FROM r_translation"),
        ("products", "product_id", "SELECT product_id AS k, 0 AS k2 FROM r_products"),
        ("geolocation", "zip_code_prefix", "SELECT DISTINCT zip AS k, 0 AS k2 FROM r_points"),
        ("orders", "order_id", "SELECT order_id AS k, 0 AS k2 FROM r_orders"),
        ("order_items", "order_id, order_item_id", "SELECT order_id AS k, order_item_id AS k2 FROM r_lines"),
        ("order_payments", "order_id, payment_sequential", "SELECT CAST(o_orderkey AS VARCHAR) AS k, 1 AS k2 FROM orders"),
        ("order_reviews", "review_id, order_id", "SELECT review_id AS k, order_id AS k2 FROM r_reviews"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) AS violating_keys, "
        f"CAST(coalesce(sum(n), 0) AS BIGINT) AS violating_rows "
        f"FROM (SELECT count(*) AS n FROM ({rows}) GROUP BY k, k2 HAVING count(*) > 1)"
        for table, rule, rows in keys
    )


def _audit_foreign_keys() -> str:
    links = [
        ("orders", "customer_id -> customers", "SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders", "SELECT order_id FROM r_orders"),
        ("order_items", "order_id -> orders", "SELECT order_id AS k FROM r_lines", "SELECT CAST(o_orderkey AS VARCHAR) FROM orders"),
        ("order_items", "product_id -> products", "SELECT product_id AS k FROM r_lines", "SELECT product_id FROM r_products"),
        ("order_items", "seller_id -> sellers", "SELECT seller_id AS k FROM r_lines", "SELECT seller_id FROM r_sellers"),
        ("order_payments", "order_id -> orders", "SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders", "SELECT CAST(o_orderkey AS VARCHAR) FROM orders"),
        ("order_reviews", "order_id -> orders", "SELECT order_id AS k FROM r_reviews", "SELECT CAST(o_orderkey AS VARCHAR) FROM orders"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(DISTINCT k) AS violating_keys, "
        f"count(*) AS violating_rows FROM ({child}) WHERE k NOT IN ({parent})"
        for table, rule, child, parent in links
    )


def _columns(parts: list[tuple[str, str, str]]) -> str:
    """(table, column, 'SELECT count of violations ...')"""
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, ({count}) AS violating_rows"
        for table, column, count in parts
    )


def _n(relation: str, condition: str) -> str:
    return f"SELECT count(*) FROM {relation} WHERE {condition}"


def _audit_required() -> str:
    return _columns([
        ("customers", "customer_id", _n("r_orders", "order_id IS NULL")),
        ("customers", "customer_unique_id", _n("r_orders", "person IS NULL")),
        ("customers", "customer_zip_code_prefix", _n("r_orders", "zip IS NULL")),
        ("customers", "customer_city", _n("r_orders", "city IS NULL")),
        ("customers", "customer_state", _n("r_orders", "state IS NULL")),
        ("sellers", "seller_id", _n("r_sellers", "seller_id IS NULL")),
        ("sellers", "seller_zip_code_prefix", _n("r_sellers", "zip IS NULL")),
        ("sellers", "seller_city", _n("r_sellers", "city IS NULL")),
        ("sellers", "seller_state", _n("r_sellers", "state IS NULL")),
        ("category_translation", "product_category_name", _n("r_translation", "p_type IS NULL")),
        ("category_translation", "product_category_name_english", _n("r_translation", "p_type IS NULL")),
        ("products", "product_id", _n("r_products", "product_id IS NULL")),
        ("geolocation", "zip_code_prefix", _n("r_points", "FALSE")),
        ("geolocation", "lat", "SELECT count(*) FROM (SELECT zip FROM r_points WHERE zip IS NOT NULL GROUP BY zip HAVING count(lat) = 0)"),
        ("geolocation", "lng", "SELECT count(*) FROM (SELECT zip FROM r_points WHERE zip IS NOT NULL GROUP BY zip HAVING count(lat) = 0)"),
        ("orders", "order_id", _n("orders", "o_orderkey IS NULL")),
        ("orders", "customer_id", _n("orders", "o_orderkey IS NULL")),
        ("orders", "order_status", _n("r_orders", "status IS NULL")),
        ("orders", "order_purchase_timestamp", _n("orders", "o_orderdate IS NULL")),
        ("orders", "order_estimated_delivery_date", _n("orders", "o_orderdate IS NULL")),
        ("order_items", "order_id", _n("r_lines", "order_id IS NULL")),
        ("order_items", "order_item_id", _n("r_lines", "order_item_id IS NULL")),
        ("order_items", "product_id", _n("r_lines", "product_id IS NULL")),
        ("order_items", "seller_id", _n("r_lines", "seller_id IS NULL")),
        ("order_items", "shipping_limit_date", _n("r_lines", "shipping_limit_date IS NULL")),
        ("order_items", "price", _n("r_lines", "price IS NULL")),
        ("order_items", "freight_value", _n("r_lines", "freight IS NULL")),
        ("order_payments", "order_id", _n("orders", "o_orderkey IS NULL")),
        ("order_payments", "payment_sequential", _n("orders", "FALSE")),
        ("order_payments", "payment_type", _n("orders", "o_orderpriority IS NULL")),
        ("order_payments", "payment_installments", _n("orders", "o_orderkey IS NULL")),
        ("order_payments", "payment_value", _n("orders", "o_totalprice IS NULL")),
        ("order_reviews", "review_id", _n("r_reviews", "review_id IS NULL")),
        ("order_reviews", "order_id", _n("r_reviews", "order_id IS NULL")),
        ("order_reviews", "review_score", _n("r_reviews", "score IS NULL")),
        ("order_reviews", "review_creation_date", _n("lineitem", "l_linestatus = 'F' AND l_shipdate IS NULL")),
        ("order_reviews", "review_answer_timestamp", _n("lineitem", "l_linestatus = 'F' AND l_shipdate IS NULL")),
    ])


def _audit_lengths() -> str:
    return _columns([
        ("customers", "customer_id", _n("r_orders", "length(order_id) > 32")),
        ("customers", "customer_unique_id", _n("r_orders", "length(person) > 32")),
        ("customers", "customer_zip_code_prefix", _n("r_orders", "length(zip) > 5")),
        ("customers", "customer_city", _n("r_orders", "length(city) > 50")),
        ("customers", "customer_state", _n("r_orders", "length(state) > 2")),
        ("sellers", "seller_id", _n("r_sellers", "length(seller_id) > 32")),
        ("sellers", "seller_zip_code_prefix", _n("r_sellers", "length(zip) > 5")),
        ("sellers", "seller_city", _n("r_sellers", "length(city) > 50")),
        ("sellers", "seller_state", _n("r_sellers", "length(state) > 2")),
        ("category_translation", "product_category_name", _n("r_translation", "length(p_type) > 60")),
        ("category_translation", "product_category_name_english", _n("r_translation", "length(p_type) > 60")),
        ("products", "product_id", _n("r_products", "length(product_id) > 32")),
        ("products", "product_category_name", _n("r_products", "length(raw_category) > 60")),
        ("geolocation", "zip_code_prefix", "SELECT count(DISTINCT zip) FROM r_points WHERE length(zip) > 5"),
        ("geolocation", "city", "SELECT count(DISTINCT zip) FROM r_points WHERE length(city) > 50"),
        ("geolocation", "state", "SELECT count(DISTINCT zip) FROM r_points WHERE length(state) > 2"),
        ("orders", "order_id", _n("r_orders", "length(order_id) > 32")),
        ("orders", "customer_id", _n("r_orders", "length(order_id) > 32")),
        ("orders", "order_status", _n("r_orders", "length(status) > 12")),
        ("order_items", "order_id", _n("r_lines", "length(order_id) > 32")),
        ("order_items", "product_id", _n("r_lines", "length(product_id) > 32")),
        ("order_items", "seller_id", _n("r_lines", "length(seller_id) > 32")),
        ("order_payments", "order_id", _n("r_orders", "length(order_id) > 32")),
        ("order_payments", "payment_type", _n("orders", "length(o_orderpriority) > 20")),
        ("order_reviews", "review_id", _n("r_reviews", "length(review_id) > 32")),
        ("order_reviews", "order_id", _n("r_reviews", "length(order_id) > 32")),
    ])


def _midnight(day: str) -> str:
    return f"CAST(CAST({day} AS TIMESTAMP) AS VARCHAR)"


_TABLE_SIZES = [
    ("customers", "r_orders"),
    ("sellers", "r_sellers"),
    ("category_translation", "r_translation"),
    ("products", "r_products"),
    ("geolocation", "(SELECT DISTINCT zip FROM r_points)"),
    ("orders", "orders"),
    ("order_items", "r_lines"),
    ("order_payments", "orders"),
    ("order_reviews", "r_reviews"),
]

_MODE = """(
  SELECT zip, {c} AS top FROM (
    SELECT zip, {c}, row_number() OVER (PARTITION BY zip ORDER BY count(*) DESC, {c}) AS i
    FROM r_points GROUP BY zip, {c}) WHERE i = 1)"""

# values have two decimals, and longitude is the negated latitude
_MEAN_LAT = mean("sum(CAST(round(lat * 100) AS BIGINT))", "count(lat)", 6, 100)

_RUNNING = "sum(rev) OVER (ORDER BY rev DESC, seller_id ROWS UNBOUNDED PRECEDING)"


def _sellers_by(rank: str) -> str:
    return (
        f"SELECT seller_id, {money('rev')} AS revenue, reviewed AS reviewed_orders, "
        f"{mean('rating14', '1', 2, E14)} AS avg_rating, revenue_rank, rating_rank, "
        f"qualified AS qualified_sellers FROM r_ranked WHERE {rank} <= 20"
    )


def _bodies() -> dict[str, tuple[str, str]]:
    """name -> (extra CTEs, final SELECT)"""
    none = ""
    return {
        "q1a_row_counts": (none, " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {r}" for t, r in _TABLE_SIZES)),
        "q1b_date_range": (none,
            "SELECT CAST(min(ts) AS VARCHAR) AS first_order, CAST(max(ts) AS VARCHAR) AS last_order FROM r_orders"),
        "q2_status_share": (none,
            f"SELECT status AS order_status, count(*) AS orders, {pct('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct_of_orders FROM r_orders GROUP BY status"),
        "q3_score_distribution": (none,
            f"SELECT score AS review_score, count(*) AS reviews, {pct('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct_of_reviews FROM r_reviews GROUP BY score"),
        "q4_top_categories": (none,
            "SELECT category, count(*) AS items_sold FROM r_lines JOIN r_products USING (product_id) GROUP BY category ORDER BY items_sold DESC, category LIMIT 10"),
        "q5_monthly_revenue": (none,
            f"SELECT CAST(month AS VARCHAR) AS month, orders, {money('rev')} AS revenue FROM r_monthly"),
        "q8_revenue_growth": (
            "w AS (SELECT *, lag(rev) OVER o AS p1, lag(rev, 12) OVER o AS p12, "
            "sum(rev) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3, "
            "count(*) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3 "
            "FROM r_monthly WINDOW o AS (ORDER BY month))",
            f"SELECT CAST(month AS VARCHAR) AS month, orders, {money('rev')} AS revenue, {money('p1')} AS prev_month_revenue, "
            f"{pct('rev - p1', 'p1', 1)} AS mom_growth_pct, {money(half_up('s3', 'n3'))} AS rolling_3m_avg, "
            f"{pct('rev - p12', 'p12', 1)} AS yoy_growth_pct FROM w"),
        "q6_delay_buckets": (none,
            f"SELECT {bucket('delay')} AS delay_bucket, count(*) AS orders, {pct('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct_of_orders, "
            f"{mean('sum(score14)', 'count(*)', 2, E14)} AS avg_review_score, "
            f"{pct(f'count(*) FILTER (WHERE score14 <= {2 * E14})', 'count(*)', 1)} AS pct_1_2_star FROM r_delays GROUP BY 1"),
        "q6b_delay_score_corr": (none,
            "SELECT round(corr(CAST(delay AS DOUBLE), CAST(score14 AS DOUBLE) / 1e14), 3) AS corr_delay_vs_score FROM r_delays"),
        "q6c_late_rate_quarter": (none,
            f"SELECT CAST(CAST(date_trunc('quarter', day) AS DATE) AS VARCHAR) AS quarter, count(*) AS delivered_orders, "
            f"{pct('count(*) FILTER (WHERE delay > 0)', 'count(*)', 1)} AS late_pct FROM r_scoped WHERE delay IS NOT NULL GROUP BY 1"),
        "q9a_top_sellers": (
            f"w AS (SELECT *, rank() OVER (ORDER BY rev DESC) AS rk, sum(rev) OVER () AS total, {_RUNNING} AS running "
            "FROM r_seller_rev JOIN r_sellers USING (seller_id))",
            f"SELECT rk AS revenue_rank, seller_id, state AS seller_state, orders, {money('rev')} AS revenue, "
            f"{pct('rev', 'total', 2)} AS pct_of_revenue, {pct('running', 'total', 2)} AS cumulative_pct "
            "FROM w ORDER BY rk, seller_id LIMIT 20"),
        "q9b_pareto": (
            f"w AS (SELECT {_RUNNING} AS running, sum(rev) OVER () AS total FROM r_seller_rev)",
            "SELECT count(*) AS total_sellers, count(*) FILTER (WHERE running * 100 <= total * 80) AS sellers_for_80pct, "
            f"{pct('count(*) FILTER (WHERE running * 100 <= total * 80)', 'count(*)', 1)} AS pct_of_sellers FROM w"),
        "q10_sellers_rating": (none, _sellers_by("revenue_rank")),
        "q10_sellers_rating_by_rating": (none, _sellers_by("rating_rank")),
        "q12_repeat_rate": (
            "p AS (SELECT person, count(DISTINCT order_id) AS n, count(DISTINCT day) AS days FROM r_scoped GROUP BY person)",
            "SELECT count(*) AS customers, count(*) FILTER (WHERE n >= 2) AS repeat_customers, "
            f"{pct('count(*) FILTER (WHERE n >= 2)', 'count(*)', 2)} AS repeat_rate_pct, "
            "count(*) FILTER (WHERE days >= 2) AS repeat_customers_strict, "
            f"{pct('count(*) FILTER (WHERE days >= 2)', 'count(*)', 2)} AS repeat_rate_strict_pct, "
            f"{mean('sum(n)', 'count(*)', 3)} AS avg_orders_per_customer FROM p"),
        "q13_cohort_long": (
            "w AS (SELECT *, first_value(active) OVER (PARTITION BY cohort ORDER BY k) AS size FROM r_activity)",
            "SELECT CAST(cohort AS VARCHAR) AS cohort_month, CAST(k AS INTEGER) AS month_number, active AS active_customers, "
            f"size AS cohort_size, {pct('active', 'size', 2)} AS retention_pct FROM w"),
        "q13_cohort_long_observable": (
            "w AS (SELECT *, first_value(active) OVER (PARTITION BY cohort ORDER BY k) AS size FROM r_activity)",
            "SELECT CAST(cohort AS VARCHAR) AS cohort_month, CAST(k AS INTEGER) AS month_number, active AS active_customers, "
            f"size AS cohort_size, {pct('active', 'size', 2)} AS retention_pct FROM w WHERE cohort + to_months(CAST(k AS INTEGER)) < DATE '1998-09-01'"),
        "q13b_cohort_matrix": (none, _cohort_matrix()),
        "q14_second_order_gap": (
            "firsts AS (SELECT person, min({'t': ts, 'o': order_id, 'd': day}) AS a FROM r_scoped GROUP BY person), "
            "seconds AS (SELECT r.person, min({'t': ts, 'o': order_id, 'd': day}) AS b FROM r_scoped r "
            "JOIN firsts f ON r.person = f.person WHERE order_id <> f.a.o GROUP BY r.person), "
            "g AS (SELECT date_diff('day', a.d, b.d) AS gap FROM firsts JOIN seconds USING (person))",
            f"SELECT count(*) AS repeat_customers, {mean('sum(gap)', 'count(*)', 1)} AS avg_days, "
            "CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY gap) AS DOUBLE) AS median_days, "
            f"{pct('count(*) FILTER (WHERE gap = 0)', 'count(*)', 1)} AS pct_same_day, "
            f"{pct('count(*) FILTER (WHERE gap <= 30)', 'count(*)', 1)} AS pct_within_30d FROM g"),
        "q15_late_first_order_test": (_FIRST_ORDERS.strip(),
            f"SELECT sample, r.n0 AS n_on_time, {pct('r.h0', 'r.n0', 2)} AS on_time_repeat_pct, r.n1 AS n_late, "
            f"{pct('r.h1', 'r.n1', 2)} AS late_repeat_pct, round(z, 2) AS z_score, round(p, 3) AS p_value "
            "FROM f_rates r JOIN f_z USING (sample) JOIN f_p USING (sample)"),
        "q7_state_category": (none,
            f"SELECT state AS customer_state, category, orders, {money('rev')} AS revenue FROM r_grid"),
        "q7b_state_revenue": (none,
            f"SELECT state AS customer_state, orders, {money('rev')} AS revenue, {pct('rev', 'sum(rev) OVER ()', 2)} AS pct_of_revenue, "
            f"{money(half_up('freight', 'lines'))} AS avg_freight_per_item FROM r_states"),
        "q11_top_categories_state": (
            "w AS (SELECT *, dense_rank() OVER (PARTITION BY state ORDER BY rev DESC) AS rk, sum(rev) OVER (PARTITION BY state) AS total FROM r_grid)",
            f"SELECT state AS customer_state, CAST(rk AS INTEGER) AS category_rank, category, {money('rev')} AS revenue, "
            f"{pct('rev', 'total', 1)} AS pct_of_state_revenue FROM w WHERE rk <= 3"),
        "v1_orders": (
            "i AS (SELECT order_id, count(*) AS items, sum(price) AS price, sum(freight) AS freight FROM r_lines GROUP BY order_id)",
            "SELECT o.order_id, person AS customer_unique_id, state AS customer_state, CAST(day AS VARCHAR) AS purchase_date, "
            f"CAST(month AS VARCHAR) AS order_month, items, {money('price')} AS product_value, {money('freight')} AS freight_value, "
            f"{money('price + freight')} AS revenue, CAST(delay AS INTEGER) AS delay_days, {bucket('delay')} AS delay_bucket, "
            f"{mean('score14', '1', 2, E14)} AS review_score FROM r_scoped o JOIN i USING (order_id) LEFT JOIN r_scores USING (order_id)"),
        "v2_order_items": (none,
            f"SELECT order_id, order_item_id, seller_id, s.state AS seller_state, category, {money('price')} AS price, "
            f"{money('freight')} AS freight_value, {money('price + freight')} AS revenue FROM r_lines JOIN r_scoped USING (order_id) "
            "JOIN r_sellers s USING (seller_id) JOIN r_products USING (product_id)"),
        "v3_seller_summary": (none,
            f"SELECT seller_id, substr(seller_id, 1, 8) AS seller_short_id, state AS seller_state, orders, {money('rev')} AS revenue, "
            f"reviewed AS reviewed_orders, {mean('rating14', '1', 2, E14)} AS avg_rating, revenue_rank, rating_rank "
            "FROM r_known_ranked"),
        "v4_cohort_retention": (none,
            "SELECT CAST(cohort AS VARCHAR) AS cohort_month, CAST(k AS INTEGER) AS month_number, active AS active_customers, "
            f"size AS cohort_size, {pct('active', 'size', 2)} AS retention_pct FROM {_COHORT_GRID}"),
        "d1_ytd_growth": (
            "y AS (SELECT sum(rev) FILTER (WHERE year(month) = 1998) AS a, sum(rev) FILTER (WHERE year(month) = 1997) AS b "
            "FROM r_monthly WHERE month(month) <= 8)",
            f"SELECT {money('a')} AS revenue_this_year, {money('b')} AS revenue_last_year, {pct('a - b', 'b', 1)} AS ytd_growth_pct FROM y"),
        "d2_top_list_overlap": (none,
            "SELECT count(*) AS in_both_lists FROM r_ranked WHERE revenue_rank <= 20 AND rating_rank <= 20"),
        "d3_leading_category_states": (
            "w AS (SELECT *, dense_rank() OVER (PARTITION BY state ORDER BY rev DESC) AS rk FROM r_grid)",
            "SELECT category, count(*) AS states_led FROM w WHERE rk = 1 GROUP BY category"),
        "d4_mean_month1_retention": (
            f"w AS (SELECT * FROM {_COHORT_GRID} WHERE k = 1)",
            f"SELECT round(avg(active * 100.0::DOUBLE / size), 2) AS mean_retention_pct, {pct('sum(active)', 'sum(size)', 2)} AS pooled_retention_pct FROM w"),
        "d5_top_state_share": (
            "w AS (SELECT *, row_number() OVER (ORDER BY rev DESC, state) AS i, sum(rev) OVER () AS total, "
            "sum(rev) OVER (ORDER BY rev DESC, state ROWS UNBOUNDED PRECEDING) AS running FROM r_states)",
            f"SELECT CAST(i AS INTEGER) AS state_rank, state AS customer_state, {money('rev')} AS revenue, {pct('running', 'total', 2)} AS cumulative_pct FROM w WHERE i <= 3"),
        "a1_primary_keys": (none, _audit_keys()),
        "a2_unique_columns": (none,
            "SELECT 'orders' AS table_name, 'customer_id' AS rule, count(*) AS violating_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS violating_rows "
            "FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1)"),
        "a3_foreign_keys": (none, _audit_foreign_keys()),
        "a4_required_values": (none, _audit_required()),
        "a5_value_domains": (none, _columns([("order_reviews", "review_score", _n("r_reviews", "score NOT BETWEEN 1 AND 5"))])),
        "a6_text_lengths": (none, _audit_lengths()),
        "a7_known_anomalies": (none,
            "SELECT 'surplus rows of repeated review ids' AS anomaly, count(*) - count(DISTINCT review_id) AS found FROM r_reviews "
            "UNION ALL SELECT 'orders with more than one review', count(*) FROM (SELECT order_id FROM r_reviews GROUP BY order_id HAVING count(*) > 1) "
            "UNION ALL SELECT 'products without a category', count(*) FROM r_products WHERE raw_category IS NULL "
            "UNION ALL SELECT 'categories without a translation', count(DISTINCT raw_category) FROM r_products WHERE raw_category NOT IN (SELECT p_type FROM r_translation) "
            "UNION ALL SELECT 'zip prefixes without a point', count(*) FROM (SELECT zip FROM r_orders UNION SELECT zip FROM r_sellers) WHERE zip NOT IN (SELECT zip FROM r_points)"),
        "l3_products_from_text": (none,
            "SELECT CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN p_partkey % 53 <> 0 THEN p_type END AS product_category_name, "
            "length(p_name) AS product_name_length, p_size * 10 AS product_description_length, CAST(p_partkey % 7 AS INTEGER) AS product_photos_qty, "
            "CAST(floor(p_retailprice) AS INTEGER) AS product_weight_g, p_size AS product_length_cm, p_size AS product_height_cm, p_size AS product_width_cm FROM part"),
        "l4_geolocation_rollup": (none,
            f"SELECT p.zip AS zip_code_prefix, {_MEAN_LAT} AS lat, -{_MEAN_LAT} AS lng, any_value(c.top) AS city, any_value(s.top) AS state "
            f"FROM r_points p JOIN {_MODE.format(c='city')} c ON c.zip = p.zip JOIN {_MODE.format(c='state')} s ON s.zip = p.zip GROUP BY p.zip"),
        "l5_customers": (none,
            "SELECT order_id AS customer_id, person AS customer_unique_id, zip AS customer_zip_code_prefix, "
            "city AS customer_city, state AS customer_state FROM r_orders"),
        "l5_orders": (none,
            "SELECT order_id, order_id AS customer_id, status AS order_status, CAST(ts AS VARCHAR) AS order_purchase_timestamp, "
            "CASE WHEN o_orderkey % 89 <> 0 THEN CAST(ts AS VARCHAR) END AS order_approved_at, "
            f"CASE WHEN o_orderkey % 83 <> 0 THEN {_midnight('day + 1')} END AS order_delivered_carrier_date, "
            f"{_midnight('day + CAST(delay + 37 AS INTEGER)')} AS order_delivered_customer_date, "
            f"{_midnight('day + 37')} AS order_estimated_delivery_date FROM r_orders"),
        "l5_order_items": (none,
            f"SELECT order_id, order_item_id, product_id, seller_id, {_midnight('shipping_limit_date')} AS shipping_limit_date, "
            f"{money('price')} AS price, {money('freight')} AS freight_value FROM r_lines"),
        "l5_order_reviews": (none,
            "SELECT CAST(l_partkey AS VARCHAR) AS review_id, CAST(l_orderkey AS VARCHAR) AS order_id, "
            "CAST(l_partkey % 5 + 1 AS INTEGER) AS review_score, CASE WHEN l_partkey % 11 = 0 THEN l_returnflag END AS review_comment_title, "
            "CASE WHEN l_partkey % 13 = 0 THEN 'Part ' || l_partkey || ' is \"fine\",' || chr(10) || 'said the buyer, twice' END AS review_comment_message, "
            f"{_midnight('l_shipdate')} AS review_creation_date, {_midnight('CAST(l_shipdate AS DATE) + 1')} AS review_answer_timestamp "
            "FROM lineitem WHERE l_linestatus = 'F'"),
        "l5_order_payments": (none,
            "SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 1 AS payment_sequential, o_orderpriority AS payment_type, "
            f"CAST(o_orderkey % 10 + 1 AS INTEGER) AS payment_installments, {money('CAST(round(o_totalprice * 100) AS BIGINT)')} AS payment_value FROM orders"),
        "l5_sellers": (none,
            "SELECT seller_id, zip AS seller_zip_code_prefix, city AS seller_city, state AS seller_state FROM r_sellers"),
        "l5_category_translation": (none,
            "SELECT p_type AS product_category_name, lower(p_type) AS product_category_name_english FROM r_translation"),
        "l6_load_reconcile": (none, " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS expected, count(*) AS actual, 'OK' AS status FROM {r}" for t, r in _TABLE_SIZES)),
    }


# Registered under two names: read as a plan and from files, or through a view's name.
SAME = {
    "l5_products": "l3_products_from_text",
    "l5_geolocation": "l4_geolocation_rollup",
    "s1_vw_orders": "v1_orders",
    "s2_vw_order_items": "v2_order_items",
    "s3_vw_seller_summary": "v3_seller_summary",
    "s4_vw_cohort_retention": "v4_cohort_retention",
}


def statements() -> dict[str, str]:
    base = BASE.strip().replace("{rating14}", RATING14)
    bodies = _bodies()
    bodies |= {name: bodies[other] for name, other in SAME.items()}
    return {
        name: f"WITH {base}{', ' + extra if extra else ''}\n{body}"
        for name, (extra, body) in bodies.items()
    }
