"""The registered queries once more as DuckDB SQL over the same tables."""

from __future__ import annotations

from basketwise.functions.expressions import WHITESPACE

LINES = """
lines AS (
  SELECT l_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id,
         o_orderdate AS order_date, l_quantity AS quantity,
         l_extendedprice / l_quantity AS unit_price, l_discount * 100 AS discount_pct,
         CASE WHEN l_returnflag = 'R' THEN 'Returned' WHEN o_orderstatus = 'P' THEN 'Cancelled'
              ELSE 'Completed' END AS order_status,
         (l_extendedprice / l_quantity) * l_quantity * (1 - (l_discount * 100) / 100) AS revenue,
         strftime(o_orderdate, '%Y-%m') AS year_month
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS sub_category,
         p_retailprice * (30 + p_partkey % 50) / 100 AS cost_price, p_retailprice AS selling_price
  FROM part
),
customers AS (
  SELECT c_custkey AS customer_id, n_name AS city, c_mktsegment AS acquisition_channel
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
),
facts AS (
  SELECT l.*, p.product_name, p.category, p.sub_category, coalesce(p.cost_price, 0) AS cost_price,
         p.selling_price, coalesce(p.cost_price, 0) * quantity AS cost,
         revenue - coalesce(p.cost_price, 0) * quantity AS profit, revenue::DECIMAL(18,4) AS money
  FROM lines l LEFT JOIN products p USING (product_id)
),
done AS (SELECT * FROM facts WHERE order_status = 'Completed')
"""


def _r2(x: str) -> str:
    return f"round(({x})::DECIMAL(32,6), 2)::DOUBLE"


def _fixed(x: str, places: int) -> str:
    return f"round(({x})::DECIMAL(32,6), {places})::DECIMAL(32,{places})::VARCHAR"


GROWTH = """
bounds AS (SELECT max(order_date) AS hi, min(order_date) AS lo FROM done),
windows AS (
  SELECT any_value(hi) AS hi, any_value(lo) AS lo,
         coalesce(sum(CASE WHEN order_date > hi - INTERVAL 30 DAY THEN money END), 0)::DOUBLE AS last,
         coalesce(sum(CASE WHEN order_date <= hi - INTERVAL 30 DAY AND order_date > hi - INTERVAL 60 DAY
                  THEN money END), 0)::DOUBLE AS prior
  FROM done, bounds
),
growth AS (
  SELECT CASE WHEN floor(epoch(hi - lo) / 86400) >= 60 AND prior > 0
              THEN (last - prior) / prior * 100 END AS growth_pct
  FROM windows
)
"""

PRODUCT_TABLE = f"""
sales AS (
  SELECT product_id, sum(quantity) AS units, sum(money) AS amount, sum(cost::DECIMAL(18,4)) AS cost
  FROM done GROUP BY product_id
),
product_table AS (
  SELECT p.product_id, product_name, category, cost_price, selling_price,
         CASE WHEN selling_price > 0
              THEN {_r2('(selling_price - cost_price) / selling_price * 100')} ELSE 0.0 END AS margin_pct,
         coalesce(units, 0)::BIGINT AS units_sold,
         round(coalesce(amount, 0), 2)::DOUBLE AS revenue,
         round(coalesce(amount - cost, 0), 2)::DOUBLE AS profit
  FROM products p LEFT JOIN sales s USING (product_id)
),
hmlv AS (
  SELECT * FROM product_table
  WHERE margin_pct >= 50 AND units_sold <= (SELECT quantile_cont(units_sold, 0.25) FROM product_table)
)
"""

CHANNEL = f"""
channel AS (
  SELECT acquisition_channel, round(sum(money), 2)::DOUBLE AS revenue,
         count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers,
         {_r2('sum(money)::DOUBLE / count(DISTINCT order_id)')} AS aov
  FROM done LEFT JOIN customers USING (customer_id) GROUP BY acquisition_channel
)
"""

CATEGORY = f"""
category AS (
  SELECT category, round(sum(money), 2)::DOUBLE AS revenue, count(DISTINCT order_id) AS orders,
         sum(quantity) AS units_sold,
         {_r2('sum(money)::DOUBLE / (SELECT sum(money)::DOUBLE FROM done) * 100')} AS revenue_share_pct
  FROM done GROUP BY category
)
"""

RFM = """
per_customer AS (
  SELECT customer_id,
         floor(epoch((SELECT max(order_date) FROM done) - max(order_date)) / 86400)::BIGINT AS recency_days,
         count(DISTINCT order_id) AS frequency, round(sum(money), 2)::DOUBLE AS monetary
  FROM done GROUP BY customer_id
),
ranked AS (
  SELECT *, count(*) OVER () AS n,
         row_number() OVER (ORDER BY recency_days, customer_id) AS rr,
         row_number() OVER (ORDER BY frequency, customer_id) AS rf,
         row_number() OVER (ORDER BY monetary, customer_id) AS rm
  FROM per_customer
),
scored AS (
  SELECT *, (5 - greatest(1, (4 * (rr - 1) + n - 2) // (n - 1)))::INTEGER AS r_score,
         greatest(1, (4 * (rf - 1) + n - 2) // (n - 1))::INTEGER AS f_score,
         greatest(1, (4 * (rm - 1) + n - 2) // (n - 1))::INTEGER AS m_score
  FROM ranked
),
rfm AS (
  SELECT customer_id, recency_days, frequency, monetary, r_score, f_score, m_score,
         (r_score + f_score + m_score)::INTEGER AS rfm_score,
         CASE WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'Champions'
              WHEN f_score >= 3 AND m_score >= 3 THEN 'At Risk'
              WHEN r_score >= 3 AND f_score <= 2 THEN 'New Customers'
              WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Hibernating / Lost'
              ELSE 'Others' END AS segment
  FROM scored
),
churn AS (SELECT * FROM rfm WHERE recency_days > 60 AND (f_score >= 3 OR m_score >= 3))
"""

KPIS = f"""
kpis AS (
  SELECT {_r2('sum(money)::DOUBLE')} AS total_revenue,
         count(DISTINCT order_id) AS total_orders, sum(quantity)::BIGINT AS total_units_sold,
         {_r2('sum(money)::DOUBLE / count(DISTINCT order_id)')} AS average_order_value,
         count(DISTINCT customer_id) AS active_customers,
         (SELECT count(DISTINCT customer_id) FROM customers) AS total_registered_customers,
         (SELECT {_r2('growth_pct')} FROM growth) AS revenue_growth_pct_30d,
         (SELECT count(*) FROM facts WHERE order_status = 'Cancelled') AS cancelled_orders,
         (SELECT count(*) FROM facts WHERE order_status = 'Returned') AS returned_orders
  FROM done
)
"""

MONTHLY = """
monthly AS (
  SELECT year_month AS period, round(sum(money), 2)::DOUBLE AS revenue,
         count(DISTINCT order_id) AS orders, sum(quantity) AS units_sold
  FROM done GROUP BY year_month
)
"""

SPIKES = f"""
category_months AS (
  SELECT category, year_month, sum(money) AS amount FROM done
  WHERE category IS NOT NULL GROUP BY category, year_month
),
peaks AS (
  SELECT *, avg(amount) OVER (PARTITION BY category) AS ignored,
         sum(amount) OVER (PARTITION BY category)::DOUBLE / count(*) OVER (PARTITION BY category) AS mean,
         count(*) OVER (PARTITION BY category) AS months,
         row_number() OVER (PARTITION BY category ORDER BY amount DESC, year_month) AS place
  FROM category_months
),
spikes AS (
  SELECT 'seasonal_category_spike' AS signal_type, category, year_month AS peak_month,
         {_r2('amount::DOUBLE')} AS peak_month_revenue, {_r2('mean')} AS category_avg_monthly_revenue,
         {_r2('amount::DOUBLE / mean')} AS spike_ratio,
         category || ' revenue in ' || year_month || ' was ' || {_fixed('amount::DOUBLE / mean', 1)}
           || 'x its average monthly revenue — a seasonal spike worth planning inventory/marketing around.'
           AS description
  FROM peaks WHERE place = 1 AND months >= 2 AND amount::DOUBLE / mean >= 1.4
)
"""


def _aov(threshold: float, name: str) -> str:
    return f"""
overall AS (SELECT sum(revenue::DECIMAL(28,2))::DOUBLE / sum(orders) AS overall FROM channel),
lifts AS (SELECT *, (aov - overall) / overall * 100 AS lift FROM channel, overall),
{name} AS (
  SELECT 'high_aov_channel' AS signal_type, acquisition_channel AS channel, aov AS channel_aov,
         {_r2('overall')} AS overall_aov, {_r2('lift')} AS lift_pct, customers,
         coalesce(acquisition_channel, 'nan') || ' customers have an AOV of ' || {_fixed('aov', 0)}
           || ' vs the overall ' || {_fixed('overall', 0)} || ' (' || {_fixed('lift', 0)}
           || '% higher) — a candidate channel to scale spend on.' AS description
  FROM lifts WHERE overall > 0 AND lift >= {threshold}
)
"""


SIGNALS = f"""
hmlv_signals AS (
  SELECT 'high_margin_low_volume_product' AS signal_type, product_id, product_name, category,
         margin_pct, units_sold, revenue,
         product_name || ' carries a ' || {_fixed('margin_pct', 0)} || '% margin but sold only '
           || units_sold::VARCHAR || ' unit(s) — a strong candidate for a marketing push '
           || 'or bundling rather than a price cut.' AS description
  FROM (SELECT * FROM hmlv ORDER BY margin_pct DESC, units_sold, product_id LIMIT 10)
),
churn_signals AS (
  SELECT 'churn_risk_high_value_customer' AS signal_type, customer_id, recency_days, frequency,
         monetary, segment,
         'Customer ' || customer_id::VARCHAR || ' generated ' || {_fixed('monetary', 0)}
           || ' in revenue across ' || frequency::VARCHAR || ' order(s) but hasn''t ordered in '
           || recency_days::VARCHAR || ' days — a retention/win-back candidate.' AS description
  FROM (SELECT * FROM churn ORDER BY monetary DESC, customer_id LIMIT 15)
)
"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in (LINES, *parts)) + "\n" + select


COMMERCE = {
    "order_facts": _with(
        select="""SELECT order_id, customer_id, product_id, order_date, quantity,
        round(unit_price::DECIMAL(32,6), 4)::DOUBLE AS unit_price,
        round(discount_pct::DECIMAL(32,6), 4)::DOUBLE AS discount_pct, order_status,
        product_name, category, sub_category, round(cost_price::DECIMAL(32,6), 4)::DOUBLE AS cost_price,
        selling_price, money::DOUBLE AS revenue, cost::DECIMAL(18,4)::DOUBLE AS cost,
        profit::DECIMAL(18,4)::DOUBLE AS profit, year_month FROM facts"""
    ),
    "completed_facts": _with(
        select="""SELECT order_id, product_id, customer_id, order_status, money::DOUBLE AS revenue, year_month
        FROM done"""
    ),
    "executive_kpis": _with(GROWTH, KPIS, select="SELECT * FROM kpis"),
    "revenue_growth_30d": _with(GROWTH, select=f"SELECT {_r2('growth_pct')} AS growth_pct FROM growth"),
    "revenue_by_day": _with(
        select="""SELECT strftime(order_date, '%Y-%m-%d') AS period, round(sum(money), 2)::DOUBLE AS revenue,
        count(DISTINCT order_id) AS orders, sum(quantity) AS units_sold FROM done GROUP BY 1"""
    ),
    "revenue_by_week": _with(
        select="""SELECT strftime(date_trunc('week', order_date), '%Y-%m-%d') || '/'
        || strftime(date_trunc('week', order_date) + INTERVAL 6 DAY, '%Y-%m-%d') AS period,
        round(sum(money), 2)::DOUBLE AS revenue, count(DISTINCT order_id) AS orders,
        sum(quantity) AS units_sold FROM done GROUP BY 1"""
    ),
    "revenue_by_month": _with(MONTHLY, select="SELECT * FROM monthly"),
    "monthly_growth": _with(
        MONTHLY,
        select=f"""SELECT period, revenue, orders,
        {_r2('(revenue - lag(revenue) OVER (ORDER BY period)) / lag(revenue) OVER (ORDER BY period) * 100')}
        AS revenue_growth_pct FROM monthly""",
    ),
    "revenue_by_category": _with(CATEGORY, select="SELECT * FROM category"),
    "revenue_by_channel": _with(CHANNEL, select="SELECT * FROM channel"),
    "product_performance": _with(PRODUCT_TABLE, select="SELECT * FROM product_table"),
    "top_products": _with(
        PRODUCT_TABLE, select="SELECT * FROM product_table ORDER BY revenue DESC, product_id LIMIT 10"
    ),
    "bottom_products": _with(
        PRODUCT_TABLE, select="SELECT * FROM product_table ORDER BY revenue, product_id LIMIT 10"
    ),
    "high_margin_low_volume": _with(PRODUCT_TABLE, select="SELECT * FROM hmlv"),
    "customer_performance": _with(
        select=f"""SELECT customer_id, round(sum(money), 2)::DOUBLE AS revenue,
        count(DISTINCT order_id) AS orders, sum(quantity) AS units_sold,
        {_r2('sum(money)::DOUBLE / count(DISTINCT order_id)')} AS aov,
        min(order_date) AS first_order_date, max(order_date) AS last_order_date
        FROM done GROUP BY customer_id"""
    ),
    "rfm_segmentation": _with(RFM, select="SELECT * FROM rfm"),
    "high_value_customers": _with(
        RFM, select="SELECT * FROM rfm WHERE monetary >= (SELECT quantile_cont(monetary, 0.85) FROM rfm)"
    ),
    "churn_risk_customers": _with(RFM, select="SELECT * FROM churn"),
    "segment_counts": _with(RFM, select="SELECT segment, count(*) AS customers FROM rfm GROUP BY segment"),
    "seasonal_category_spikes": _with(SPIKES, select="SELECT * FROM spikes"),
    "high_aov_channels": _with(CHANNEL, _aov(2, "aov_signals"), select="SELECT * FROM aov_signals"),
    "hmlv_signals": _with(PRODUCT_TABLE, RFM, SIGNALS, select="SELECT * FROM hmlv_signals"),
    "churn_signals": _with(PRODUCT_TABLE, RFM, SIGNALS, select="SELECT * FROM churn_signals"),
    "signal_counts": _with(
        PRODUCT_TABLE, CHANNEL, RFM, SPIKES, _aov(10, "aov_signals"), SIGNALS,
        select="""SELECT 'seasonal_category_spikes' AS detector, count(*) AS signals FROM spikes
        UNION ALL SELECT 'high_aov_channels', count(*) FROM aov_signals
        UNION ALL SELECT 'high_margin_low_volume_products', count(*) FROM hmlv_signals
        UNION ALL SELECT 'churn_risk_customers', count(*) FROM churn_signals""",
    ),
    "growth_signals": _with(
        PRODUCT_TABLE, CHANNEL, RFM, SPIKES, _aov(10, "aov_signals"), SIGNALS,
        select="""SELECT 'seasonal_category_spikes' AS detector, * FROM spikes
        UNION ALL BY NAME SELECT 'high_aov_channels' AS detector, * FROM aov_signals
        UNION ALL BY NAME SELECT 'high_margin_low_volume_products' AS detector, * FROM hmlv_signals
        UNION ALL BY NAME SELECT 'churn_risk_customers' AS detector, * FROM churn_signals""",
    ),
}


RAW = """
raw_customers AS (
  SELECT c_custkey::VARCHAR AS customer_id,
         CASE WHEN c_acctbal < -900 THEN 'not-a-date'
              ELSE strftime(DATE '2020-01-01' + (c_custkey % 1000)::INTEGER, '%Y-%m-%d') END AS signup_date,
         n_name AS city, CASE WHEN c_acctbal < 9800 THEN '25-34' END AS age_group,
         c_mktsegment AS acquisition_channel
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
),
raw_products AS (
  SELECT p_partkey::VARCHAR AS product_id, p_name AS product_name, p_type AS category,
         p_brand AS sub_category,
         CASE WHEN p_size = 50 THEN '-1' ELSE (p_retailprice * 6 / 10)::DECIMAL(18,4)::VARCHAR END AS cost_price,
         CASE WHEN p_size <> 49 THEN p_retailprice::DECIMAL(18,4)::VARCHAR END AS selling_price
  FROM part
),
raw_orders AS (
  SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS order_id, o_custkey::VARCHAR AS customer_id,
         l_partkey::VARCHAR AS product_id,
         CASE WHEN o_orderpriority = '5-LOW' AND l_linenumber = 3 THEN 'not-a-date'
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
         CASE WHEN round(l_tax * 100) = 8 AND l_linenumber = 7 THEN '-' ELSE '' END
           || l_quantity::DECIMAL(18,2)::VARCHAR AS quantity,
         CASE WHEN round(l_tax * 100) = 7 AND l_linenumber = 6 THEN 'free'
              ELSE (l_extendedprice / l_quantity)::DECIMAL(32,8)::VARCHAR END AS unit_price,
         CASE WHEN NOT (round(l_tax * 100) = 6 AND l_linenumber = 1)
              THEN (l_discount * 100)::DECIMAL(18,2)::VARCHAR END AS discount_pct,
         CASE WHEN round(l_tax * 100) = 0 AND l_linenumber = 2 THEN 'Shipped'
              WHEN l_returnflag = 'R' THEN 'Returned' WHEN o_orderstatus = 'P' THEN 'Cancelled'
              ELSE 'Completed' END AS order_status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
ok_customers AS (
  SELECT * FROM raw_customers WHERE try_cast(signup_date AS TIMESTAMP) IS NOT NULL AND age_group IS NOT NULL
),
ok_products AS (
  SELECT * FROM raw_products WHERE cost_price::DOUBLE >= 0 AND selling_price IS NOT NULL
),
checked AS (
  SELECT *, order_date = 'not-a-date' AS bad_date, quantity::DOUBLE < 1 AS low_quantity,
         unit_price = 'free' AS bad_price, discount_pct IS NULL AS no_discount,
         order_status = 'Shipped' AS bad_status,
         customer_id NOT IN (SELECT customer_id FROM ok_customers) AS no_customer,
         product_id NOT IN (SELECT product_id FROM ok_products) AS no_product,
         row_number() OVER (PARTITION BY order_id
           ORDER BY product_id, quantity, unit_price, discount_pct NULLS FIRST, order_status) > 1 AS again
  FROM raw_orders
),
judged AS (
  SELECT *, bad_date OR low_quantity OR bad_price OR no_discount OR bad_status OR no_customer OR no_product
            AS invalid
  FROM checked
),
counts AS (
  SELECT count(*) AS total, count(*) FILTER (invalid) AS invalid, count(*) FILTER (again) AS again,
         count(*) FILTER (NOT invalid AND NOT again) AS clean,
         count(*) FILTER (bad_date) AS bad_date, count(*) FILTER (low_quantity) AS low_quantity,
         count(*) FILTER (bad_price) AS bad_price, count(*) FILTER (no_discount) AS no_discount,
         count(*) FILTER (bad_status) AS bad_status, count(*) FILTER (no_customer) AS no_customer,
         count(*) FILTER (no_product) AS no_product
  FROM judged
)
"""

_ROW_LIMIT = """
  CASE WHEN {clean} = 0 THEN 'No valid rows remained after validation.'
       WHEN {invalid} * 2 > {total}
       THEN 'More than 50% of rows (' || {invalid} || '/' || {total} || ') failed validation.' END
"""


def _warn(flag: str, text: str) -> str:
    return f"CASE WHEN {flag} > 0 THEN '" + text.replace("'", "''").replace("%s", f"' || {flag} || '") + "' END"


def _summary_sql(name: str, source: str, missing: str, warnings: list[str]) -> str:
    error = _ROW_LIMIT.format(clean="clean", invalid="invalid", total="total")
    return f"""SELECT '{name}' AS dataset, ({error}) IS NULL AS is_valid, total AS total_rows,
      invalid AS invalid_rows_dropped, again AS duplicate_rows_dropped, {missing} AS missing_values,
      coalesce({error}, '') AS errors, concat_ws('; ', {', '.join(warnings)}) AS warnings
      FROM {source}"""


_SUMMARY = [
    """customer_counts AS (
      SELECT count(*) AS total, 0::BIGINT AS again,
             count(*) FILTER (signup_date = 'not-a-date') AS bad_date,
             count(*) FILTER (age_group IS NULL) AS no_age,
             count(*) FILTER (signup_date = 'not-a-date' OR age_group IS NULL) AS invalid,
             count(*) FILTER (NOT (signup_date = 'not-a-date' OR age_group IS NULL)) AS clean
      FROM raw_customers)""",
    """product_counts AS (
      SELECT count(*) AS total, 0::BIGINT AS again,
             count(*) FILTER (cost_price = '-1') AS low_cost,
             count(*) FILTER (selling_price IS NULL) AS no_price,
             count(*) FILTER (cost_price = '-1' OR selling_price IS NULL) AS invalid,
             count(*) FILTER (NOT (cost_price = '-1' OR selling_price IS NULL)) AS clean
      FROM raw_products)""",
]


def _validation_summary(extra_column: str) -> str:
    missing = "CASE WHEN {0} > 0 THEN '{1}=' || {0} ELSE '' END"
    return (
        "WITH " + RAW.strip() + ",\n" + ",\n".join(_SUMMARY) + "\n"
        + _summary_sql(
            "customers", "customer_counts", missing.format("no_age", "age_group"),
            [
                f"'Ignoring unexpected extra columns: [''{extra_column}'']'",
                _warn("bad_date", "Column 'signup_date': %s value(s) could not be parsed as date "
                      "and were flagged invalid."),
                _warn("no_age", "Column 'age_group' has %s missing value(s)."),
            ],
        )
        + "\nUNION ALL\n"
        + _summary_sql(
            "products", "product_counts", missing.format("no_price", "selling_price"),
            [
                _warn("low_cost", "Column 'cost_price': %s value(s) below minimum allowed value (0)."),
                _warn("no_price", "Column 'selling_price' has %s missing value(s)."),
            ],
        )
        + "\nUNION ALL\n"
        + _summary_sql(
            "orders", "counts", missing.format("no_discount", "discount_pct"),
            [
                _warn("bad_date", "Column 'order_date': %s value(s) could not be parsed as date "
                      "and were flagged invalid."),
                _warn("low_quantity", "Column 'quantity': %s value(s) below minimum allowed value (1)."),
                _warn("bad_price", "Column 'unit_price': %s value(s) could not be parsed as float "
                      "and were flagged invalid."),
                _warn("no_discount", "Column 'discount_pct' has %s missing value(s)."),
                _warn("bad_status", "Column 'order_status': %s value(s) outside allowed set "
                      "('Completed', 'Cancelled', 'Returned')."),
                _warn("again", "%s duplicate 'order_id' value(s) found; keeping first occurrence only."),
                _warn("no_customer", "Column 'customer_id': %s value(s) do not match any 'customer_id' "
                      "in customers."),
                _warn("no_product", "Column 'product_id': %s value(s) do not match any 'product_id' "
                      "in products."),
            ],
        )
    )


def _raw_with(select: str) -> str:
    return "WITH " + RAW.strip() + "\n" + select


def _problem(flag: str, text: str) -> str:
    return f"CASE WHEN {flag} THEN '{text}' END"


_DATED = """
dated AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_linenumber = 7 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(l_shipdate, '%d/%m/%Y') END AS day_first,
         CASE WHEN l_linenumber = 6 THEN '31-31-2024' ELSE strftime(l_shipdate, '%-m-%-d-%Y') END AS month_first,
         CASE WHEN day(l_shipdate) <= 12 THEN strftime(l_shipdate, '%-d.%-m.%Y') END AS either
  FROM lineitem
),
texts AS (
  SELECT l_linenumber, name, translate(value, '.-', '//') AS value
  FROM (UNPIVOT dated ON day_first, month_first, either INTO NAME name VALUE value) WHERE NOT regexp_matches(value, '^[0-9]{4}-')
)
"""


def _date_votes(group: str) -> str:
    groups, on = ("name", "name") if not group else (f"{group}, name", f"{group}, name")
    return "WITH " + _DATED.strip() + f""",
every AS (SELECT DISTINCT {groups} FROM (SELECT l_linenumber, unnest(['day_first', 'month_first', 'either']) AS name FROM dated)),
counted AS (
  SELECT {groups}, count(try_strptime(value, '%m/%d/%Y')) AS month_first, count(try_strptime(value, '%d/%m/%Y')) AS day_first,
         count(*) FILTER (try_strptime(value, '%m/%d/%Y') <> try_strptime(value, '%d/%m/%Y')) AS differ
  FROM texts GROUP BY {groups}
)
SELECT {groups}, coalesce(month_first, 0) AS month_first, coalesce(day_first, 0) AS day_first, coalesce(differ, 0) AS differ,
       CASE WHEN day_first > month_first THEN 'day first' ELSE 'month first' END AS taken,
       coalesce(month_first = day_first AND differ > 0, false) AS undecided
FROM every LEFT JOIN counted USING ({on})"""


def _day_first_summary() -> str:
    missing = "CASE WHEN {0} > 0 THEN '{1}=' || {0} ELSE '' END"
    return (
        "WITH " + RAW.strip() + ",\n" + ",\n".join(_SUMMARY) + "\n"
        + _summary_sql(
            "customers", "customer_counts", missing.format("no_age", "age_group"),
            [
                "'Ignoring unexpected extra columns: [''remark'']'",
                _warn("bad_date", "Column 'signup_date': %s value(s) could not be parsed as date "
                      "and were flagged invalid."),
                _warn("no_age", "Column 'age_group' has %s missing value(s)."),
            ],
        )
        + "\nUNION ALL\n"
        + _summary_sql(
            "products", "product_counts", missing.format("no_price", "selling_price"),
            [
                _warn("low_cost", "Column 'cost_price': %s value(s) below minimum allowed value (0)."),
                _warn("no_price", "Column 'selling_price' has %s missing value(s)."),
                _warn("total", "Column 'launch_date': %s date(s) could have day or month first; the month was assumed."),
            ],
        )
    )


VALIDATION = {
    "date_orders": _date_votes(""),
    "date_orders_by_line": _date_votes("l_linenumber"),
    "read_dates": """
SELECT l_orderkey, l_linenumber, l_shipdate::TIMESTAMP AS day_first,
       CASE WHEN l_linenumber <> 6 THEN l_shipdate::TIMESTAMP END AS month_first,
       CASE WHEN day(l_shipdate) <= 12 THEN make_timestamp(year(l_shipdate), day(l_shipdate), month(l_shipdate), 0, 0, 0) END AS either
FROM lineitem""",
    "validate_day_first": _day_first_summary(),
    "clean_day_first": _raw_with("""SELECT customer_id, signup_date::TIMESTAMP AS signup_date, city, age_group, acquisition_channel
        FROM raw_customers WHERE age_group IS NOT NULL AND signup_date <> 'not-a-date'"""),
    "validate_formats": """
SELECT l_orderkey || '-' || l_linenumber AS order_id, l_shipdate::TIMESTAMP AS order_date,
       CASE WHEN round(l_tax * 100) NOT IN (7, 8) THEN 12.5::DOUBLE END AS unit_price,
       round(l_tax * 100) IN (7, 8) AS is_invalid
FROM lineitem""",
    "required_columns": """
SELECT 'customers' AS dataset, false AS is_valid, count(*) AS total_rows, 0::BIGINT AS invalid_rows_dropped,
       0::BIGINT AS duplicate_rows_dropped, '' AS missing_values,
       'Missing required columns: [''signup_date'', ''city'', ''age_group'']' AS errors, '' AS warnings
FROM customer""",
    "validate_keeping_invalid": _raw_with(
        """SELECT count(*) AS total_rows,
        count(*) FILTER (signup_date = 'not-a-date' OR age_group IS NULL) AS invalid_rows,
        0::BIGINT AS duplicate_rows, count(*) AS clean_rows, count(*) AS kept_rows FROM raw_customers"""
    ),
    "missing_value_profile": _raw_with(
        "SELECT 'discount_pct' AS \"column\", no_discount AS missing FROM counts WHERE no_discount > 0"
    ),
    "coerce_columns": _raw_with(
        """SELECT order_id, customer_id, product_id, try_cast(order_date AS TIMESTAMP) AS order_date,
        quantity::DOUBLE AS quantity, try_cast(unit_price AS DOUBLE) AS unit_price,
        discount_pct::DOUBLE AS discount_pct, order_status,
        concat_ws(';', CASE WHEN bad_date THEN 'order_date' END, CASE WHEN bad_price THEN 'unit_price' END)
          AS unreadable FROM checked"""
    ),
    "rule_counts": _raw_with(
        """SELECT rule, "rows" FROM (
          SELECT 'unreadable_order_date' AS rule, bad_date AS "rows" FROM counts
          UNION ALL SELECT 'below_quantity', low_quantity FROM counts
          UNION ALL SELECT 'unreadable_unit_price', bad_price FROM counts
          UNION ALL SELECT 'missing_discount_pct', no_discount FROM counts
          UNION ALL SELECT 'outside_order_status', bad_status FROM counts
          UNION ALL SELECT 'orphan_customer_id', no_customer FROM counts
          UNION ALL SELECT 'orphan_product_id', no_product FROM counts) WHERE "rows" > 0"""
    ),
    "validation_summary": _validation_summary("remark"),
    "csv_round_trip": _validation_summary("remark"),
    "dataset_row_counts": _raw_with(
        """SELECT 'customers' AS dataset, count(*) AS "rows",
          (SELECT count(*) FROM raw_customers) >= 2 * ((SELECT count(*) FROM raw_customers) - count(*)) AS is_valid
          FROM ok_customers
        UNION ALL SELECT 'products', count(*),
          (SELECT count(*) FROM raw_products) >= 2 * ((SELECT count(*) FROM raw_products) - count(*))
          FROM ok_products
        UNION ALL SELECT 'orders', clean, clean > 0 AND total >= 2 * invalid FROM counts"""
    ),
    "clean_orders": _raw_with(
        """SELECT order_id, customer_id, product_id, order_date::TIMESTAMP AS order_date,
        quantity::DOUBLE AS quantity, unit_price::DOUBLE AS unit_price, discount_pct::DOUBLE AS discount_pct,
        order_status FROM judged WHERE NOT invalid AND NOT again"""
    ),
    "quarantine": _raw_with(
        f"""SELECT order_id, customer_id, product_id, concat_ws(';',
          {_problem('no_customer', 'customer_id unknown')}, {_problem('no_discount', 'discount_pct missing')},
          {_problem('bad_date', 'order_date unreadable')}, {_problem('again', 'order_id duplicate')},
          {_problem('bad_status', 'order_status not allowed')}, {_problem('no_product', 'product_id unknown')},
          {_problem('low_quantity', 'quantity below minimum')}, {_problem('bad_price', 'unit_price unreadable')}
        ) AS problems FROM judged WHERE invalid OR again"""
    ),
    "duplicate_key_check": _raw_with(
        """SELECT order_id, product_id, quantity, unit_price, discount_pct, order_status, again AS is_duplicate
        FROM checked"""
    ),
    "foreign_key_check": _raw_with("SELECT order_id, customer_id, product_id FROM checked WHERE no_customer"),
}


# --- bundle ---------------------------------------------------------------------------------

_EVERYTHING = (GROWTH, KPIS, MONTHLY, CATEGORY, CHANNEL, PRODUCT_TABLE, RFM, SPIKES, _aov(10, "aov_signals"), SIGNALS)

_RESULTS = {
    "executive_kpis": ("kpis", "total_revenue"),
    "revenue_by_month": ("monthly", "revenue"),
    "revenue_by_day": (
        "(SELECT date_trunc('day', order_date) AS d, round(sum(money), 2) AS revenue FROM done GROUP BY 1)",
        "revenue",
    ),
    "monthly_growth": ("monthly", "revenue"),
    "revenue_by_category": ("category", "revenue"),
    "revenue_by_channel": ("channel", "revenue"),
    "product_table": ("product_table", "revenue"),
    "top_products": ("(SELECT * FROM product_table ORDER BY revenue DESC, product_id LIMIT 10)", "revenue"),
    "bottom_products": ("(SELECT * FROM product_table ORDER BY revenue, product_id LIMIT 10)", "revenue"),
    "high_margin_low_volume_products": ("hmlv", "revenue"),
    "customer_table": (
        "(SELECT customer_id, round(sum(money), 2) AS revenue FROM done GROUP BY customer_id)",
        "revenue",
    ),
    "rfm_table": ("rfm", "monetary"),
    "high_value_customers": (
        "(SELECT * FROM rfm WHERE monetary >= (SELECT quantile_cont(monetary, 0.85) FROM rfm))",
        "monetary",
    ),
    "churn_risk_customers": ("churn", "monetary"),
    "segment_counts": ("(SELECT segment FROM rfm GROUP BY segment)", None),
    "growth_signals": (
        """(SELECT NULL::DOUBLE AS revenue FROM spikes UNION ALL SELECT NULL FROM aov_signals
            UNION ALL SELECT revenue FROM hmlv_signals UNION ALL SELECT NULL FROM churn_signals)""",
        "revenue",
    ),
    "signals:seasonal_category_spikes": ("spikes", None),
    "signals:high_aov_channels": ("aov_signals", None),
    "signals:high_margin_low_volume_products": ("hmlv_signals", "revenue"),
    "signals:churn_risk_customers": ("churn_signals", "monetary"),
}


def _pair(name: str, kind: str) -> str:
    if kind == "money":
        value = f"coalesce(round(({name})::DECIMAL(32,6), 2)::DECIMAL(32,2)::VARCHAR, 'null')"
    elif kind == "int":
        value = f"coalesce({name}::VARCHAR, 'null')"
    else:
        value = f"coalesce(to_json({name})::VARCHAR, 'null')"
    return f"""'"{name}":' || {value}"""


def _context(section: str, source: str, order: str, fields: dict[str, str], n: int | None = None) -> str:
    payload = " || ',' || ".join(_pair(name, kind) for name, kind in fields.items())
    limit = f"ORDER BY {order} LIMIT {n}" if n else ""
    return f"""SELECT '{section}' AS section, (row_number() OVER (ORDER BY {order}))::INTEGER AS rank,
      '{{' || {payload} || '}}' AS payload FROM (SELECT * FROM {source} {limit})"""


_PRODUCT = {"product_id": "int", "product_name": "text", "category": "text", "revenue": "money",
            "units_sold": "int", "margin_pct": "money"}

_TOTALS = "\nUNION ALL ".join(
    f"""SELECT '{name}' AS result, count(*) AS "rows",
    {f'sum({amount}::DECIMAL(28,2))::DOUBLE' if amount else 'NULL::DOUBLE'} AS amount FROM {source}"""
    for name, (source, amount) in _RESULTS.items()
)

#: The tables of LINES as validation leaves them.
VALIDATED = """
lines AS (
  SELECT order_id, customer_id, product_id, order_date::TIMESTAMP AS order_date, quantity::DOUBLE AS quantity,
         unit_price::DOUBLE AS unit_price, discount_pct::DOUBLE AS discount_pct, order_status,
         unit_price::DOUBLE * quantity::DOUBLE * (1 - discount_pct::DOUBLE / 100) AS revenue,
         strftime(order_date::TIMESTAMP, '%Y-%m') AS year_month
  FROM judged WHERE NOT invalid AND NOT again
),
products AS (
  SELECT product_id, product_name, category, sub_category, cost_price::DOUBLE AS cost_price,
         selling_price::DOUBLE AS selling_price FROM ok_products
),
customers AS (SELECT customer_id, city, acquisition_channel FROM ok_customers),
""" + LINES[LINES.index("facts AS (") :]

def _actives(period: str) -> str:
    return _with(
        select=f"""SELECT {period} AS period, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers
        FROM lines WHERE order_status = 'Completed' GROUP BY 1"""
    )


#: Results merged from stored days are the results over all lines.
_DAYS = {
    "days_kpis": "executive_kpis",
    "days_revenue_by_month": "revenue_by_month",
    "days_revenue_by_day": "revenue_by_day",
    "days_monthly_growth": "monthly_growth",
    "days_revenue_by_category": "revenue_by_category",
    "days_revenue_by_channel": "revenue_by_channel",
    "days_product_table": "product_performance",
    "days_top_products": "top_products",
    "days_bottom_products": "bottom_products",
    "days_high_margin_low_volume": "high_margin_low_volume",
    "days_customer_table": "customer_performance",
    "days_rfm_table": "rfm_segmentation",
    "days_high_value_customers": "high_value_customers",
    "days_churn_risk_customers": "churn_risk_customers",
    "days_segment_counts": "segment_counts",
    "days_growth_signals": "growth_signals",
}

BUNDLE = {
    **{name: COMMERCE[same] for name, same in _DAYS.items()},
    "weekly_actives": _actives("date_trunc('week', order_date)::DATE::VARCHAR"),
    "monthly_actives": _actives("strftime(order_date, '%Y-%m')"),
    "actives_so_far": _actives("'all'"),
    "full_analysis": _with(*_EVERYTHING, select=_TOTALS),
    "validated_analysis": "WITH " + ",\n".join(p.strip() for p in (RAW, VALIDATED, *_EVERYTHING)) + "\n" + _TOTALS,
    "business_context": _with(
        *_EVERYTHING,
        select="\nUNION ALL ".join(
            [
                _context("executive_kpis", "kpis", "1", {
                    "total_revenue": "money", "total_orders": "int", "total_units_sold": "int",
                    "average_order_value": "money", "active_customers": "int",
                    "total_registered_customers": "int", "revenue_growth_pct_30d": "money",
                    "cancelled_orders": "int", "returned_orders": "int"}),
                _context("top_categories_by_revenue", "category", "revenue DESC, category", {
                    "category": "text", "revenue": "money", "orders": "int", "units_sold": "money",
                    "revenue_share_pct": "money"}, 5),
                _context("channel_performance", "channel", "aov DESC, acquisition_channel", {
                    "acquisition_channel": "text", "revenue": "money", "orders": "int", "customers": "int",
                    "aov": "money"}),
                _context("top_products_by_revenue", "product_table", "revenue DESC, product_id", _PRODUCT, 5),
                _context("bottom_products_by_revenue", "product_table", "revenue, product_id", _PRODUCT, 5),
                _context(
                    "customer_segment_counts",
                    "(SELECT segment, count(*) AS customers FROM rfm GROUP BY segment)",
                    "customers DESC, segment", {"segment": "text", "customers": "int"}),
                _context("growth_signals.seasonal_category_spikes", "spikes", "spike_ratio DESC, category", {
                    "signal_type": "text", "category": "text", "peak_month": "text",
                    "peak_month_revenue": "money", "category_avg_monthly_revenue": "money",
                    "spike_ratio": "money", "description": "text"}),
                _context("growth_signals.high_aov_channels", "aov_signals", "lift_pct DESC, channel", {
                    "signal_type": "text", "channel": "text", "channel_aov": "money", "overall_aov": "money",
                    "lift_pct": "money", "customers": "int", "description": "text"}),
                _context(
                    "growth_signals.high_margin_low_volume_products", "hmlv_signals",
                    "margin_pct DESC, units_sold, product_id",
                    {"signal_type": "text", "product_id": "int", "product_name": "text", "category": "text",
                     "margin_pct": "money", "units_sold": "int", "revenue": "money", "description": "text"}),
                _context("growth_signals.churn_risk_customers", "churn_signals", "monetary DESC, customer_id", {
                    "signal_type": "text", "customer_id": "int", "recency_days": "int", "frequency": "int",
                    "monetary": "money", "segment": "text", "description": "text"}),
            ]
        ),
    ),
}


# --- corpus ---------------------------------------------------------------------------------


def _strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


MARKDOWN = f"""
docs AS (
  SELECT 'doc_' || doc_id::VARCHAR AS source,
         'Note ' || doc_id::VARCHAR || E'\\n\\n## ' || source || E'\\n\\n' || replace(text, E'\\n', E'\\n\\n')
           || E'\\n\\n## Language\\n\\n' || lang AS text
  FROM documents
),
blanked AS (
  SELECT 'doc_' || doc_id::VARCHAR AS source, CASE WHEN n_chars < 100 THEN E' \\n ' ELSE text END AS text
  FROM documents
),
expected AS (
  SELECT 'doc_' || doc_id::VARCHAR AS source FROM labels
  UNION SELECT 'item_' || item_id::VARCHAR FROM benchmark
),
manifest AS (
  SELECT source, CASE WHEN text IS NULL THEN 'missing' WHEN {_strip('text')} = '' THEN 'empty'
                      ELSE 'present' END AS status
  FROM expected LEFT JOIN blanked USING (source)
)
"""


def _sections(name: str, documents: str) -> str:
    return f"""
{name}_split AS (
  SELECT source, list_filter(list_transform(
      list_transform(string_split(text, E'\\n## '), lambda part, i: CASE WHEN i = 1 THEN part ELSE '## ' || part END),
      lambda part: {_strip('part')}), lambda part: part <> '') AS sections
  FROM {documents}
),
{name} AS (
  SELECT source, unnest(sections) AS text, generate_subscripts(sections, 1) - 1 AS section_index FROM {name}_split
)
"""


def _chunks(name: str, sections: str, size: int, overlap: int) -> str:
    """Paragraphs are packed by a fold over the list; every element is a state {done, buffer}."""
    both = _strip("a.buffer || E'\\n\\n' || x.buffer")
    joined = f"CASE WHEN a.buffer = '' THEN x.buffer ELSE {both} END"
    hard = (
        f"list_transform(range(0, length(x.buffer), {size - overlap}), "
        f"lambda i: substring(x.buffer, i + 1, {size}))"
    )
    reopened = _strip(f"right(a.buffer, {overlap}) || E'\\n\\n' || x.buffer")
    return f"""
{name}_packed AS (
  SELECT source, section_index, text, list_reduce(
    list_transform(list_filter(list_transform(string_split(text, E'\\n\\n'), lambda p: {_strip('p')}),
      lambda p: p <> ''), lambda p: {{'done': []::VARCHAR[], 'buffer': p}}),
    lambda a, x: CASE
      WHEN length({joined}) <= {size} THEN {{'done': a.done, 'buffer': {joined}}}
      WHEN a.buffer = '' THEN {{'done': a.done || {hard}, 'buffer': ''}}
      ELSE {{'done': a.done || [a.buffer], 'buffer': {reopened}}} END,
    {{'done': []::VARCHAR[], 'buffer': ''}}) AS state
  FROM {sections}
),
{name}_lists AS (
  SELECT source, flatten(list(CASE WHEN length(text) <= {size} THEN [text]
           WHEN state.buffer <> '' THEN state.done || [state.buffer] ELSE state.done END
           ORDER BY section_index)) AS chunks
  FROM {name}_packed GROUP BY source
),
{name} AS (
  SELECT source || '::chunk_' || (i - 1)::VARCHAR AS id, source, (i - 1)::INTEGER AS chunk_index, text
  FROM (SELECT source, unnest(chunks) AS text, generate_subscripts(chunks, 1) AS i FROM {name}_lists)
)
"""


def _corpus(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in (MARKDOWN, *parts)) + "\n" + select


def _nearest(k: int, where: str = "TRUE") -> str:
    return f"""
components AS (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings
),
topics AS (
  SELECT label, list(x ORDER BY pos) AS query FROM
    (SELECT label, pos, avg(x) AS x FROM components GROUP BY label, pos) GROUP BY label
),
scored AS (
  SELECT topics.label, vec_id AS id, source, round(1 - list_dot_product(embedding::DOUBLE[], query)
    / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(query, query))),
    9) AS distance
  FROM embeddings LEFT JOIN documents ON vec_id = doc_id, topics WHERE {where}
),
hits AS (
  SELECT 'label_' || label::VARCHAR AS query_id, label, id, distance,
         row_number() OVER (PARTITION BY label ORDER BY distance, id) AS rank
  FROM scored QUALIFY rank <= {k}
),
shown AS (
  SELECT query_id, rank::INTEGER AS rank, id, round(distance::DECIMAL(20,9), 6)::DOUBLE AS distance,
    round(greatest(0.0, least(1.0, 1 - distance / 2))::DECIMAL(20,12), 4)::DOUBLE AS relevance_score FROM hits
),
topic_chunks AS (
  SELECT query_id AS topic, label AS topic_order, rank::INTEGER AS rank, source, doc_id::INTEGER AS chunk_index, text,
    round(greatest(0.0, least(1.0, 1 - distance / 2))::DECIMAL(20,12), 4)::DOUBLE AS relevance_score
  FROM hits JOIN documents ON id = doc_id
  QUALIFY row_number() OVER (PARTITION BY source, doc_id ORDER BY label, rank) = 1
)
"""


def _vectors(k: int, select: str, where: str = "TRUE") -> str:
    return "WITH " + _nearest(k, where).strip() + "\n" + select


CORPUS = {
    "document_manifest": _corpus(select="SELECT source, status FROM manifest"),
    "document_sections": _corpus(
        _sections("sections", "docs"),
        select="SELECT source, section_index::INTEGER AS section_index, text FROM sections",
    ),
    "document_chunks": _corpus(
        _sections("sections", "docs"), _chunks("chunks", "sections", 900, 150), select="SELECT * FROM chunks"
    ),
    "corpus_stats": _corpus(
        _sections("sections", "docs"), _chunks("chunks", "sections", 900, 150),
        select='SELECT TRUE AS "exists", count(*) AS chunk_count FROM chunks',
    ),
    "upsert_chunks": _corpus(
        _sections("sections", "docs"), _chunks("old", "sections", 900, 150),
        _chunks("new", "sections", 1500, 150),
        select="SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new",
    ),
    "stored_chunks": _corpus(
        _sections("sections", "docs"), _chunks("old", "sections", 900, 150),
        "renewed AS (SELECT * FROM sections WHERE source IN (SELECT source FROM docs WHERE contains(text, E'\\n## src7\\n')))",
        _chunks("new", "renewed", 1500, 150),
        select="SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new",
    ),
    "stored_chunks_reset": _corpus(
        _sections("sections", "docs"), _chunks("old", "sections", 900, 150),
        "renewed AS (SELECT * FROM sections WHERE source IN (SELECT source FROM docs WHERE contains(text, E'\\n## src7\\n')))",
        _chunks("new", "renewed", 1500, 150),
        """upserted AS (SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new),
        few AS (SELECT * FROM old WHERE source IN (SELECT source FROM renewed))""",
        select="\nUNION ALL ".join(
            f"SELECT {v} AS version, count(*) AS chunks, sum(length(text))::BIGINT AS characters FROM {name}"
            for v, name in enumerate(("old", "upserted", "few"), 1)
        ),
    ),
    "ingest_summary": _corpus(
        """present AS (SELECT source, text FROM blanked
           WHERE source IN (SELECT source FROM manifest WHERE status = 'present'))""",
        _sections("sections", "present"), _chunks("chunks", "sections", 900, 150),
        select="""SELECT count(*) FILTER (status = 'present') > 0 AND (SELECT count(*) FROM chunks) > 0 AS is_success,
        count(*) FILTER (status = 'present') AS documents_loaded,
        count(*) FILTER (status = 'missing') AS documents_missing,
        count(*) FILTER (status = 'empty') AS documents_empty,
        (SELECT count(*) FROM chunks) AS chunks_created,
        (SELECT count(*) FROM chunks) AS chunks_upserted FROM manifest""",
    ),
    "ingest_snapshot": _corpus(
        "present AS (SELECT source, text FROM blanked WHERE source IN (SELECT source FROM expected))",
        _sections("sections", "docs"), _chunks("old", "sections", 900, 150),
        _sections("wanted", "present"), _chunks("new", "wanted", 900, 150),
        select="SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new",
    ),
    "vector_top_k": _vectors(4, "SELECT * FROM shown"),
    "vector_neighbours": """
WITH unit AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, u.vec_id AS id, round(1 - list_dot_product(u.v, q.v) / (u.norm * q.norm), 9) AS distance
  FROM unit u, unit q WHERE q.vec_id % 100 = 0
),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM scored QUALIFY rank <= 5)
SELECT query_id, rank::INTEGER AS rank, id, round(distance::DECIMAL(20,9), 6)::DOUBLE AS distance,
  round(greatest(0.0, least(1.0, 1 - distance / 2))::DECIMAL(20,12), 4)::DOUBLE AS relevance_score FROM hits""",
    "vector_top_k_of_source": _vectors(4, "SELECT * FROM shown", "source = 'src7'"),
    "retrieve_chunks": _vectors(
        4,
        """SELECT query_id, rank, source, doc_id::INTEGER AS chunk_index, text, relevance_score
        FROM shown JOIN documents ON id = doc_id""",
    ),
    "multi_topic_retrieval": _vectors(3, "SELECT * FROM topic_chunks"),
    "sources_used": _vectors(
        3, "SELECT array_to_string(list_sort(list(DISTINCT source)), ';') AS sources_used FROM topic_chunks"
    ),
}


# --- reports --------------------------------------------------------------------------------

REPORTS_CTE = """
made AS (
  SELECT doc_id AS report_id, source, lang, text, n_chars,
    source = 'src3' AS broken, source = 'src9' AS listed,
    CASE WHEN source = 'src3' THEN CASE WHEN contains(text, '}')
           THEN 'the response could not be parsed as JSON'
           ELSE 'the response did not contain a JSON object' END END AS parse_error,
    CASE WHEN source = 'src9' THEN 'the JSON response was not an object at the top level (got list)' END
      AS shape_error
  FROM documents
),
audited AS (
  SELECT *, NOT broken AND NOT listed AS usable,
    CASE WHEN source = 'src6' THEN '  ' ELSE text END AS summary,
    CASE WHEN source = 'src5' THEN [lang || '_policy'] ELSE list_sort(list_distinct([lang || '_policy', source])) END
      AS cited,
    CASE WHEN source = 'src5' THEN ['revenue_opportunities']
         ELSE ['revenue_opportunities', 'customer_growth_opportunities'] END AS cited_in
  FROM made
),
judged AS (
  SELECT *, list_filter(cited, lambda c: c NOT IN ('en_policy', 'de_policy', 'src10')) AS unknown,
         usable AND {blank} <> '' AS ok
  FROM audited
)
""".replace("{blank}", _strip("summary"))

_WARNINGS = """concat_ws('; ',
  CASE WHEN source = 'src6' THEN 'Missing or empty ''executive_summary'' in model output.' END,
  CASE WHEN source = 'src4' THEN
    'Section ''revenue_opportunities'' was a single object, not a list — wrapped automatically.' END,
  CASE WHEN source = 'src5' THEN
    'Section ''customer_growth_opportunities'' had an unexpected type (str) — defaulted to an empty list.' END,
  CASE WHEN source = 'src7' THEN
    'Missing section ''product_opportunities'' in model output — defaulted to an empty list.' END,
  CASE WHEN source = 'src8' THEN
    'Model output included unexpected extra key(s), ignored: [''author'', ''notes'']' END)"""

_SECTION_NAMES = ("executive_summary", "revenue_opportunities", "customer_growth_opportunities",
                  "product_opportunities", "risks", "recommended_actions")


def _reports(select: str) -> str:
    return "WITH " + REPORTS_CTE.strip() + "\n" + select


REPORTS = {
    "parse_reports": _reports(
        """SELECT report_id, CASE WHEN usable THEN summary END AS executive_summary, parse_error AS error
        FROM judged"""
    ),
    "rejected_reports": _reports("SELECT report_id, parse_error AS error FROM judged WHERE broken"),
    "normalize_reports": _reports(
        f"""SELECT report_id, CASE WHEN usable THEN summary END AS executive_summary,
        CASE WHEN usable THEN CASE WHEN source = 'src4' THEN 1 ELSE 2 END END::BIGINT AS revenue_opportunities,
        CASE WHEN usable THEN CASE WHEN source = 'src5' THEN 0 ELSE 1 END END::BIGINT
          AS customer_growth_opportunities,
        CASE WHEN usable THEN 0 END::BIGINT AS product_opportunities,
        CASE WHEN usable THEN 1 END::BIGINT AS risks, CASE WHEN usable THEN 1 END::BIGINT AS recommended_actions,
        CASE WHEN usable THEN {_WARNINGS} END AS warnings, coalesce(parse_error, shape_error) AS error FROM judged"""
    ),
    "section_presence": _reports(
        "SELECT report_id, usable AS all_sections_present, "
        + ", ".join(f"usable AS has_{name}" for name in _SECTION_NAMES)
        + " FROM judged"
    ),
    "citation_audit": _reports(
        """SELECT report_id, CASE WHEN NOT usable THEN 0 WHEN source = 'src5' THEN 1 ELSE 2 END::BIGINT
          AS total_citations,
        CASE WHEN usable THEN array_to_string(cited, '; ') ELSE '' END AS cited_sources,
        CASE WHEN usable THEN array_to_string(cited_in, '; ') ELSE '' END AS sections_with_citations,
        CASE WHEN usable THEN array_to_string(unknown, '; ') ELSE '' END AS unrecognized_citations FROM judged"""
    ),
    "report_verdict": _reports(
        """SELECT report_id, ok AS is_valid,
        CASE WHEN NOT ok THEN 'error' WHEN len(unknown) = 0 THEN 'success' ELSE 'warning' END AS status,
        concat_ws('; ',
          CASE WHEN NOT usable THEN 'Validator: missing required section(s) in strategy report: '
            || '[''executive_summary'', ''revenue_opportunities'', ''customer_growth_opportunities'', '
            || '''product_opportunities'', ''risks'', ''recommended_actions'']' END,
          CASE WHEN NOT usable THEN 'Validator: no policy citations found anywhere in the strategy report — '
            || 'recommendations may not be grounded in company policy.' END,
          CASE WHEN usable AND len(unknown) > 0 THEN 'Validator: strategy report cites policy source(s) not among '
            || 'the chunks retrieved this run (possible hallucinated citation): ['''
            || array_to_string(unknown, ''', ''') || ''']' END,
          CASE WHEN NOT ok THEN 'Validator: strategy report is empty or missing an executive summary — '
            || 'treating as invalid.' END) AS audit_warnings FROM judged"""
    ),
    "map_actions": _reports(
        """SELECT report_id, (row_number() OVER (PARTITION BY report_id ORDER BY place) - 1)::INTEGER AS position,
        source_section, title, reason, supporting_metric, estimated_impact, policy_reference,
        499 AS amount_inr, substring('Growth action — ' || title, 1, 2048) AS description
        FROM (
          SELECT report_id, 1 AS place, 'revenue_opportunities' AS source_section, 'Push ' || source AS title,
                 text AS reason, CASE WHEN n_chars = 0 THEN '' ELSE n_chars::VARCHAR END AS supporting_metric,
                 NULL::VARCHAR AS estimated_impact, lang || '_policy' AS policy_reference
          FROM judged WHERE usable
          UNION ALL
          SELECT report_id, 2, 'customer_growth_opportunities', 'Call ' || lang, '', '', NULL, source
          FROM judged WHERE usable AND source <> 'src5'
          UNION ALL
          SELECT report_id, 3, 'recommended_actions', 'Review ' || source, text, '', NULL, ''
          FROM judged WHERE usable)"""
    ),
}


# --- action log -----------------------------------------------------------------------------

LOG = """
log AS (
  SELECT user_id::VARCHAR AS reference_id, 'Offer ' || event_type AS recommendation, props AS reason,
         event_type <> 'error' AS merchant_approved, 499 AS amount_inr,
         CASE WHEN event_type = 'purchase' THEN 'link_' || event_id::VARCHAR END AS payment_link_id,
         event_type AS result,
         CASE WHEN event_id % 2 = 1 THEN strftime(ts + INTERVAL '5 hours 30 minutes', '%Y-%m-%dT%H:%M:%S.%f') || '+05:30'
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS "timestamp", event_id
  FROM events
),
updates AS (
  SELECT c_custkey::VARCHAR AS reference_id, CASE WHEN c_acctbal >= 0 THEN 'paid' END AS result,
         'link_of_' || c_name AS payment_link_id, '2024-06-01T00:00:00+00:00' AS status_checked_at,
         'card' AS payment_method
  FROM customer
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY reference_id ORDER BY "timestamp"::TIMESTAMPTZ DESC, event_id DESC) AS place FROM log
)
"""


def _log(select: str) -> str:
    return "WITH " + LOG.strip() + "\n" + select


_VIEW = '"timestamp", recommendation, reason, merchant_approved, amount_inr, payment_link_id, result'

_STORED = """
refunds AS (
  SELECT c_custkey::VARCHAR AS reference_id, 'refunded' AS result, '2024-07-01T00:00:00+00:00' AS status_checked_at,
         '{"nation":' || c_nationkey || '}' AS refund FROM customer WHERE c_acctbal < 1000
),
first_half AS (
  SELECT event_id, row_number() OVER (PARTITION BY reference_id ORDER BY "timestamp"::TIMESTAMPTZ DESC, event_id DESC) AS place
  FROM log WHERE event_id % 2 = 0
),
stored AS (
  SELECT p.reference_id, "timestamp", recommendation, reason, merchant_approved, amount_inr,
         coalesce(u.payment_link_id, p.payment_link_id) AS payment_link_id, coalesce(r.result, u.result, p.result) AS result,
         coalesce(r.status_checked_at, u.status_checked_at) AS status_checked_at, p.event_id::VARCHAR AS event_id,
         '"' || u.payment_method || '"' AS payment_method, r.refund, p.place
  FROM placed p LEFT JOIN first_half f USING (event_id)
  LEFT JOIN updates u ON p.reference_id = u.reference_id AND f.place = 1
  LEFT JOIN refunds r ON p.reference_id = r.reference_id AND p.place = 1
)
"""


def _stored(select: str) -> str:
    return "WITH " + LOG.strip() + ",\n" + _STORED.strip() + "\n" + select


ACTIONS = {
    "stored_log": _stored("SELECT * EXCLUDE (place) FROM stored"),
    "compacted_log": _stored(
        """SELECT * EXCLUDE (place) REPLACE (
          CASE WHEN place = 1 AND reference_id IN (SELECT reference_id FROM updates) THEN 'settled' ELSE result END AS result,
          CASE WHEN place = 1 AND reference_id IN (SELECT reference_id FROM updates) THEN '2024-06-01T00:00:00+00:00'
               ELSE status_checked_at END AS status_checked_at) FROM stored"""
    ),
    "latest_status": _log('SELECT reference_id, "timestamp", result FROM placed WHERE place = 1'),
    "apply_status_updates": _log(
        """SELECT p.reference_id, recommendation, reason, merchant_approved, amount_inr,
        coalesce(u.payment_link_id, p.payment_link_id) AS payment_link_id, coalesce(u.result, p.result) AS result,
        "timestamp", event_id, u.status_checked_at, u.payment_method
        FROM placed p LEFT JOIN updates u ON p.reference_id = u.reference_id AND place = 1"""
    ),
    "unmatched_updates": _log("SELECT * FROM updates WHERE reference_id NOT IN (SELECT reference_id FROM log)"),
    "log_view": _log(f"SELECT {_VIEW} FROM log"),
    "log_round_trip": _log(f"""SELECT {_VIEW}, '{{"id":' || event_id || '}}' AS batch FROM log"""),
    "latest_open_action": _log(
        'SELECT * FROM log WHERE payment_link_id IS NOT NULL ORDER BY "timestamp"::TIMESTAMPTZ DESC, event_id DESC LIMIT 1'
    ),
}

SQL = {**COMMERCE, **BUNDLE, **VALIDATION, **CORPUS, **REPORTS, **ACTIONS}
