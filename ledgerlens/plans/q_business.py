"""Queries for business analytics (B1-B57) over fx_sales, fx_finance, events and lineitem/orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.business import alerts as AL
from ..operators.business import customers as CU
from ..operators.business import finance as FI
from ..operators.business import pricing as PR
from ..operators.business import products as PD
from ..operators.business import roles as RO
from ..operators.business import sales as SA
from ..operators.frames import attach
from ..sources.fixtures import fixture
from ..sources.tables import load
from .common import round_doubles, sig
from .q_profile import W
from .registry import register


def S(x, alias=None):
    return f"{sig(x)} AS {alias or x}"


def sales(spark, sf):
    return fixture(spark, sf, "fx_sales")


def fin(spark, sf):
    return fixture(spark, sf, "fx_finance")


def WS(body, *extra, ctes=()):
    return W(body, "fx_sales", *extra, ctes=ctes)


def WF(body, ctes=()):
    return W(body, "fx_finance", ctes=ctes)


MONTH = "CAST(date_trunc('month', order_date) AS DATE)"
SALES_COLS = [("order_id", "bigint"), ("order_date", "timestamp_ntz"), ("customer_id", "bigint"), ("category", "string"),
              ("product", "string"), ("amount", "double"), ("cost", "double"), ("rating", "bigint"), ("discount", "double"),
              ("quantity", "bigint")]


def _roles_sql():
    parts = []
    for i, (c, t) in enumerate(SALES_COLS):
        is_amount = str(any(w in c for w in RO.AMOUNT_WORDS) and t in ("bigint", "double")).lower()
        is_rating = str(any(w in c for w in RO.RATING_WORDS) and t in ("bigint", "double")).lower()
        kw_cat = any(w in c for w in RO.CATEGORY_WORDS) and t == "string"
        is_id = any(w in c for w in RO.ID_WORDS)
        is_cust = str(any(w in c for w in RO.CUSTOMER_WORDS)).lower()
        is_date = str(t.startswith("timestamp")).lower()
        r = f"count(DISTINCT {c}) * 1.0 / count(*)"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, {S(r, 'unique_ratio')}, {is_date} AS is_date, "
            f"{is_amount} AS is_amount, ({r} < 0.1 OR {str(kw_cat).lower()}) AS is_category, {is_rating} AS is_rating, "
            f"({str(is_id).lower()} AND {r} > 0.8) AS is_id, {is_cust} AS is_customer FROM fx_sales")
    return WS(" UNION ALL ".join(parts))


@register("B1_B5_roles_sales", _roles_sql())
def q_b1(spark, sf):
    return round_doubles(RO.roles(sales(spark, sf)))


@register("B7_liquidity_finance", WF(f"""
SELECT {S('round(ca / cl, 2)', 'current_ratio')}, CASE WHEN ca / cl >= 1.5 THEN 'Good' ELSE 'Needs Attention' END AS current_ratio_status,
  {S('round((ca - inv) / cl, 2)', 'quick_ratio')}, CASE WHEN (ca - inv) / cl >= 1.0 THEN 'Good' ELSE 'Needs Attention' END AS quick_ratio_status,
  {S('round(cash / cl, 2)', 'cash_ratio')}, CASE WHEN cash / cl >= 0.2 THEN 'Good' ELSE 'Low' END AS cash_ratio_status
FROM (SELECT sum(current_assets) AS ca, sum(current_liabilities) AS cl, sum(inventory) AS inv, sum(cash) AS cash FROM fx_finance)"""))
def q_b7(spark, sf):
    return round_doubles(FI.liquidity(fin(spark, sf), "current_assets", "current_liabilities", "inventory", "cash"))


def _b3(x, hi, mid, a, b, c):
    return f"CASE WHEN {x} >= {hi} THEN '{a}' WHEN {x} >= {mid} THEN '{b}' ELSE '{c}' END"


@register("B8_profitability_finance", WF(f"""
SELECT {S('round(nm, 2)', 'net_profit_margin')}, {_b3('nm', 20, 10, 'Excellent', 'Good', 'Needs Improvement')} AS net_margin_status,
  {S('round(gm, 2)', 'gross_profit_margin')}, {_b3('gm', 40, 25, 'Excellent', 'Good', 'Low')} AS gross_margin_status,
  {S('round(roe, 2)', 'roe')}, {_b3('roe', 15, 10, 'Excellent', 'Good', 'Needs Improvement')} AS roe_status,
  {S('round(roa, 2)', 'roa')}, {_b3('roa', 5, 2, 'Excellent', 'Good', 'Low')} AS roa_status
FROM (SELECT ni / rev * 100 AS nm, (rev - cogs) / rev * 100 AS gm, ni / eq * 100 AS roe, ni / ta * 100 AS roa FROM (SELECT sum(revenue) AS rev, sum(net_income) AS ni, sum(cogs) AS cogs,
  sum(equity) AS eq, sum(total_assets) AS ta FROM fx_finance))"""))
def q_b8(spark, sf):
    return round_doubles(FI.profitability(fin(spark, sf), "revenue", "net_income", "cogs", "equity", "total_assets"))


@register("B9_sales_growth_halves", WS(f"""
SELECT {S('o', 'older_revenue')}, {S('r', 'recent_revenue')}, {S('round((r - o) / o * 100, 2)', 'sales_growth')},
  CASE WHEN (r - o) / o * 100 >= 20 THEN 'Excellent' WHEN (r - o) / o * 100 >= 10 THEN 'Good'
    WHEN (r - o) / o * 100 < 0 THEN 'Declining' ELSE 'Stable' END AS growth_status
FROM (SELECT sum(CASE WHEN pos < h THEN amount END) AS o, sum(CASE WHEN pos >= n - h THEN amount END) AS r FROM (
  SELECT amount, row_number() OVER (ORDER BY order_date, order_id) - 1 AS pos, count(*) OVER () AS n,
    floor(count(*) OVER () / 2) AS h FROM fx_sales))"""))
def q_b9(spark, sf):
    return round_doubles(FI.sales_growth(sales(spark, sf), "amount", "order_date", "order_id"))


@register("B10_ltv_estimate", WS(f"""
SELECT {S('round(m * (n * 1.0 / c) * 12, 2)', 'estimated_customer_ltv')},
  CASE WHEN m * (n * 1.0 / c) * 12 >= 1000 THEN 'High Value' WHEN m * (n * 1.0 / c) * 12 >= 500
    THEN 'Medium Value' ELSE 'Low Value' END AS ltv_band
FROM (SELECT avg(amount) AS m, count(*) AS n, count(DISTINCT customer_id) AS c FROM fx_sales)"""))
def q_b10(spark, sf):
    return round_doubles(FI.ltv_estimate(sales(spark, sf), "amount", "customer_id"))


@register("B11_ratio_insights", WF("""
SELECT 1 AS rule_no, 'Info' AS priority, 'roe' AS category, printf('ROE of %s%% indicates %s profitability', CAST(r AS VARCHAR),
  CASE WHEN r >= 15 THEN 'strong' WHEN r >= 10 THEN 'moderate' ELSE 'weak' END) AS message FROM x
UNION ALL SELECT 2, 'Info', 'margin', printf('Net margin of %s%% shows %s efficiency', CAST(m AS VARCHAR),
  CASE WHEN m >= 20 THEN 'excellent' WHEN m >= 10 THEN 'good' ELSE 'concerning' END) FROM x
UNION ALL SELECT 3, 'Info', 'liquidity', printf('Current ratio of %s indicates %s liquidity', CAST(c AS VARCHAR),
  CASE WHEN c >= 2 THEN 'strong' WHEN c >= 1.5 THEN 'adequate' ELSE 'tight' END) FROM x""", ctes=(
    ("x", "SELECT round(sum(net_income) / sum(equity) * 100, 2) AS r, round(sum(net_income) / sum(revenue) * 100, 2) AS m, "
          "round(sum(current_assets) / sum(current_liabilities), 2) AS c FROM fx_finance"),)))
def q_b11(spark, sf):
    f = fin(spark, sf)
    return FI.ratio_insights(FI.liquidity(f, "current_assets", "current_liabilities", "inventory", "cash"),
                             FI.profitability(f, "revenue", "net_income", "cogs", "equity", "total_assets"))


@register("B12_sales_summary", WS(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {S(f'sum({c})', 'total_revenue')}, {S(f'avg({c})', 'average_transaction')}, "
    f"{S(f'quantile_cont({c}, 0.5)', 'median_transaction')} FROM fx_sales" for c in ["amount", "cost"])))
def q_b12(spark, sf):
    return round_doubles(SA.sales_summary(sales(spark, sf), ["amount", "cost"]))


@register("B13_top_transactions", WS(f"""
SELECT {S('amount')}, order_id, category, product, order_date FROM fx_sales WHERE amount IS NOT NULL
ORDER BY amount DESC, order_id LIMIT 10"""))
def q_b13(spark, sf):
    return round_doubles(SA.top_transactions(sales(spark, sf), "amount", ["order_id", "category", "product", "order_date"],
                                             "order_id", 10))


@register("B14_revenue_distribution", WS(f"""
SELECT 'amount' AS "column", {S('max(amount)', 'q4_max')}, {S('stddev_samp(amount)', 'std_deviation')},
  {S('quantile_cont(amount, 0.25)', 'q1')}, {S('quantile_cont(amount, 0.5)', 'q2_median')}, {S('quantile_cont(amount, 0.75)', 'q3')},
  {S('quantile_cont(amount, 0.9)', 'p90')}, {S('quantile_cont(amount, 0.95)', 'p95')}, {S('quantile_cont(amount, 0.99)', 'p99')},
  {S('stddev_samp(amount) / avg(amount)', 'coefficient_of_variation')}, {S('skewness(amount)', 'skewness')}
FROM fx_sales"""))
def q_b14(spark, sf):
    return round_doubles(SA.revenue_distribution(sales(spark, sf), "amount"))


@register("B15_performance", WS(f"""
SELECT count(amount) AS total_transactions, {S('avg(amount)', 'revenue_per_transaction')},
  {S('count(amount) * 100.0 / count(*)', 'conversion_rate')},
  {S('CASE WHEN count(amount) > 10 AND (SELECT count(*) FROM mo) > 1 THEN ((SELECT arg_max(s, m) FROM mo) - (SELECT arg_min(s, m) FROM mo)) / (SELECT arg_min(s, m) FROM mo) * 100 END', 'revenue_growth_rate')}
FROM fx_sales""", ctes=(("mo", f"SELECT {MONTH} AS m, sum(amount) AS s FROM fx_sales WHERE order_date IS NOT NULL AND "
                               f"amount IS NOT NULL GROUP BY 1"),)))
def q_b15(spark, sf):
    return round_doubles(SA.performance(sales(spark, sf), "amount", "order_date"))


@register("B16_monthly_trend", WS(f"""
SELECT month, {S('revenue')}, {S('average')}, transactions,
  month = (SELECT arg_min(month, (-revenue, month)) FROM mo) AS is_peak,
  month = (SELECT arg_min(month, (revenue, month)) FROM mo) AS is_lowest FROM mo""", ctes=(
    ("mo", f"SELECT {MONTH} AS month, round(sum(amount), 2) AS revenue, round(avg(amount), 2) AS average, count(*) AS transactions "
           f"FROM fx_sales WHERE order_date IS NOT NULL AND amount IS NOT NULL GROUP BY 1"),)))
def q_b16(spark, sf):
    return round_doubles(SA.monthly_trend(sales(spark, sf), "amount", "order_date"))


@register("B17_category_performance", WS(f"""
SELECT g.category_column, g.category, {S('revenue')}, {S('average')}, transactions, {S('std')},
  g.category = e.top AS is_top, g.category = e.low AS is_lowest
FROM g JOIN (SELECT category_column, arg_min(category, (-revenue, category)) AS top,
  arg_min(category, (revenue, category)) AS low FROM g GROUP BY 1) e USING (category_column)""", ctes=(
    ("l", "SELECT 'category' AS category_column, CAST(category AS VARCHAR) AS category, amount FROM fx_sales UNION ALL "
          "SELECT 'product', CAST(product AS VARCHAR), amount FROM fx_sales"),
    ("g", "SELECT category_column, category, round(sum(amount), 2) AS revenue, round(avg(amount), 2) AS average, "
          "count(amount) AS transactions, round(stddev_samp(amount), 2) AS std FROM l WHERE category IS NOT NULL GROUP BY 1, 2"))))
def q_b17(spark, sf):
    return round_doubles(SA.category_performance(sales(spark, sf), "amount", ["category", "product"]))


@register("B18_value_segments", WS(f"""
SELECT CAST(sum(CASE WHEN amount > q75 THEN 1 ELSE 0 END) AS BIGINT) AS high_value,
  CAST(sum(CASE WHEN amount > q50 AND amount <= q75 THEN 1 ELSE 0 END) AS BIGINT) AS medium_value,
  CAST(sum(CASE WHEN amount <= q50 THEN 1 ELSE 0 END) AS BIGINT) AS low_value, {S('max(q75)', 'high_value_min')},
  {S('max(q50)', 'medium_value_min')}
FROM fx_sales, (SELECT quantile_cont(amount, 0.5) AS q50, quantile_cont(amount, 0.75) AS q75 FROM fx_sales)
WHERE amount IS NOT NULL"""))
def q_b18(spark, sf):
    return round_doubles(CU.value_segments(sales(spark, sf), "amount"))


@register("B18_frequency_segments", WS(f"""
SELECT CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeat_customers,
  CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS one_time_customers, {S('avg(n)', 'average_transactions_per_customer')}
FROM (SELECT customer_id, count(*) AS n FROM fx_sales WHERE customer_id IS NOT NULL GROUP BY 1)"""))
def q_b18f(spark, sf):
    return round_doubles(CU.frequency_segments(sales(spark, sf), "customer_id"))


@register("B18_top_customers", WS("""
SELECT customer_id AS customer, count(*) AS transactions, CAST(row_number() OVER (ORDER BY count(*) DESC, customer_id) AS INTEGER) AS rank
FROM fx_sales WHERE customer_id IS NOT NULL GROUP BY 1 QUALIFY rank <= 10"""))
def q_b18t(spark, sf):
    return CU.top_customers_by_rows(sales(spark, sf), "customer_id")


@register("B19_behaviour_by_category", WS(f"""
SELECT category, CASE WHEN row_number() OVER (ORDER BY count(*) DESC, category) <= 10 THEN count(*) END AS transactions,
  {S('round(avg(amount), 2)', 'average_spend')} FROM fx_sales WHERE category IS NOT NULL GROUP BY 1"""))
def q_b19(spark, sf):
    return round_doubles(CU.behaviour_by_category(sales(spark, sf), "category", "amount"))


@register("B19_behaviour_by_time", WS("""
SELECT strftime(order_date, '%A') AS label, count(*) AS transactions, 'weekday' AS dimension FROM fx_sales
WHERE order_date IS NOT NULL GROUP BY 1
UNION ALL SELECT strftime(order_date, '%B'), count(*), 'month' FROM fx_sales WHERE order_date IS NOT NULL GROUP BY 1"""))
def q_b19t(spark, sf):
    return CU.behaviour_by_time(sales(spark, sf), "order_date")


@register("B20_seasonality", WS("""
SELECT CAST(quarter AS INTEGER) AS quarter, transactions,
  'Q' || CAST((SELECT arg_min(quarter, (-transactions, quarter)) FROM q) AS VARCHAR) AS peak_quarter,
  CASE WHEN (SELECT stddev_samp(transactions) FROM q) > (SELECT avg(transactions) FROM q) * 0.2 THEN 'detected'
    ELSE 'minimal' END AS seasonal_pattern FROM q""", ctes=(
    ("q", "SELECT quarter(order_date) AS quarter, count(*) AS transactions FROM fx_sales WHERE order_date IS NOT NULL GROUP BY 1"),)))
def q_b20(spark, sf):
    return CU.seasonality(sales(spark, sf), "order_date")


@register("B21_satisfaction", WS(f"""
SELECT CAST(rating AS DOUBLE) AS rating, count(*) AS responses_at_rating,
  {S('(SELECT avg(rating) FROM fx_sales WHERE rating IS NOT NULL)', 'average_rating')},
  (SELECT count(*) FROM fx_sales WHERE rating IS NOT NULL) AS total_responses,
  (SELECT CASE WHEN avg(rating) >= 4.5 THEN 'Excellent' WHEN avg(rating) >= 4.0 THEN 'Good' WHEN avg(rating) >= 3.5
    THEN 'Average' WHEN avg(rating) >= 3.0 THEN 'Below Average' ELSE 'Poor' END FROM fx_sales) AS satisfaction_level
FROM fx_sales WHERE rating IS NOT NULL GROUP BY 1"""))
def q_b21(spark, sf):
    return round_doubles(CU.satisfaction(sales(spark, sf), "rating"))


@register("B22_rating_trend", WS(f"""
SELECT month, {S('round(a, 2)', 'average_rating')},
  CASE WHEN (SELECT arg_max(a, month) FROM mo) > (SELECT arg_min(a, month) FROM mo) THEN 'improving' ELSE 'declining' END
    AS trend_direction,
  month = (SELECT arg_min(month, (-a, month)) FROM mo) AS is_best, month = (SELECT arg_min(month, (a, month)) FROM mo) AS is_worst
FROM mo""", ctes=(("mo", f"SELECT {MONTH} AS month, avg(rating) AS a FROM fx_sales WHERE rating IS NOT NULL AND "
                         f"order_date IS NOT NULL GROUP BY 1"),)))
def q_b22(spark, sf):
    return round_doubles(CU.rating_trend(sales(spark, sf), "rating", "order_date"))


_CV = ("SELECT customer_id AS customer, sum(amount) AS value, count(amount) AS transactions, avg(amount) AS mean "
       "FROM fx_sales WHERE customer_id IS NOT NULL GROUP BY 1")


@register("B23_top_customers_by_value", WS(f"""
SELECT customer, {S('value')}, transactions, {S('mean')} FROM cv ORDER BY value DESC NULLS LAST, customer LIMIT 10""",
                                           ctes=(("cv", _CV),)))
def q_b23v(spark, sf):
    return round_doubles(CU.top_customers(sales(spark, sf), "customer_id", "amount", "value"))


@register("B23_top_customers_by_frequency", WS(f"""
SELECT customer, {S('value')}, transactions, {S('mean')} FROM cv ORDER BY transactions DESC, customer LIMIT 10""",
                                               ctes=(("cv", _CV),)))
def q_b23f(spark, sf):
    return round_doubles(CU.top_customers(sales(spark, sf), "customer_id", "amount", "transactions"))


@register("B24_customer_value_summary", WS(f"""
SELECT {S('sum(amount)', 'total_customer_value')}, {S('avg(amount)', 'average_customer_value')},
  CAST(sum(CASE WHEN amount > t80 THEN 1 ELSE 0 END) AS BIGINT) AS high_value_transactions,
  CAST(sum(CASE WHEN amount > t40 AND amount <= t80 THEN 1 ELSE 0 END) AS BIGINT) AS medium_value_transactions,
  CAST(sum(CASE WHEN amount <= t40 THEN 1 ELSE 0 END) AS BIGINT) AS low_value_transactions,
  {S('max(t80) / avg(amount)', 'value_concentration')},
  {S('(SELECT avg(value) FROM cv)', 'average_clv')},
  (SELECT CAST(sum(CASE WHEN value > c80 THEN 1 ELSE 0 END) AS BIGINT) FROM cv, cq WHERE value IS NOT NULL) AS high_clv_customers,
  (SELECT CAST(sum(CASE WHEN value > c40 AND value <= c80 THEN 1 ELSE 0 END) AS BIGINT) FROM cv, cq WHERE value IS NOT NULL)
    AS medium_clv_customers,
  (SELECT CAST(sum(CASE WHEN value <= c40 THEN 1 ELSE 0 END) AS BIGINT) FROM cv, cq WHERE value IS NOT NULL) AS low_clv_customers,
  {S('(SELECT stddev_samp(value) FROM cv)', 'clv_variance')}
FROM fx_sales, (SELECT quantile_cont(amount, 0.4) AS t40, quantile_cont(amount, 0.8) AS t80 FROM fx_sales)
WHERE amount IS NOT NULL""", ctes=(("cv", _CV), ("cq", "SELECT quantile_cont(value, 0.4) AS c40, quantile_cont(value, 0.8) AS c80 FROM cv"))))
def q_b24(spark, sf):
    return round_doubles(CU.customer_value_summary(sales(spark, sf), "customer_id", "amount"))


@register("B25_product_overview", WS(f"""
SELECT count(*) AS total_products, arg_min(p, (-n, p)) AS most_popular_product, arg_min(p, (n, p)) AS least_popular_product,
  {S('count(*) * 1.0 / (SELECT count(*) FROM fx_sales)', 'product_diversity_index')}
FROM (SELECT product AS p, count(*) AS n FROM fx_sales WHERE product IS NOT NULL GROUP BY 1)"""))
def q_b25(spark, sf):
    return round_doubles(PD.product_overview(sales(spark, sf), "product"))


@register("B25_product_distribution", W("""
SELECT p_name AS product, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, p_name) AS INTEGER) AS rank
FROM part GROUP BY 1 QUALIFY rank <= 10"""))
def q_b25d(spark, sf):
    return PD.product_distribution(load(spark, sf, "part"), "p_name")


@register("B26_product_performance", WS(f"""
SELECT product, {S('revenue')}, {S('average_price')}, volume,
  product = (SELECT arg_min(product, (-revenue, product)) FROM g) AS top_revenue,
  product = (SELECT arg_min(product, (-volume, product)) FROM g) AS top_volume,
  product = (SELECT arg_min(product, (-average_price, product)) FROM g) AS highest_priced FROM g""", ctes=(
    ("g", "SELECT product, round(sum(amount), 2) AS revenue, round(avg(amount), 2) AS average_price, count(amount) AS volume "
          "FROM fx_sales WHERE product IS NOT NULL GROUP BY 1"),)))
def q_b26(spark, sf):
    return round_doubles(PD.product_performance(sales(spark, sf), "product", "amount"))


@register("B27_product_trends", WS(f"""
SELECT product, {S('f', 'first_month_sales')}, {S('l', 'last_month_sales')},
  CASE WHEN l > f THEN 'growing' ELSE 'declining' END AS trend_direction, peak_month,
  {S('CASE WHEN f <> 0 THEN (l - f) / f * 100 ELSE 0.0 END', 'growth_rate')}
FROM (SELECT product, coalesce(sum(CASE WHEN month = (SELECT min(month) FROM c) THEN s END), 0.0) AS f,
  coalesce(sum(CASE WHEN month = (SELECT max(month) FROM c) THEN s END), 0.0) AS l,
  arg_min(month, (-s, month)) AS peak_month FROM c GROUP BY product)""", ctes=(
    ("c", f"SELECT {MONTH} AS month, product, sum(amount) AS s FROM fx_sales WHERE order_date IS NOT NULL AND "
          f"product IS NOT NULL AND amount IS NOT NULL GROUP BY 1, 2"),)))
def q_b27(spark, sf):
    return round_doubles(PD.product_trends(sales(spark, sf), "product", "amount", "order_date"))


@register("B27_product_months", WS(f"""
SELECT p.product, m.month, {S('coalesce(s, 0.0)', 'sales')} FROM (SELECT DISTINCT product FROM c) p JOIN (SELECT DISTINCT month FROM c) m ON true
LEFT JOIN c ON c.product = p.product AND c.month = m.month""", ctes=(
    ("c", f"SELECT {MONTH} AS month, product, sum(amount) AS s FROM fx_sales WHERE order_date IS NOT NULL AND "
          f"product IS NOT NULL AND amount IS NOT NULL GROUP BY 1, 2"),)))
def q_b27m(spark, sf):
    return round_doubles(PD.product_months(sales(spark, sf), "product", "amount", "order_date"))


_MISS = ("100 - (" + " + ".join(f"count({c})" for c, _ in SALES_COLS) + f") * 100.0 / (count(*) * {len(SALES_COLS)})")


@register("B28_business_recommendations", WS(f"""
SELECT CAST(n AS INTEGER) AS rule_no, priority, category, message FROM (
  SELECT *, row_number() OVER (ORDER BY n) AS k FROM (
    SELECT 1 AS n, 'Medium' AS priority, 'pricing' AS category,
      'High revenue variance detected - consider implementing tiered pricing strategy' AS message
      FROM a HAVING stddev_samp(amount) / avg(amount) > 1.0
    UNION ALL SELECT 2, 'Medium', 'upsell', 'Many low-value transactions - explore upselling opportunities'
      FROM a, (SELECT quantile_cont(amount, 0.1) AS p FROM a) HAVING count(*) FILTER (amount < p) * 1.0 / count(*) > 0.1
    UNION ALL SELECT 3, 'High', 'satisfaction', 'Customer satisfaction below average - prioritize service improvement'
      FROM fx_sales HAVING avg(rating) < 3.5
    UNION ALL SELECT 4, 'Low', 'satisfaction', 'Excellent customer satisfaction - leverage for referral programs'
      FROM fx_sales HAVING avg(rating) > 4.5
    UNION ALL SELECT 5, 'Medium', 'products', 'Revenue concentrated in one product - diversify product portfolio'
      FROM (SELECT product, coalesce(sum(amount), 0) AS s FROM fx_sales WHERE product IS NOT NULL GROUP BY 1)
      HAVING count(*) > 1 AND max(s) / sum(s) > 0.5
    UNION ALL SELECT 6, 'Medium', 'seasonality', 'Seasonal patterns detected - plan inventory and marketing accordingly'
      FROM (SELECT count(*) AS c FROM fx_sales WHERE order_date IS NOT NULL GROUP BY month(order_date))
      HAVING stddev_samp(c) / avg(c) > 0.5
    UNION ALL SELECT 7, 'Low', 'dimensions', 'Multiple business dimensions available - consider cross-category analysis'
    UNION ALL SELECT 8, 'High', 'data', 'Significant missing data detected - improve data collection processes'
      FROM fx_sales HAVING {_MISS} > 10)) WHERE k <= 8""", ctes=(
    ("a", "SELECT amount FROM fx_sales WHERE amount IS NOT NULL AND NOT isnan(amount)"),)))
def q_b28(spark, sf):
    return AL.recommendations(sales(spark, sf), "amount", "rating", "product", "order_date", categories=2)


_DBINS = ("(VALUES (0, 'No Discount'), (1, 'Low (0-5%)'), (2, 'Medium (5-15%)'), (3, 'High (15-30%)'), "
          "(4, 'Very High (30%+)')) AS b(bin_order, discount_category)")


@register("B29_discount_impact", WS(f"""
SELECT b.discount_category, CAST(b.bin_order AS INTEGER) AS bin_order, CAST(coalesce(g.transactions, 0) AS BIGINT) AS transactions,
  {S('g.revenue', 'revenue')}, {S('g.average_transaction', 'average_transaction')}, {S('g.revenue_std', 'revenue_std')}
FROM {_DBINS} LEFT JOIN (
  SELECT CASE WHEN discount <= 0 THEN 'No Discount' WHEN discount <= 5 THEN 'Low (0-5%)' WHEN discount <= 15 THEN 'Medium (5-15%)'
    WHEN discount <= 30 THEN 'High (15-30%)' ELSE 'Very High (30%+)' END AS discount_category, count(*) AS transactions,
    round(sum(amount), 2) AS revenue, round(avg(amount), 2) AS average_transaction, round(stddev_samp(amount), 2) AS revenue_std
  FROM fx_sales WHERE discount IS NOT NULL AND amount IS NOT NULL GROUP BY 1) g USING (discount_category)"""))
def q_b29(spark, sf):
    return round_doubles(PR.discount_impact(sales(spark, sf), "discount", "amount"))


@register("B30_discount_effectiveness", WS(f"""
SELECT {S('coalesce(r, 0.0)', 'discount_revenue_correlation')}, {S('CASE WHEN d > 0 THEN a / d ELSE 0.0 END', 'revenue_per_discount_point')},
  CASE WHEN r IS NULL THEN 'Insufficient data'
    WHEN r < -0.3 AND (CASE WHEN d > 0 THEN a / d ELSE 0.0 END) < 50 THEN 'Poor - discounts may be reducing profitability'
    WHEN r < 0 AND (CASE WHEN d > 0 THEN a / d ELSE 0.0 END) > 50 THEN 'Moderate - discounts driving volume but reducing margins'
    WHEN r > 0.1 THEN 'Good - discounts correlated with higher transaction values'
    ELSE 'Average - mixed discount effectiveness' END AS effectiveness_rating
FROM (SELECT corr(discount, amount) AS r, sum(discount) AS d, sum(amount) AS a FROM fx_sales
  WHERE discount IS NOT NULL AND amount IS NOT NULL)"""))
def q_b30(spark, sf):
    return round_doubles(PR.discount_effectiveness(sales(spark, sf), "discount", "amount"))


@register("B31_optimal_discount_range", WS(f"""
SELECT CAST(bin AS INTEGER) AS bin, {S('CASE WHEN bin = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + bin * ((hi - lo) / 10) END', 'lower')},
  {S('lo + (bin + 1) * ((hi - lo) / 10)', 'upper')}, coalesce(transactions, 0) AS transactions,
  {S('coalesce(revenue, 0.0)', 'revenue')}, {S('average')},
  bin = (SELECT arg_min(bin, (-revenue, bin)) FROM g) AS best_for_revenue,
  bin = (SELECT arg_min(bin, (-average, bin)) FROM g) AS best_for_average
FROM r, (SELECT unnest(range(10)) AS bin) LEFT JOIN g USING (bin)""", ctes=(
    ("d", "SELECT CAST(discount AS DOUBLE) AS d, amount AS a FROM fx_sales WHERE discount IS NOT NULL AND amount IS NOT NULL"),
    ("r", "SELECT min(d) AS lo, max(d) AS hi FROM d"),
    ("g", "SELECT CAST(least(greatest(ceil((d - lo) / ((hi - lo) / 10)) - 1, 0), 9) AS INTEGER) AS bin, "
          "count(*) AS transactions, sum(a) AS revenue, avg(a) AS average FROM d, r GROUP BY 1"))))
def q_b31(spark, sf):
    return round_doubles(PR.optimal_discount_range(sales(spark, sf), "discount", "amount"))


@register("B32_price_points", WS(f"""
SELECT {S('avg(amount)', 'current_average_price')},
  CAST(sum(CASE WHEN amount < q33 THEN 1 ELSE 0 END) AS BIGINT) AS low_price_transactions,
  CAST(sum(CASE WHEN amount >= q33 AND amount < q67 THEN 1 ELSE 0 END) AS BIGINT) AS medium_price_transactions,
  CAST(sum(CASE WHEN amount >= q67 THEN 1 ELSE 0 END) AS BIGINT) AS high_price_transactions,
  {S('(SELECT sum(amount) FROM (SELECT amount FROM a ORDER BY amount DESC LIMIT (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM a))) / sum(amount) * 100', 'top_20_percent_contribution')},
  {S('(SELECT sum(amount) FROM (SELECT amount FROM a ORDER BY amount LIMIT (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM a))) / sum(amount) * 100', 'bottom_20_percent_contribution')}
FROM a, (SELECT quantile_cont(amount, 0.33) AS q33, quantile_cont(amount, 0.67) AS q67 FROM a)""", ctes=(
    ("a", "SELECT amount FROM fx_sales WHERE amount IS NOT NULL AND NOT isnan(amount)"),)))
def q_b32(spark, sf):
    return round_doubles(PR.price_points(sales(spark, sf), "amount"))


@register("B33_category_optimisation", WS(f"""
SELECT category, {S('revenue')}, transactions, {S('average')}, average < (SELECT avg(amount) FROM fx_sales) AS underperforming,
  transactions > (SELECT quantile_cont(transactions, 0.5) FROM g) AS high_potential FROM g""", ctes=(
    ("g", "SELECT category, sum(amount) AS revenue, count(amount) AS transactions, avg(amount) AS average FROM fx_sales "
          "WHERE category IS NOT NULL GROUP BY 1"),)))
def q_b33(spark, sf):
    return round_doubles(PR.category_optimisation(sales(spark, sf), "category", "amount"))


@register("B34_financial_kpis", WS(f"""
SELECT {S('sum(amount)', 'total_revenue')}, {S('avg(amount)', 'average_revenue_per_transaction')},
  {S('stddev_samp(amount)', 'revenue_standard_deviation')}, count(amount) AS total_transactions,
  {S('count(amount) * 100.0 / count(*)', 'transaction_frequency')}, {S('CAST(sum(quantity) AS DOUBLE)', 'total_quantity_sold')},
  {S('avg(quantity)', 'average_quantity_per_transaction')}, {S('quantile_cont(amount, 0.5)', 'median_revenue_per_transaction')},
  {S('sum(amount) / CAST(sum(quantity) AS DOUBLE)', 'revenue_per_unit')},
  (SELECT CAST(datediff('day', min(order_date), max(order_date)) AS INTEGER) FROM fx_sales WHERE amount IS NOT NULL) AS data_period_days,
  {S('sum(amount) / (SELECT datediff(' + "'day'" + ', min(order_date), max(order_date)) FROM fx_sales WHERE amount IS NOT NULL)', 'revenue_per_day')},
  {S('count(amount) * 1.0 / (SELECT datediff(' + "'day'" + ', min(order_date), max(order_date)) FROM fx_sales WHERE amount IS NOT NULL)', 'transactions_per_day')}
FROM fx_sales"""))
def q_b34(spark, sf):
    return round_doubles(FI.financial_kpis(sales(spark, sf), "amount", "order_date", "quantity"))


_MARGIN = ("SELECT category, amount AS a, cost AS c, amount - cost AS p, round((amount - cost) / amount * 100, 2) AS mp "
           "FROM fx_sales WHERE amount IS NOT NULL AND cost IS NOT NULL")
_MARGIN_AGG = (f"{S('sum(a)', 'total_revenue')}, {S('sum(c)', 'total_costs')}, {S('sum(p)', 'total_profit')}, "
               f"{S('sum(p) / sum(a) * 100', 'overall_margin_percent')}, {S('avg(mp)', 'average_margin_percent')}, "
               f"{S('stddev_samp(mp)', 'margin_volatility')}, "
               "CAST(sum(CASE WHEN mp > 30 THEN 1 ELSE 0 END) AS BIGINT) AS high_margin_transactions, "
               "CAST(sum(CASE WHEN mp > 15 AND mp <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS medium_margin_transactions, "
               "CAST(sum(CASE WHEN mp <= 15 THEN 1 ELSE 0 END) AS BIGINT) AS low_margin_transactions, "
               "CAST(sum(CASE WHEN mp < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_margin_transactions, "
               f"{S('quantile_cont(mp, 0.5)', 'median_margin_percent')}")


@register("B35_margins_overall", WS(f"SELECT {_MARGIN_AGG} FROM m", ctes=(("m", _MARGIN),)))
def q_b35(spark, sf):
    return round_doubles(FI.margins(sales(spark, sf), "amount", "cost"))


@register("B35_margins_by_category", WS(f"""
SELECT *, category = (SELECT arg_min(category, (-total_profit, category)) FROM g) AS most_profitable,
  category = (SELECT arg_min(category, (-round(average_margin_percent, 2), category)) FROM g) AS highest_margin FROM g""",
    ctes=(("m", _MARGIN), ("g", f"SELECT CAST(category AS VARCHAR) AS category, {_MARGIN_AGG} FROM m GROUP BY 1"))))
def q_b35c(spark, sf):
    return round_doubles(FI.margins(sales(spark, sf), "amount", "cost", "category"))


_HALF_A, _HALF_B = "order_date < TIMESTAMP '1995-07-01'", "order_date >= TIMESTAMP '1995-07-01'"
_AMOUNTS, _CATEGORIES = (["amount"], ["amount", "cost"]), (["category"], ["category", "product"])
_EARLY, _LATE = "order_id, order_date, customer_id, category, product, amount", "*"


def _halves(spark, sf):
    """All orders, as two datasets by date; the early one has fewer columns."""
    s = sales(spark, sf)
    return s.filter(_HALF_A).select(*_EARLY.split(", ")), s.filter(_HALF_B)


def _compared(spark, sf):
    a, b = _halves(spark, sf)
    return AL.compare_datasets(a, b, "amount", "customer_id", "product", "early", "late", _AMOUNTS, _CATEGORIES)


_COLUMNS = "(SELECT len(json_keys(to_json(t))) FROM (SELECT {c} FROM fx_sales LIMIT 1) t)"


@register("B36_compare_datasets", WS(" UNION ALL ".join(
    f"SELECT '{n}' AS dataset, count(*) AS records, {_COLUMNS.format(c=c)} AS columns, {k}::BIGINT AS amount_columns, {k}::BIGINT AS category_columns, "
    f"{S('sum(amount)', 'revenue')}, {S('avg(amount)', 'average_transaction')}, "
    f"count(DISTINCT customer_id) AS customers, count(DISTINCT product) AS products FROM fx_sales WHERE {y}"
    for n, y, c, k in (("early", _HALF_A, _EARLY, 1), ("late", _HALF_B, _LATE, 2)))))
def q_b36(spark, sf):
    return round_doubles(_compared(spark, sf))


@register("B37_retention", WS(f"""
SELECT customers, "returning", {S('r', 'retention_rate')}, {S('100 - r', 'churn_rate')},
  CASE WHEN r >= 80 THEN 'Excellent' WHEN r >= 60 THEN 'Good' ELSE 'Needs Improvement' END AS retention_band,
  CASE WHEN 100 - r <= 20 THEN 'Good' WHEN 100 - r >= 40 THEN 'Concerning' ELSE 'Moderate' END AS churn_band
FROM (SELECT count(*) AS customers, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS "returning",
  sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) * 100.0 / count(*) AS r
  FROM (SELECT customer_id, count(*) AS n FROM fx_sales WHERE customer_id IS NOT NULL AND (order_id % 3 <> 0) AND order_date IS NOT NULL GROUP BY 1))"""))
def q_b37(spark, sf):
    """Every third order lacks its date, so rows that count and rows that don't both occur."""
    s = sales(spark, sf).withColumn("order_date", F.when(F.col("order_id") % 3 != 0, F.col("order_date")))
    return round_doubles(CU.retention(s, "customer_id", "order_date"))


@register("B38_cac_ltv", WS(f"""
SELECT customers, {S('spend', 'marketing_spend')}, {S('cac')}, {S('ltv')},
  CASE WHEN cac <= 100 THEN 'Efficient' WHEN cac >= 500 THEN 'Expensive' ELSE 'Moderate' END AS cac_band,
  CASE WHEN ltv >= 1000 THEN 'High Value' WHEN ltv >= 500 THEN 'Medium Value' ELSE 'Low Value' END AS ltv_band
FROM (SELECT count(*) AS customers, (SELECT sum(cost) FROM fx_sales) AS spend, (SELECT sum(cost) FROM fx_sales) / count(*) AS cac,
  avg(value) * avg(transactions) / 12 AS ltv FROM cv)""", ctes=(("cv", _CV),)))
def q_b38(spark, sf):
    return round_doubles(CU.acquisition(sales(spark, sf), "customer_id", "amount", "cost"))


@register("B39_fulfilment", f"""
SELECT avg_cycle_days, on_time_percentage, orders, CASE WHEN avg_cycle_days <= 2 THEN 'Excellent' WHEN avg_cycle_days <= 5 THEN 'Good'
  ELSE 'Needs Improvement' END AS cycle_band, CASE WHEN on_time_percentage >= 95 THEN 'Excellent' WHEN on_time_percentage >= 85
  THEN 'Good' ELSE 'Needs Improvement' END AS interpretation FROM (
SELECT {S("avg(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))", 'avg_cycle_days')},
  {S("sum(CASE WHEN regexp_matches(st, '(?i)(on.time|delivered|success)') THEN 1 ELSE 0 END) * 100.0 / count(st)", 'on_time_percentage')},
  count(st) AS orders
FROM (SELECT l_orderkey, l_shipdate, CASE WHEN l_linestatus = 'F' THEN 'Delivered' WHEN l_returnflag = 'N' AND l_quantity < 25 THEN 'open' END AS st
  FROM lineitem) JOIN orders ON l_orderkey = o_orderkey)""")
def q_b39(spark, sf):
    st = F.when(F.col("l_linestatus") == "F", "Delivered").when((F.col("l_returnflag") == "N") & (F.col("l_quantity") < 25), "open")
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", st.alias("st"))
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return round_doubles(FI.fulfilment(li.join(o, li.l_orderkey == o.o_orderkey), "o_orderdate", "l_shipdate", "st"))


@register("B40_turnover_training_roi", WS(f"""
SELECT {S('t', 'turnover_rate')}, CASE WHEN t <= 10 THEN 'Good' WHEN t >= 20 THEN 'Concerning' ELSE 'Moderate' END AS turnover_band,
  {S('r', 'training_roi')}, CASE WHEN r >= 200 THEN 'Excellent' WHEN r >= 100 THEN 'Good' ELSE 'Poor' END AS roi_band
FROM (SELECT count(CASE WHEN category = '5-LOW' THEN order_date END) * 100.0 / count(DISTINCT customer_id) AS t,
  (avg(rating) * 1000 - sum(discount)) / sum(discount) * 100 AS r FROM fx_sales)"""))
def q_b40(spark, sf):
    df = sales(spark, sf).withColumn("left_on", F.when(F.col("category") == "5-LOW", F.col("order_date")))
    return round_doubles(FI.workforce(df, "customer_id", "left_on", "rating", "discount"))


@register("B41_cpi_spi", f"""
SELECT {S('cpi')}, CASE WHEN cpi > 1 THEN 'Under Budget' WHEN cpi < 1 THEN 'Over Budget' ELSE 'On Budget' END AS cost_status,
  planned_days, actual_days, {S('planned_days / actual_days', 'spi')}, CASE WHEN planned_days > actual_days THEN 'Ahead of Schedule'
  WHEN planned_days < actual_days THEN 'Behind Schedule' ELSE 'On Schedule' END AS schedule_status FROM (
SELECT sum(l_extendedprice) / sum(l_extendedprice * (1 - l_discount)) AS cpi,
  CAST(datediff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS INTEGER) AS planned_days,
  CAST(datediff('day', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE))) AS INTEGER) AS actual_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def q_b41(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate",
                                            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("actual_cost"))
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return round_doubles(FI.project_indices(j, "l_extendedprice", "actual_cost", "o_orderdate", "l_shipdate"))


@register("B42_dso_debt_equity", WF(f"""
SELECT {S('d', 'dso')}, CASE WHEN d <= 30 THEN 'Excellent' WHEN d <= 45 THEN 'Good' ELSE 'Concerning' END AS dso_band,
  {S('e', 'debt_to_equity')}, CASE WHEN e <= 0.5 THEN 'Conservative' WHEN e <= 1 THEN 'Moderate' ELSE 'Aggressive' END AS debt_band
FROM (SELECT avg(current_assets) / (sum(revenue) / 365) AS d, sum(current_liabilities) / sum(equity) AS e FROM fx_finance)"""))
def q_b42(spark, sf):
    return round_doubles(FI.banking(fin(spark, sf), "current_assets", "revenue", "current_liabilities", "equity"))


@register("B9_sales_growth_kpi", WS(f"""
SELECT {S('g', 'sales_growth_percent')}, CASE WHEN g >= 20 THEN 'Excellent' WHEN g >= 10 THEN 'Good' WHEN g < 0 THEN 'Concerning' ELSE 'Stable' END
  AS interpretation FROM (SELECT (r - o) / o * 100 AS g FROM (
  SELECT sum(amount) FILTER (pos < h) AS o, sum(amount) FILTER (pos >= n - h) AS r FROM (
    SELECT amount, row_number() OVER (ORDER BY order_date, order_id) - 1 AS pos, count(*) OVER () AS n, floor(count(*) OVER () / 2) AS h
    FROM fx_sales WHERE order_date IS NOT NULL AND amount IS NOT NULL)))"""))
def q_b9k(spark, sf):
    return round_doubles(FI.sales_growth_kpi(sales(spark, sf), "amount", "order_date", "order_id"))


@register("B43_trend_slope", WS(f"""
SELECT {S('regr_slope(y, x)', 'slope_per_day')}, {S('regr_slope(y, x) / avg(y) * 100', 'slope_pct_of_mean')}, count(*) AS n,
  CASE WHEN count(*) >= 30 THEN 'Good' WHEN count(*) >= 10 THEN 'Moderate' ELSE 'Basic' END AS confidence,
  CASE WHEN regr_slope(y, x) > 0 THEN 'Growing' WHEN regr_slope(y, x) < 0 THEN 'Declining' ELSE 'Stable' END AS direction
FROM (SELECT CAST(datediff('day', (SELECT min(CAST(order_date AS DATE)) FROM fx_sales WHERE amount IS NOT NULL),
  CAST(order_date AS DATE)) AS DOUBLE) AS x, amount AS y FROM fx_sales WHERE amount IS NOT NULL AND order_date IS NOT NULL)"""))
def q_b43(spark, sf):
    return round_doubles(SA.trend_slope(sales(spark, sf), "amount", "order_date"))


@register("B44_anomalies", WS(f"""
SELECT {S('m', 'mean')}, {S('s', 'std')}, above_2sigma, below_2sigma, beyond_3sigma, n, {S('(above_2sigma + below_2sigma) * 100.0 / n', 'anomaly_rate')},
  {S('m + 2 * s', 'threshold_upper')}, {S('m - 2 * s', 'threshold_lower')},
  CASE WHEN (above_2sigma + below_2sigma) * 100.0 / n > 10 THEN 'High Variance' WHEN (above_2sigma + below_2sigma) * 100.0 / n > 5
    THEN 'Normal Variance' ELSE 'Low Variance' END AS interpretation
FROM (SELECT any_value(m) AS m, any_value(s) AS s, count(*) FILTER (amount > m + 2 * s) AS above_2sigma, count(*) FILTER (amount < m - 2 * s) AS below_2sigma,
  count(*) FILTER (abs(amount - m) > 3 * s) AS beyond_3sigma, count(*) AS n
  FROM fx_sales, (SELECT avg(amount) AS m, stddev_samp(amount) AS s FROM fx_sales) WHERE amount IS NOT NULL)"""))
def q_b44(spark, sf):
    return round_doubles(SA.anomalies(sales(spark, sf), "amount"))


@register("B45_engagement_events", f"""
SELECT active_users, total_interactions, {S('m', 'avg_interactions_per_record')}, {S('d', 'avg_session_duration')},
  CASE WHEN active_users >= 1000 THEN 'High Engagement' WHEN active_users >= 100 THEN 'Medium Engagement' ELSE 'Low Engagement' END AS user_band,
  CASE WHEN m >= 10 THEN 'High Activity' WHEN m >= 5 THEN 'Moderate Activity' ELSE 'Low Activity' END AS activity_band,
  CASE WHEN d >= 15 THEN 'Highly Engaged' WHEN d >= 5 THEN 'Engaged' ELSE 'Brief Sessions' END AS session_band
FROM (SELECT count(DISTINCT user_id) AS active_users, CAST(sum(length(event_type)) AS BIGINT) AS total_interactions,
  avg(length(event_type)) AS m, avg(value) AS d FROM events)""")
def q_b45(spark, sf):
    ev = load(spark, sf, "events").select("user_id", "value", F.length("event_type").alias("interactions"))
    return round_doubles(FI.engagement(ev, "user_id", "interactions", "value"))


_SC = [c for c, _ in SALES_COLS]
_FULL = '(' + ' + '.join(f'count({c})' for c in _SC) + f') * 100.0 / (count(*) * {len(_SC)})'


@register("B46_governance", WS(f"""
SELECT {S('v', 'valid_cell_percentage')}, {S('a', 'audit_coverage')}, n AS tracked_records, {S('m', 'mrr')},
  CASE WHEN v >= 95 THEN 'Excellent' WHEN v >= 85 THEN 'Good' ELSE 'Needs Improvement' END AS quality_band,
  CASE WHEN a >= 95 THEN 'Full Compliance' WHEN a >= 80 THEN 'Partial Compliance' ELSE 'Poor Compliance' END AS audit_band,
  CASE WHEN m >= 50000 THEN 'Strong MRR' WHEN m >= 10000 THEN 'Growing MRR' ELSE 'Early Stage' END AS mrr_band
FROM (SELECT {_FULL} AS v, count(amount) * 100.0 / count(*) AS a, count(amount) AS n, sum(discount) AS m FROM fx_sales)"""))
def q_b46(spark, sf):
    return round_doubles(FI.governance(sales(spark, sf), "amount", "discount"))


_ALERT_CTES = (
    ("d", "SELECT order_date, order_id, amount FROM fx_sales WHERE order_date IS NOT NULL AND amount IS NOT NULL"),
    ("p", "SELECT amount, row_number() OVER (ORDER BY order_date, order_id) - 1 AS pos, count(*) OVER () AS n, "
          "floor(count(*) OVER () / 3) AS k FROM d"),
    ("t", "SELECT avg(amount) FILTER (pos < k) AS f, avg(amount) FILTER (pos >= n - k) AS l FROM p"),
    ("z", "SELECT avg(amount) AS m, stddev_samp(amount) AS s, count(amount) AS c FROM fx_sales"),
    ("o", "SELECT CASE WHEN any_value(c) > 10 THEN count(*) FILTER (amount > m + 3 * s OR amount < m - 3 * s) ELSE 0 END AS anomalies "
          "FROM fx_sales, z"),
    ("c", "SELECT max(v) / sum(v) * 100 AS share FROM (SELECT coalesce(sum(amount), 0) AS v FROM fx_sales WHERE customer_id IS NOT NULL "
          "GROUP BY customer_id)"),
    ("x", "SELECT f, l, (l / f - 1) * 100 AS change, anomalies, share FROM t, o, c"))


@register("B47_alert_metrics", WS(f"""
SELECT {S('f', 'first_third_mean')}, {S('l', 'last_third_mean')}, {S('change', 'trend_change_pct')}, anomalies,
  {S('share', 'top_customer_share')} FROM x""", ctes=_ALERT_CTES))
def q_b47m(spark, sf):
    return round_doubles(AL.alert_metrics(sales(spark, sf), "amount", "order_date", "order_id", "customer_id"))


def _alerts(spark, sf):
    return AL.early_warnings(sales(spark, sf), "amount", "order_date", "order_id", "customer_id", fin(spark, sf),
                             "current_assets", "current_liabilities")


_ALERTS_SQL = """
SELECT 1 AS rule_no, 'CRITICAL' AS severity, 'Liquidity Crisis' AS category, printf('Current ratio of %s is below safe threshold of 1.0', CAST(r AS VARCHAR)) AS message,
  'Immediate cash flow review required' AS recommendation FROM y WHERE r < 1
UNION ALL SELECT 2, 'WARNING', 'Liquidity Warning', printf('Current ratio of %s approaching low threshold', CAST(r AS VARCHAR)),
  'Monitor cash flow closely' FROM y WHERE r >= 1 AND r < 1.5
UNION ALL SELECT 3, 'CRITICAL', 'Revenue Decline', printf('Revenue declined by %.1f%%', abs(change)), 'Urgent business review required'
  FROM y WHERE change < -20
UNION ALL SELECT 4, 'WARNING', 'Revenue Softening', printf('Revenue declined by %.1f%%', abs(change)), 'Investigate market conditions'
  FROM y WHERE change >= -20 AND change < -10
UNION ALL SELECT 5, 'WARNING', 'Data Anomalies Detected', printf('%d extreme outliers found in transaction data', anomalies),
  'Investigate unusual transactions' FROM y WHERE anomalies > 0
UNION ALL SELECT 6, 'CRITICAL', 'Customer Concentration Risk', printf('Top customer represents %.1f%% of revenue', share),
  'Diversify customer base urgently' FROM y WHERE share > 50
UNION ALL SELECT 7, 'WARNING', 'High Customer Dependency', printf('Top customer represents %.1f%% of revenue', share),
  'Consider customer diversification' FROM y WHERE share > 30 AND share <= 50"""
_Y = (("fin", "SELECT round(sum(current_assets) / sum(current_liabilities), 2) AS r FROM fx_finance"), ("y", "SELECT x.*, r FROM x, fin"))


def WSF(body, ctes=()):
    return W(body, "fx_sales", "fx_finance", ctes=tuple(ctes))


@register("B47_early_warnings", WSF(_ALERTS_SQL, ctes=_ALERT_CTES + _Y))
def q_b47(spark, sf):
    return _alerts(spark, sf)


_DIMENSIONS = ["category", "product", "amount", "cost", "order_date"]


@register("B48_benchmarks", WS(f"""
SELECT {S('v', 'revenue_per_record')}, {S('f', 'completeness')}, 5 AS dimensions,
  CASE WHEN v >= 1000 THEN 'High Performer' WHEN v >= 500 THEN 'Average Performer' ELSE 'Below Average' END AS revenue_tier,
  CASE WHEN v >= 750 THEN 'Above median' ELSE 'Below median' END AS industry_comparison,
  CASE WHEN f >= 95 THEN 'Excellent' WHEN f >= 85 THEN 'Good' ELSE 'Needs Improvement' END AS completeness_tier,
  CASE WHEN f >= 95 THEN 'Enterprise Grade' WHEN f >= 85 THEN 'Business Grade' ELSE 'Basic Grade' END AS compliance_level,
  'Mid-Market' AS dimension_tier, 'Intermediate' AS analytics_readiness
FROM (SELECT avg(amount) AS v, {_FULL} AS f FROM fx_sales)"""))
def q_b48(spark, sf):
    return round_doubles(AL.benchmarks(sales(spark, sf), "amount", _DIMENSIONS))


@register("B49_sector_ranking", WS(f"""
SELECT sector, {S('revenue')}, {S('average')}, records, {S('share')}, CAST(rk AS INTEGER) AS rank,
  CASE WHEN rk = 1 THEN 'Leader' WHEN rk <= 3 THEN 'Strong' ELSE 'Developing' END AS tier,
  CASE WHEN rk > k - 3 AND share < 5 THEN CASE WHEN average > (SELECT quantile_cont(average, 0.5) FROM g) THEN 'High' ELSE 'Medium' END END
    AS growth_potential
FROM (SELECT *, revenue / sum(revenue) OVER () * 100 AS share, row_number() OVER (ORDER BY revenue DESC, sector) AS rk,
  count(*) OVER () AS k FROM g)""", ctes=(
    ("g", "SELECT product || ' ' || category AS sector, sum(amount) AS revenue, avg(amount) AS average, count(amount) AS records "
          "FROM fx_sales WHERE category IS NOT NULL AND product IS NOT NULL GROUP BY 1"),)))
def q_b49(spark, sf):
    df = sales(spark, sf).select(F.concat("product", F.lit(" "), "category").alias("sector"), "amount")
    return round_doubles(AL.sector_ranking(df, "sector", "amount"))


_RISK = (("r", f"SELECT (SELECT max(s) / sum(s) * 100 FROM (SELECT sum(amount) AS s FROM fx_sales WHERE category IS NOT NULL GROUP BY category)) "
               f"AS c, {_MISS} AS miss FROM fx_sales"),
         ("p", "SELECT *, CASE WHEN c > 70 THEN 30 ELSE 0 END + CASE WHEN miss > 20 THEN 20 ELSE 0 END AS points FROM r"))


@register("B50_risk_assessment", WS(f"""
SELECT {S('c', 'category_concentration')}, {S('miss', 'missing_pct')}, {len(_SC)} AS columns, points AS risk_points,
  CASE WHEN points >= 50 THEN 'High' WHEN points >= 25 THEN 'Medium' ELSE 'Low' END AS risk_level FROM p""", ctes=_RISK))
def q_b50(spark, sf):
    return round_doubles(AL.risk_assessment(sales(spark, sf), "category", "amount"))


def _risky(spark, sf):
    """All sales, one category but for urgent orders, most other columns emptied: every risk factor that data can have."""
    s = sales(spark, sf)
    return s.select(F.when(F.col("category") == "1-URGENT", "urgent").otherwise("rest").alias("category"), "amount",
                    F.when(F.col("rating") == 1, F.col("rating")).alias("rating"))


@register("B50_risk_factors", WS("""
SELECT 'High' AS severity, 'Revenue Concentration' AS type, printf('Over-dependence on single category (%.1f%%)', c) AS description,
  'Business vulnerability to category-specific downturns' AS impact,
  'Diversify product/service portfolio across multiple categories' AS mitigation FROM r WHERE c > 70
UNION ALL SELECT CASE WHEN miss < 40 THEN 'Medium' ELSE 'High' END, 'Data Quality', printf('High missing data rate (%.1f%%)', miss),
  'Unreliable analytics and decision-making', 'Implement data quality controls and validation processes' FROM r WHERE miss > 20""", ctes=(
    ("s", "SELECT CASE WHEN category = '1-URGENT' THEN 'urgent' ELSE 'rest' END AS category, amount, CASE WHEN rating = 1 THEN rating END AS rating "
          "FROM fx_sales"),
    ("r", "SELECT (SELECT max(t) / sum(t) * 100 FROM (SELECT sum(amount) AS t FROM s GROUP BY category)) AS c, "
          "100 - (count(category) + count(amount) + count(rating)) * 100.0 / (count(*) * 3) AS miss FROM s"))))
def q_b50f(spark, sf):
    return AL.risk_factors(_risky(spark, sf), "category", "amount")


@register("B51_value_concentration", WS(f"""
SELECT {S('share', 'top_share')}, {S('rows_pct', 'top_rows_pct')},
  CASE WHEN share >= 80 THEN 'High' WHEN share >= 60 THEN 'Moderate' ELSE 'Well distributed' END AS concentration
FROM (SELECT CASE WHEN sum(amount) > 0 THEN sum(CASE WHEN amount >= q80 THEN amount ELSE 0.0 END) / sum(amount) * 100 ELSE 0.0 END AS share,
  sum(CASE WHEN amount >= q80 THEN 1 ELSE 0 END) * 100.0 / count(*) AS rows_pct
  FROM fx_sales, (SELECT quantile_cont(amount, 0.8) AS q80 FROM fx_sales) WHERE amount IS NOT NULL)"""))
def q_b51(spark, sf):
    return round_doubles(AL.value_concentration(sales(spark, sf), "amount"))


@register("B51_value_concentration_losses", WF(f"""
SELECT {S('0.0', 'top_share')}, {S('sum(CASE WHEN loss >= q80 THEN 1 ELSE 0 END) * 100.0 / count(*)', 'top_rows_pct')},
  'Well distributed' AS concentration
FROM (SELECT -abs(net_income) AS loss FROM fx_finance), (SELECT quantile_cont(-abs(net_income), 0.8) AS q80 FROM fx_finance)"""))
def q_b51l(spark, sf):
    """A total that isn't positive gives a share of 0."""
    return round_doubles(AL.value_concentration(fin(spark, sf).select((-F.abs("net_income")).alias("loss")), "loss"))


@register("B52_growth_indicator", WS(f"""
SELECT {S('l', 'last_month')}, {S('p', 'previous_month')}, {S('(l - p) / p * 100', 'growth_pct')},
  CASE WHEN p IS NULL THEN 'Insufficient data' WHEN (l - p) / p * 100 > 5 THEN 'Increasing' WHEN (l - p) / p * 100 > -5 THEN 'Stable' ELSE 'Decreasing' END AS indicator
FROM (SELECT (SELECT s FROM mo WHERE month = (SELECT max(month) FROM mo)) AS l,
  (SELECT arg_max(s, month) FROM mo WHERE month < (SELECT max(month) FROM mo)) AS p)""", ctes=(
    ("mo", f"SELECT {MONTH} AS month, sum(amount) AS s FROM fx_sales WHERE order_date IS NOT NULL GROUP BY 1"),)))
def q_b52(spark, sf):
    return round_doubles(AL.growth_indicator(sales(spark, sf), "amount", "order_date"))


@register("B52_growth_indicator_few_months", f"""
SELECT {S('l', 'last_month')}, {S('p', 'previous_month')}, {S('(l - p) / p * 100', 'growth_pct')},
  CASE WHEN p IS NULL THEN 'Insufficient data' WHEN (l - p) / p * 100 > 5 THEN 'Increasing' WHEN (l - p) / p * 100 > -5 THEN 'Stable'
    ELSE 'Decreasing' END AS indicator
FROM (SELECT count(*) * 95.0 AS l, count(*) * 100.0 AS p FROM orders UNION ALL SELECT count(*) * 1.0, NULL FROM orders)""")
def q_b52f(spark, sf):
    """Exactly -5 % is a decrease; one month alone says nothing."""
    o = load(spark, sf, "orders")
    one = o.select(F.lit("1995-02-01").cast("date").alias("d"), F.lit(1.0).alias("a"))
    two = o.select(F.explode(F.array(F.struct(F.lit("1995-02-01").cast("date").alias("d"), F.lit(95.0).alias("a")),
                                     F.struct(F.lit("1995-01-01").cast("date").alias("d"), F.lit(100.0).alias("a")))).alias("x")).select("x.*")
    return round_doubles(AL.growth_indicator(two, "a", "d").unionByName(AL.growth_indicator(one, "a", "d")))


_RS = (("al", _ALERTS_SQL), ("rs", "SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning FROM al"),
       ("rk", "SELECT *, CAST(least(100, critical * 30 + warning * 15) AS BIGINT) AS risk_score FROM rs"))


@register("B53_risk_score", WSF("SELECT * FROM rk", ctes=_ALERT_CTES + _Y + _RS))
def q_b53(spark, sf):
    return AL.risk_score(_alerts(spark, sf))


def _metrics(spark, sf):
    """Financial metrics by entity, as rows (name, value)."""
    f = fin(spark, sf)
    one = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (
        ("current_ratio", F.try_divide("current_assets", "current_liabilities")), ("net_margin", F.try_divide("net_income", "revenue") * 100),
        ("roe", F.try_divide("net_income", "equity") * 100), ("asset_turnover", F.try_divide("revenue", "total_assets")))])
    return f.select(F.explode(one).alias("m")).select("m.*")


_SCORE = (
    ("mt", "SELECT unnest([{'n': 'current_ratio', 'v': current_assets / nullif(current_liabilities, 0)}, {'n': 'net_margin', 'v': net_income / nullif(revenue, 0) * 100}, "
           "{'n': 'roe', 'v': net_income / nullif(equity, 0) * 100}, {'n': 'asset_turnover', 'v': revenue / nullif(total_assets, 0)}]) AS m FROM fx_finance"),
    ("ms", "SELECT CASE WHEN m.n = 'current_ratio' THEN CASE WHEN m.v >= 2 THEN 100 WHEN m.v >= 1.5 THEN 80 WHEN m.v >= 1 THEN 60 ELSE 30 END "
           "WHEN m.n = 'net_margin' THEN CASE WHEN m.v >= 20 THEN 100 WHEN m.v >= 15 THEN 80 WHEN m.v >= 10 THEN 60 WHEN m.v >= 5 THEN 40 ELSE 20 END "
           "WHEN m.n = 'roe' THEN CASE WHEN m.v >= 15 THEN 100 WHEN m.v >= 10 THEN 80 WHEN m.v >= 5 THEN 60 ELSE 40 END ELSE 70 END AS points "
           "FROM mt WHERE m.v IS NOT NULL"),
    ("sc0", "SELECT round(avg(points), 1) AS overall_score, count(*) AS metrics_analyzed FROM ms"),
    ("sc", f"SELECT {S('overall_score')}, CASE WHEN overall_score >= 90 THEN 'A+' WHEN overall_score >= 85 THEN 'A' WHEN overall_score >= 80 THEN 'A-' "
           "WHEN overall_score >= 75 THEN 'B+' WHEN overall_score >= 70 THEN 'B' WHEN overall_score >= 65 THEN 'B-' WHEN overall_score >= 60 THEN 'C+' "
           "WHEN overall_score >= 55 THEN 'C' ELSE 'D' END AS performance_grade, metrics_analyzed, CASE WHEN overall_score >= 75 THEN "
           "'Above Industry Average' WHEN overall_score >= 60 THEN 'Industry Average' ELSE 'Below Industry Average' END AS benchmark_comparison FROM sc0"))


@register("B53_performance_scorecard", WF("SELECT * FROM sc", ctes=_SCORE))
def q_b53p(spark, sf):
    return round_doubles(AL.performance_scorecard(_metrics(spark, sf)))


@register("B54_executive_summary", WSF(f"""
SELECT records, {S('completeness')}, {S('total_value')}, {S('average_transaction')}, rk.*, {S('top_share')},
  CASE WHEN top_share >= 80 THEN 'High' WHEN top_share >= 60 THEN 'Moderate' ELSE 'Well distributed' END AS concentration, {S('growth_pct')},
  CASE WHEN growth_pct > 5 THEN 'Increasing' WHEN growth_pct > -5 THEN 'Stable' ELSE 'Decreasing' END AS indicator, sc.*,
  CASE WHEN critical > 0 THEN 'HIGH' WHEN warning > 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, 5 AS dimensions,
  CASE WHEN completeness >= 95 THEN 'A' WHEN completeness >= 85 THEN 'B' ELSE 'C' END AS data_quality_grade,
  list_filter([CASE WHEN total_value > 1000000 THEN 'High-value dataset with significant financial impact' END,
    CASE WHEN average_transaction > 1000 THEN 'Premium transaction profile indicates quality customer base' END], lambda v: v IS NOT NULL) AS key_findings
FROM rk, sc, (SELECT count(*) AS records, {_FULL} AS completeness, sum(amount) AS total_value, avg(amount) AS average_transaction FROM fx_sales),
  (SELECT sum(CASE WHEN amount >= q THEN amount ELSE 0.0 END) / sum(amount) * 100 AS top_share
   FROM fx_sales, (SELECT quantile_cont(amount, 0.8) AS q FROM fx_sales) WHERE amount IS NOT NULL),
  (SELECT (last(s ORDER BY month) - list(s ORDER BY month)[-2]) / list(s ORDER BY month)[-2] * 100 AS growth_pct FROM mo)""",
    ctes=_ALERT_CTES + _Y + _RS + _SCORE + (
        ("mo", f"SELECT {MONTH} AS month, sum(amount) AS s FROM fx_sales WHERE order_date IS NOT NULL GROUP BY 1"),)))
def q_b54(spark, sf):
    s = sales(spark, sf)
    return round_doubles(AL.executive_summary(s, "amount", _DIMENSIONS, _alerts(spark, sf), AL.value_concentration(s, "amount"),
                                              AL.growth_indicator(s, "amount", "order_date"), AL.performance_scorecard(_metrics(spark, sf))))


@register("B56_kpi_scorecard", WS(f"""
SELECT kpi, {S('value')}, unit, interpretation, CASE WHEN regexp_matches(lower(interpretation), 'excellent|good|strong') THEN 'green'
  WHEN regexp_matches(lower(interpretation), 'concerning|poor|critical') THEN 'red' ELSE 'orange' END AS status
FROM (SELECT 'total_revenue' AS kpi, (SELECT sum(amount) FROM fx_sales) AS value, '$' AS unit, 'Unknown' AS interpretation
  UNION ALL SELECT 'retention_rate', r, '%', CASE WHEN r >= 80 THEN 'Excellent' WHEN r >= 60 THEN 'Good' ELSE 'Needs Improvement' END FROM x
  UNION ALL SELECT 'churn_rate', 100 - r, '%', CASE WHEN 100 - r <= 20 THEN 'Good' WHEN 100 - r >= 40 THEN 'Concerning' ELSE 'Moderate' END FROM x)""",
    ctes=(("x", "SELECT sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) * 100.0 / count(*) AS r FROM (SELECT count(*) AS n FROM fx_sales "
                "WHERE customer_id IS NOT NULL GROUP BY customer_id)"),)))
def q_b56(spark, sf):
    s = sales(spark, sf)
    k = attach(CU.retention(s, "customer_id", "order_date"), FI.financial_kpis(s, "amount").select("total_revenue"))
    return round_doubles(AL.kpi_scorecard(k, {"total_revenue": "$", "retention_rate": "%", "churn_rate": "%"},
                                          {"retention_rate": "retention_band", "churn_rate": "churn_band"}))


_PROFILES = ("p", " UNION ALL ".join(
    f"SELECT '{n}' AS d, count(*)::DOUBLE AS records, {_COLUMNS.format(c=c)}::DOUBLE AS columns, {k}.0::DOUBLE AS amount_columns, "
    f"{k}.0::DOUBLE AS category_columns, sum(amount) AS revenue, avg(amount) AS average_transaction, "
    f"count(DISTINCT customer_id)::DOUBLE AS customers, count(DISTINCT product)::DOUBLE AS products FROM fx_sales WHERE {y}"
    for n, y, c, k in (("early", _HALF_A, _EARLY, 1), ("late", _HALF_B, _LATE, 2))))
_DIFFS = ("df", " UNION ALL ".join(
    f"SELECT '{c}' AS measure, a.{c} AS dataset_a, b.{c} AS dataset_b, b.{c} - a.{c} AS difference, "
    f"CASE WHEN a.{c} > 0 THEN (b.{c} - a.{c}) / a.{c} * 100 ELSE 0.0 END AS growth_rate "
    f"FROM (FROM p WHERE d = 'early') a, (FROM p WHERE d = 'late') b"
    for c in ("records", "columns", "amount_columns", "category_columns", "revenue", "average_transaction", "customers", "products")))


def _differences(spark, sf):
    return AL.dataset_differences(_compared(spark, sf), "early", "late")


@register("B36_differences", WS(f"SELECT measure, {S('dataset_a')}, {S('dataset_b')}, {S('difference')}, {S('growth_rate')} FROM df",
                                ctes=(_PROFILES, _DIFFS)))
def q_b36d(spark, sf):
    return round_doubles(_differences(spark, sf))


@register("B36_sentences", WS("""
SELECT measure, CASE measure WHEN 'records' THEN printf(CASE WHEN difference > 0 THEN 'Dataset B has %.1f%% more records than Dataset A'
    ELSE 'Dataset B has %.1f%% fewer records than Dataset A' END, abs(growth_rate))
  ELSE printf(CASE WHEN difference > 0 THEN 'Revenue increased by %.1f%% in Dataset B' ELSE 'Revenue decreased by %.1f%% in Dataset B' END,
    abs(growth_rate)) END AS sentence
FROM df WHERE measure IN ('records', 'revenue') AND difference <> 0
UNION ALL SELECT 'dimensions', printf('Dataset B has more business dimensions (%.0f vs %.0f)', sum(dataset_b), sum(dataset_a))
FROM df WHERE measure IN ('amount_columns', 'category_columns') HAVING sum(difference) > 0""", ctes=(_PROFILES, _DIFFS)))
def q_b36s(spark, sf):
    return AL.comparison_sentences(_differences(spark, sf))


@register("B57_two_dataset_monthly", WS(f"""
SELECT coalesce(a.month, b.month) AS month, {S('coalesce(a.s, 0.0)', 'revenue_a')}, {S('coalesce(b.s, 0.0)', 'revenue_b')}
FROM (SELECT {MONTH} AS month, sum(amount) AS s FROM fx_sales WHERE {_HALF_A} GROUP BY 1) a
FULL JOIN (SELECT {MONTH} AS month, sum(amount) AS s FROM fx_sales WHERE {_HALF_B} GROUP BY 1) b
ON a.month = b.month"""))
def q_b57m(spark, sf):
    a, b = _halves(spark, sf)
    return round_doubles(AL.two_dataset_monthly(a, b, "amount", "order_date"))


@register("B57_two_dataset_categories", WS(f"""
SELECT coalesce(a.category, b.category) AS category, {S('coalesce(a.s, 0.0)', 'revenue_a')}, {S('coalesce(b.s, 0.0)', 'revenue_b')}
FROM (SELECT category, sum(amount) AS s FROM fx_sales WHERE {_HALF_A} AND category IS NOT NULL GROUP BY 1) a
FULL JOIN (SELECT category, sum(amount) AS s FROM fx_sales WHERE {_HALF_B} AND category IS NOT NULL GROUP BY 1) b
ON a.category = b.category"""))
def q_b57c(spark, sf):
    a, b = _halves(spark, sf)
    return round_doubles(AL.two_dataset_categories(a, b, "category", "amount"))
