"""Queries for column profiling (A1-A25) on whole base tables and fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normal_scores as NS
from ..operators import profile as P
from ..sources.fixtures import FIXTURE_SQL, fixture
from ..sources.tables import load
from .common import long_sql, round_doubles, sig
from .registry import register

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NULL_COLS = ["grp", "seq", "src_order", "num", "num_text", "date_text", "flag_text", "email"]


def W(body: str, *fixtures: str, ctes=()) -> str:
    parts = [f"{n} AS ({FIXTURE_SQL[n]})" for n in fixtures] + [f"{n} AS ({s})" for n, s in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def S(x: str, alias: str | None = None) -> str:
    return f"{sig(x)} AS {alias or x}"


@register("A1_shape_lineitem", "SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns, "
                               "count(*) * 11 AS total_cells FROM lineitem")
def q_a1(spark, sf):
    return P.shape(load(spark, sf, "lineitem"))


A2_SQL = W(f"""
SELECT m."column", m.count, {S('m.mean', 'mean')}, {S('q.median', 'median')}, {S('md.mode', 'mode')},
  {S('m.std_dev', 'std_dev')}, {S('m.variance', 'variance')}, {S('m.min', 'min')}, {S('m.max', 'max')},
  {S('m.max - m.min', 'range')}, {S('q.q1', 'q1')}, {S('q.q3', 'q3')}, {S('q.q3 - q.q1', 'iqr')},
  {S('c.m3 / pow(c.m2, 1.5)', 'skewness')}, {S('c.m4 / (c.m2 * c.m2) - 3', 'kurtosis')},
  {S('CASE WHEN m.mean <> 0 THEN m.std_dev / m.mean * 100 ELSE 0.0 END', 'coefficient_of_variation')}
FROM m JOIN q USING ("column") JOIN c USING ("column") JOIN md USING ("column")""", ctes=(
    ("l", long_sql("lineitem", LI_NUM)),
    ("m", 'SELECT "column", count(*) AS count, avg(value) AS mean, stddev_samp(value) AS std_dev, '
          'var_samp(value) AS variance, min(value) AS min, max(value) AS max FROM l GROUP BY "column"'),
    ("q", 'SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, '
          'quantile_cont(value, 0.75) AS q3 FROM l GROUP BY "column"'),
    ("c", 'SELECT l."column", avg(pow(value - mean, 2)) AS m2, avg(pow(value - mean, 3)) AS m3, '
          'avg(pow(value - mean, 4)) AS m4 FROM l JOIN m USING ("column") GROUP BY l."column"'),
    ("md", 'SELECT "column", value AS mode FROM (SELECT "column", value, count(*) AS n FROM l GROUP BY ALL) '
           'QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) = 1'),
))


@register("A2_describe_lineitem", A2_SQL)
def q_a2(spark, sf):
    d = P.describe(load(spark, sf, "lineitem"), LI_NUM)
    return round_doubles(d.select("column", "count", "mean", "median", "mode", "std_dev", "variance", "min", "max",
                                  "range", "q1", "q3", "iqr", "skewness", "kurtosis", "coefficient_of_variation"))


A3_SQL = W(f"""
SELECT "column", missing_count, {S('missing_count * 100.0 / n', 'missing_percentage')}, n - missing_count AS present_count,
  {S('100.0 - missing_count * 100.0 / n', 'present_percentage')}
FROM (SELECT n, "column", missing_count FROM (
  SELECT count(*) AS n, {', '.join(f"CAST(count(*) - count({c}) AS BIGINT) AS {c}" for c in NULL_COLS)} FROM fx_nulls)
  UNPIVOT (missing_count FOR "column" IN ({', '.join(NULL_COLS)})))""", "fx_nulls")


@register("A3_missing_by_column", A3_SQL)
def q_a3(spark, sf):
    return round_doubles(P.missing(fixture(spark, sf, "fx_nulls").select(*NULL_COLS)))


_ROWN = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in NULL_COLS)
A4_SQL = W(f"""
SELECT CAST(sum(rn) AS BIGINT) AS total_missing_cells, count(*) * {len(NULL_COLS)} AS total_cells,
  {S(f'sum(rn) * 100.0 / (count(*) * {len(NULL_COLS)})', 'overall_missing_percentage')},
  CAST({' + '.join(f'max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)' for c in NULL_COLS)} AS BIGINT) AS columns_with_missing_data,
  CAST(sum(CASE WHEN rn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS complete_rows,
  CAST(count(*) - sum(CASE WHEN rn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS incomplete_rows
FROM (SELECT *, {_ROWN} AS rn FROM fx_nulls)""", "fx_nulls")


@register("A4_missing_summary", A4_SQL)
def q_a4(spark, sf):
    return round_doubles(P.missing_summary(fixture(spark, sf, "fx_nulls").select(*NULL_COLS)))


A7_SQL = W(f"""
SELECT "column", {S('lower_bound')}, {S('upper_bound')}, CAST(sum(CASE WHEN value < lower_bound OR value > upper_bound
  THEN 1 ELSE 0 END) AS BIGINT) AS outliers_count, count(DISTINCT value) AS unique_values,
  CAST(sum(CASE WHEN value = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros_count,
  CAST(sum(CASE WHEN value < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_count,
  CAST(sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_count,
  {S('sum(CASE WHEN value < lower_bound OR value > upper_bound THEN 1 ELSE 0 END) * 100.0 / count(*)', 'outliers_percentage')},
  CASE WHEN sum(CASE WHEN value < lower_bound OR value > upper_bound THEN 1 ELSE 0 END) * 100.0 / count(*) > 10 THEN 'High'
    WHEN sum(CASE WHEN value < lower_bound OR value > upper_bound THEN 1 ELSE 0 END) * 100.0 / count(*) > 5 THEN 'Medium'
    ELSE 'Low' END AS severity
FROM l JOIN b USING ("column") GROUP BY "column", lower_bound, upper_bound""", ctes=(
    ("l", long_sql("lineitem", LI_NUM)),
    ("b", 'SELECT "column", q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM '
          '(SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1)'),
))


@register("A7_outliers_lineitem", A7_SQL)
def q_a7(spark, sf):
    return round_doubles(P.outliers(load(spark, sf, "lineitem"), LI_NUM))


def _hist_sql(table, cols, bins, group=None):
    g = f"{group}, " if group else ""
    gj = f" AND g.{group} = c.{group}" if group else ""
    gsel = f"g.{group}, " if group else ""
    grid = (f"(SELECT r.*, unnest(range(0, {bins})) AS bin FROM r) g" if not group else
            f"(SELECT r.*, d.{group}, unnest(range(0, {bins})) AS bin FROM r JOIN (SELECT DISTINCT \"column\", {group} "
            f"FROM l) d USING (\"column\")) g")
    return W(f"""
SELECT g."column", {gsel}CAST(g.bin AS INTEGER) AS bin, {S(f'lo + g.bin * ((hi - lo) / {bins})', 'lower')},
  {S(f'lo + (g.bin + 1) * ((hi - lo) / {bins})', 'upper')},
  {S(f'(lo + g.bin * ((hi - lo) / {bins}) + (lo + (g.bin + 1) * ((hi - lo) / {bins}))) / 2', 'center')},
  coalesce(c.cnt, 0) AS count
FROM {grid} LEFT JOIN c ON c."column" = g."column" AND c.bin = g.bin{gj}""", ctes=(
        ("l", long_sql(table, cols, keep=group or "")),
        ("r", 'SELECT "column", CASE WHEN max(value) = min(value) THEN min(value) - 0.5 ELSE min(value) END AS lo, '
              'CASE WHEN max(value) = min(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM l GROUP BY 1'),
        ("c", f'SELECT l."column", {g.replace(group or "", "l." + group) if group else ""}'
              f'CAST(least(floor((value - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) AS bin, count(*) AS cnt '
              f'FROM l JOIN r USING ("column") GROUP BY ALL'),
    ))


@register("A9_histogram_lineitem", _hist_sql("lineitem", LI_NUM, 20))
def q_a9(spark, sf):
    return round_doubles(P.histogram(load(spark, sf, "lineitem"), LI_NUM, bins=20))


@register("A10_comparative_histogram", W(_hist_sql("s", ["price", "tax"], 30, "dataset").replace("WITH ", ", ", 1),
                                         "fx_sample_a", "fx_sample_r", ctes=(
    ("s", "SELECT 'A' AS dataset, * FROM fx_sample_a UNION ALL SELECT 'R', * FROM fx_sample_r"),)))
def q_a10(spark, sf):
    a = fixture(spark, sf, "fx_sample_a").withColumn("dataset", F.lit("A"))
    r = fixture(spark, sf, "fx_sample_r").withColumn("dataset", F.lit("R"))
    return round_doubles(P.histogram(a.unionByName(r), ["price", "tax"], bins=30, group="dataset"))


ORD_STR = ["o_orderstatus", "o_orderpriority"]
A11_SQL = W(f"""
SELECT "column", count(*) AS unique_values, arg_min(value, (-n, value)) AS most_frequent,
  CAST(max(n) AS BIGINT) AS most_frequent_count, arg_min(value, (n, value)) AS least_frequent,
  CAST(min(n) AS BIGINT) AS least_frequent_count, {S('sum(n * length(value)) * 1.0 / sum(n)', 'average_length')},
  max(length(value)) AS max_length, min(length(value)) AS min_length,
  CAST(sum(CASE WHEN trim(value) = '' THEN n ELSE 0 END) AS BIGINT) AS empty_strings
FROM (SELECT "column", value, count(*) AS n FROM l GROUP BY ALL) GROUP BY "column" """, ctes=(
    ("l", long_sql("orders", ORD_STR, cast="VARCHAR")),))


@register("A11_categorical_orders", A11_SQL)
def q_a11(spark, sf):
    return round_doubles(P.categorical(load(spark, sf, "orders"), ORD_STR))


@register("A11_top_values_orders", W(f"""
SELECT "column", value, n AS count, CAST(rk AS INTEGER) AS rank, {S('n * 100.0 / t', 'percentage')} FROM (
  SELECT "column", value, n, sum(n) OVER (PARTITION BY "column") AS t,
    row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rk
  FROM (SELECT "column", value, count(*) AS n FROM l GROUP BY ALL)) WHERE rk <= 10""", ctes=(
    ("l", long_sql("customer", ["c_mktsegment", "c_name"], cast="VARCHAR")),)))
def q_a11_top(spark, sf):
    return round_doubles(P.top_values(load(spark, sf, "customer"), ["c_mktsegment", "c_name"], k=10)
                         .select("column", "value", "count", "rank", "percentage"))


@register("A12_normality_lineitem", W(f"""
SELECT "column", n AS count, CASE WHEN n >= 8 THEN 'moment_check' ELSE 'insufficient_data' END AS test,
  {S('n / 6.0 * (s * s + k * k / 4.0)', 'jarque_bera')}, {S('exp(-(n / 6.0 * (s * s + k * k / 4.0)) / 2.0)', 'p_value')},
  n >= 8 AND abs(s) < 2 AND abs(k) < 7 AS is_normal_rule,
  n >= 8 AND exp(-(n / 6.0 * (s * s + k * k / 4.0)) / 2.0) > 0.05 AS is_normal_jb
FROM (SELECT l."column", count(*) AS n, avg(pow(value - mean, 3)) / pow(avg(pow(value - mean, 2)), 1.5) AS s,
  avg(pow(value - mean, 4)) / pow(avg(pow(value - mean, 2)), 2) - 3 AS k
  FROM l JOIN (SELECT "column", avg(value) AS mean FROM l GROUP BY 1) m USING ("column") GROUP BY l."column")""",
    ctes=(("l", long_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])),)))
def q_a12(spark, sf):
    d = P.describe(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return round_doubles(P.normality(d))


def _poly_sql(coefficients, x):
    return " + ".join(f"{c!r} * pow({x}, {k})" for k, c in enumerate(coefficients))


def _ratio_sql(parts, x):
    return f"({_poly_sql(parts[0], x)}) / ({_poly_sql(parts[1], x)})"


NORMAL_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("A12_shapiro_francia_lineitem", W(f"""
SELECT "column", count, {S('w')}, {S('(ln(1 - w) - (-1.2725 + 1.0521 * (ln(ln(count)) - ln(count)))) / '
                                     '(1.0308 - 0.26758 * (ln(ln(count)) + 2 / ln(count)))', 'z')}
FROM (SELECT "column", count(*) AS count, pow(sum((value - mean) * m), 2) / (sum(m * m) * sum(pow(value - mean, 2))) AS w
  FROM scores GROUP BY 1)""", ctes=(
    ("l", long_sql("lineitem", NORMAL_COLS)),
    ("placed", """SELECT "column", value, avg(value) OVER (PARTITION BY "column") AS mean, (row_number() OVER (PARTITION BY "column"
      ORDER BY value) - 0.375::DOUBLE) / (count(*) OVER (PARTITION BY "column") + 0.25::DOUBLE) AS p FROM l"""),
    ("tails", "SELECT *, p - 0.5::DOUBLE AS q, sqrt(-ln(least(p, 1 - p))) AS r FROM placed"),
    ("scores", f"""SELECT *, CASE WHEN abs(q) <= 0.425 THEN q * {_ratio_sql(NS.MIDDLE, '(0.180625 - q * q)')}
      WHEN r <= 5 THEN sign(q) * {_ratio_sql(NS.NEAR, '(r - 1.6)')} ELSE sign(q) * {_ratio_sql(NS.FAR, '(r - 5)')} END AS m FROM tails"""))))
def q_a12_shapiro(spark, sf):
    return round_doubles(NS.shapiro_francia(load(spark, sf, "lineitem"), NORMAL_COLS).select("column", "count", "w", "z"))


CORR_COLS = LI_NUM
_PAIRS = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]


@register("A13_pearson_lineitem", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {S(f'corr({a}, {b})', 'r')} FROM lineitem" for a, b in _PAIRS))
def q_a13(spark, sf):
    return round_doubles(P.correlations(load(spark, sf, "lineitem"), CORR_COLS))


@register("A13_spearman_orders", W(f"""
SELECT 'o_totalprice' AS col_a, 'o_custkey' AS col_b, {S('corr(rx, ry)', 'r')} FROM (
  SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS ry FROM orders)"""))
def q_a13s(spark, sf):
    return round_doubles(P.correlations(load(spark, sf, "orders"), ["o_totalprice", "o_custkey"], method="spearman"))


@register("A14_strong_pairs_lineitem", "SELECT col_a, col_b, r, strength FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {S(f'corr({a}, {b})', 'r')}, "
    f"CASE WHEN abs(corr({a}, {b})) > 0.9 THEN 'very strong' ELSE 'strong' END AS strength, "
    f"abs(corr({a}, {b})) AS ar FROM lineitem" for a, b in
    [(a, b) for i, a in enumerate(LI_NUM) for b in LI_NUM[i + 1:]]) + ") WHERE ar > 0.7")
def q_a14(spark, sf):
    c = P.correlations(load(spark, sf, "lineitem"), LI_NUM)
    return round_doubles(P.strong_pairs(c))


@register("A14_correlation_summary", "SELECT count(*) AS total_pairs, count(*) FILTER (abs(r) > 0.7) AS strong_correlations_count, "
          + S("avg(r)", "average_correlation") + " FROM (" + " UNION ALL ".join(
    f"SELECT corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(LI_NUM) for b in LI_NUM[i + 1:]) + ")")
def q_a14s(spark, sf):
    return round_doubles(P.correlation_summary(P.correlations(load(spark, sf, "lineitem"), LI_NUM)))


def _quality_sql(c: str) -> str:
    return f"""
SELECT '{c}' AS "column", {S('s', 'matching_quality')}, CASE WHEN s >= 80 THEN 'Excellent' WHEN s >= 60 THEN 'Good' ELSE 'Needs Attention' END AS band,
  CASE WHEN u = n AND z = 0 THEN ['Perfect key column - ideal for matching!'] ELSE list_filter([
    CASE WHEN np > 5 THEN 'Missing data reduces matching accuracy' END,
    CASE WHEN up < 80 THEN printf('Low uniqueness (%.1f%%) may cause multiple matches', up) END], lambda x: x IS NOT NULL) END AS issues
FROM (SELECT *, CASE WHEN u = n AND z = 0 THEN 100.0 ELSE greatest(0.0, 100 - CASE WHEN np > 5 THEN least(np, 30.0) ELSE 0.0 END
    - CASE WHEN up < 80 THEN (80 - up) * 0.5 ELSE 0.0 END) END AS s
  FROM (SELECT n, u, z, z * 100.0 / n AS np, u * 100.0 / n AS up
    FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS u, count(*) - count({c}) AS z FROM fx_nulls)))"""


_QUALITY_COLS = ["src_order", "num", "num_text", "flag_text"]


@register("A17_matching_quality", W(" UNION ALL ".join(_quality_sql(c) for c in _QUALITY_COLS), "fx_nulls"))
def q_a17m(spark, sf):
    df = fixture(spark, sf, "fx_nulls").select(*NULL_COLS)
    out = P.matching_quality(df, _QUALITY_COLS[0])
    for c in _QUALITY_COLS[1:]:
        out = out.unionByName(P.matching_quality(df, c))
    return round_doubles(out)


@register("A17_key_analysis_orders_custkey", f"""
SELECT 'o_custkey' AS "column", count(*) AS total_rows, count(DISTINCT o_custkey) AS unique_values,
  CAST(count(*) - count(o_custkey) AS BIGINT) AS null_count,
  {S('(count(*) - count(o_custkey)) * 100.0 / count(*)', 'null_percentage')},
  {S('(count(*) - count(DISTINCT o_custkey)) * 100.0 / count(*)', 'duplicate_percentage')},
  {S('''greatest(0.0, 100.0 - CASE WHEN (count(*) - count(o_custkey)) * 100.0 / count(*) > 10
     THEN least(30.0, (count(*) - count(o_custkey)) * 100.0 / count(*)) ELSE 0.0 END
   - CASE WHEN (count(*) - count(DISTINCT o_custkey)) * 100.0 / count(*) > 50
     THEN least(40.0, (count(*) - count(DISTINCT o_custkey)) * 100.0 / count(*) - 50) ELSE 0.0 END)''', 'quality_score')},
  count(DISTINCT o_custkey) = count(*) AND count(*) - count(o_custkey) = 0 AS perfect_key
FROM orders""")
def q_a17(spark, sf):
    return round_doubles(P.key_analysis(load(spark, sf, "orders"), "o_custkey"))


@register("A18_dataset_diff_samples", W(f"""
SELECT 'A' AS dataset_a, 'R' AS dataset_b, a.n AS rows_a, r.n AS rows_b, r.n - a.n AS row_difference,
  CAST(0 AS BIGINT) AS column_difference, {S('r.n * 4.0 / (a.n * 4)', 'size_ratio')},
  {S('r.m - a.m', 'missing_difference')}
FROM (SELECT count(*) AS n, (count(*) * 4 - count(quantity) - count(price) - count(discount) - count(tax)) * 100.0
  / (count(*) * 4) AS m FROM fx_sample_a) a,
 (SELECT count(*) AS n, (count(*) * 4 - count(quantity) - count(price) - count(discount) - count(tax)) * 100.0
  / (count(*) * 4) AS m FROM fx_sample_r) r""", "fx_sample_a", "fx_sample_r"))
def q_a18(spark, sf):
    return round_doubles(P.dataset_diff(fixture(spark, sf, "fx_sample_a"), fixture(spark, sf, "fx_sample_r"), "A", "R"))


@register("A20_bar_feed_sales", W(f"""
SELECT category, product, {S('sum(amount)', 'sum')}, {S('avg(amount)', 'mean')}, count(amount) AS count
FROM fx_sales WHERE category IS NOT NULL GROUP BY category, product""", "fx_sales"))
def q_a20(spark, sf):
    return round_doubles(P.bar_feed(fixture(spark, sf, "fx_sales"), "category", "amount", "product"))


@register("A21_category_feed", W(f"""
SELECT coalesce(a.category, b.category) AS category, coalesce(a.n, 0) AS count_a, {S('coalesce(a.s, 0.0)', 'share_a')},
  coalesce(b.n, 0) AS count_b, {S('coalesce(b.s, 0.0)', 'share_b')}
FROM (SELECT category, n, n * 100.0 / sum(n) OVER () AS s FROM (SELECT CAST(c_mktsegment AS VARCHAR) AS category,
  count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1) ORDER BY n DESC, category LIMIT 10) a
FULL JOIN (SELECT category, n, n * 100.0 / sum(n) OVER () AS s FROM (SELECT CAST(category AS VARCHAR) AS category,
  count(*) AS n FROM fx_sales WHERE category IS NOT NULL GROUP BY 1) ORDER BY n DESC, category LIMIT 10) b
ON a.category = b.category""", "fx_sales"))
def q_a21(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("category"))
    s = fixture(spark, sf, "fx_sales").select("category")
    return round_doubles(P.category_feed(c, s, "category"))


@register("A22_null_patterns", W("""
SELECT concat_ws('', """ + ", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in NULL_COLS) + """) AS null_mask,
  count(*) AS rows FROM fx_nulls GROUP BY 1""", "fx_nulls"))
def q_a22(spark, sf):
    return P.null_patterns(fixture(spark, sf, "fx_nulls").select(*NULL_COLS))


@register("A24_time_series_feed", W(f"""
SELECT CAST(order_date AS DATE) AS date, category, {S('sum(amount)', 'value')}, count(*) AS points
FROM fx_sales WHERE order_date IS NOT NULL GROUP BY 1, 2""", "fx_sales"))
def q_a24(spark, sf):
    return round_doubles(P.time_series_feed(fixture(spark, sf, "fx_sales"), "order_date", "amount", "category"))


@register("A25_summary_cards_nulls", W(f"""
SELECT count(*) AS rows, 8 AS columns, {S('100.0 - sum(rn) * 100.0 / (count(*) * 8)', 'completeness')},
  4 AS numeric_columns, 4 AS text_columns, 0 AS date_columns, 0 AS other_columns
FROM (SELECT {_ROWN} AS rn FROM fx_nulls)""", "fx_nulls"))
def q_a25(spark, sf):
    return round_doubles(P.summary_cards(fixture(spark, sf, "fx_nulls").select(*NULL_COLS)))
