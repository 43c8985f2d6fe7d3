"""Queries for column types (A5/A6, A16), box-plot feeds (A23), table overview (A19), business overview (B6),
quality comparison (Q14) and issue counts (Q15)."""

from __future__ import annotations

from ..operators import profile as P
from ..operators import quality as Q
from ..operators.business import sales as SA
from ..sources.fixtures import fixture
from ..sources.tables import load
from .common import round_doubles, sig
from .q_profile import LI_NUM, NULL_COLS, W
from .q_quality import _CONV, _DATE_SQL, _OUTL, _REPORT_CTES, _TYPES, _VALID
from .registry import register


def S(x, alias=None):
    return f"{sig(x)} AS {alias or x}"


def _smallest(c: str, table: str) -> str:
    return f"(SELECT list(v ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {table} WHERE {c} IS NOT NULL ORDER BY v LIMIT 3))"


def _types_sql(k: int, c: str, kind: str) -> str:
    """A5/A6 of one column of fx_nulls."""
    v = f"CAST({c} AS VARCHAR)"
    text = f"""CASE WHEN bool_and({c} IS NULL OR TRY_CAST({v} AS DOUBLE) IS NOT NULL) THEN 'numeric'
      WHEN bool_and({c} IS NULL OR {_DATE_SQL.replace("(v,", f"({v},")} IS NOT NULL) THEN 'datetime'
      WHEN count(DISTINCT {c}) * 1.0 / count(*) < 0.1 AND count(DISTINCT {c}) < 50 THEN 'categorical' ELSE 'text' END"""
    return f"""SELECT {k} AS position, '{c}' AS "column", '{kind}' AS current_type, count(DISTINCT {c}) AS unique_values,
  CAST(count(*) - count({c}) AS BIGINT) AS null_values, CASE WHEN (count(*) - count({c})) * 1.0 / count(*) > 0.5
    THEN 'High null percentage - consider data cleaning' ELSE {text if kind == 'string' else "'numeric'"} END AS recommended_type,
  {_smallest(c, 'fx_nulls')} AS sample_values FROM fx_nulls"""


@register("A5_A6_data_types", W(" UNION ALL ".join(_types_sql(k, c, _TYPES.get(c, "string")) for k, c in enumerate(NULL_COLS)), "fx_nulls"))
def q_a5(spark, sf):
    return P.data_types(fixture(spark, sf, "fx_nulls").select(*NULL_COLS))


_ORDERS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
           ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@register("A16_column_info", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS current_type, CAST(count(*) - count({c}) AS BIGINT) AS null_values,
  count(DISTINCT {c}) AS unique_values, {_smallest(c, 'orders')} AS sample_values FROM orders""" for c, t in _ORDERS))
def q_a16(spark, sf):
    return P.data_types(load(spark, sf, "orders")).select("column", "current_type", "null_values", "unique_values",
                                                          "sample_values")


_LI = LI_NUM


@register("A23_box_stats", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", {S(f'min({c} + 0.0)', 'min')}, {S(f'max({c} + 0.0)', 'max')},
  {S(f'quantile_cont({c} + 0.0, 0.25)', 'q1')}, {S(f'quantile_cont({c} + 0.0, 0.5)', 'median')},
  {S(f'quantile_cont({c} + 0.0, 0.75)', 'q3')},
  {S(f'quantile_cont({c} + 0.0, 0.25) - 1.5 * (quantile_cont({c} + 0.0, 0.75) - quantile_cont({c} + 0.0, 0.25))', 'lower_fence')},
  {S(f'quantile_cont({c} + 0.0, 0.75) + 1.5 * (quantile_cont({c} + 0.0, 0.75) - quantile_cont({c} + 0.0, 0.25))', 'upper_fence')}
FROM lineitem""" for c in _LI))
def q_a23(spark, sf):
    return round_doubles(P.box_stats(load(spark, sf, "lineitem"), _LI))


@register("A23_outlier_points", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", {S(f'{c} + 0.0', 'value')} FROM lineitem,
  (SELECT quantile_cont({c} + 0.0, 0.25) AS q1, quantile_cont({c} + 0.0, 0.75) AS q3 FROM lineitem)
WHERE {c} + 0.0 < q1 - 1.5 * (q3 - q1) OR {c} + 0.0 > q3 + 1.5 * (q3 - q1)""" for c in _LI))
def q_a23o(spark, sf):
    return round_doubles(P.outlier_points(load(spark, sf, "lineitem"), _LI))


def _overview_sql(other: str, cells_b: str, classes_b: str, overlap: float, share: str, mismatches: str) -> str:
    """A19 of fx_sample_a against another table: its non-null cells, type counts and overlap are given."""
    return W(f"""
SELECT na AS rows_a, nb AS rows_b, 4 AS numeric_a, 0 AS text_a, 0 AS date_a, {classes_b}, {S(f'{overlap}', 'column_overlap')},
  {S('(nb - na) * 100.0 / na', 'row_gap')}, {S('mb - ma', 'missing_gap')}, '{mismatches}' AS type_mismatches,
  concat_ws('; ', CASE WHEN nb > na THEN format('B has {{:,}} more rows than A', nb - na) WHEN nb < na THEN format('A has {{:,}} more rows than B', na - nb)
      ELSE format('Both datasets have the same number of rows ({{:,}})', na) END,
    CASE WHEN mb - ma > 5 THEN printf('B has significantly more missing data (%+.1f%%)', mb - ma)
      WHEN mb - ma < -5 THEN printf('A has significantly more missing data (%.1f%%)', ma - mb) END,
    '{share}') AS insights,
  coalesce(nullif(concat_ws('; ', CASE WHEN '{mismatches}' <> '' THEN '{P.TYPE_ALIGNMENT}' END, CASE WHEN abs(mb - ma) > 10 THEN '{P.DATA_QUALITY}' END,
    CASE WHEN {overlap} < 50 THEN '{P.SCHEMA_REVIEW}' END, CASE WHEN abs(nb - na) > na * 0.1 THEN '{P.SIZE_DISPARITY}' END), ''),
    '{P.WELL_ALIGNED}') AS recommendations
FROM (SELECT count(*) AS na, 100.0 - (count(quantity) + count(price) + count(discount) + count(tax)) * 100.0 / (count(*) * 4) AS ma FROM fx_sample_a),
  (SELECT count(*) AS nb, 100.0 - {cells_b} AS mb FROM {other})""", "fx_sample_a", other)


@register("A19_overview_alignment", _overview_sql(
    "fx_sample_r", "(count(quantity) + count(price) + count(discount) + count(tax)) * 100.0 / (count(*) * 4)",
    "4 AS numeric_b, 0 AS text_b, 0 AS date_b", 100.0, "Column overlap: 100.0% (4 of 4 total unique columns)", ""))
def q_a19(spark, sf):
    return round_doubles(P.overview_alignment(fixture(spark, sf, "fx_sample_a"), fixture(spark, sf, "fx_sample_r")))


@register("A19_overview_alignment_unlike", _overview_sql(
    "fx_sample_odd", "(count(quantity) + count(price) + count(flag) + count(shipdate) + count(linestatus) + count(supplier) + count(part)) "
    "* 100.0 / (count(*) * 7)", "3 AS numeric_b, 3 AS text_b, 1 AS date_b", 2 / 9 * 100,
    "Column overlap: 22.2% (2 of 9 total unique columns)", "quantity"))
def q_a19u(spark, sf):
    """Types that differ, many missing values, little overlap."""
    return round_doubles(P.overview_alignment(fixture(spark, sf, "fx_sample_a"), fixture(spark, sf, "fx_sample_odd")))


@register("A18_dataset_diff_unlike", W(f"""
SELECT 'A' AS dataset_a, 'B' AS dataset_b, na AS rows_a, nb AS rows_b, nb - na AS row_difference, CAST(3 AS BIGINT) AS column_difference,
  {S('(nb * 7) / (na * 4.0)', 'size_ratio')}, {S('mb - ma', 'missing_difference')}
FROM (SELECT count(*) AS na, 100.0 - (count(quantity) + count(price) + count(discount) + count(tax)) * 100.0 / (count(*) * 4) AS ma FROM fx_sample_a),
  (SELECT count(*) AS nb, 100.0 - (count(quantity) + count(price) + count(flag) + count(shipdate) + count(linestatus) + count(supplier)
    + count(part)) * 100.0 / (count(*) * 7) AS mb FROM fx_sample_odd)""", "fx_sample_a", "fx_sample_odd"))
def q_a18u(spark, sf):
    return round_doubles(P.dataset_diff(fixture(spark, sf, "fx_sample_a"), fixture(spark, sf, "fx_sample_odd")))


@register("B6_date_ranges", W("""
SELECT 'order_date' AS "column", CAST(min(order_date) AS DATE) AS start_date, CAST(max(order_date) AS DATE) AS end_date,
  CAST(datediff('day', CAST(min(order_date) AS DATE), CAST(max(order_date) AS DATE)) AS INTEGER) AS duration_days,
  count(order_date) AS data_points FROM fx_sales""", "fx_sales"))
def q_b6(spark, sf):
    return SA.date_ranges(fixture(spark, sf, "fx_sales"), ["order_date"])


@register("B6_key_insights", W(" UNION ALL ".join(
    [f"SELECT {k} AS position, printf('Total {c}: %.2f | Average: %.2f', sum({c}), avg({c})) AS insight FROM fx_sales" for k, c in enumerate(("amount", "cost"))]
    + [f"SELECT {k}, (SELECT printf('Top {c}: %s (%d records)', v, n) FROM (SELECT {c} AS v, count(*) AS n FROM fx_sales WHERE {c} IS NOT NULL "
       f"GROUP BY 1 ORDER BY n DESC, v LIMIT 1))" for k, c in ((2, "category"), (3, "product"))]
    + ["SELECT 4, printf('Average rating: %.2f', avg(rating)) FROM fx_sales", "SELECT 5, 'Data spans 1 time dimension(s)'"]), "fx_sales"))
def q_b6i(spark, sf):
    return SA.key_insights(fixture(spark, sf, "fx_sales"), ["amount", "cost"], ["category", "product"], ["rating"], 1)


_Q14_TEXTS = [
    ("least(ma, mb) < 80", "High", "Missing Data",
     "'Both datasets have significant missing data. Consider data collection improvements or imputation strategies.'"),
    ("least(da, db) < 90", "Medium", "Duplicates", "'Implement data deduplication processes before analysis.'"),
    ("least(ta, tb) < 85", "Medium", "Data Types", "'Standardize data entry formats and implement type validation.'"),
    ("oa - ob > 20", "Medium", "Quality Gap",
     "printf('nulls has significantly better quality (%.1f) than keys (%.1f). Focus improvement efforts on keys.', oa, ob)"),
    ("ob - oa > 20", "Medium", "Quality Gap",
     "printf('keys has significantly better quality (%.1f) than nulls (%.1f). Focus improvement efforts on nulls.', ob, oa)"),
]


@register("Q14_quality_comparison", W(" UNION ALL ".join(
    f"""SELECT {', '.join(f"{sig(f'{v}{t}')} AS {c}_{t}" for t in 'ab' for c, v in (('missing_data_score', 'm'), ('duplicate_score', 'd'),
      ('data_type_score', 't'), ('overall_quality_score', 'o')))}, {n} AS rule_no, '{p}' AS priority, '{g}' AS category, {m} AS message
    FROM c WHERE {cond}""" for n, (cond, p, g, m) in enumerate(_Q14_TEXTS, 1)), "fx_nulls", ctes=_REPORT_CTES + (
        ("a", "SELECT round(ms, 1) AS ma, round(ds, 1) AS da, round(tsc, 1) AS ta, round((ms + ds + tsc) / 3, 1) AS oa FROM rep"),
        ("k", "SELECT 100.0 - 10.0 * (SELECT count(*) FROM outl WHERE \"column\" IN ('grp', 'src_order') AND oc > 0) AS t"),
        ("c", "SELECT a.*, 100.0::DOUBLE AS mb, 100.0::DOUBLE AS db, t::DOUBLE AS tb, round((200.0 + t) / 3, 1)::DOUBLE AS ob FROM a, k"))))
def q_q14(spark, sf):
    """Q14: fx_nulls against its two key columns alone, which have no quality problem."""
    df = fixture(spark, sf, "fx_nulls").select(*NULL_COLS)
    return round_doubles(Q.compare_quality(df, df.select("grp", "src_order"), "nulls", "keys"))


@register("Q15_issue_counts", W("""
SELECT "column", CASE WHEN current_type = 'string' THEN 'text' ELSE 'numeric' END AS type_class,
  CAST(len(issues) AS INTEGER) AS issue_count FROM valid""", "fx_nulls", ctes=(("conv", _CONV), ("outl", _OUTL), ("valid", _VALID))))
def q_q15(spark, sf):
    return Q.issue_counts(Q.type_validation(fixture(spark, sf, "fx_nulls").select(*NULL_COLS)))


@register("A13_H5_kendall_customer", f"""
WITH p AS (SELECT c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer
  WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL),
pr AS (SELECT sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN 1 ELSE 0 END) / 2 AS nc,
  sum(CASE WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN 1 ELSE 0 END) / 2 AS nd FROM p a, p b),
t AS (SELECT (SELECT count(*) FROM p) AS n,
  (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM p GROUP BY x)) AS nx,
  (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM p GROUP BY y)) AS ny)
SELECT n, CAST(nc AS BIGINT) AS concordant, CAST(nd AS BIGINT) AS discordant,
  {S('(nc - nd) / sqrt((n * (n - 1) / 2 - nx) * (n * (n - 1) / 2 - ny))', 'tau_b')} FROM pr, t""")
def q_kendall(spark, sf):
    """Kendall tau-b of account balance against nation key (exact, no pair enumeration)."""
    from ..operators.kendall import kendall_tau_b
    return round_doubles(kendall_tau_b(load(spark, sf, "customer"), "c_acctbal", "c_nationkey"))


_KENDALL_COLS = ["c_custkey", "c_nationkey", "c_acctbal"]


@register("A13_kendall_matrix_customer", " UNION ALL ".join(f"""
SELECT '{a}' AS col_a, '{b}' AS col_b, {S('(sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))))', 'r')}
FROM (SELECT {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM customer) p, (SELECT {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM customer) q"""
    for i, a in enumerate(_KENDALL_COLS) for b in _KENDALL_COLS[i + 1:]))
def q_kendall_matrix(spark, sf):
    """Kendall tau-b of every pair of numeric columns."""
    return round_doubles(P.correlations(load(spark, sf, "customer"), _KENDALL_COLS, "kendall"))
