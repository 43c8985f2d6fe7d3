"""Queries for consolidation (C1-C6, J8) and historical period comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consolidate as C
from ..operators import periods as T
from ..sources.fixtures import fixture
from ..sources.tables import load
from .common import round_doubles, sig
from .q_profile import W
from .registry import register


def S(x, alias=None):
    return f"{sig(x)} AS {alias or x}"


def cons_tables(spark, sf):
    return {"customers": fixture(spark, sf, "fx_cons_customer"), "suppliers": fixture(spark, sf, "fx_cons_supplier")}


def nation_tables(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return {"customer_nations": c, "supplier_nations": s}


WC = ("fx_cons_customer", "fx_cons_supplier")


_C1 = (("a", "SELECT count(*) AS n, count(key) AS key, count(name) AS name, count(balance) AS balance, count(segment) AS segment FROM fx_cons_customer"),
       ("b", "SELECT count(*) AS n, count(key) AS key, count(name) AS name, count(balance) AS balance FROM fx_cons_supplier"),
       ("c", " UNION ALL ".join(
           f"SELECT {k} AS position, '{c}' AS \"column\", 2 AS tables, true AS is_common, 'customers;suppliers' AS present_in, '{t};{t}' AS types, "
           f"false AS type_mismatch, CAST(a.n + b.n AS BIGINT) AS rows, CAST(a.{c} + b.{c} AS BIGINT) AS \"values\" FROM a, b"
           for k, (c, t) in enumerate((("key", "bigint"), ("name", "string"), ("balance", "double"))))
        + " UNION ALL SELECT 3, 'segment', 1, false, 'customers', 'string', false, CAST(n AS BIGINT), CAST(segment AS BIGINT) FROM a"))


@register("C1_schema_analysis", W("SELECT * FROM c", *WC, ctes=_C1))
def q_c1(spark, sf):
    """Per column presence, common flag, types and filled values across the two tables."""
    return C.schema_analysis(cons_tables(spark, sf))


@register("C1_schema_advice", W(f"""
SELECT count(*) FILTER (is_common) AS common_columns, count(*) AS all_columns, count(*) FILTER (type_mismatch) AS compatibility_issues,
  {S('sum("values") * 100.0 / sum(rows)', 'filled_percentage')}, CASE WHEN count(*) FILTER (is_common) = 0 THEN 'No common columns: use union with source tracking.'
    WHEN count(*) FILTER (is_common) < count(*) * 0.5 THEN 'Few common columns: union recommended over key merge.'
    ELSE 'Good column alignment: key-based merge is viable.' END AS recommendation FROM c""", *WC, ctes=_C1))
def q_c1a(spark, sf):
    return round_doubles(C.schema_advice(cons_tables(spark, sf)))


@register("C2_union_fill_with_source", W(f"""
SELECT key, name, {S('balance')}, segment, _source_sheet FROM (
  SELECT *, 'customers' AS _source_sheet FROM fx_cons_customer
  UNION ALL BY NAME SELECT *, 'suppliers' AS _source_sheet FROM fx_cons_supplier)""", *WC))
def q_c2(spark, sf):
    return round_doubles(C.union_tables(cons_tables(spark, sf), True, "fill").select(
        "key", "name", "balance", "segment", "_source_sheet"))


@register("C2_union_common_columns", W(f"""
SELECT key, name, {S('balance')} FROM (SELECT key, name, balance FROM fx_cons_customer
  UNION ALL SELECT key, name, balance FROM fx_cons_supplier)""", *WC))
def q_c2i(spark, sf):
    return round_doubles(C.union_tables(cons_tables(spark, sf), False, "inner"))


@register("C2_union_default_value", W("""
SELECT coalesce(CAST(key AS VARCHAR), 'DEFAULT_VALUE') AS key, coalesce(name, 'DEFAULT_VALUE') AS name,
  coalesce(CAST(balance AS VARCHAR), 'DEFAULT_VALUE') AS balance, coalesce(segment, 'DEFAULT_VALUE') AS segment,
  _source_sheet FROM (
  SELECT *, 'customers' AS _source_sheet FROM fx_cons_customer
  UNION ALL BY NAME SELECT *, 'suppliers' AS _source_sheet FROM fx_cons_supplier)""", *WC))
def q_c2d(spark, sf):
    return C.union_tables(cons_tables(spark, sf), True, "default").select("key", "name", "balance", "segment", "_source_sheet")


_NAT = ("SELECT c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL "
        "SELECT s_nationkey AS nation, NULL AS segment FROM supplier")


@register("C3_mark_duplicates", f"""
SELECT nation, segment, count(*) OVER (PARTITION BY nation, segment) > 1 AS _is_duplicate FROM ({_NAT})""")
def q_c3m(spark, sf):
    return C.union_tables(nation_tables(spark, sf), False, "fill", "mark")


@register("C3_remove_duplicates", f"SELECT DISTINCT nation, segment FROM ({_NAT})")
def q_c3r(spark, sf):
    return C.union_tables(nation_tables(spark, sf), False, "fill", "remove")


@register("C4_catalogue", W("""
SELECT sheet, CAST(position AS INTEGER) AS position, "column", data_type, non_null_count, null_count, unique_values,
  sample_value FROM (""" + " UNION ALL ".join(
    f"SELECT '{t}' AS sheet, {i} AS position, '{c}' AS \"column\", '{dt}' AS data_type, count({c}) AS non_null_count, "
    f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_values, "
    f"coalesce(min(CAST({c} AS VARCHAR)), 'N/A') AS sample_value FROM {fx}"
    for t, fx, cols in (
        ("customers", "fx_cons_customer", [("key", "bigint"), ("name", "string"), ("balance", "double"), ("segment", "string")]),
        ("suppliers", "fx_cons_supplier", [("key", "bigint"), ("name", "string"), ("balance", "double")]))
    for i, (c, dt) in enumerate(cols)) + ")", *WC))
def q_c4_all(spark, sf):
    return C.catalogue(cons_tables(spark, sf))


@register("C5_consolidation_report", W("""
SELECT 2 AS total_sheets, CAST((SELECT count(*) FROM fx_cons_customer) + (SELECT count(*) FROM fx_cons_supplier) AS BIGINT)
  AS total_input_rows, (SELECT count(*) FROM (SELECT key, name, balance FROM fx_cons_customer UNION
  SELECT key, name, balance FROM fx_cons_supplier)) AS final_output_rows,
  """ + S("(SELECT count(*) FROM (SELECT key, name, balance FROM fx_cons_customer UNION SELECT key, name, balance FROM "
          "fx_cons_supplier)) * 100.0 / ((SELECT count(*) FROM fx_cons_customer) + (SELECT count(*) FROM fx_cons_supplier))",
          "row_efficiency") + """,
  CAST(3 AS BIGINT) AS common_columns, CAST(4 AS BIGINT) AS total_unique_columns, CAST(0 AS BIGINT) AS compatibility_issues,
  'union' AS strategy_used""", *WC))
def q_c5(spark, sf):
    t = cons_tables(spark, sf)
    res = C.consolidate(t, "union", include_source=False, missing="inner", duplicates="remove")
    return round_doubles(C.consolidation_report(t, res, "union"))


@register("J8_merge_on_key", W(f"""
SELECT coalesce(c.key, s.key) AS key, c.name, {S('c.balance', 'balance')}, c.segment, s.name AS name_from_suppliers,
  {S('s.balance', 'balance_from_suppliers')},
  concat_ws(';', CASE WHEN c.key IS NOT NULL THEN 'customers' END, CASE WHEN s.key IS NOT NULL THEN 'suppliers' END) AS _sources
FROM fx_cons_customer c FULL JOIN fx_cons_supplier s ON c.key = s.key""", *WC))
def q_j8(spark, sf):
    return round_doubles(C.merge_on_key(cons_tables(spark, sf)))


def periods_df(spark, sf):
    return fixture(spark, sf, "fx_periods")


WP = ("fx_periods",)


@register("T1_detect_time_patterns", W("""
SELECT sheet, 'Yearly Time Series' AS pattern_type, substring(sheet, 7, 4) AS period FROM (SELECT DISTINCT sheet FROM fx_periods)""",
                                       *WP))
def q_t1(spark, sf):
    names = periods_df(spark, sf).select("sheet").distinct()
    return T.detect_time_patterns(names, "sheet", years=range(1990, 2031))


@register("T3_trends_numeric", W(f"""
SELECT sheet AS period, "column", {S('avg(value)', 'mean')}, {S('sum(value)', 'sum')}, count(*) AS count,
  {S('min(value)', 'min')}, {S('max(value)', 'max')}, {S('quantile_cont(value, 0.5)', 'median')}
FROM (SELECT sheet, 'amount' AS "column", CAST(amount AS DOUBLE) AS value FROM fx_periods UNION ALL
  SELECT sheet, 'customer_id', CAST(customer_id AS DOUBLE) FROM fx_periods) WHERE value IS NOT NULL GROUP BY 1, 2""", *WP))
def q_t3(spark, sf):
    return round_doubles(T.trends(periods_df(spark, sf), "sheet", ["amount", "customer_id"]))


@register("T3_trends_text", W(" UNION ALL ".join(f"""
SELECT c.period, c.count, c.null_count, m.unique_count, m.most_common, '{col}' AS "column" FROM
  (SELECT sheet AS period, count({col}) AS count, CAST(sum(CASE WHEN {col} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count
   FROM fx_periods GROUP BY 1) c LEFT JOIN
  (SELECT sheet AS period, count(*) AS unique_count, arg_min(v, (-n, v)) AS most_common FROM
   (SELECT sheet, {col} AS v, count(*) AS n FROM fx_periods WHERE {col} IS NOT NULL GROUP BY 1, 2) GROUP BY 1) m
  USING (period)""" for col in ("status", "priority")), *WP))
def q_t3t(spark, sf):
    return T.text_trends(periods_df(spark, sf), "sheet", ["status", "priority"])


@register("T3_pooled_variance", W(f"""
SELECT 'amount' AS "column", {S('stddev_samp(amount)', 'std_dev')}, {S('var_samp(amount)', 'variance')},
  {S('stddev_samp(amount) / avg(amount) * 100', 'coefficient_variation')}, {S('max(amount) - min(amount)', 'range')}
FROM fx_periods WHERE amount IS NOT NULL""", *WP))
def q_t3v(spark, sf):
    return round_doubles(T.pooled_variance(periods_df(spark, sf), "sheet", ["amount"]))


@register("T4_period_changes", W(f"""
SELECT "column", prev || ' → ' || period AS period_key, CAST(pn AS INTEGER) AS period_no, {S('s - ps', 'change')},
  {S('CASE WHEN ps <> 0 THEN (s - ps) / ps * 100 ELSE 0.0 END', 'growth_rate')} FROM (
  SELECT "column", period, pn, s, lag(period) OVER (PARTITION BY "column" ORDER BY pn) AS prev,
    lag(s) OVER (PARTITION BY "column" ORDER BY pn) AS ps FROM (
    SELECT "column", sheet AS period, row_number() OVER (PARTITION BY "column" ORDER BY sheet) AS pn,
      coalesce(sum(value), 0.0) AS s FROM (
      SELECT sheet, 'amount' AS "column", CAST(amount AS DOUBLE) AS value FROM fx_periods UNION ALL
      SELECT sheet, 'customer_id', CAST(customer_id AS DOUBLE) FROM fx_periods) GROUP BY 1, 2))
WHERE prev IS NOT NULL""", *WP))
def q_t4(spark, sf):
    return round_doubles(T.period_changes(periods_df(spark, sf), "sheet", ["amount", "customer_id"]))


@register("T5_baseline_comparison", W(f"""
SELECT v.period, v."column", {S('v.value', 'value')}, {S('b.value', 'baseline_value')}, {S('v.value - b.value', 'difference')},
  {S('CASE WHEN b.value <> 0 THEN (v.value - b.value) / b.value * 100 ELSE 0.0 END', 'percent_change')}
FROM v JOIN v b ON b."column" = v."column" AND b.period = 'Sales 1995' WHERE v.period <> 'Sales 1995'""", *WP, ctes=(
    ("v", "SELECT sheet AS period, 'amount' AS \"column\", coalesce(sum(amount), 0.0) AS value FROM fx_periods GROUP BY 1 "
          "UNION ALL SELECT sheet, 'status', CAST(count(status) AS DOUBLE) FROM fx_periods GROUP BY 1"),)))
def q_t5(spark, sf):
    return round_doubles(T.baseline_comparison(periods_df(spark, sf), "sheet", "Sales 1995", ["amount"], ["status"]))


@register("T6_historical_report", W("""
SELECT count(DISTINCT sheet) AS periods_analyzed, count(*) AS total_records, 'Trend Analysis' AS analysis_mode,
  true AS include_variance FROM fx_periods""", *WP))
def q_t6(spark, sf):
    return T.historical_report(periods_df(spark, sf), "sheet", "Trend Analysis")


_SHEETS = {  # three sheets of all orders, with unequal columns
    "until 1995": ("sheet <= 'Sales 1995'", "order_id, customer_id, amount, status, priority"),
    "1996": ("sheet = 'Sales 1996'", "order_id, customer_id, amount, priority"),
    "from 1997": ("sheet >= 'Sales 1997'", "order_id, customer_id, amount, status, sheet AS source_sheet"),
}


@register("T2_structure", W(f"""
SELECT period, rows, len(common)::INTEGER AS common_columns,
  array_to_string(list_sort(list_filter(names, lambda x: NOT list_contains(common, x))), ', ') AS unique_columns,
  {sig('len(common) * 100.0 / len(list_distinct(every))')} AS compatibility_score
FROM sheets, (SELECT flatten(list(names)) AS every,
  list_filter(list_distinct(flatten(list(names))), lambda x: len(list_filter(flatten(list(names)), lambda y: y = x)) = count(*)) AS common FROM sheets)""",
    *WP, ctes=(("sheets", " UNION ALL ".join(
        f"SELECT '{n}' AS period, count(*) AS rows, any_value(json_keys(to_json(t))) AS names FROM (SELECT {c} FROM fx_periods WHERE {w}) t"
        for n, (w, c) in _SHEETS.items())),)))
def q_t2(spark, sf):
    p = periods_df(spark, sf)
    return round_doubles(T.structure({n: p.filter(w).selectExpr(*c.split(", ")) for n, (w, c) in _SHEETS.items()}))
