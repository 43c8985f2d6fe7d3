"""Stand-in inputs derived from the base test tables.

Each fixture is plain SQL that runs unchanged on Spark and DuckDB, so the
same input feeds the Spark operator and its SQL oracle. The fixtures only
shape rows into the schema an operator expects; none of them does any of an
operator's work. They cover whole tables (no id ranges or row caps), so
their size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import register_tables

FIXTURE_SQL: dict[str, str] = {
    # left side of exact/fuzzy matching: one key per part
    "fx_match_a": """
SELECT p_partkey AS id, concat(p_name, ' ', p_brand, ' ', p_type) AS item, p_name AS name, p_brand AS brand,
  p_retailprice AS price
FROM part""",
    # right side: kept, recased + padded, first letter dropped, token changed, missing (key % 5 = 4)
    "fx_match_b": """
SELECT p_partkey AS id,
  CASE p_partkey % 5 WHEN 0 THEN concat(p_name, ' ', p_brand, ' ', p_type)
    WHEN 1 THEN concat('  ', upper(concat(p_name, ' ', p_brand, ' ', p_type)), ' ')
    WHEN 2 THEN concat(substring(p_name, 2), ' ', p_brand, ' ', p_type)
    WHEN 3 THEN concat(p_name, ' ', replace(p_brand, 'Brand', 'Mark'), ' ', p_type) END AS item,
  p_name AS name, p_brand AS brand, p_size AS size
FROM part WHERE p_partkey % 5 <> 4""",
    "fx_sales": """
SELECT o_orderkey AS order_id, o_orderdate AS order_date, o_custkey AS customer_id, o_orderpriority AS category,
  c_mktsegment AS product, nullif(o_totalprice, CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice END) AS amount,
  o_totalprice * (0.5 + (o_orderkey % 40) / 100.0) AS cost, 1 + o_orderkey % 5 AS rating,
  cast((o_orderkey % 8) * 5 AS double) AS discount, 1 + o_orderkey % 7 AS quantity
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fx_nulls": """
SELECT o_custkey % 50 AS grp, o_orderkey % 900 AS seq, o_orderkey AS src_order,
  CASE WHEN o_orderkey % 7 < 2 THEN NULL ELSE o_totalprice END AS num,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('$', cast(o_custkey AS varchar(20)), ',000') END AS num_text,
  substring(cast(o_orderdate AS varchar(30)), 1, 10) AS date_text,
  CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'No' END AS flag_text,
  CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE concat('u', cast(o_custkey AS varchar(20)), '@mail.com') END AS email
FROM orders""",
    "fx_finance": """
SELECT s_suppkey AS entity_id, abs(s_acctbal) * 3 AS total_assets, abs(s_acctbal) * 2 AS current_assets,
  abs(s_acctbal) * 1.5 AS current_liabilities, abs(s_acctbal) * 0.4 AS inventory, abs(s_acctbal) * 0.3 AS cash,
  abs(s_acctbal) * 5 AS revenue, abs(s_acctbal) * 3.2 AS cogs, s_acctbal * 0.6 AS net_income, abs(s_acctbal) AS equity
FROM supplier""",
    # formula cells: plain values in column A, a chain per block of 10 in column D, a 2-cycle at D99/D100
    "fx_cells": """
SELECT 'b' AS book, 's' AS sheet, concat('A', cast(p_partkey + 1 AS varchar(20))) AS cell, p_partkey + 1 AS row_no,
  1 AS col_no, cast(p_size AS varchar(20)) AS formula
FROM part
UNION ALL
SELECT 'b', 's', concat('D', cast(p_partkey + 1 AS varchar(20))), p_partkey + 1, 4,
  CASE WHEN p_partkey = 98 THEN '=D100*2' WHEN p_partkey = 99 THEN '=D99+1'
    WHEN p_partkey % 10 = 0 THEN concat('=SUM($A$', cast(p_partkey + 1 AS varchar(20)), ':A', cast(p_partkey + 2 AS varchar(20)), ')')
    ELSE concat('=IF(D', cast(p_partkey AS varchar(20)), '>0,ROUND(D', cast(p_partkey AS varchar(20)), ',2),A',
      cast(p_partkey + 1 AS varchar(20)), ')') END
FROM part""",
    # second version of the formula sheet for F8: every 7th formula edited, every 13th D cell missing
    "fx_cells_b": """
SELECT 'b' AS book, 's' AS sheet, concat('A', cast(p_partkey + 1 AS varchar(20))) AS cell, p_partkey + 1 AS row_no,
  1 AS col_no, cast(p_size AS varchar(20)) AS formula
FROM part
UNION ALL
SELECT 'b', 's', concat('D', cast(p_partkey + 1 AS varchar(20))), p_partkey + 1, 4,
  CASE WHEN p_partkey % 7 = 0 THEN concat('=AVERAGE(A', cast(p_partkey + 1 AS varchar(20)), ':A', cast(p_partkey + 3 AS varchar(20)),
      ')+MAX(A1:A', cast(p_size AS varchar(20)), ')*1000000000+MIN(A1:A2)')
    WHEN p_partkey % 10 = 0 THEN concat('=SUM($A$', cast(p_partkey + 1 AS varchar(20)), ':A', cast(p_partkey + 3 AS varchar(20)), ')')
    ELSE concat('=IF(D', cast(p_partkey AS varchar(20)), '>0,ROUND(D', cast(p_partkey AS varchar(20)), ',2),A',
      cast(p_partkey + 1 AS varchar(20)), ')') END
FROM part WHERE p_partkey % 13 <> 0""",
    "fx_attrs_a": """
SELECT 'b' AS book, 's' AS sheet, concat('C', cast(p_partkey AS varchar(20))) AS cell, cat AS category, attr,
  CASE WHEN (p_partkey) % 3 = 0 THEN concat(attr, '-x') ELSE concat(attr, '-', p_type) END AS value
FROM part CROSS JOIN (VALUES ('font','name'), ('font','bold'), ('fill','color'), ('border','left'), ('alignment','wrap'),
  ('number_format','code'), ('protection','locked')) AS v(cat, attr)
WHERE p_partkey % 11 <> 0""",
    "fx_attrs_b": """
SELECT 'b' AS book, 's' AS sheet, concat('C', cast(p_partkey AS varchar(20))) AS cell, cat AS category, attr,
  CASE WHEN (p_partkey + 1) % 3 = 0 THEN concat(attr, '-x') ELSE concat(attr, '-', p_type) END AS value
FROM part CROSS JOIN (VALUES ('font','name'), ('font','bold'), ('fill','color'), ('border','left'), ('alignment','wrap'),
  ('number_format','code'), ('protection','locked')) AS v(cat, attr)
WHERE p_partkey % 9 <> 0""",
    # sheet objects: row heights / hidden flags and conditional-format rules, second version edited
    "fx_objects_a": """
SELECT 's' AS sheet, 'row' AS kind, cast(p_partkey + 1 AS varchar(20)) AS id, 'height' AS attr,
  cast(p_size AS varchar(20)) AS value FROM part
UNION ALL
SELECT 's', 'conditional_format', concat('rule', cast(p_size AS varchar(20))), 'type', p_type FROM part WHERE p_partkey % 50 = 0""",
    "fx_objects_b": """
SELECT 's' AS sheet, 'row' AS kind, cast(p_partkey + 1 AS varchar(20)) AS id, 'height' AS attr,
  cast(CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS varchar(20)) AS value FROM part WHERE p_partkey % 97 <> 0
UNION ALL
SELECT 's', 'conditional_format', concat('rule', cast(p_size AS varchar(20))), 'type', p_type FROM part WHERE p_partkey % 40 = 0""",
    # consolidation inputs: two differently shaped tables
    "fx_cons_customer": """
SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer""",
    "fx_cons_supplier": """
SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier""",
    # period sheets: orders tagged with the sheet name of their year
    "fx_periods": """
SELECT concat('Sales ', cast(year(o_orderdate) AS varchar(4))) AS sheet, o_orderkey AS order_id, o_custkey AS customer_id,
  o_totalprice AS amount, o_orderstatus AS status, o_orderpriority AS priority
FROM orders""",
    # batch targets: the right side split in three sheets
    "fx_batch": """
SELECT concat('T', cast(id % 3 AS varchar(2))) AS target, id, item FROM (
SELECT p_partkey AS id,
  CASE p_partkey % 5 WHEN 0 THEN concat(p_name, ' ', p_brand, ' ', p_type)
    WHEN 1 THEN concat('  ', upper(concat(p_name, ' ', p_brand, ' ', p_type)), ' ')
    WHEN 2 THEN concat(substring(p_name, 2), ' ', p_brand, ' ', p_type)
    WHEN 3 THEN concat(p_name, ' ', replace(p_brand, 'Brand', 'Mark'), ' ', p_type) END AS item
FROM part WHERE p_partkey % 5 <> 4) t""",
    # two samples for the two-sample tests
    "fx_sample_a": """
SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount + 0.0 AS discount, l_tax AS tax
FROM lineitem WHERE l_returnflag = 'A'""",
    "fx_sample_r": """
SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount + 0.0 AS discount, l_tax AS tax
FROM lineitem WHERE l_returnflag = 'R'""",
    # the returned items with other columns and types, and half of the prices missing
    "fx_sample_odd": """
SELECT cast(l_quantity AS varchar(20)) AS quantity, CASE WHEN l_orderkey % 2 = 0 THEN l_extendedprice END AS price,
  l_returnflag AS flag, l_shipdate AS shipdate, l_linestatus AS linestatus, l_suppkey AS supplier, l_partkey AS part
FROM lineitem WHERE l_returnflag = 'R'""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build one fixture on Spark from the base tables under ``sf_dir``."""
    register_tables(spark, sf_dir)
    return spark.sql(FIXTURE_SQL[name])
