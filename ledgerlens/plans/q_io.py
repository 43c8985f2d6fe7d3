"""Queries for clean reads, validation and the text summary."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.summaries import type_distribution
from ..session import ensure_checkpoint_dir
from ..sources import sinks
from ..sources.fixtures import fixture
from ..sources.tables import clean_read, load, validate
from .common import round_doubles, sig
from .q_match import match_items, match_result_ctes
from .q_profile import NULL_COLS, W
from .registry import register
from .sqlparts import build


@register("S2_clean_read_nulls", W(
    "SELECT grp, seq, src_order, " + sig("num") + " AS num, num_text, date_text, flag_text, email FROM fx_nulls WHERE NOT ("
    + " AND ".join(f"{c} IS NULL" for c in NULL_COLS) + ")", "fx_nulls"))
def q_s2(spark, sf):
    return round_doubles(clean_read(fixture(spark, sf, "fx_nulls").select(*NULL_COLS)))


@register("S3_validate_columns", W("""
SELECT 'table' AS "check", CAST(NULL AS VARCHAR) AS "column", count(*) > 0 AS passed,
  CASE WHEN count(*) > 0 THEN 'ok' ELSE 'table is empty' END AS message FROM fx_nulls
UNION ALL SELECT 'column', 'num', count(num) > 0, CASE WHEN count(num) > 0 THEN 'ok' ELSE 'column is all null' END FROM fx_nulls
UNION ALL SELECT 'column', 'email', count(email) > 0, CASE WHEN count(email) > 0 THEN 'ok' ELSE 'column is all null' END
  FROM fx_nulls
UNION ALL SELECT 'column', 'no_such_column', false, 'column not found'""", "fx_nulls"))
def q_s3(spark, sf):
    return validate(fixture(spark, sf, "fx_nulls"), ["num", "email", "no_such_column"])


_S7_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("S7_statistical_summary", f"""
WITH cv AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, stddev_samp({c}) / abs(avg({c})) AS v FROM lineitem" for c in _S7_COLS)}),
o AS ({' UNION ALL '.join(f"SELECT count(*) FILTER ({c} + 0.0 < q1 - 1.5 * (q3 - q1) OR {c} + 0.0 > q3 + 1.5 * (q3 - q1)) AS k FROM lineitem, (SELECT quantile_cont({c} + 0.0, 0.25) AS q1, quantile_cont({c} + 0.0, 0.75) AS q3 FROM lineitem)" for c in _S7_COLS)})
SELECT 0 AS line_no, 'Dataset: lineitem' AS line
UNION ALL SELECT 1, printf('Rows: %d, Columns: 11, Cells: %d', count(*), count(*) * 11) FROM lineitem
UNION ALL SELECT 2, 'Missing cells: 0 (0.00%)'
UNION ALL SELECT 3, 'Most variable column: ' || arg_max(c, v) FROM cv
UNION ALL SELECT 4, printf('Total outliers (IQR): %d', CAST(sum(k) AS BIGINT)) FROM o""")
def q_s7(spark, sf):
    return sinks.statistical_summary(load(spark, sf, "lineitem"), "lineitem")


def _out(spark) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sinks-{uuid.uuid4().hex}"


@register("S4_S8_categorised_and_tables", build("""
SELECT 'rows' AS part, category AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM mres GROUP BY 2
UNION ALL SELECT 'report', match_type, count(*), NULL FROM mres GROUP BY 2
UNION ALL SELECT 'table', 'customers', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer
UNION ALL SELECT 'table', 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders""", match_result_ctes()))
def q_s4(spark, sf):
    """Match rows by category with a report table, and exported tables; written, read back and counted."""
    path = _out(spark)
    r = match_items(spark, sf)
    sinks.write_categorised(r, f"{path}/match")
    sinks.write_categorised(r.limit(0), f"{path}/none", {"types": type_distribution(spark.read.parquet(f"{path}/match/rows"))})
    sinks.export_tables({"customers": load(spark, sf, "customer"), "orders": load(spark, sf, "orders")}, f"{path}/tables")
    read = spark.read.parquet
    total = lambda c: F.sum(c).cast("long").alias("ids")
    rows = read(f"{path}/match/rows").groupBy(F.lit("rows").alias("part"), F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("n"), total("id"))
    report = read(f"{path}/none/types").select(F.lit("report").alias("part"), F.col("match_type").alias("name"), F.col("count").alias("n"),
                                                F.lit(None).cast("long").alias("ids"))
    out = rows.unionByName(report)
    for name, key in (("customers", "c_custkey"), ("orders", "o_orderkey")):
        out = out.unionByName(read(f"{path}/tables/{name}").agg(F.count(F.lit(1)).alias("n"), total(key)).select(
            F.lit("table").alias("part"), F.lit(name).alias("name"), "n", "ids"))
    return out


@register("S5_S6_csv_and_json", """
SELECT 'csv' AS format, c_custkey, c_name, c_mktsegment FROM customer
UNION ALL SELECT 'json', c_custkey, c_name, c_mktsegment FROM customer""")
def q_s5(spark, sf):
    """CSV with header and JSON lines, written and read back."""
    path = _out(spark)
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    sinks.write_csv(c, f"{path}/csv")
    sinks.write_json(c, f"{path}/json")
    csv = spark.read.schema(c.schema).option("header", True).csv(f"{path}/csv")
    json = spark.read.schema(c.schema).json(f"{path}/json")
    return csv.select(F.lit("csv").alias("format"), *c.columns).unionByName(json.select(F.lit("json").alias("format"), *c.columns))
