import importlib.util
import os
import sys

from ledgerlens.operators.match import match
from ledgerlens.sources.fixtures import fixture
from ledgerlens.sources.tables import load

from conftest import SF

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    mod = _entry()
    df = mod.entry(spark)
    assert df.count() >= 0
    assert {"match_type", "similarity_score", "category"} <= set(df.columns)


def test_oracle_keys_subset_of_queries():
    mod = _entry()
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 150


def test_no_row_at_a_time_python_udf_in_match(spark):
    a = fixture(spark, SF, "fx_match_a")
    b = fixture(spark, SF, "fx_match_b")
    plan = match(a, b, "item", "item", b_order="id")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan


def test_filter_and_projection_reach_the_scan(spark):
    li = load(spark, SF, "lineitem").filter("l_quantity > 10").select("l_orderkey", "l_quantity")
    plan = li._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_catalogue_and_duplicates_over_all_columns(spark):
    from ledgerlens.plans import q_consolidate, q_quality

    sheets = {(r["sheet"], r["column"]) for r in q_consolidate.q_c4_all(spark, SF).collect()}
    assert {("customers", "balance"), ("suppliers", "balance")} <= sheets and len(sheets) == 7
    # customers who share nation and segment are no duplicate rows
    assert q_quality.q_q4_all(spark, SF).first()["duplicate_rows"] == 0 and q_quality.q_q4g_all(spark, SF).count() == 0


def test_diff_summary_deals_keys_before_it_makes_them_distinct(spark):
    """A task that reads held a map of all its keys (503 MB for four tasks of 60 x sf0.1): no aggregate below the exchange by key."""
    from ledgerlens.operators import formats as G
    rows = [("s", f"C{k}", "font", "name", "x") for k in range(5)] + [(None, "C1", "fill", None, "y")] * 2
    a = spark.createDataFrame(rows, "sheet string, cell string, category string, attr string, value string")
    out = G.diff_summary(G.attribute_diff(a, a), a, a)
    assert sorted((r.category, r.compared) for r in out.collect()) == [("fill", 1), ("font", 5)]
    plan = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines()]
    distinct = [i for i, x in enumerate(plan) if "HashAggregate(keys=[sheet" in x]
    assert distinct and "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()
    assert "Exchange hashpartitioning(sheet" in "".join(plan[max(distinct) + 1: max(distinct) + 2])
