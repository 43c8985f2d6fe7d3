"""Constant, empty, one-row and all-null tables: no operator raises (ANSI division by zero included)."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cells as C
from ledgerlens.operators import kendall, profile, quality, summaries, twosample
from ledgerlens.operators.business import alerts, customers, finance, pricing, products, sales
from ledgerlens.operators.match import match
from ledgerlens.sources import sinks

SCHEMA = ("id long, amount double, cost double, discount double, rating long, quantity long, category string, product string, "
          "customer long, day timestamp, other timestamp")
ROW = "(1L, 5.0D, 5.0D, 5.0D, 3L, 2L, 'c', 'p', 7L, timestamp'2024-01-05', timestamp'2024-01-05')"


def tables(spark):
    row = spark.sql(f"SELECT inline(array(struct{ROW}))").toDF(*[c.split()[0] for c in SCHEMA.split(", ")])
    null = row.select(*[F.lit(None).cast(t).alias(c) for c, t in row.dtypes])
    zero = row.select(*[(F.lit(0).cast(t) if t in ("double", "bigint") else F.col(c)).alias(c) for c, t in row.dtypes])
    return {"empty": row.limit(0), "one": row, "constant": row.crossJoin(spark.range(12)).drop("id").withColumn("id", F.lit(1).cast("long")),
            "null": null.crossJoin(spark.range(3).select()), "zero": zero.union(zero)}


OPERATORS = {
    "A5": lambda d: profile.data_types(d),
    "A12": lambda d: quality.risk_profile(d),
    "B13": lambda d: sales.performance(d, "amount", "day"),
    "B28": lambda d: alerts.recommendations(d, "amount", "rating", "product", "day"),
    "B31": lambda d: pricing.optimal_discount_range(d, "discount", "amount"),
    "B34": lambda d: finance.financial_kpis(d, "amount", "day", "quantity"),
    "B35": lambda d: finance.margins(d, "amount", "cost"),
    "B35c": lambda d: finance.margins(d, "amount", "cost", "category"),
    "B39": lambda d: finance.fulfilment(d, "day", "other", "category"),
    "B40": lambda d: finance.workforce(d, "customer", "day", "rating", "discount"),
    "B41": lambda d: finance.project_indices(d, "amount", "cost", "day", "other"),
    "B44": lambda d: sales.anomalies(d, "amount"),
    "B45": lambda d: finance.engagement(d, "customer", "quantity", "amount"),
    "B46": lambda d: finance.governance(d, "customer", "amount"),
    "B47": lambda d: alerts.early_warnings(d, "amount", "day", "id", "customer", d, "amount", "cost"),
    "B48": lambda d: alerts.benchmarks(d, "amount", ["amount", "day"]),
    "B49": lambda d: alerts.sector_ranking(d, "category", "amount"),
    "B50": lambda d: alerts.risk_assessment(d, "category", "amount"),
    "B51": lambda d: alerts.value_concentration(d, "amount"),
    "B52": lambda d: alerts.growth_indicator(d, "amount", "day"),
    "B53": lambda d: alerts.performance_scorecard(d.select(F.lit("roe").alias("name"), F.col("amount").alias("value"))),
    "B18": lambda d: customers.value_segments(d, "amount"),
    "B19": lambda d: customers.behaviour_by_category(d, "category", "amount"),
    "B27": lambda d: products.product_trends(d, "product", "amount", "day"),
    "H1": lambda d: twosample.t_test(twosample.pooled_long(d, d, ["amount"])),
    "H3": lambda d: twosample.mann_whitney(twosample.pooled_long(d, d, ["amount"])),
    "H4": lambda d: twosample.ks_test(twosample.pooled_long(d, d, ["amount"])),
    "H5": lambda d: kendall.kendall_tau_b(d, "amount", "cost"),
    "M3": lambda d: summaries.quality_table(match(d.select("id", "product"), d, "product", "product", b_order="id"), "product"),
    "M9": lambda d: summaries.key_readiness(d, "category", d, "product"),
    "Q6": lambda d: quality.key_candidates(d),
    "Q10": lambda d: quality.type_validation(d),
    "Q14": lambda d: quality.compare_quality(d, d),
    "S7": lambda d: sinks.statistical_summary(d, "t"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_operator_raises(spark, name):
    for kind, df in tables(spark).items():
        try:
            OPERATORS[name](df).collect()
        except Exception as e:
            raise AssertionError(f"{name} on {kind}: {str(e)[:600]}") from e


def test_every_column_is_validated(spark):
    rows = {r["column"]: r for r in quality.type_validation(tables(spark)["null"]).collect()}
    assert set(rows) == {c.split()[0] for c in SCHEMA.split(", ")}
    assert all(r["issues"] == ["Column is completely empty"] for r in rows.values())


def test_threshold_zero_matches_everything(spark):
    a = spark.createDataFrame([("abc",), ("zz",)], "k string")
    b = spark.createDataFrame([("abd", 1), ("qqqqqqqq", 2)], "k string, n int")
    rows = match(a, b, "k", "k", threshold=0, b_order="n").collect()
    assert all(r["match_type"] == "Fuzzy" for r in rows)


def test_long_formula_chain(spark):
    """A chain deeper than any round limit keeps its levels, and its first cell the whole cascade."""
    n = 130
    cells = spark.createDataFrame([("b", "s", "A1", 1, 1, "7")] + [
        ("b", "s", f"A{k}", k, 1, f"=A{k - 1}+1") for k in range(2, n + 1)], "book string, sheet string, cell string, row_no int, col_no int, formula string")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    parsed = C.parse_formulas(cells)
    levels = {r["cell"]: (r["level"], r["on_or_behind_cycle"]) for r in C.dependency_levels(cells, parsed).collect()}
    assert levels == {f"s!A{k}": (k - 1, False) for k in range(2, n + 1)}


def test_constant_discount_fills_one_range(spark):
    rows = pricing.optimal_discount_range(tables(spark)["constant"], "discount", "amount").collect()
    assert [r["transactions"] for r in sorted(rows, key=lambda r: r["bin"])] == [0] * 4 + [12] + [0] * 5
