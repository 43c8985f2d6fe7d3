"""Recommendations, alerts, rankings, risk, summaries and two-dataset feeds.

All are rule tables over small aggregates (the shared ``rules`` helper) or
grouped aggregates; the one ordered split (first/last third by date) uses
range-partitioned row positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.normalize import col
from ...functions.rules import Rule, band, rules
from .. import ranks
from ..frames import attach
from ..profile import to_long
from .sales import month


def _thirds(df: DataFrame, amount: str, date: str, tie: str) -> DataFrame:
    """Means of the first and last third (by date, ties by ``tie``) of the rows that have both date and amount."""
    rows = df.filter(col(date).isNotNull() & col(amount).isNotNull() & ~F.isnan(col(amount).cast("double"))).select(
        col(date).alias("_d"), col(tie).alias("_t"), col(amount).alias("_a"))
    x = attach(ranks.row_positions(rows, ["_d", "_t"]), rows.agg(F.count(F.lit(1)).alias("_n")))
    x = x.withColumn("_k", F.floor(F.col("_n") / 3))
    return x.agg(F.avg(F.when(F.col("_pos") < F.col("_k"), F.col("_a"))).alias("first_third_mean"),
                 F.avg(F.when(F.col("_pos") >= F.col("_n") - F.col("_k"), F.col("_a"))).alias("last_third_mean"))


def alert_metrics(sales: DataFrame, amount: str, date: str, tie: str, customer: str) -> DataFrame:
    """B47 inputs as one row: third means and change % (null unless the first mean is positive), count of values
    beyond 3 sigma (0 up to ten values), top customer's share % of the revenue with a customer."""
    th = _thirds(sales, amount, date, tie)
    a = sales.filter(col(amount).isNotNull()).select(col(amount).cast("double").alias("a"))
    st = a.agg(F.avg("a").alias("_m"), F.stddev_samp("a").alias("_s"), F.count(F.lit(1)).alias("_k"))
    z = attach(a, st).agg(F.sum(F.when((F.col("_k") > 10) & (F.abs(F.col("a") - F.col("_m")) > 3 * F.col("_s")), 1).otherwise(0))
                          .alias("anomalies"))
    top = (sales.filter(col(customer).isNotNull()).groupBy(col(customer)).agg(F.coalesce(F.sum(col(amount)), F.lit(0.0)).alias("_v"))
           .agg(F.max("_v").alias("_top"), F.sum("_v").alias("_t")))
    m = attach(attach(th, z), top)
    change = F.when(F.col("first_third_mean") > 0, (F.col("last_third_mean") / F.col("first_third_mean") - 1) * 100)
    share = F.when(F.col("_t") > 0, F.col("_top") / F.col("_t") * 100)
    return m.select("first_third_mean", "last_third_mean", change.alias("trend_change_pct"),
                    F.coalesce("anomalies", F.lit(0)).cast("long").alias("anomalies"), share.alias("top_customer_share"))


#: Fixed output texts: alert type and advice of each rule, in rule order.
ALERT_TEXTS = [
    ("Liquidity Crisis", "Immediate cash flow review required"),
    ("Liquidity Warning", "Monitor cash flow closely"),
    ("Revenue Decline", "Urgent business review required"),
    ("Revenue Softening", "Investigate market conditions"),
    ("Data Anomalies Detected", "Investigate unusual transactions"),
    ("Customer Concentration Risk", "Diversify customer base urgently"),
    ("High Customer Dependency", "Consider customer diversification"),
]


def early_warnings(sales: DataFrame, amount: str, date: str, tie: str, customer: str,
                   finance: DataFrame | None = None, current_assets: str | None = None,
                   current_liabilities: str | None = None) -> DataFrame:
    """Alert rows: liquidity (< 1 critical, < 1.5 warning), last against first third (below -20% / -10%),
    values beyond 3 sigma, top customer share (> 50% / > 30%)."""
    m = alert_metrics(sales, amount, date, tie, customer)
    if finance is not None:
        m = attach(m, finance.agg(F.round(F.try_divide(F.sum(col(current_assets)), F.sum(col(current_liabilities))), 2)
                                  .alias("current_ratio")))
    else:
        m = m.withColumn("current_ratio", F.lit(None).cast("double"))
    ratio, change, share = F.col("current_ratio"), F.col("trend_change_pct"), F.col("top_customer_share")
    fell = F.format_string("Revenue declined by %.1f%%", F.abs(change))
    holds = F.format_string("Top customer represents %.1f%% of revenue", share)
    conds = [
        (ratio < 1, "CRITICAL", F.format_string("Current ratio of %s is below safe threshold of 1.0", ratio)),
        ((ratio >= 1) & (ratio < 1.5), "WARNING", F.format_string("Current ratio of %s approaching low threshold", ratio)),
        (change < -20, "CRITICAL", fell),
        ((change >= -20) & (change < -10), "WARNING", fell),
        (F.col("anomalies") > 0, "WARNING", F.format_string("%d extreme outliers found in transaction data", F.col("anomalies"))),
        (share > 50, "CRITICAL", holds),
        ((share > 30) & (share <= 50), "WARNING", holds),
    ]
    fired = rules(m, [Rule(c, severity, kind, text) for (c, severity, text), (kind, _) in zip(conds, ALERT_TEXTS)])
    advice = F.element_at(F.array(*[F.lit(x) for _, x in ALERT_TEXTS]), F.col("rule_no"))
    return fired.withColumnRenamed("priority", "severity").withColumn("recommendation", advice)


def benchmarks(df: DataFrame, amount: str, dimensions: list[str]) -> DataFrame:
    """Mean amount, completeness % and number of business dimensions (category, amount and date columns), each
    with its tiers."""
    cols = df.columns
    nn = reduce(lambda a, b: a + b, [F.count(col(c)) for c in cols])
    s = df.agg(F.avg(col(amount)).alias("revenue_per_record"),
               F.try_divide(nn * 100.0, F.count(F.lit(1)) * len(cols)).alias("completeness"))
    n, rev, comp = len(dimensions), F.col("revenue_per_record"), F.col("completeness")
    return s.select(
        "revenue_per_record", "completeness", F.lit(n).alias("dimensions"),
        band(rev, [(1000, "High Performer"), (500, "Average Performer")], "Below Average").alias("revenue_tier"),
        band(rev, [(750, "Above median")], "Below median").alias("industry_comparison"),
        band(comp, [(95, "Excellent"), (85, "Good")], "Needs Improvement").alias("completeness_tier"),
        band(comp, [(95, "Enterprise Grade"), (85, "Business Grade")], "Basic Grade").alias("compliance_level"),
        F.lit("Enterprise" if n >= 10 else "Mid-Market" if n >= 5 else "Small Business").alias("dimension_tier"),
        F.lit("Advanced" if n >= 8 else "Intermediate" if n >= 4 else "Basic").alias("analytics_readiness"))


def sector_ranking(df: DataFrame, sector: str, amount: str) -> DataFrame:
    """Per sector sum, mean, count, share %, rank (sum desc), tier by rank (first Leader, next two Strong, rest
    Developing); potential of the bottom three where their share is below 5% (High above the median mean, else Medium)."""
    g = df.filter(col(sector).isNotNull()).groupBy(col(sector).alias("sector")).agg(
        F.coalesce(F.sum(col(amount)), F.lit(0.0)).alias("revenue"), F.avg(col(amount)).alias("average"),
        F.count(col(amount)).alias("records"))
    tot = g.agg(F.sum("revenue").alias("_t"), F.count(F.lit(1)).alias("_k"))
    med = ranks.quantile_wide(to_long(g, ["average"]), {"_med": 0.5}).drop("column")
    # global rank without a single-partition window: range-partitioned positions over (revenue desc, sector)
    pos = ranks.row_positions(g.withColumn("_neg", -F.col("revenue")), ["_neg", "sector"]).drop("_neg")
    x = attach(pos, attach(tot, med)).withColumn("share", F.try_divide(F.col("revenue") * 100.0, F.col("_t"))).withColumn(
        "rank", (F.col("_pos") + 1).cast("int"))
    tier = F.when(F.col("rank") == 1, "Leader").when(F.col("rank") <= 3, "Strong").otherwise("Developing")
    weak = (F.col("rank") > F.col("_k") - 3) & (F.col("share") < 5)
    return x.select("sector", "revenue", "average", "records", "share", "rank", tier.alias("tier"),
                    F.when(weak, F.when(F.col("average") > F.col("_med"), "High").otherwise("Medium")).alias("growth_potential"))


#: Fixed output texts of the risk factors: type, impact, mitigation.
RISK_TEXTS = {
    "concentration": ("Revenue Concentration", "Business vulnerability to category-specific downturns",
                      "Diversify product/service portfolio across multiple categories"),
    "quality": ("Data Quality", "Unreliable analytics and decision-making", "Implement data quality controls and validation processes"),
    "complexity": ("Operational Complexity", "Increased operational overhead and maintenance costs",
                   "Simplify data model and focus on key business metrics"),
}


def _risk_inputs(df: DataFrame, category: str, amount: str) -> DataFrame:
    cols = df.columns
    by = df.filter(col(category).isNotNull()).groupBy(col(category)).agg(F.coalesce(F.sum(col(amount)), F.lit(0.0)).alias("_c"))
    top = by.agg(F.max("_c").alias("_top"), F.sum("_c").alias("_n"))
    nn = reduce(lambda a, b: a + b, [F.count(col(c)) for c in cols])
    miss = df.agg((100 - F.try_divide(nn * 100.0, F.count(F.lit(1)) * len(cols))).alias("missing_pct"))
    return attach(top, miss).select(F.when(F.col("_n") > 0, F.col("_top") / F.col("_n") * 100).alias("category_concentration"),
                                    "missing_pct", F.lit(len(cols)).alias("columns"))


def risk_assessment(df: DataFrame, category: str, amount: str) -> DataFrame:
    """+30 if one category holds more than 70% of revenue, +20 if over 20% of cells are missing, +10 if over 50
    columns; level 50 / 25."""
    x = _risk_inputs(df, category, amount)
    score = (F.when(F.col("category_concentration") > 70, 30).otherwise(0) + F.when(F.col("missing_pct") > 20, 20).otherwise(0)
             + F.when(F.col("columns") > 50, 10).otherwise(0))
    return x.withColumn("risk_points", score).withColumn(
        "risk_level", band(F.col("risk_points"), [(50, "High"), (25, "Medium")], "Low"))


def risk_factors(df: DataFrame, category: str, amount: str) -> DataFrame:
    """A row for each risk factor: severity, type, description, impact, mitigation."""
    x = _risk_inputs(df, category, amount)
    conc, miss = F.col("category_concentration"), F.col("missing_pct")
    fired = rules(x, [
        Rule(conc > 70, "High", "concentration", F.format_string("Over-dependence on single category (%.1f%%)", conc)),
        Rule((miss > 20) & (miss < 40), "Medium", "quality", F.format_string("High missing data rate (%.1f%%)", miss)),
        Rule(miss >= 40, "High", "quality", F.format_string("High missing data rate (%.1f%%)", miss)),
        Rule(F.col("columns") > 50, "Medium", "complexity", F.format_string("High number of data dimensions (%d columns)", F.col("columns")))])
    text = F.create_map(*[x for k, v in RISK_TEXTS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])[F.col("category")]
    return fired.select(F.col("priority").alias("severity"), text[0].alias("type"), F.col("message").alias("description"),
                        text[1].alias("impact"), text[2].alias("mitigation"))


def value_concentration(df: DataFrame, amount: str) -> DataFrame:
    """Share of revenue held by rows at or above the 80th percentile (0 unless the total is positive); >= 80 High, >= 60
    Moderate."""
    long = to_long(df, [amount])
    q = ranks.quantile_wide(long, {"_q80": 0.8}).drop("column")
    x = attach(long.select(F.col("value").alias("a")), q)
    high = F.col("a") >= F.col("_q80")
    share = F.sum(F.when(high, F.col("a")).otherwise(0.0)) * 100 / F.sum("a")
    s = x.agg(F.when(F.sum("a") > 0, share).otherwise(0.0).alias("top_share"),
              F.try_divide(F.sum(F.when(high, 1).otherwise(0)) * 100.0, F.count(F.lit(1))).alias("top_rows_pct"))
    return s.withColumn("concentration", F.when(F.col("top_share") >= 80, "High").when(F.col("top_share") >= 60, "Moderate")
                        .otherwise("Well distributed"))


def growth_indicator(df: DataFrame, amount: str, date: str) -> DataFrame:
    """Last month against the previous month (sum): above 5% Increasing, above -5% Stable, else Decreasing; below two months
    Insufficient data."""
    m = df.filter(col(date).isNotNull()).groupBy(month(date).alias("month")).agg(F.sum(col(amount)).alias("s"))
    last = m.agg(F.max("month").alias("_last"))
    x = attach(m, last)
    prev = x.filter(F.col("month") < F.col("_last")).agg(F.max_by("s", "month").alias("previous_month"))
    cur = x.filter(F.col("month") == F.col("_last")).select(F.col("s").alias("last_month"))
    y = attach(cur, prev)
    g = F.try_divide((F.col("last_month") - F.col("previous_month")) * 100, F.col("previous_month"))
    return y.select("last_month", "previous_month", g.alias("growth_pct"),
                    F.when(F.col("previous_month").isNull(), "Insufficient data").when(g > 5, "Increasing").when(g > -5, "Stable")
                    .otherwise("Decreasing").alias("indicator"))


def risk_score(alerts: DataFrame) -> DataFrame:
    """30 per critical + 15 per warning alert, capped at 100."""
    s = alerts.agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "WARNING").alias("warning"))
    return s.withColumn("risk_score", F.least(F.lit(100), F.col("critical") * 30 + F.col("warning") * 15).cast("long"))


def metric_score(name: Column, value: Column) -> Column:
    """Points 0-100 of a named financial metric."""
    return (F.when(name == "current_ratio", band(value, [(2.0, 100), (1.5, 80), (1.0, 60)], 30))
            .when(F.instr(name, "margin") > 0, band(value, [(20, 100), (15, 80), (10, 60), (5, 40)], 20))
            .when(name.isin("roe", "roa"), band(value, [(15, 100), (10, 80), (5, 60)], 40)).otherwise(70))


def performance_grade(score: Column) -> Column:
    """Nine grades."""
    return band(score, [(90, "A+"), (85, "A"), (80, "A-"), (75, "B+"), (70, "B"), (65, "B-"), (60, "C+"), (55, "C")], "D")


def performance_scorecard(metrics: DataFrame) -> DataFrame:
    """Mean metric score, grade and comparison over rows (name, value); 0 and D without metrics."""
    s = metrics.filter(F.col("value").isNotNull()).agg(
        F.coalesce(F.round(F.avg(metric_score(F.lower("name"), F.col("value"))), 1), F.lit(0.0)).alias("overall_score"),
        F.count(F.lit(1)).alias("metrics_analyzed"))
    return s.select("overall_score", performance_grade(F.col("overall_score")).alias("performance_grade"), "metrics_analyzed",
                    band(F.col("overall_score"), [(75, "Above Industry Average"), (60, "Industry Average")], "Below Industry Average")
                    .alias("benchmark_comparison"))


def executive_summary(df: DataFrame, amount: str, dimensions: list[str], alerts: DataFrame, concentration: DataFrame,
                      growth: DataFrame, scorecard: DataFrame) -> DataFrame:
    """One row: overview, highlights, risk (HIGH with a critical alert, MEDIUM above two warnings; D9: read from the
    alerts), scorecard, findings and advice."""
    cols = df.columns
    nn = reduce(lambda a, b: a + b, [F.count(col(c)) for c in cols])
    over = df.agg(F.count(F.lit(1)).alias("records"), F.try_divide(nn * 100.0, F.count(F.lit(1)) * len(cols)).alias("completeness"),
                  F.sum(col(amount)).alias("total_value"), F.avg(col(amount)).alias("average_transaction"))
    x = attach(attach(attach(attach(over, risk_score(alerts)), concentration.select("top_share", "concentration")),
                      growth.select("growth_pct", "indicator")), scorecard)
    risk = F.when(F.col("critical") > 0, "HIGH").when(F.col("warning") > 2, "MEDIUM").otherwise("LOW")
    x = x.withColumn("risk_level", risk).withColumn("dimensions", F.lit(len(dimensions))).withColumn(
        "data_quality_grade", band(F.col("completeness"), [(95, "A"), (85, "B")], "C"))
    some = lambda *items: F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in items]), lambda v: v.isNotNull())
    return x.withColumn("key_findings", some(
        (F.col("total_value") > 1000000, "High-value dataset with significant financial impact"),
        (F.col("average_transaction") > 1000, "Premium transaction profile indicates quality customer base")))


def recommendations(df: DataFrame, amount: str, rating: str | None, product: str | None, date: str | None,
                    categories: int = 1, limit: int = 8) -> DataFrame:
    """CV > 1, over 10% of amounts below P10, mean rating < 3.5 or > 4.5, one product above half of revenue, CV of
    row counts per calendar month > 0.5, several category columns, missing > 10%; the first ``limit`` messages."""
    long = to_long(df, [amount])
    q = ranks.quantile_wide(long, {"_p10": 0.1}).drop("column")
    m = attach(long.select(F.col("value").alias("a")), q).agg(
        F.try_divide(F.stddev_samp("a"), F.avg("a")).alias("_cv"),
        F.try_divide(F.sum(F.when(F.col("a") < F.col("_p10"), 1).otherwise(0)), F.count(F.lit(1))).alias("_low"))
    none = F.lit(None).cast("double")
    m = attach(m, df.agg(F.avg(col(rating)).alias("_rating"))) if rating else m.withColumn("_rating", none)
    if product:
        per = df.filter(col(product).isNotNull()).groupBy(col(product)).agg(F.coalesce(F.sum(col(amount)), F.lit(0.0)).alias("_c"))
        m = attach(m, per.agg(F.when(F.count(F.lit(1)) > 1, F.try_divide(F.max("_c"), F.sum("_c"))).alias("_pshare")))
    else:
        m = m.withColumn("_pshare", none)
    if date:
        mo = df.filter(col(date).isNotNull()).groupBy(F.month(col(date))).agg(F.count(F.lit(1)).alias("_s"))
        m = attach(m, mo.agg(F.try_divide(F.stddev_samp("_s"), F.avg("_s")).alias("_mcv")))
    else:
        m = m.withColumn("_mcv", none)
    cols = df.columns
    nn = reduce(lambda x, y: x + y, [F.count(col(c)) for c in cols])
    m = attach(m, df.agg((100 - F.try_divide(nn * 100.0, F.count(F.lit(1)) * len(cols))).alias("_miss")))
    items = [
        Rule(F.col("_cv") > 1.0, "Medium", "pricing", "High revenue variance detected - consider implementing tiered pricing strategy"),
        Rule(F.col("_low") > 0.1, "Medium", "upsell", "Many low-value transactions - explore upselling opportunities"),
        Rule(F.col("_rating") < 3.5, "High", "satisfaction", "Customer satisfaction below average - prioritize service improvement"),
        Rule(F.col("_rating") > 4.5, "Low", "satisfaction", "Excellent customer satisfaction - leverage for referral programs"),
        Rule(F.col("_pshare") > 0.5, "Medium", "products", "Revenue concentrated in one product - diversify product portfolio"),
        Rule(F.col("_mcv") > 0.5, "Medium", "seasonality", "Seasonal patterns detected - plan inventory and marketing accordingly"),
        Rule(F.lit(categories > 1), "Low", "dimensions", "Multiple business dimensions available - consider cross-category analysis"),
        Rule(F.col("_miss") > 10, "High", "data", "Significant missing data detected - improve data collection processes"),
    ]
    return rules(m, items, limit=limit)


def kpi_scorecard(kpis: DataFrame, units: dict[str, str], bands: dict[str, str] | None = None) -> DataFrame:
    """One row per KPI column of a one-row table: name, value, unit, interpretation (from the KPI's band column) and
    status colour: green for excellent, good or strong, red for concerning, poor or critical, else orange."""
    bands = bands or {}
    st = F.explode(F.array(*[F.struct(F.lit(n).alias("kpi"), F.col(n).cast("double").alias("value"), F.lit(u).alias("unit"),
                                      F.coalesce(F.col(bands[n]) if n in bands else F.lit(None).cast("string"), F.lit("Unknown"))
                                      .alias("interpretation")) for n, u in units.items()]))
    word = F.lower("interpretation")
    return kpis.select(st.alias("k")).select("k.*").withColumn("status", F.when(word.rlike("excellent|good|strong"), "green")
                                                             .when(word.rlike("concerning|poor|critical"), "red").otherwise("orange"))


def compare_datasets(a: DataFrame, b: DataFrame, amount: str, customer: str, product: str, name_a: str = "A", name_b: str = "B",
                     amounts: tuple[list[str], list[str]] = ([], []), categories: tuple[list[str], list[str]] = ([], [])) -> DataFrame:
    """Rows, columns, amount and category columns (as named for each side), revenue (sum, mean), customers and products per
    dataset."""
    def prof(df, name, side):
        return df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("records"), F.lit(len(df.columns)).cast("long").alias("columns"),
                      F.lit(len(amounts[side])).cast("long").alias("amount_columns"), F.lit(len(categories[side])).cast("long").alias("category_columns"),
                      F.sum(col(amount)).alias("revenue"), F.avg(col(amount)).alias("average_transaction"),
                      F.count_distinct(col(customer)).alias("customers"), F.count_distinct(col(product)).alias("products"))
    return prof(a, name_a, 0).unionByName(prof(b, name_b, 1))


MEASURES = ["records", "columns", "amount_columns", "category_columns", "revenue", "average_transaction", "customers", "products"]


def dataset_differences(profiles: DataFrame, name_a: str = "A", name_b: str = "B") -> DataFrame:
    """A row per measure of compare_datasets: both values, B - A, and growth % (0 unless A's value is positive)."""
    side = lambda n, t: profiles.filter(F.col("dataset") == n).select(*[F.col(c).cast("double").alias(f"{c}_{t}") for c in MEASURES])
    x = attach(side(name_a, "a"), side(name_b, "b"))
    rows = x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"{c}_a").alias("dataset_a"), F.col(f"{c}_b").alias("dataset_b"))
                                        for c in MEASURES])).alias("r")).select("r.*")
    diff = F.col("dataset_b") - F.col("dataset_a")
    return rows.withColumn("difference", diff).withColumn(
        "growth_rate", F.when(F.col("dataset_a") > 0, diff / F.col("dataset_a") * 100).otherwise(0.0))


def comparison_sentences(differences: DataFrame) -> DataFrame:
    """Summary sentences on records, revenue and, where B has more, business dimensions (amount and category columns)."""
    g, m = F.abs("growth_rate"), F.col("measure")
    up, down = F.col("difference") > 0, F.col("difference") < 0
    text = (F.when((m == "records") & up, F.format_string("Dataset B has %.1f%% more records than Dataset A", g))
            .when((m == "records") & down, F.format_string("Dataset B has %.1f%% fewer records than Dataset A", g))
            .when((m == "revenue") & up, F.format_string("Revenue increased by %.1f%% in Dataset B", g))
            .when((m == "revenue") & down, F.format_string("Revenue decreased by %.1f%% in Dataset B", g))
            .when((m == "dimensions") & up, F.format_string("Dataset B has more business dimensions (%.0f vs %.0f)", F.col("dataset_b"), F.col("dataset_a"))))
    dims = differences.filter(m.isin("amount_columns", "category_columns")).agg(
        F.lit("dimensions").alias("measure"), F.sum("dataset_a").alias("dataset_a"), F.sum("dataset_b").alias("dataset_b"),
        F.sum("difference").alias("difference"), F.lit(0.0).alias("growth_rate"))
    return differences.unionByName(dims).select("measure", text.alias("sentence")).filter(F.col("sentence").isNotNull())


def two_dataset_monthly(a: DataFrame, b: DataFrame, amount: str, date: str) -> DataFrame:
    """Monthly sums of two datasets side by side (full outer join on month, 0 where absent)."""
    ma = a.filter(col(date).isNotNull()).groupBy(month(date).alias("month")).agg(F.sum(col(amount)).alias("revenue_a"))
    mb = b.filter(col(date).isNotNull()).groupBy(month(date).alias("month")).agg(F.sum(col(amount)).alias("revenue_b"))
    return ma.join(mb, "month", "full").na.fill(0.0, ["revenue_a", "revenue_b"])


def two_dataset_categories(a: DataFrame, b: DataFrame, category: str, amount: str) -> DataFrame:
    """Category sums of two datasets aligned by a full outer join, 0 where absent."""
    ga = a.filter(col(category).isNotNull()).groupBy(col(category).alias("category")).agg(F.sum(col(amount)).alias("revenue_a"))
    gb = b.filter(col(category).isNotNull()).groupBy(col(category).alias("category")).agg(F.sum(col(amount)).alias("revenue_b"))
    return ga.join(gb, "category", "full").na.fill(0.0, ["revenue_a", "revenue_b"])
