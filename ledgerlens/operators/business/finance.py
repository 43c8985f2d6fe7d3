"""Ratios and KPIs as one-row (or per-group) aggregates.

Every ratio takes explicit column names (the reference's keyword lookup is
in ``roles.first_numeric_by_keywords``); sums share one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.normalize import col
from ...functions.rules import Rule, band, rules
from .. import ranks
from ..frames import attach
from ..profile import to_long


def _div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def liquidity(df: DataFrame, current_assets: str, current_liabilities: str, inventory: str | None = None,
              cash: str | None = None) -> DataFrame:
    """Current (>= 1.5 good), quick (>= 1.0), cash (>= 0.2) ratios of column sums, 2 dp; bands read the unrounded ratio."""
    s = df.agg(F.sum(col(current_assets)).alias("ca"), F.sum(col(current_liabilities)).alias("cl"),
               (F.sum(col(inventory)) if inventory else F.lit(None).cast("double")).alias("inv"),
               (F.sum(col(cash)) if cash else F.lit(None).cast("double")).alias("cash"))
    cur = _div(F.col("ca"), F.col("cl"))
    quick = _div(F.col("ca") - F.col("inv"), F.col("cl"))
    cr = _div(F.col("cash"), F.col("cl"))
    return s.select(F.round(cur, 2).alias("current_ratio"),
                    F.when(cur >= 1.5, "Good").otherwise("Needs Attention").alias("current_ratio_status"),
                    F.round(quick, 2).alias("quick_ratio"), F.when(quick >= 1.0, "Good").otherwise("Needs Attention").alias("quick_ratio_status"),
                    F.round(cr, 2).alias("cash_ratio"), F.when(cr >= 0.2, "Good").otherwise("Low").alias("cash_ratio_status"))


def profitability(df: DataFrame, revenue: str, net_income: str, cogs: str | None = None, equity: str | None = None,
                  total_assets: str | None = None) -> DataFrame:
    """Net margin (20/10), gross margin (40/25), ROE (15/10), ROA (5/2) in %, 2 dp; bands read the unrounded ratio."""
    s = df.agg(F.sum(col(revenue)).alias("rev"), F.sum(col(net_income)).alias("ni"),
               (F.sum(col(cogs)) if cogs else F.lit(None).cast("double")).alias("cogs"),
               (F.sum(col(equity)) if equity else F.lit(None).cast("double")).alias("eq"),
               (F.sum(col(total_assets)) if total_assets else F.lit(None).cast("double")).alias("ta"))
    nm = _div(F.col("ni"), F.col("rev")) * 100
    gm = _div(F.col("rev") - F.col("cogs"), F.col("rev")) * 100
    roe = _div(F.col("ni"), F.col("eq")) * 100
    roa = _div(F.col("ni"), F.col("ta")) * 100

    def b3(x, hi, mid, labels):
        return F.when(x >= hi, labels[0]).when(x >= mid, labels[1]).otherwise(labels[2])
    return s.select(F.round(nm, 2).alias("net_profit_margin"), b3(nm, 20, 10, ("Excellent", "Good", "Needs Improvement")).alias("net_margin_status"),
                    F.round(gm, 2).alias("gross_profit_margin"), b3(gm, 40, 25, ("Excellent", "Good", "Low")).alias("gross_margin_status"),
                    F.round(roe, 2).alias("roe"), b3(roe, 15, 10, ("Excellent", "Good", "Needs Improvement")).alias("roe_status"),
                    F.round(roa, 2).alias("roa"), b3(roa, 5, 2, ("Excellent", "Good", "Low")).alias("roa_status"))


def sales_growth(df: DataFrame, amount: str, date: str, tie: str) -> DataFrame:
    """Sum of the last half of rows by date against the first half (middle row of an odd count in neither).

    Row positions come from range partitions (no single-partition sort).
    """
    pos = ranks.row_positions(df.select(col(date).alias("_d"), col(tie).alias("_t"), col(amount).alias("_a")),
                              ["_d", "_t"])
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    x = attach(pos, n).withColumn("_h", F.floor(F.col("_n") / 2))
    s = x.agg(F.sum(F.when(F.col("_pos") < F.col("_h"), F.col("_a"))).alias("older_revenue"),
              F.sum(F.when(F.col("_pos") >= F.col("_n") - F.col("_h"), F.col("_a"))).alias("recent_revenue"))
    g = F.try_divide(F.col("recent_revenue") - F.col("older_revenue"), F.col("older_revenue")) * 100
    return s.select("older_revenue", "recent_revenue", F.when(F.col("older_revenue") != 0, F.round(g, 2)).alias("sales_growth"),
                    F.when(F.col("older_revenue") == 0, None).when(g >= 20, "Excellent").when(g >= 10, "Good")
                    .when(g < 0, "Declining").otherwise("Stable").alias("growth_status"))


def ltv_estimate(df: DataFrame, amount: str, customer: str) -> DataFrame:
    """Mean amount * rows per distinct customer * 12; bands 1000 / 500."""
    s = df.agg(F.avg(col(amount)).alias("_m"), F.count(F.lit(1)).alias("_n"), F.count_distinct(col(customer)).alias("_c"))
    freq = F.when(F.col("_c") > 0, F.col("_n") / F.col("_c")).otherwise(1.0)
    ltv = F.col("_m") * freq * 12
    return s.select(F.round(ltv, 2).alias("estimated_customer_ltv"),
                    F.when(ltv >= 1000, "High Value").when(ltv >= 500, "Medium Value").otherwise("Low Value").alias("ltv_band"))


def ratio_insights(liq: DataFrame, prof: DataFrame) -> DataFrame:
    """Sentences for ROE, net margin and current ratio."""
    m = attach(liq, prof)
    items = [
        Rule(F.col("roe").isNotNull(), "Info", "roe", F.format_string(
            "ROE of %s%% indicates %s profitability", F.col("roe"),
            F.when(F.col("roe") >= 15, "strong").when(F.col("roe") >= 10, "moderate").otherwise("weak"))),
        Rule(F.col("net_profit_margin").isNotNull(), "Info", "margin", F.format_string(
            "Net margin of %s%% shows %s efficiency", F.col("net_profit_margin"),
            F.when(F.col("net_profit_margin") >= 20, "excellent").when(F.col("net_profit_margin") >= 10, "good")
            .otherwise("concerning"))),
        Rule(F.col("current_ratio").isNotNull(), "Info", "liquidity", F.format_string(
            "Current ratio of %s indicates %s liquidity", F.col("current_ratio"),
            F.when(F.col("current_ratio") >= 2, "strong").when(F.col("current_ratio") >= 1.5, "adequate").otherwise("tight"))),
    ]
    return rules(m, items)


def financial_kpis(df: DataFrame, amount: str, date: str | None = None, quantity: str | None = None) -> DataFrame:
    """Revenue (total, mean, median, std), volume (count, % of rows), quantity and per-day metrics."""
    a = df.filter(col(amount).isNotNull())
    med = ranks.quantile_wide(to_long(df, [amount]), {"median_revenue_per_transaction": 0.5}).drop("column")
    s = df.agg(F.sum(col(amount)).alias("total_revenue"), F.avg(col(amount)).alias("average_revenue_per_transaction"),
               F.stddev_samp(col(amount)).alias("revenue_standard_deviation"), F.count(col(amount)).alias("total_transactions"),
               F.try_divide(F.count(col(amount)) * 100.0, F.count(F.lit(1))).alias("transaction_frequency"),
               *( [F.sum(col(quantity)).cast("double").alias("total_quantity_sold"),
                   F.avg(col(quantity)).alias("average_quantity_per_transaction")] if quantity else []))
    out = attach(s, med)
    if quantity:
        out = out.withColumn("revenue_per_unit", _div(F.col("total_revenue"), F.col("total_quantity_sold")))
    if date:
        span = a.filter(col(date).isNotNull()).agg(
            F.datediff(F.max(col(date)).cast("date"), F.min(col(date)).cast("date")).alias("data_period_days"))
        out = attach(out, span)
        out = (out.withColumn("revenue_per_day", F.when(F.col("data_period_days") > 0,
                                                        F.col("total_revenue") / F.col("data_period_days")))
               .withColumn("transactions_per_day", F.when(F.col("data_period_days") > 0,
                                                          F.col("total_transactions") / F.col("data_period_days"))))
    return out


def margins(df: DataFrame, amount: str, cost: str, category: str | None = None) -> DataFrame:
    """Profit and margin % (2 dp) per row; totals, overall margin, mean/median/std margin, bands 30/15 (losses count
    as low and as negative).

    With ``category`` (D8 fixed) the same figures per category value, and which category has the highest profit and
    which the highest mean margin (ties: the first in order).
    """
    m = df.filter(col(amount).isNotNull() & col(cost).isNotNull()).select(
        *([col(category).alias("category")] if category else []), col(amount).alias("_a"), col(cost).alias("_c"))
    m = m.withColumn("_p", F.col("_a") - F.col("_c")).withColumn(
        "_mp", F.round(F.try_divide(F.col("_p"), F.col("_a")) * 100, 2))
    keys = ["category"] if category else []
    g = m.groupBy(*keys).agg(
        F.sum("_a").alias("total_revenue"), F.sum("_c").alias("total_costs"), F.sum("_p").alias("total_profit"),
        (F.try_divide(F.sum("_p"), F.sum("_a")) * 100).alias("overall_margin_percent"), F.avg("_mp").alias("average_margin_percent"),
        F.stddev_samp("_mp").alias("margin_volatility"),
        F.sum(F.when(F.col("_mp") > 30, 1).otherwise(0)).alias("high_margin_transactions"),
        F.sum(F.when((F.col("_mp") > 15) & (F.col("_mp") <= 30), 1).otherwise(0)).alias("medium_margin_transactions"),
        F.sum(F.when(F.col("_mp") <= 15, 1).otherwise(0)).alias("low_margin_transactions"),
        F.sum(F.when(F.col("_mp") < 0, 1).otherwise(0)).alias("negative_margin_transactions"))
    grp = F.col("category").cast("string") if category else F.lit("all")
    by = "category" if category else "column"
    med = ranks.quantile_wide(m.select(grp.alias(by), F.col("_mp").alias("value")), {"median_margin_percent": 0.5}, by)
    if category:
        g = g.withColumn("category", F.col("category").cast("string")).join(med, "category")
        best = g.agg(F.min_by("category", F.struct((-F.round("total_profit", 2)).alias("a"), F.col("category").alias("b"))).alias("_bp"),
                     F.min_by("category", F.struct((-F.round("average_margin_percent", 2)).alias("a"), F.col("category").alias("b")))
                     .alias("_bm"))
        return attach(g, best).withColumn("most_profitable", F.col("category") == F.col("_bp")).withColumn(
            "highest_margin", F.col("category") == F.col("_bm")).drop("_bp", "_bm")
    return attach(g, med.drop("column"))


def fulfilment(df: DataFrame, order_date: str, ship_date: str, status: str,
               on_time_pattern: str = "on.time|delivered|success") -> DataFrame:
    """Mean cycle days (ship - order) with their band 2 / 5; % of the non-null status values that match the pattern in any case, with its
    band 95 / 85 (D6 fixed: columns given)."""
    rate = F.try_divide(F.count_if(col(status).cast("string").rlike(f"(?i)({on_time_pattern})")) * 100.0, F.count(col(status)))
    s = df.agg(F.avg(F.datediff(col(ship_date).cast("date"), col(order_date).cast("date"))).alias("avg_cycle_days"),
               F.coalesce(rate, F.lit(0.0)).alias("on_time_percentage"), F.count(col(status)).alias("orders"))
    days = F.col("avg_cycle_days")
    s = s.withColumn("cycle_band", F.when(days <= 2, "Excellent").when(days <= 5, "Good").otherwise("Needs Improvement"))
    return s.withColumn("interpretation", band(F.col("on_time_percentage"), [(95, "Excellent"), (85, "Good")], "Needs Improvement"))


def workforce(df: DataFrame, employee: str, departure: str, performance: str, training_cost: str) -> DataFrame:
    """Turnover % = rows with a departure / distinct employees; training ROI % = (mean performance x 1000 - cost) /
    cost, null unless the cost is positive; each with its band."""
    s = df.agg(F.coalesce(F.try_divide(F.count(col(departure)) * 100.0, F.count_distinct(col(employee))), F.lit(0.0)).alias("turnover_rate"),
               F.avg(col(performance)).alias("_p"), F.sum(col(training_cost)).alias("_c"))
    roi = F.when(F.col("_c") > 0, (F.col("_p") * 1000 - F.col("_c")) / F.col("_c") * 100)
    t = F.col("turnover_rate")
    return s.select("turnover_rate", F.when(t <= 10, "Good").when(t >= 20, "Concerning").otherwise("Moderate").alias("turnover_band"),
                    roi.alias("training_roi"), F.when(roi.isNotNull(), band(roi, [(200, "Excellent"), (100, "Good")], "Poor")).alias("roi_band"))


def project_indices(df: DataFrame, planned_cost: str, actual_cost: str, planned_date: str, actual_date: str) -> DataFrame:
    """CPI = sum planned / sum actual cost; SPI = span in days (max - min) of the planned date column / span of the
    actual one; 0 where the divisor isn't positive."""
    def span(c):
        return F.datediff(F.max(col(c)).cast("date"), F.min(col(c)).cast("date"))
    s = df.agg(F.sum(col(planned_cost)).alias("_p"), F.sum(col(actual_cost)).alias("_a"),
               span(planned_date).alias("planned_days"), span(actual_date).alias("actual_days"))
    cpi = F.when(F.col("_a") > 0, F.col("_p") / F.col("_a")).otherwise(0.0)
    spi = F.when(F.col("actual_days") > 0, F.col("planned_days") / F.col("actual_days")).otherwise(0.0)
    return s.select(cpi.alias("cpi"), F.when(cpi > 1, "Under Budget").when(cpi < 1, "Over Budget").otherwise("On Budget").alias("cost_status"),
                    "planned_days", "actual_days", spi.alias("spi"),
                    F.when(spi > 1, "Ahead of Schedule").when(spi < 1, "Behind Schedule").otherwise("On Schedule").alias("schedule_status"))


def banking(df: DataFrame, receivables: str, sales: str, debt: str, equity: str) -> DataFrame:
    """DSO = mean receivables / (total sales / 365) (band 30 / 45 days); debt-to-equity = sum debt / sum equity (band
    0.5 / 1); 0 where the divisor isn't positive."""
    s = df.agg(F.avg(col(receivables)).alias("_r"), (F.sum(col(sales)) / 365).alias("_s"), F.sum(col(debt)).alias("_d"), F.sum(col(equity)).alias("_e"))
    dso = F.when(F.col("_s") > 0, F.col("_r") / F.col("_s")).otherwise(0.0)
    dte = F.when(F.col("_e") > 0, F.col("_d") / F.col("_e")).otherwise(0.0)
    return s.select(dso.alias("dso"), F.when(dso <= 30, "Excellent").when(dso <= 45, "Good").otherwise("Concerning").alias("dso_band"),
                    dte.alias("debt_to_equity"), F.when(dte <= 0.5, "Conservative").when(dte <= 1, "Moderate").otherwise("Aggressive").alias("debt_band"))


def sales_growth_kpi(df: DataFrame, amount: str, date: str, tie: str) -> DataFrame:
    """B9 as KPI: recent against earlier half (by date) of the rows that have both date and amount; null unless the
    earlier half is positive; bands 20 / 10 / below 0."""
    rows = df.filter(col(date).isNotNull() & col(amount).isNotNull()).select(col(date).alias("_d"), col(tie).alias("_t"), col(amount).alias("_a"))
    x = attach(ranks.row_positions(rows, ["_d", "_t"]), rows.agg(F.count(F.lit(1)).alias("_n"))).withColumn("_h", F.floor(F.col("_n") / 2))
    s = x.agg(F.sum(F.when(F.col("_pos") < F.col("_h"), F.col("_a"))).alias("_o"), F.sum(F.when(F.col("_pos") >= F.col("_n") - F.col("_h"), F.col("_a"))).alias("_r"))
    g = F.when(F.col("_o") > 0, (F.col("_r") - F.col("_o")) / F.col("_o") * 100)
    return s.select(g.alias("sales_growth_percent"), F.when(g >= 20, "Excellent").when(g >= 10, "Good").when(g < 0, "Concerning")
                    .when(g.isNotNull(), "Stable").alias("interpretation"))


def engagement(df: DataFrame, user: str, interactions: str, duration: str) -> DataFrame:
    """Active users (distinct), sum and mean of an interaction column, mean session duration, each with its band."""
    s = df.agg(F.count_distinct(col(user)).alias("active_users"), F.sum(col(interactions)).cast("long").alias("total_interactions"),
               F.avg(col(interactions)).alias("avg_interactions_per_record"), F.avg(col(duration)).alias("avg_session_duration"))
    return (s.withColumn("user_band", band(F.col("active_users"), [(1000, "High Engagement"), (100, "Medium Engagement")], "Low Engagement"))
            .withColumn("activity_band", band(F.col("avg_interactions_per_record"), [(10, "High Activity"), (5, "Moderate Activity")], "Low Activity"))
            .withColumn("session_band", band(F.col("avg_session_duration"), [(15, "Highly Engaged"), (5, "Engaged")], "Brief Sessions")))


def governance(df: DataFrame, audit: str, subscription: str) -> DataFrame:
    """Valid (non-null) cell %, audit coverage (% rows with the audit column set), MRR = sum of the subscription
    column, each with its band."""
    cols = df.columns
    nn = sum([F.count(col(c)) for c in cols[1:]], F.count(col(cols[0])))
    s = df.agg(F.coalesce(F.try_divide(nn * 100.0, F.count(F.lit(1)) * len(cols)), F.lit(0.0)).alias("valid_cell_percentage"),
               F.try_divide(F.count(col(audit)) * 100.0, F.count(F.lit(1))).alias("audit_coverage"),
               F.count(col(audit)).alias("tracked_records"), F.coalesce(F.sum(col(subscription)), F.lit(0.0)).alias("mrr"))
    return (s.withColumn("quality_band", band(F.col("valid_cell_percentage"), [(95, "Excellent"), (85, "Good")], "Needs Improvement"))
            .withColumn("audit_band", band(F.col("audit_coverage"), [(95, "Full Compliance"), (80, "Partial Compliance")], "Poor Compliance"))
            .withColumn("mrr_band", band(F.col("mrr"), [(50000, "Strong MRR"), (10000, "Growing MRR")], "Early Stage")))
