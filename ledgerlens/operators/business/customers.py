"""Customer segments, behaviour, satisfaction, value, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.normalize import col
from ...functions.rules import band
from .. import ranks
from ..frames import attach, top_k
from ..profile import to_long
from .sales import month


def _q(df: DataFrame, c: str, probs: dict[str, float]) -> DataFrame:
    return ranks.quantile_wide(to_long(df, [c]), probs).drop("column")


def value_segments(df: DataFrame, amount: str) -> DataFrame:
    """Counts above q75 (high), in (q50, q75] (medium), at or below q50 (low), with the thresholds."""
    q = _q(df, amount, {"q50": 0.5, "q75": 0.75})
    a = df.filter(col(amount).isNotNull() & ~F.isnan(col(amount))).select(col(amount).alias("a"))
    x = attach(a, q)
    return x.agg(F.sum(F.when(F.col("a") > F.col("q75"), 1).otherwise(0)).alias("high_value"),
                 F.sum(F.when((F.col("a") > F.col("q50")) & (F.col("a") <= F.col("q75")), 1).otherwise(0)).alias("medium_value"),
                 F.sum(F.when(F.col("a") <= F.col("q50"), 1).otherwise(0)).alias("low_value"),
                 F.max("q75").alias("high_value_min"), F.max("q50").alias("medium_value_min"))


def frequency_segments(df: DataFrame, customer: str) -> DataFrame:
    """Repeat (>1 row) and one-time customers, mean transactions per customer."""
    f = df.filter(col(customer).isNotNull()).groupBy(col(customer)).agg(F.count(F.lit(1)).alias("n"))
    return f.agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeat_customers"),
                 F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("one_time_customers"),
                 F.avg("n").alias("average_transactions_per_customer"))


def top_customers_by_rows(df: DataFrame, customer: str, k: int = 10) -> DataFrame:
    """The k customers with most rows, ties by customer."""
    f = df.filter(col(customer).isNotNull()).groupBy(col(customer).alias("customer")).agg(F.count(F.lit(1)).alias("transactions"))
    return top_k(f, [], [F.desc("transactions"), F.asc("customer")], k)


def behaviour_by_category(df: DataFrame, category: str, amount: str, k: int = 10) -> DataFrame:
    """Mean spend (2 dp) of every category; transactions of the k most frequent ones only (else null)."""
    g = df.filter(col(category).isNotNull()).groupBy(col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("transactions"), F.round(F.avg(col(amount)), 2).alias("average_spend"))
    top = g.orderBy(F.desc("transactions"), F.asc("category")).limit(k).select("category", "transactions")
    return g.drop("transactions").join(F.broadcast(top), "category", "left").select("category", "transactions", "average_spend")


def behaviour_by_time(df: DataFrame, date: str) -> DataFrame:
    """Transactions by weekday name and by month name (full names)."""
    d = df.filter(col(date).isNotNull())
    wd = d.groupBy(F.date_format(col(date), "EEEE").alias("label")).agg(F.count(F.lit(1)).alias("transactions"))
    mo = d.groupBy(F.date_format(col(date), "MMMM").alias("label")).agg(F.count(F.lit(1)).alias("transactions"))
    return wd.withColumn("dimension", F.lit("weekday")).unionByName(mo.withColumn("dimension", F.lit("month")))


def seasonality(df: DataFrame, date: str) -> DataFrame:
    """Rows per quarter, peak quarter, pattern detected when std > 0.2 * mean of quarter counts."""
    q = df.filter(col(date).isNotNull()).groupBy(F.quarter(col(date)).alias("quarter")).agg(
        F.count(F.lit(1)).alias("transactions"))
    s = q.agg(F.stddev_samp("transactions").alias("_s"), F.avg("transactions").alias("_m"),
              F.min_by("quarter", F.struct((-F.col("transactions")).alias("a"), F.col("quarter").alias("b"))).alias("_p"))
    return (attach(q, s).withColumn("peak_quarter", F.concat(F.lit("Q"), F.col("_p").cast("string")))
            .withColumn("seasonal_pattern", F.when(F.col("_s") > F.col("_m") * 0.2, "detected").otherwise("minimal"))
            .drop("_s", "_m", "_p"))


def satisfaction(df: DataFrame, rating: str) -> DataFrame:
    """Mean rating, level (4.5 / 4 / 3.5 / 3 bands), responses, and the rating distribution."""
    r = df.filter(col(rating).isNotNull())
    dist = r.groupBy(col(rating).cast("double").alias("rating")).agg(F.count(F.lit(1)).alias("responses_at_rating"))
    s = r.agg(F.avg(col(rating)).alias("average_rating"), F.count(F.lit(1)).alias("total_responses"))
    lvl = (F.when(F.col("average_rating") >= 4.5, "Excellent").when(F.col("average_rating") >= 4.0, "Good")
           .when(F.col("average_rating") >= 3.5, "Average").when(F.col("average_rating") >= 3.0, "Below Average")
           .otherwise("Poor"))
    return attach(dist, s.withColumn("satisfaction_level", lvl))


def rating_trend(df: DataFrame, rating: str, date: str) -> DataFrame:
    """Monthly mean rating (2 dp), direction (last vs first month), best and worst month flags."""
    m = (df.filter(col(rating).isNotNull() & col(date).isNotNull()).groupBy(month(date).alias("month"))
         .agg(F.avg(col(rating)).alias("_avg")))
    e = m.agg(F.min_by("_avg", "month").alias("_f"), F.max_by("_avg", "month").alias("_l"),
              F.min_by("month", F.struct((-F.col("_avg")).alias("a"), F.col("month").alias("b"))).alias("_best"),
              F.min_by("month", F.struct(F.col("_avg").alias("a"), F.col("month").alias("b"))).alias("_worst"))
    return (attach(m, e).select("month", F.round("_avg", 2).alias("average_rating"),
                                F.when(F.col("_l") > F.col("_f"), "improving").otherwise("declining").alias("trend_direction"),
                                (F.col("month") == F.col("_best")).alias("is_best"),
                                (F.col("month") == F.col("_worst")).alias("is_worst")))


def customer_values(df: DataFrame, customer: str, amount: str) -> DataFrame:
    """Per customer sum, count, mean of amount (nulls keys dropped)."""
    return df.filter(col(customer).isNotNull()).groupBy(col(customer).alias("customer")).agg(
        F.sum(col(amount)).alias("value"), F.count(col(amount)).alias("transactions"), F.avg(col(amount)).alias("mean"))


def top_customers(df: DataFrame, customer: str, amount: str, by: str = "value", k: int = 10) -> DataFrame:
    """Top-k customers by total value or by frequency (ties by customer key)."""
    cv = customer_values(df, customer, amount)
    return cv.orderBy(F.desc_nulls_last(by), F.asc("customer")).limit(k)


def customer_value_summary(df: DataFrame, customer: str, amount: str) -> DataFrame:
    """Total and mean value; q40/q80 transaction bands and concentration; CLV bands and std."""
    a = df.filter(col(amount).isNotNull() & ~F.isnan(col(amount))).select(col(amount).alias("a"))
    q = _q(df, amount, {"t40": 0.4, "t80": 0.8})
    tx = attach(a, q).agg(
        F.sum("a").alias("total_customer_value"), F.avg("a").alias("average_customer_value"),
        F.sum(F.when(F.col("a") > F.col("t80"), 1).otherwise(0)).alias("high_value_transactions"),
        F.sum(F.when((F.col("a") > F.col("t40")) & (F.col("a") <= F.col("t80")), 1).otherwise(0))
        .alias("medium_value_transactions"),
        F.sum(F.when(F.col("a") <= F.col("t40"), 1).otherwise(0)).alias("low_value_transactions"),
        F.try_divide(F.max("t80"), F.avg("a")).alias("value_concentration"))
    cv = customer_values(df, customer, amount).select(F.col("value").alias("v")).filter(F.col("v").isNotNull())
    cq = ranks.quantile_wide(cv.select(F.lit("clv").alias("column"), F.col("v").alias("value")), {"c40": 0.4, "c80": 0.8})
    clv = attach(cv, cq.drop("column")).agg(
        F.avg("v").alias("average_clv"),
        F.sum(F.when(F.col("v") > F.col("c80"), 1).otherwise(0)).alias("high_clv_customers"),
        F.sum(F.when((F.col("v") > F.col("c40")) & (F.col("v") <= F.col("c80")), 1).otherwise(0)).alias("medium_clv_customers"),
        F.sum(F.when(F.col("v") <= F.col("c40"), 1).otherwise(0)).alias("low_clv_customers"),
        F.stddev_samp("v").alias("clv_variance"))
    return attach(tx, clv)


def retention(df: DataFrame, customer: str, date: str) -> DataFrame:
    """Retention % = customers with more than one row / customers (band 80 / 60); churn = 100 - retention (band 20 / 40).
    Rows count that have both a customer and a date."""
    f = df.filter(col(customer).isNotNull() & col(date).isNotNull()).groupBy(col(customer)).agg(F.count(F.lit(1)).alias("n"))
    r = f.agg(F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)), F.lit(0)).alias("returning"))
    rate = F.coalesce(F.try_divide(F.col("returning") * 100.0, F.col("customers")), F.lit(0.0))
    churn = 100 - rate
    return r.select("customers", "returning", rate.alias("retention_rate"), churn.alias("churn_rate"),
                    band(rate, [(80, "Excellent"), (60, "Good")], "Needs Improvement").alias("retention_band"),
                    F.when(churn <= 20, "Good").when(churn >= 40, "Concerning").otherwise("Moderate").alias("churn_band"))


def acquisition(df: DataFrame, customer: str, amount: str, marketing: str) -> DataFrame:
    """CAC = marketing spend / customers (band 100 / 500); LTV = mean customer value * mean transactions / 12 (band
    1000 / 500)."""
    cv = customer_values(df, customer, amount)
    c = cv.agg(F.count(F.lit(1)).alias("customers"), F.avg("value").alias("_mv"), F.avg("transactions").alias("_mt"))
    x = attach(c, df.agg(F.sum(col(marketing)).alias("marketing_spend")))
    cac, ltv = F.coalesce(F.try_divide("marketing_spend", "customers"), F.lit(0.0)), F.col("_mv") * F.col("_mt") / 12
    return x.select("customers", "marketing_spend", cac.alias("cac"), ltv.alias("ltv"),
                    F.when(cac <= 100, "Efficient").when(cac >= 500, "Expensive").otherwise("Moderate").alias("cac_band"),
                    band(ltv, [(1000, "High Value"), (500, "Medium Value")], "Low Value").alias("ltv_band"))
