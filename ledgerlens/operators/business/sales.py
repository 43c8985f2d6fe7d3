"""Sales summaries, distributions, trends and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.normalize import col
from .. import ranks
from ..frames import attach
from ..profile import to_long


def month(c) -> F.Column:
    return F.date_trunc("month", col(c)).cast("date")


def sales_summary(df: DataFrame, amounts: list[str]) -> DataFrame:
    """Total, mean, median per amount column (exact median)."""
    long = to_long(df, amounts)
    m = long.groupBy("column").agg(F.sum("value").alias("total_revenue"), F.avg("value").alias("average_transaction"))
    q = ranks.quantile_wide(long, {"median_transaction": 0.5})
    return m.join(q, "column")


def top_transactions(df: DataFrame, amount: str, context: list[str], tie: str, n: int = 10) -> DataFrame:
    """The n largest amounts with context columns (distributed TakeOrdered; ties by ``tie``)."""
    return (df.filter(col(amount).isNotNull()).orderBy(F.desc(amount), F.asc(tie)).limit(n)
            .select(col(amount).alias("amount"), *[col(c) for c in context]))


def revenue_distribution(df: DataFrame, amount: str) -> DataFrame:
    """Quartiles, max, P90/95/99, std, CV (std/mean) and sample-adjusted skew."""
    long = to_long(df, [amount])
    q = ranks.quantile_wide(long, {"q1": 0.25, "q2_median": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    n = F.col("n")
    m = long.groupBy("column").agg(F.max("value").alias("q4_max"), F.stddev_samp("value").alias("std_deviation"),
                                   F.avg("value").alias("_mean"), F.skewness("value").alias("_g1"),
                                   F.count(F.lit(1)).alias("n"))
    adj = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    return (m.join(q, "column").withColumn("coefficient_of_variation",
                                           F.when(F.col("_mean") != 0, F.col("std_deviation") / F.col("_mean"))
                                           .otherwise(0.0))
            .withColumn("skewness", adj).drop("_mean", "_g1", "n"))


def performance(df: DataFrame, amount: str, date: str | None = None) -> DataFrame:
    """Non-null count, mean, 'conversion' % of rows; growth first->last month sum when > 10 amounts."""
    base = df.agg(F.count(col(amount)).alias("total_transactions"), F.avg(col(amount)).alias("revenue_per_transaction"),
                  F.try_divide(F.count(col(amount)) * 100.0, F.count(F.lit(1))).alias("conversion_rate"))
    if not date:
        return base
    monthly = (df.filter(col(date).isNotNull() & col(amount).isNotNull())
               .groupBy(month(date).alias("m")).agg(F.sum(col(amount)).alias("s")))
    g = monthly.agg(F.min_by("s", "m").alias("_first"), F.max_by("s", "m").alias("_last"), F.count(F.lit(1)).alias("_k"))
    out = attach(base, g)
    growth = F.when((F.col("total_transactions") > 10) & (F.col("_k") > 1),
                    F.try_divide((F.col("_last") - F.col("_first")) * 100, F.col("_first")))
    return out.withColumn("revenue_growth_rate", growth).drop("_first", "_last", "_k")


def monthly_trend(df: DataFrame, amount: str, date: str) -> DataFrame:
    """Per month sum, mean, count (2 dp) and peak / lowest month flags."""
    m = (df.filter(col(date).isNotNull() & col(amount).isNotNull())
         .groupBy(month(date).alias("month")).agg(F.round(F.sum(col(amount)), 2).alias("revenue"),
                                                   F.round(F.avg(col(amount)), 2).alias("average"),
                                                   F.count(F.lit(1)).alias("transactions")))
    ext = m.agg(F.min_by("month", F.struct((-F.col("revenue")).alias("a"), F.col("month").alias("b"))).alias("_peak"),
                F.min_by("month", F.struct(F.col("revenue").alias("a"), F.col("month").alias("b"))).alias("_low"))
    return (attach(m, ext).withColumn("is_peak", F.col("month") == F.col("_peak"))
            .withColumn("is_lowest", F.col("month") == F.col("_low")).drop("_peak", "_low"))


def category_performance(df: DataFrame, amount: str, categories: list[str]) -> DataFrame:
    """Per category column and value: sum, mean, count, std (2 dp); top and lowest performer flags."""
    long = df.select(col(amount).alias("_a"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("category_column"), col(c).cast("string").alias("category")) for c in categories]))
        .alias("kv")).select("_a", "kv.*").filter(F.col("category").isNotNull())
    g = long.groupBy("category_column", "category").agg(
        F.round(F.sum("_a"), 2).alias("revenue"), F.round(F.avg("_a"), 2).alias("average"),
        F.count("_a").alias("transactions"), F.round(F.stddev_samp("_a"), 2).alias("std"))
    ext = g.groupBy("category_column").agg(
        F.min_by("category", F.struct((-F.col("revenue")).alias("a"), F.col("category").alias("b"))).alias("_top"),
        F.min_by("category", F.struct(F.col("revenue").alias("a"), F.col("category").alias("b"))).alias("_low"))
    return (g.join(F.broadcast(ext), "category_column")
            .withColumn("is_top", F.col("category") == F.col("_top"))
            .withColumn("is_lowest", F.col("category") == F.col("_low")).drop("_top", "_low"))


def trend_slope(df: DataFrame, amount: str, date: str) -> DataFrame:
    """Least-squares slope of amount per day, slope as % of mean, confidence by n (>=30 high, >=10 medium)."""
    x = df.filter(col(amount).isNotNull() & col(date).isNotNull())
    mn = x.agg(F.min(col(date).cast("date")).alias("_d0"))
    xd = attach(x, mn).select(F.datediff(col(date).cast("date"), F.col("_d0")).cast("double").alias("x"),
                              col(amount).cast("double").alias("y"))
    r = xd.agg(F.regr_slope("y", "x").alias("slope_per_day"), F.avg("y").alias("_mean"), F.count(F.lit(1)).alias("n"))
    return r.select("slope_per_day", F.when(F.col("_mean") != 0, F.col("slope_per_day") / F.col("_mean") * 100)
                    .alias("slope_pct_of_mean"), "n",
                    F.when(F.col("n") >= 30, "Good").when(F.col("n") >= 10, "Moderate").otherwise("Basic").alias("confidence"),
                    F.when(F.col("slope_per_day") > 0, "Growing").when(F.col("slope_per_day") < 0, "Declining")
                    .otherwise("Stable").alias("direction"))


def anomalies(df: DataFrame, amount: str) -> DataFrame:
    """Values beyond 2 sigma: rate %, count, thresholds and band 10 / 5 (null up to five values); also those above,
    below, and beyond 3 sigma."""
    a = df.filter(col(amount).isNotNull()).select(col(amount).cast("double").alias("a"))
    st = a.agg(F.avg("a").alias("mean"), F.stddev_samp("a").alias("std"), F.count(F.lit(1)).alias("n"))
    up, low = F.col("a") > F.col("mean") + 2 * F.col("std"), F.col("a") < F.col("mean") - 2 * F.col("std")
    x = attach(a, st).agg(F.count_if(up).alias("above_2sigma"), F.count_if(low).alias("below_2sigma"),
                          F.count_if(F.abs(F.col("a") - F.col("mean")) > 3 * F.col("std")).alias("beyond_3sigma"))
    x = attach(st, x)
    count = F.col("above_2sigma") + F.col("below_2sigma")
    rate = F.when(F.col("n") > 5, count * 100.0 / F.col("n"))
    return x.select("mean", "std", "above_2sigma", "below_2sigma", "beyond_3sigma", "n", rate.alias("anomaly_rate"),
                    (F.col("mean") + 2 * F.col("std")).alias("threshold_upper"), (F.col("mean") - 2 * F.col("std")).alias("threshold_lower"),
                    F.when(rate > 10, "High Variance").when(rate > 5, "Normal Variance").when(rate.isNotNull(), "Low Variance").alias("interpretation"))


def date_ranges(df: DataFrame, dates: list[str]) -> DataFrame:
    """Per date column start, end, span in days and non-null points."""
    parts = [df.agg(F.lit(c).alias("column"), F.min(col(c)).cast("date").alias("start_date"),
                    F.max(col(c)).cast("date").alias("end_date"),
                    F.datediff(F.max(col(c)).cast("date"), F.min(col(c)).cast("date")).alias("duration_days"),
                    F.count(col(c)).alias("data_points")) for c in dates]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def key_insights(df: DataFrame, amounts: list[str], categories: list[str], ratings: list[str], n_dates: int,
                 limit: int = 6) -> DataFrame:
    """Up to six insight lines: totals and averages per amount column, top value of the first two category
    columns, average ratings, number of time dimensions."""
    from functools import reduce as _reduce
    lines = []
    for c in amounts:
        lines.append(df.agg(F.format_string("Total %s: %.2f | Average: %.2f", F.lit(c), F.sum(col(c)), F.avg(col(c)))
                            .alias("insight")))
    for c in categories[:2]:
        vc = df.filter(col(c).isNotNull()).groupBy(col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        lines.append(vc.agg(F.format_string("Top %s: %s (%d records)", F.lit(c),
                                            F.min_by("v", F.struct((-F.col("n")).alias("a"), F.col("v").alias("b"))),
                                            F.max("n")).alias("insight")))
    for c in ratings:
        lines.append(df.agg(F.format_string("Average %s: %.2f", F.lit(c), F.avg(col(c))).alias("insight")))
    if n_dates:
        lines.append(df.limit(1).select(F.lit(f"Data spans {n_dates} time dimension(s)").alias("insight")))
    tagged = [l.withColumn("position", F.lit(i)) for i, l in enumerate(lines)]
    return _reduce(lambda a, b: a.unionByName(b), tagged).filter(F.col("position") < limit)
