"""Discount impact and effectiveness, optimal discount range, price bands, category optimisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.normalize import col
from .. import ranks
from ..frames import attach
from ..profile import to_long

# The reference's discount bins (right-closed) and labels.
DISCOUNT_BINS = [(None, 0.0, "No Discount"), (0.0, 5.0, "Low (0-5%)"), (5.0, 15.0, "Medium (5-15%)"),
                 (15.0, 30.0, "High (15-30%)"), (30.0, None, "Very High (30%+)")]


def discount_impact(df: DataFrame, discount: str, amount: str) -> DataFrame:
    """Count / sum / mean / std (2 dp) of amount per discount bin; empty bins kept with count 0."""
    d = df.filter(col(discount).isNotNull() & col(amount).isNotNull()).select(col(discount).alias("d"), col(amount).alias("a"))
    label = None
    for lo, hi, name in DISCOUNT_BINS:
        cond = (F.col("d") > lo) if lo is not None else F.lit(True)
        if hi is not None:
            cond = cond & (F.col("d") <= hi)
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    g = d.withColumn("discount_category", label).groupBy("discount_category").agg(
        F.count(F.lit(1)).alias("transactions"), F.round(F.sum("a"), 2).alias("revenue"),
        F.round(F.avg("a"), 2).alias("average_transaction"), F.round(F.stddev_samp("a"), 2).alias("revenue_std"))
    bins = df.sparkSession.createDataFrame([(i, n) for i, (_, _, n) in enumerate(DISCOUNT_BINS)], "bin_order int, discount_category string")
    return (F.broadcast(bins).join(g, "discount_category", "left")
            .withColumn("transactions", F.coalesce("transactions", F.lit(0)).cast("long")))


def discount_effectiveness(df: DataFrame, discount: str, amount: str) -> DataFrame:
    """Correlation, revenue per discount point and the rating of the two."""
    d = df.filter(col(discount).isNotNull() & col(amount).isNotNull())
    s = d.agg(F.corr(col(discount).cast("double"), col(amount).cast("double")).alias("_r"),
              F.sum(col(discount)).alias("_d"), F.sum(col(amount)).alias("_a"))
    r = F.coalesce(F.col("_r"), F.lit(0.0))
    rpp = F.when(F.col("_d") > 0, F.col("_a") / F.col("_d")).otherwise(0.0)
    rating = (F.when(F.col("_r").isNull(), "Insufficient data")
              .when((F.col("_r") < -0.3) & (rpp < 50), "Poor - discounts may be reducing profitability")
              .when((F.col("_r") < 0) & (rpp > 50), "Moderate - discounts driving volume but reducing margins")
              .when(F.col("_r") > 0.1, "Good - discounts correlated with higher transaction values")
              .otherwise("Average - mixed discount effectiveness"))
    return s.select(r.alias("discount_revenue_correlation"), rpp.alias("revenue_per_discount_point"),
                    rating.alias("effectiveness_rating"))


def optimal_discount_range(df: DataFrame, discount: str, amount: str, bins: int = 10) -> DataFrame:
    """10 equal right-closed bins (lowest edge widened by 0.1% of the range), ranges without rows with 0 and a null
    mean; best bin by sum and by mean. A constant column is one point within the middle bins' border: it fills bin 4."""
    d = df.filter(col(discount).isNotNull() & col(amount).isNotNull()).select(col(discount).cast("double").alias("d"),
                                                                             col(amount).alias("a"))
    r = d.agg(F.min("d").alias("_lo"), F.max("d").alias("_hi"))
    # a constant c is cut over c -/+ 0.1% of |c| (0.001 for zero)
    pad = F.when(F.col("_lo") == F.col("_hi"), F.when(F.col("_lo") == 0, 0.001).otherwise(F.abs("_lo") * 0.001)).otherwise(0.0)
    r = r.filter("_lo is not null").select((F.col("_lo") - pad).alias("_lo"), (F.col("_hi") + pad).alias("_hi"), (pad > 0).alias("_const"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_const"), (bins - 1) // 2).otherwise(
        F.least(F.greatest(F.ceil((F.col("d") - F.col("_lo")) / w) - 1, F.lit(0)), F.lit(bins - 1))).cast("int")
    g = attach(d, r).withColumn("bin", b).groupBy("bin").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("a").alias("revenue"), F.avg("a").alias("average"))
    e = g.agg(F.min_by("bin", F.struct((-F.col("revenue")).alias("a"), F.col("bin").alias("b"))).alias("_bs"),
              F.min_by("bin", F.struct((-F.col("average")).alias("a"), F.col("bin").alias("b"))).alias("_bm"))
    every = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lower = F.when((F.col("bin") == 0) & ~F.col("_const"), F.col("_lo") - (F.col("_hi") - F.col("_lo")) * 0.001).otherwise(
        F.col("_lo") + F.col("bin") * w)
    upper = F.col("_lo") + (F.col("bin") + 1) * w
    return attach(every.join(g, "bin", "left"), e).select(
        "bin", lower.alias("lower"), upper.alias("upper"), F.coalesce("transactions", F.lit(0)).cast("long").alias("transactions"),
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"), "average", (F.col("bin") == F.col("_bs")).alias("best_for_revenue"),
        (F.col("bin") == F.col("_bm")).alias("best_for_average"))


def price_points(df: DataFrame, amount: str) -> DataFrame:
    """Counts below q33, in [q33, q67), at or above q67; share of total held by the top and bottom 20% of rows.

    The top/bottom k = int(0.2 n) rows are taken exactly from cumulative
    counts over distinct values (a boundary value contributes only the rows
    that fall inside the k).
    """
    long = to_long(df, [amount])
    q = ranks.quantile_wide(long, {"q33": 0.33, "q67": 0.67}).drop("column")
    a = long.select(F.col("value").alias("a"))
    bands = attach(a, q).agg(
        F.avg("a").alias("current_average_price"),
        F.sum(F.when(F.col("a") < F.col("q33"), 1).otherwise(0)).alias("low_price_transactions"),
        F.sum(F.when((F.col("a") >= F.col("q33")) & (F.col("a") < F.col("q67")), 1).otherwise(0)).alias("medium_price_transactions"),
        F.sum(F.when(F.col("a") >= F.col("q67"), 1).otherwise(0)).alias("high_price_transactions"),
        F.sum("a").alias("_total"))
    cum = ranks.cumulative_counts(long)
    k = F.floor(F.col("n") * 0.2)
    top_rows = F.greatest(F.lit(0), F.least(F.col("before") + F.col("cnt"), F.col("n")) - F.greatest(F.col("before"), F.col("n") - k))
    bot_rows = F.greatest(F.lit(0), F.least(F.col("before") + F.col("cnt"), k) - F.col("before"))
    tb = cum.agg(F.sum(F.col("value") * top_rows).alias("_top"), F.sum(F.col("value") * bot_rows).alias("_bot"))
    x = attach(bands, tb)
    return x.select("current_average_price", "low_price_transactions", "medium_price_transactions", "high_price_transactions",
                    (F.try_divide("_top", "_total") * 100).alias("top_20_percent_contribution"),
                    (F.try_divide("_bot", "_total") * 100).alias("bottom_20_percent_contribution"))


def category_optimisation(df: DataFrame, category: str, amount: str) -> DataFrame:
    """Per category sum/count/mean; underperforming = mean below the overall mean; high potential = count above
    the median category count."""
    g = df.filter(col(category).isNotNull()).groupBy(col(category).alias("category")).agg(
        F.sum(col(amount)).alias("revenue"), F.count(col(amount)).alias("transactions"), F.avg(col(amount)).alias("average"))
    overall = df.agg(F.avg(col(amount)).alias("_m"))
    med = ranks.quantile_wide(g.select(F.lit("c").alias("column"), F.col("transactions").cast("double").alias("value")),
                              {"_med": 0.5}).drop("column")
    return (attach(attach(g, overall), med)
            .withColumn("underperforming", F.col("average") < F.col("_m"))
            .withColumn("high_potential", F.col("transactions") > F.col("_med")).drop("_m", "_med"))
