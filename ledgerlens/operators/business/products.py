"""Product overview, performance and monthly trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.normalize import col
from ..frames import attach, top_k
from .sales import month


def product_overview(df: DataFrame, product: str) -> DataFrame:
    """Distinct products, most / least popular (count, then name), diversity = products / rows."""
    vc = df.filter(col(product).isNotNull()).groupBy(col(product).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    s = vc.agg(F.count(F.lit(1)).alias("total_products"),
               F.min_by("p", F.struct((-F.col("n")).alias("a"), F.col("p").alias("b"))).alias("most_popular_product"),
               F.min_by("p", F.struct(F.col("n").alias("a"), F.col("p").alias("b"))).alias("least_popular_product"))
    return attach(s, rows).withColumn("product_diversity_index", F.try_divide("total_products", "_rows")).drop("_rows")


def product_distribution(df: DataFrame, product: str, k: int = 10) -> DataFrame:
    """Rows of the k most frequent products, ties by product."""
    vc = df.filter(col(product).isNotNull()).groupBy(col(product).alias("product")).agg(F.count(F.lit(1)).alias("count"))
    return top_k(vc, [], [F.desc("count"), F.asc("product")], k)


def product_months(df: DataFrame, product: str, amount: str, date: str) -> DataFrame:
    """The month x product grid of sales, 0 where a product has none in a month that others have."""
    base = df.filter(col(date).isNotNull() & col(product).isNotNull() & col(amount).isNotNull())
    cells = base.groupBy(month(date).alias("month"), col(product).alias("product")).agg(F.sum(col(amount)).alias("sales"))
    # the grid is the result: every product gets every month that occurs
    months = cells.agg(F.array_sort(F.collect_set("month")).alias("months"))
    grid = attach(cells.select("product").distinct(), months).select("product", F.explode("months").alias("month"))
    return grid.join(cells, ["product", "month"], "left").select("product", "month", F.coalesce("sales", F.lit(0.0)).alias("sales"))


def product_performance(df: DataFrame, product: str, amount: str) -> DataFrame:
    """Per product sum, mean, count (2 dp) and flags for top revenue, top volume, highest mean price."""
    g = df.filter(col(product).isNotNull()).groupBy(col(product).alias("product")).agg(
        F.round(F.sum(col(amount)), 2).alias("revenue"), F.round(F.avg(col(amount)), 2).alias("average_price"),
        F.count(col(amount)).alias("volume"))
    e = g.agg(F.min_by("product", F.struct((-F.col("revenue")).alias("a"), F.col("product").alias("b"))).alias("_r"),
              F.min_by("product", F.struct((-F.col("volume")).alias("a"), F.col("product").alias("b"))).alias("_v"),
              F.min_by("product", F.struct((-F.col("average_price")).alias("a"), F.col("product").alias("b"))).alias("_p"))
    return (attach(g, e).withColumn("top_revenue", F.col("product") == F.col("_r"))
            .withColumn("top_volume", F.col("product") == F.col("_v"))
            .withColumn("highest_priced", F.col("product") == F.col("_p")).drop("_r", "_v", "_p"))


def product_trends(df: DataFrame, product: str, amount: str, date: str) -> DataFrame:
    """Per product, sales in the first and last month of the *whole* data (0 when absent), direction,
    peak month and growth %.

    The reference fills a month x product grid with zeros; only the global
    first/last month cells and the peak are read from it, so a one-row
    aggregate (first/last month) and a conditional sum give the same values
    without materialising the grid.
    """
    base = df.filter(col(date).isNotNull() & col(product).isNotNull() & col(amount).isNotNull())
    cells = base.groupBy(month(date).alias("month"), col(product).alias("product")).agg(F.sum(col(amount)).alias("s"))
    span = cells.agg(F.min("month").alias("_m0"), F.max("month").alias("_m1"))
    x = attach(cells, span)
    ext = x.groupBy("product").agg(
        F.coalesce(F.sum(F.when(F.col("month") == F.col("_m0"), F.col("s"))), F.lit(0.0)).alias("_first"),
        F.coalesce(F.sum(F.when(F.col("month") == F.col("_m1"), F.col("s"))), F.lit(0.0)).alias("_last"),
        F.min_by("month", F.struct((-F.col("s")).alias("a"), F.col("month").alias("b"))).alias("peak_month"))
    return ext.select(
        "product", F.col("_first").alias("first_month_sales"), F.col("_last").alias("last_month_sales"),
        F.when(F.col("_last") > F.col("_first"), "growing").otherwise("declining").alias("trend_direction"), "peak_month",
        F.when(F.col("_first") != 0, (F.col("_last") - F.col("_first")) / F.col("_first") * 100).otherwise(0.0)
        .alias("growth_rate"))
