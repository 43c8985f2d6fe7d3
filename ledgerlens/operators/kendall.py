"""Exact Kendall tau-b without enumerating pairs.

Two points are discordant if the one further left lies higher. Give the distinct y values numbers 0, 1, 2, ...; two different
numbers agree in their leading bits down to one bit, in which the larger has 1. So each discordant pair belongs to exactly one
level (that bit) and one group (the leading bits above it), and there the point on the left has bit 1, the one on the right bit 0.
In a group, in order of x, the count is thus a running sum: for every point with bit 0, the weight of the points with bit 1
strictly left of it. All levels run at once: a point gives a row for each level, rows are summed by (level, group, x) before they
are shuffled, dealt in ranges of it, and running totals are stitched over the tasks from a small table. No group, however many
points it holds, is gathered in one place, and nothing but the result reaches the driver.

Points are first collapsed to distinct (x, y) with a weight, and the column with fewer distinct values is numbered: it takes
log2 of that number of rows a point. Concordant pairs follow from the tie identity nc + nd = n0 - n_x - n_y + n_xy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import col
from . import ranks
from .frames import attach


def _discordant(weighted: DataFrame, levels: int) -> DataFrame:
    """One row (discordant): weight of the pairs with x left and y higher. weighted: (x, y number, w)."""
    keys = ["level", "group"]
    rows = weighted.select("x", "w", "y", F.explode(F.sequence(F.lit(0), F.lit(max(levels - 1, 0)))).alias("level"))
    bit = F.expr("shiftright(y, level) & 1L")
    summed = rows.select("level", F.expr("shiftright(y, level + 1)").alias("group"), "x", bit.alias("bit"), "w").groupBy(*keys, "x").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("w")).otherwise(0)).alias("low"), F.sum(F.when(F.col("bit") == 1, F.col("w")).otherwise(0)).alias("high"))
    ranged = ranks._checkpoint(summed.repartitionByRange(*keys, "x").withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid", *keys).agg(F.sum("high").alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(
        Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_before > 0").drop("_t")
    inside = F.coalesce(F.sum("high").over(Window.partitionBy("_pid", *keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = ranged.withColumn("_inside", inside).where("low > 0").groupBy("_pid", *keys).agg(
        F.sum(F.col("low") * F.col("_inside")).alias("own"), F.sum("low").alias("low"))
    # points on the left in earlier tasks count for all points with bit 0 of the task
    return own.join(before, ["_pid", *keys], "left").agg(
        F.coalesce(F.sum(F.col("own") + F.col("low") * F.coalesce("_before", F.lit(0))), F.lit(0)).alias("discordant"))


def kendall_tau_b(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b of two numeric columns over pairwise-complete rows: one row (n, concordant, discordant, tau_b)."""
    pts = df.select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y")).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    w = ranks._checkpoint(pts.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")))
    by = {c: w.groupBy(c).agg(F.sum("w").alias("t")).agg(F.count(F.lit(1)).alias("d"), F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("ties")).first()
          for c in "xy"}
    # discordant pairs are the same with the columns exchanged
    few, many = ("x", "y") if by["x"]["d"] < by["y"]["d"] else ("y", "x")
    numbers = ranks.row_positions(w.select(few).distinct(), [few]).withColumnRenamed("_pos", "_n")
    weighted = w.join(numbers, few).select(F.col(many).alias("x"), F.col("_n").cast("long").alias("y"), "w")
    found = _discordant(weighted, (by[few]["d"] - 1).bit_length() if by[few]["d"] else 0)
    ties = w.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("w") * (F.col("w") - 1) / 2), F.lit(0.0)).alias("n_xy"))
    m = attach(found, ties)
    n_x, n_y = (F.lit(float(by[c]["ties"] or 0)) for c in "xy")
    n0 = F.col("n").cast("double") * (F.col("n") - 1) / 2
    nd = F.col("discordant")
    nc = n0 - n_x - n_y + F.col("n_xy") - nd
    tau = F.try_divide(nc - nd, F.sqrt((n0 - n_x) * (n0 - n_y)))
    return m.select(F.col("n").cast("long").alias("n"), nc.cast("long").alias("concordant"), nd.cast("long").alias("discordant"),
                    tau.alias("tau_b"))
