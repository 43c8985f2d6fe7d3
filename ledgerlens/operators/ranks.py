"""Exact ranks and quantiles without a single-partition window.

Input is a *long* table ``(column, value)`` (any number of measured columns).

1. ``groupBy(column, value).count()``: a hot value collapses to one row.
2. ``repartitionByRange(column, value)`` over those distinct values, so
   partitions are balanced whatever the skew of the raw data.
3. per (partition, column) totals: a table of at most partitions x columns
   rows, turned into exclusive offsets by a window over that small table.
4. the range-partitioned table is checkpointed (its bounds are sampled, so it
   must be evaluated once), then a window *inside* each range partition plus the broadcast offset gives
   every distinct value its cumulative count.

From the cumulative counts we get linear-interpolated quantiles (pandas'
default), average ranks (ties share the mean rank) and empirical CDFs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _checkpoint(df: DataFrame) -> DataFrame:
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _round(df: DataFrame) -> DataFrame:
    """A round's table, written as Parquet to the shared checkpoint folder and read back. checkpoint() keeps the size that the
    planner estimated, a product over the joins behind it: carried from round to round its digits double, and so do the
    driver's time and memory. The files have a size of their own."""
    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _small(df: DataFrame, group: str) -> DataFrame:
    """Broadcast a table with a row per measured column (bounded by the schema); groups that are data values are left to
    the adaptive join."""
    return F.broadcast(df) if group == "column" else df


def value_counts(long: DataFrame, group: str = "column") -> DataFrame:
    return long.groupBy(group, "value").agg(F.count(F.lit(1)).alias("cnt"))


def cumulative_counts(long: DataFrame, group: str = "column", partitions: int | None = None) -> DataFrame:
    """(group, value, cnt, before, n): ``before`` = rows with a smaller value in the group."""
    vc = value_counts(long, group)
    spark = long.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # range bounds come from sampling, so the partitioned table is materialised once (reliable
    # checkpoint): totals and positions must both see the same partitioning
    ranged = _checkpoint(vc.repartitionByRange(p, group, "value").withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid", group).agg(F.sum("cnt").alias("_pt"))
    w_off = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.withColumn("_off", F.coalesce(F.sum("_pt").over(w_off), F.lit(0)))
               .withColumn("n", F.sum("_pt").over(Window.partitionBy(group))).drop("_pt"))
    w_in = Window.partitionBy("_pid", group).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.join(_small(offsets, group), ["_pid", group])
            .withColumn("before", F.col("_off") + F.coalesce(F.sum("cnt").over(w_in), F.lit(0)))
            .drop("_pid", "_off"))


def quantiles(long: DataFrame, probs: list[float], group: str = "column", cum: DataFrame | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group: (group, p, q) - exact, pandas' default method."""
    cum = cum if cum is not None else cumulative_counts(long, group)
    # rank positions are 0-based: h = (n - 1) * p, between floor(h) and ceil(h)
    t = (cum.select(group, "n").distinct()
         .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
         .withColumn("h", (F.col("n") - 1) * F.col("p"))
         .withColumn("lo", F.floor("h")).withColumn("hi", F.ceil("h")))
    hits = (cum.join(_small(t.select(group, "p", "h", "lo", "hi"), group), group)
            .filter(((F.col("before") <= F.col("lo")) & (F.col("lo") < F.col("before") + F.col("cnt"))) |
                    ((F.col("before") <= F.col("hi")) & (F.col("hi") < F.col("before") + F.col("cnt")))))
    picked = hits.groupBy(group, "p", "h", "lo").agg(
        F.min(F.when((F.col("before") <= F.col("lo")) & (F.col("lo") < F.col("before") + F.col("cnt")),
                     F.col("value"))).alias("v_lo"),
        F.min(F.when((F.col("before") <= F.col("hi")) & (F.col("hi") < F.col("before") + F.col("cnt")),
                     F.col("value"))).alias("v_hi"))
    return picked.select(group, "p", (F.col("v_lo") + (F.col("h") - F.col("lo")) * (F.col("v_hi") - F.col("v_lo")))
                         .alias("q"))


def quantile(p: float) -> F.Column:
    """Aggregate over cumulative counts: the linear-interpolated quantile of a group."""
    h = (F.col("n") - 1) * F.lit(float(p))

    def at(place):
        return F.min(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("cnt")), F.col("value")))

    low, high = at(F.floor(h)), at(F.ceil(h))
    return low + F.max(h - F.floor(h)) * (high - low)


def quantile_wide(long: DataFrame, probs: dict[str, float], group: str = "column", cum: DataFrame | None = None) -> DataFrame:
    """Quantiles as columns: one row per group, one column per name in ``probs``; one aggregate over the cumulative counts."""
    cum = cum if cum is not None else cumulative_counts(long, group)
    return cum.groupBy(group).agg(*[quantile(p).alias(k) for k, p in probs.items()])


def average_ranks(long: DataFrame, group: str = "column") -> DataFrame:
    """(group, value, cnt, avg_rank): 1-based ranks, ties get the mean of their positions."""
    cum = cumulative_counts(long, group)
    return cum.withColumn("avg_rank", F.col("before") + (F.col("cnt") + 1) / 2.0)


def row_positions(df: DataFrame, order_by: list[str], partitions: int | None = None) -> DataFrame:
    """Exact 0-based row position under a total order, without a global window.

    The order must be total (unique tie-break last). Range partitions hold
    contiguous slices; a small per-partition count table gives the offsets.
    """
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = _checkpoint(df.repartitionByRange(p, *order_by).withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_pt"))
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_pt").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_pt")
    w = Window.partitionBy("_pid").orderBy(*order_by)
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn("_pos", F.col("_off") + F.row_number().over(w) - 1).drop("_pid", "_off"))
