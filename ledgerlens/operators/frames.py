"""Plan-shape helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row (broadcast equi-join on a constant); nulls if there is none."""
    return (df.withColumn("_attached", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_attached", F.lit(1))), "_attached", "left").drop("_attached"))


def top_k(df: DataFrame, group_cols: list[str], order_cols: list, k: int, rank_col: str = "rank",
          buckets: int = 64) -> DataFrame:
    """Exact top-k rows per group under a *total* order, in two bounded stages.

    Stage 1 ranks inside (group, hash bucket) sub-groups, so a hot group is
    spread over ``buckets`` tasks; stage 2 ranks the <= buckets*k survivors of
    each group. The global top-k of a group is always inside the union of its
    buckets' top-k, so the result is exact.
    """
    g = [F.col(c) for c in group_cols]
    salted = df.withColumn("_b", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(buckets)))
    w1 = Window.partitionBy(*g, F.col("_b")).orderBy(*order_cols)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_b")
    w2 = Window.partitionBy(*g).orderBy(*order_cols) if group_cols else Window.orderBy(*order_cols)
    return stage1.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
