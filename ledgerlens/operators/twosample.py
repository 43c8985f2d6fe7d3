"""H1-H7: two-sample tests per common numeric column, all from distributed aggregates.

* t-test: n / mean / variance per (column, sample) - one aggregate.
* Mann-Whitney U: pooled average ranks from distinct-value counts (a hot value
  is one row), rank sum of sample 1, tie correction, normal approximation with
  continuity correction.
* Kolmogorov-Smirnov: pooled distinct values with per-sample counts, running
  sums over range partitions (checkpointed, as in ``ranks``), max |F1 - F2|.
Only the p-value step is Python, applied to one row per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import col
from ..functions.pvalues import MANN_WHITNEY_EXACT, p_value
from . import ranks
from .profile import numeric_columns


def pooled_long(a: DataFrame, b: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, sample, value) for the numeric columns both tables share; missing values dropped."""
    cols = cols or [c for c in numeric_columns(a) if c in numeric_columns(b)]

    def lg(df, tag):
        items = [F.struct(F.lit(c).alias("column"), (col(c).cast("double") + F.lit(0.0)).alias("value")) for c in cols]
        return (df.select(F.explode(F.array(*items)).alias("kv")).select("kv.*").withColumn("sample", F.lit(tag))
                .filter(F.col("value").isNotNull() & ~F.isnan("value")))
    return lg(a, 1).unionByName(lg(b, 2))


def t_test(long: DataFrame) -> DataFrame:
    """H1: Student t (pooled variance): n1, n2, means, difference (second - first), t, dof; t is null without variance."""
    g = long.groupBy("column").agg(
        F.sum(F.when(F.col("sample") == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("sample") == 2, 1).otherwise(0)).alias("n2"),
        F.avg(F.when(F.col("sample") == 1, F.col("value"))).alias("mean1"), F.avg(F.when(F.col("sample") == 2, F.col("value"))).alias("mean2"),
        F.var_samp(F.when(F.col("sample") == 1, F.col("value"))).alias("_v1"),
        F.var_samp(F.when(F.col("sample") == 2, F.col("value"))).alias("_v2"))
    dof = F.col("n1") + F.col("n2") - 2
    sp2 = F.try_divide((F.col("n1") - 1) * F.col("_v1") + (F.col("n2") - 1) * F.col("_v2"), dof)
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(sp2 * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2")))))
    return g.select("column", F.col("n1").cast("long"), F.col("n2").cast("long"), "mean1", "mean2",
                    (F.col("mean2") - F.col("mean1")).alias("mean_difference"), t.alias("t_statistic"),
                    dof.cast("double").alias("dof"))


def pooled_ranks(long: DataFrame) -> DataFrame:
    """H2: per (column, value) the pooled count and average rank (ties share the mean position)."""
    return ranks.average_ranks(long.select("column", "value")).select("column", "value", "cnt", "avg_rank")


def mann_whitney(long: DataFrame) -> DataFrame:
    """H3: U of sample 1, z with tie and continuity corrections (two-sided, U = max(U1, U2))."""
    return _mann_whitney(long).drop("has_ties")


def _mann_whitney(long: DataFrame) -> DataFrame:
    rk = pooled_ranks(long)
    c1 = long.filter(F.col("sample") == 1).groupBy("column", "value").agg(F.count(F.lit(1)).alias("c1"))
    j = rk.join(c1, ["column", "value"], "left").na.fill(0, ["c1"])
    g = j.groupBy("column").agg(F.sum(F.col("c1") * F.col("avg_rank")).alias("r1"), F.sum("c1").alias("n1"),
                                F.sum("cnt").alias("n"), F.sum(F.pow(F.col("cnt"), 3) - F.col("cnt")).alias("_ties"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    n2 = n - n1
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    mu = n1 * n2 / 2
    s = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    u = F.greatest(u1, n1 * n2 - u1)
    z = F.try_divide(u - mu - 0.5, s)
    return g.select("column", u1.alias("u_statistic"), z.alias("z"), n1.cast("long").alias("n1"), n2.cast("long").alias("n2"),
                    (F.col("_ties") > 0).alias("has_ties"))


def ks_test(long: DataFrame, partitions: int | None = None) -> DataFrame:
    """H4: D = max |F1 - F2| over pooled distinct values (running sums per sample over range partitions)."""
    vc = long.groupBy("column", "value").agg(F.sum(F.when(F.col("sample") == 1, 1).otherwise(0)).alias("c1"),
                                             F.sum(F.when(F.col("sample") == 2, 1).otherwise(0)).alias("c2"))
    spark = long.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = ranks._checkpoint(vc.repartitionByRange(p, "column", "value").withColumn("_pid", F.spark_partition_id()))
    tot = ranged.groupBy("_pid", "column").agg(F.sum("c1").alias("_t1"), F.sum("c2").alias("_t2"))
    w_off = Window.partitionBy("column").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = (tot.withColumn("_o1", F.coalesce(F.sum("_t1").over(w_off), F.lit(0)))
           .withColumn("_o2", F.coalesce(F.sum("_t2").over(w_off), F.lit(0)))
           .withColumn("n1", F.sum("_t1").over(Window.partitionBy("column")))
           .withColumn("n2", F.sum("_t2").over(Window.partitionBy("column"))).drop("_t1", "_t2"))
    w_in = Window.partitionBy("_pid", "column").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cum = (ranged.join(F.broadcast(off), ["_pid", "column"])
           .withColumn("f1", F.try_divide(F.col("_o1") + F.sum("c1").over(w_in), F.col("n1")))
           .withColumn("f2", F.try_divide(F.col("_o2") + F.sum("c2").over(w_in), F.col("n2"))))
    return cum.groupBy("column").agg(F.max(F.abs(F.col("f1") - F.col("f2"))).alias("ks_statistic"),
                                     F.max("n1").alias("n1"), F.max("n2").alias("n2"))


def compare_tests(a: DataFrame, b: DataFrame, cols: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """H6: per column t-test, Mann-Whitney and KS results with two-sided p-values and significance flags (distributions differ: by
    KS alone; Mann-Whitney has a flag of its own)."""
    long = pooled_long(a, b, cols)
    t = t_test(long)
    mw = _mann_whitney(long).select("column", "u_statistic", "z", "has_ties")
    ks = ks_test(long).select("column", "ks_statistic", F.col("n1").alias("_k1"), F.col("n2").alias("_k2"))
    j = t.join(mw, "column").join(ks, "column")
    j = (j.withColumn("t_p_value", p_value(F.lit("t"), F.col("t_statistic"), F.col("dof"), F.lit(0.0)))
         .withColumn("_exact", ~F.col("has_ties") & (F.least("_k1", "_k2") <= MANN_WHITNEY_EXACT))
         .withColumn("mw_p_value", p_value(F.when(F.col("_exact"), "u").otherwise("z"), F.when(F.col("_exact"), F.col("u_statistic")).otherwise(F.col("z")),
                                           F.col("_k1").cast("double"), F.col("_k2").cast("double")))
         .withColumn("ks_p_value", p_value(F.lit("ks"), F.col("ks_statistic"), F.col("_k1").cast("double"),
                                           F.col("_k2").cast("double"))).drop("_k1", "_k2", "_exact", "has_ties"))
    return (j.withColumn("means_differ", F.col("t_p_value") < alpha).withColumn("ranks_differ", F.col("mw_p_value") < alpha)
            .withColumn("distributions_differ", F.col("ks_p_value") < alpha))


def significance_counts(tests: DataFrame) -> DataFrame:
    """H7: how many columns show a significant mean / distribution difference."""
    return tests.agg(F.count(F.lit(1)).alias("columns_tested"),
                     F.sum(F.when(F.col("means_differ"), 1).otherwise(0)).cast("long").alias("significant_mean_differences"),
                     F.sum(F.when(F.col("distributions_differ"), 1).otherwise(0)).cast("long")
                     .alias("significant_distribution_differences"))

