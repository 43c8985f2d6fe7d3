"""Shapiro-Francia test of normality over all values of a column, no sample.

W' is the squared correlation of the sorted values with the expected normal scores of their places, here Blom's
inverse_normal((i - 3/8) / (n + 1/4)). Values come with counts and places from the numeric core; a value that occurs
often takes up many places, which are dealt in chunks so that no task holds them. Everything is a built-in expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pvalues import p_value
from . import profile

# Coefficients (constant term first) of the rational approximations in Wichura's algorithm AS 241, for the
# middle, for the near and for the far tails.
MIDDLE = ([3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457,
           67265.770927008700853, 33430.575583588128105, 2509.0809287301226727],
          [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610,
           28729.085735721942674, 5226.4952788528545610])
NEAR = ([1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258,
         0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640],
        [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590,
         0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9])
FAR = ([6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930,
        0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
       [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100,
        1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])

CHUNK = 1 << 16


def _poly(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1, to about 16 digits."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    mid = F.lit(0.180625) - q * q

    def ratio(parts, x):
        return _poly(parts[0], x) / _poly(parts[1], x)

    return F.when(F.abs(q) <= 0.425, q * ratio(MIDDLE, mid)).otherwise(
        F.signum(q) * F.when(r <= 5, ratio(NEAR, r - 1.6)).otherwise(ratio(FAR, r - 5.0)))


def shapiro_francia(df: DataFrame, cols: list[str] | None = None, core: DataFrame | None = None, alpha: float = 0.05,
                    chunk: int = CHUNK) -> DataFrame:
    """(column, count, w, z, p_value, is_normal) of each numeric column with a value.

    z and p by Royston's normal approximation of log(1 - W'), made for 5 to 5,000 values and carried on beyond. Fewer than 8
    values (the reference's bound) or one repeated value give null. Missing values (null, not-a-number) are left out.
    """
    cols = cols or profile.numeric_columns(df)
    core = core if core is not None else profile.numeric_core(df, cols)
    starts = F.sequence(F.col("before"), F.col("before") + F.col("cnt") - 1, F.lit(chunk).cast("long"))
    chunks = core.select("column", "value", "n", (F.col("before") + F.col("cnt")).alias("_end"), F.explode(starts).alias("_low"))
    # chunks of a value that fills much of the column are dealt out before they become places
    places = chunks.repartition("column", "value", "_low").select("column", "value", "n", F.explode(F.sequence(
        F.col("_low"), F.least(F.col("_low") + chunk, F.col("_end")) - 1)).alias("_i"))
    m = inverse_normal((F.col("_i") + 1 - 0.375) / (F.col("n") + 0.25))
    mean = core.groupBy("column").agg((F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("_mean"))
    shifted = F.col("value") - F.col("_mean")
    sums = (places.withColumn("_m", m).join(F.broadcast(mean), "column").groupBy("column").agg(
        F.max("n").alias("count"), F.sum(shifted * F.col("_m")).alias("_xm"), F.sum(F.col("_m") * F.col("_m")).alias("_mm"),
        F.sum(shifted * shifted).alias("_xx"), F.min("value").alias("_lo"), F.max("value").alias("_hi")))
    w = F.when((F.col("count") >= 8) & (F.col("_hi") > F.col("_lo")), F.least(F.col("_xm") * F.col("_xm") / (F.col("_mm") * F.col("_xx")), F.lit(1.0)))
    u = F.log(F.col("count"))
    v = F.log(u)
    z = (F.log(1 - F.col("w")) - (-1.2725 + 1.0521 * (v - u))) / (1.0308 - 0.26758 * (v + 2 / u))
    none = F.lit(None).cast("double")
    x = sums.select("column", "count", w.alias("w")).withColumn("z", z)
    two = p_value(F.lit("z"), F.coalesce("z", F.lit(0.0)), none, none)
    p = F.when(F.col("z").isNotNull(), F.when(F.col("z") > 0, F.col("_two") / 2).otherwise(1 - F.col("_two") / 2))
    return x.withColumn("_two", two).withColumn("p_value", p).withColumn("is_normal", F.col("p_value") > alpha).drop("_two")
