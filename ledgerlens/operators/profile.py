"""Column profile and descriptive statistics as tidy DataFrames.

Two cores hold the distinct values of a table with their counts: ``numeric_core``
(written in ranges, with places) and ``text_core`` (any column as text). Quantiles,
modes, unique, zero and outlier counts, inferred types and samples are aggregates of
a core, moments too (sums around the mean). No count-distinct per column,
no per-column collect, no single-partition window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_date
from ..functions.normalize import col
from . import ranks
from .ranks import _checkpoint
from .frames import attach, top_k

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _missing(df: DataFrame, c: str) -> F.Column:
    dt = df.schema[c].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return col(c).isNull() | F.isnan(col(c))
    return col(c).isNull()


def to_long(df: DataFrame, cols: list[str], cast: str = "double", keep=()) -> DataFrame:
    """Unpivot ``cols`` into (column, value); values cast to one type family. Missing values dropped."""
    keep = list(keep)
    items = [F.struct(F.lit(c).alias("column"), col(c).cast(cast).alias("value")) for c in cols]
    long = df.select(*[col(k) for k in keep], F.explode(F.array(*items)).alias("_kv")).select(*keep, "_kv.*")
    cond = F.col("value").isNotNull()
    if cast in ("double", "float"):
        cond = cond & ~F.isnan("value")
        long = long.withColumn("value", F.col("value") + F.lit(0.0))  # -0.0 -> 0.0
    return long.filter(cond)


def shape(df: DataFrame) -> DataFrame:
    """A1: rows, columns, cells."""
    n = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(n).cast("long").alias("total_columns"), (F.col("total_rows") * n).alias("total_cells"))


def numeric_core(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, value, cnt, before, n): the distinct values of the numeric columns with their counts and places, written once
    in ranges. Quantiles, modes, unique, zero and outlier counts are all read from it."""
    return ranks.cumulative_counts(to_long(df, cols or numeric_columns(df)))


def _text(df: DataFrame, c: str) -> F.Column:
    """A column as text, equal for equal values only (-0.0 is 0.0)."""
    dt = df.schema[c].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return (col(c) + F.lit(0.0).cast(dt)).cast("string")
    if isinstance(dt, T.BinaryType):
        return F.hex(col(c))
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(col(c).isNotNull(), F.to_json(F.struct(col(c).alias("v"))))
    return col(c).cast("string")


def text_core(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, value, cnt): the distinct non-null values of any columns as text, counted in one exchange of narrow rows."""
    cols = df.columns if cols is None else cols
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, cnt long")
    items = [F.struct(F.lit(c).alias("column"), _text(df, c).alias("value")) for c in cols]
    long = df.select(F.explode(F.array(*items)).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))


def unique_counts(df: DataFrame, cols: list[str], core: DataFrame | None = None) -> DataFrame:
    """(column, unique_values): distinct non-null values of each column, 0 where there are none."""
    found = (core if core is not None else text_core(df, cols)).groupBy("column").agg(F.count(F.lit(1)).alias("_u"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(F.broadcast(found), "column", "left").select("column", F.coalesce("_u", F.lit(0)).alias("unique_values"))


def _moments(core: DataFrame, first: DataFrame) -> DataFrame:
    """Deviation, variance, skewness and kurtosis per column: weighted sums of powers around the mean, over the core."""
    away = F.col("value") - F.col("mean")
    power = lambda k: F.sum(F.col("cnt") * F.pow(away, F.lit(k)))
    x = core.join(F.broadcast(first.select("column", "mean")), "column").groupBy("column").agg(
        F.max("n").alias("_n"), power(2.0).alias("_m2"), power(3.0).alias("_m3"), power(4.0).alias("_m4"))
    variance = F.when(F.col("_n") > 1, F.col("_m2") / (F.col("_n") - 1))
    spread = F.when(F.col("_m2") != 0, F.col("_m2"))
    return x.select("column", F.sqrt(variance).alias("std_dev"), variance.alias("variance"),
                    (F.sqrt(F.col("_n")) * F.col("_m3") / F.pow(spread, F.lit(1.5))).alias("skewness"),
                    (F.col("_n") * F.col("_m4") / (spread * spread) - 3.0).alias("kurtosis"))


def describe(df: DataFrame, cols: list[str] | None = None, core: DataFrame | None = None) -> DataFrame:
    """A2: count, mean, median, mode, std, var, min, max, range, q1, q3, iqr, skew, kurtosis, CV% per numeric column, in two
    passes over the core; the table itself is read once."""
    core = core if core is not None else numeric_core(df, cols)
    low, high = F.min("value"), F.max("value")
    first = core.groupBy("column").agg(
        F.max("n").alias("count"), F.when(low == high, low).otherwise(F.sum(F.col("value") * F.col("cnt")) / F.max("n")).alias("mean"),
        low.alias("min"), high.alias("max"),
        ranks.quantile(0.25).alias("q1"), ranks.quantile(0.5).alias("median"), ranks.quantile(0.75).alias("q3"),
        F.min_by("value", F.struct((-F.col("cnt")).alias("c"), F.col("value").alias("v"))).alias("mode"))
    return (first.join(F.broadcast(_moments(core, first)), "column")
            .withColumn("range", F.col("max") - F.col("min"))
            .withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("coefficient_of_variation",
                        F.when(F.col("mean") != 0, F.col("std_dev") / F.col("mean") * 100).otherwise(F.lit(0.0))))


def missing(df: DataFrame) -> DataFrame:
    """A3: per column missing count, %, present count, %."""
    aggs = [F.sum(F.when(_missing(df, c), 1).otherwise(0)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"))
                               for i, c in enumerate(df.columns)]))
    return (one.select("_n", rows.alias("r")).select("_n", "r.*")
            .withColumn("missing_count", F.coalesce("missing_count", F.lit(0)).cast("long"))
            .withColumn("missing_percentage", F.when(F.col("_n") > 0, F.col("missing_count") * 100.0 / F.col("_n")))
            .withColumn("present_count", F.col("_n") - F.col("missing_count"))
            .withColumn("present_percentage", 100.0 - F.col("missing_percentage")).drop("_n"))


def missing_summary(df: DataFrame) -> DataFrame:
    """A4: total missing cells, %, columns with missing, complete/incomplete rows."""
    nulls = [F.when(_missing(df, c), 1).otherwise(0) for c in df.columns]
    row_nulls = reduce(lambda x, y: x + y, nulls)
    ncols = len(df.columns)
    one = df.select(row_nulls.alias("_rn"), *[F.when(_missing(df, c), 1).otherwise(0).alias(f"c{i}")
                                              for i, c in enumerate(df.columns)])
    agg = one.agg(F.count(F.lit(1)).alias("_n"), F.sum("_rn").alias("total_missing_cells"),
                  F.sum(F.when(F.col("_rn") == 0, 1).otherwise(0)).alias("complete_rows"),
                  *[F.max(f"c{i}").alias(f"h{i}") for i in range(ncols)])
    with_cols = reduce(lambda x, y: x + y, [F.coalesce(F.col(f"h{i}"), F.lit(0)) for i in range(ncols)])
    return agg.select(
        F.coalesce("total_missing_cells", F.lit(0)).cast("long").alias("total_missing_cells"),
        (F.col("_n") * ncols).alias("total_cells"),
        F.when(F.col("_n") > 0, F.coalesce("total_missing_cells", F.lit(0)) * 100.0 / (F.col("_n") * ncols))
        .alias("overall_missing_percentage"),
        with_cols.cast("long").alias("columns_with_missing_data"),
        F.coalesce("complete_rows", F.lit(0)).cast("long").alias("complete_rows"),
        (F.col("_n") - F.coalesce("complete_rows", F.lit(0))).cast("long").alias("incomplete_rows"))


def outliers(df: DataFrame, cols: list[str] | None = None, core: DataFrame | None = None) -> DataFrame:
    """IQR bounds, outlier count and %, severity band, unique/zero/negative/positive counts."""
    core = core if core is not None else numeric_core(df, cols)
    spread = F.col("q3") - F.col("q1")
    bounds = core.groupBy("column").agg(ranks.quantile(0.25).alias("q1"), ranks.quantile(0.75).alias("q3")).select(
        "column", (F.col("q1") - 1.5 * spread).alias("lower_bound"), (F.col("q3") + 1.5 * spread).alias("upper_bound"))
    v = F.col("value")

    def rows(cond):
        return F.sum(F.when(cond, F.col("cnt")).otherwise(0))

    out = core.join(F.broadcast(bounds), "column").groupBy("column", "lower_bound", "upper_bound").agg(
        F.max("n").alias("_n"), rows((v < F.col("lower_bound")) | (v > F.col("upper_bound"))).alias("outliers_count"),
        F.count(F.lit(1)).alias("unique_values"), rows(v == 0).alias("zeros_count"), rows(v < 0).alias("negative_count"),
        rows(v > 0).alias("positive_count"))
    pct = F.try_divide(F.col("outliers_count") * 100.0, F.col("_n"))
    return (out.withColumn("outliers_percentage", pct)
            .withColumn("severity", F.when(pct > 10, "High").when(pct > 5, "Medium").otherwise("Low")).drop("_n"))


def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = 20, group: str | None = None) -> DataFrame:
    """Equal-width bins (last bin closed), zero-filled; shared edges across ``group`` values when given.

    Output: column, [group,] bin, lower, upper, center, count.
    """
    cols = cols or numeric_columns(df)
    keep = [group] if group else []
    long = to_long(df, cols, keep=keep)
    rng = long.groupBy("column").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    # numpy widens a zero range to [lo - 0.5, hi + 0.5]
    lo = F.when(F.col("_hi") == F.col("_lo"), F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    hi = F.when(F.col("_hi") == F.col("_lo"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    rng = rng.select("column", lo.alias("_lo"), hi.alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counts = (long.join(F.broadcast(rng), "column").withColumn("bin", b)
              .groupBy("column", *keep, "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    if group:
        grid = grid.join(long.select("column", group).distinct(), "column")
    edges = F.col("_lo") + F.col("bin") * width
    upper = F.col("_lo") + (F.col("bin") + 1) * width
    return (grid.join(counts, ["column", *keep, "bin"], "left")
            .select("column", *keep, "bin", edges.alias("lower"), upper.alias("upper"),
                    ((edges + upper) / 2).alias("center"), F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def categorical(df: DataFrame, cols: list[str] | None = None, top: int = 10, core: DataFrame | None = None) -> DataFrame:
    """Unique, most/least frequent (+counts), avg/max/min length, blank strings; top values list."""
    cols = cols or string_columns(df)
    vc = (core if core is not None else text_core(df, cols)).where(F.col("column").isin(cols))
    per = vc.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_values"),
        F.min_by(F.struct("value", "cnt"), F.struct((-F.col("cnt")).alias("c"), F.col("value").alias("v")))
        .alias("_most"),
        F.min_by(F.struct("value", "cnt"), F.struct(F.col("cnt").alias("c"), F.col("value").alias("v")))
        .alias("_least"),
        F.sum(F.col("cnt") * F.length("value")).alias("_len_sum"), F.sum("cnt").alias("_n"),
        F.max(F.length("value")).alias("max_length"), F.min(F.length("value")).alias("min_length"),
        F.sum(F.when(F.trim("value") == "", F.col("cnt")).otherwise(0)).alias("empty_strings"))
    return per.select("column", "unique_values", F.col("_most.value").alias("most_frequent"),
                      F.col("_most.cnt").alias("most_frequent_count"), F.col("_least.value").alias("least_frequent"),
                      F.col("_least.cnt").alias("least_frequent_count"),
                      F.try_divide("_len_sum", "_n").alias("average_length"), "max_length", "min_length",
                      F.col("empty_strings").cast("long").alias("empty_strings"))


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """A11/A17 top-k values per column (count desc, value asc), with share of non-null rows."""
    cols = cols or string_columns(df)
    long = to_long(df, cols, cast="string")
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    tot = vc.groupBy("column").agg(F.sum("count").alias("_t"))
    best = top_k(vc, ["column"], [F.desc("count"), F.asc("value")], k)
    return (best.join(F.broadcast(tot), "column")
            .withColumn("percentage", F.try_divide(F.col("count") * 100.0, F.col("_t"))).drop("_t"))


def normality(describe_df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Fallback rule |skew| < 2 and |excess kurtosis| < 7, plus Jarque-Bera from the same moments.

    JB = n/6 (S^2 + K^2/4) ~ chi2(2), p = exp(-JB/2). Fewer than 8 values -> insufficient.
    """
    s, k, n = F.col("skewness"), F.col("kurtosis"), F.col("count")
    jb = n / 6.0 * (s * s + k * k / 4.0)
    enough = n >= 8
    return describe_df.select(
        "column", n.alias("count"),
        F.when(enough, F.lit("moment_check")).otherwise(F.lit("insufficient_data")).alias("test"),
        F.when(enough, jb).alias("jarque_bera"), F.when(enough, F.exp(-jb / 2.0)).alias("p_value"),
        (enough & (F.abs(s) < 2) & (F.abs(k) < 7)).alias("is_normal_rule"),
        (enough & (F.exp(-jb / 2.0) > alpha)).alias("is_normal_jb"))


def correlations(df: DataFrame, cols: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """Pairwise-complete correlation for every column pair (long: col_a, col_b, r).

    ``spearman`` correlates average ranks computed per column over its
    pairwise-complete rows, via the distributed rank primitive; ``kendall`` is
    the exact tau-b of each pair.
    """
    cols = cols or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if method == "pearson":
        one = df.agg(*[F.corr(col(a).cast("double"), col(b).cast("double")).alias(f"r{i}")
                       for i, (a, b) in enumerate(pairs)])
        items = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{i}").alias("r"))
                 for i, (a, b) in enumerate(pairs)]
        return one.select(F.explode(F.array(*items)).alias("x")).select("x.*")
    if method == "spearman":
        rid = df.withColumn("_rid", F.monotonically_increasing_id())
        parts = []
        for a, b in pairs:
            sub = rid.select("_rid", col(a).cast("double").alias("x"), col(b).cast("double").alias("y")).filter(
                F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
            long = sub.select("_rid", F.explode(F.array(
                F.struct(F.lit("x").alias("column"), F.col("x").alias("value")),
                F.struct(F.lit("y").alias("column"), F.col("y").alias("value")))).alias("kv")).select("_rid", "kv.*")
            rk = ranks.average_ranks(long.select("column", "value"))
            ranked = long.join(rk.select("column", "value", "avg_rank"), ["column", "value"])
            wide = ranked.groupBy("_rid").agg(F.max(F.when(F.col("column") == "x", F.col("avg_rank"))).alias("rx"),
                                              F.max(F.when(F.col("column") == "y", F.col("avg_rank"))).alias("ry"))
            parts.append(wide.agg(F.corr("rx", "ry").alias("r")).select(F.lit(a).alias("col_a"),
                                                                        F.lit(b).alias("col_b"), "r"))
        return reduce(lambda x, y: x.unionByName(y), parts)
    if method == "kendall":
        from .kendall import kendall_tau_b
        return reduce(lambda x, y: x.unionByName(y), [kendall_tau_b(df, a, b).select(
            F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col("tau_b").alias("r")) for a, b in pairs])
    raise ValueError(method)


def strong_pairs(corr: DataFrame, threshold: float = 0.7, very: float = 0.9) -> DataFrame:
    """Pairs with |r| > threshold, labelled strong / very strong."""
    return (corr.filter(F.abs("r") > threshold)
            .withColumn("strength", F.when(F.abs("r") > very, "very strong").otherwise("strong")))


def correlation_summary(corr: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Number of pairs, strong pairs, and the mean coefficient of all pairs."""
    return corr.agg(F.count(F.lit(1)).alias("total_pairs"), F.count_if(F.abs("r") > threshold).alias("strong_correlations_count"),
                    F.avg("r").alias("average_correlation"))


def key_analysis(df: DataFrame, c: str, top: int = 10) -> DataFrame:
    """Key column readiness: rows, unique, null %, duplicate %, quality score, perfect-key flag."""
    one = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct(col(c)).alias("unique_values"),
                 F.sum(F.when(_missing(df, c), 1).otherwise(0)).alias("null_count"))
    null_pct = F.when(F.col("total_rows") > 0, F.col("null_count") * 100.0 / F.col("total_rows")).otherwise(0.0)
    dup_pct = F.when(F.col("total_rows") > 0,
                     (F.col("total_rows") - F.col("unique_values")) * 100.0 / F.col("total_rows")).otherwise(0.0)
    score = (F.lit(100.0) - F.when(null_pct > 10, F.least(F.lit(30.0), null_pct)).otherwise(0.0)
             - F.when(dup_pct > 50, F.least(F.lit(40.0), dup_pct - 50)).otherwise(0.0))
    return one.select(F.lit(c).alias("column"), "total_rows", "unique_values",
                      F.coalesce("null_count", F.lit(0)).cast("long").alias("null_count"),
                      null_pct.alias("null_percentage"), dup_pct.alias("duplicate_percentage"),
                      F.greatest(F.lit(0.0), score).alias("quality_score"),
                      ((F.col("unique_values") == F.col("total_rows")) & (F.col("null_count") == 0)).alias("perfect_key"))


def matching_quality(df: DataFrame, c: str) -> DataFrame:
    """Predicted matching quality of a key column: 100, less min(null %, 30) above 5% nulls, less half of what
    uniqueness lacks to 80%; a perfect key has 100. With its band (80 / 60) and the issues in words."""
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(col(c)).alias("u"), F.sum(F.when(_missing(df, c), 1).otherwise(0)).alias("z"))
    null_pct = F.coalesce(F.try_divide(F.col("z") * 100.0, "n"), F.lit(0.0))
    unique = F.coalesce(F.try_divide(F.col("u") * 100.0, "n"), F.lit(0.0))
    perfect = (F.col("u") == F.col("n")) & (F.col("z") == 0)
    score = 100 - F.when(null_pct > 5, F.least(null_pct, F.lit(30.0))).otherwise(0.0) - F.when(unique < 80, (80 - unique) * 0.5).otherwise(0.0)
    score = F.when(perfect, 100.0).otherwise(F.greatest(F.lit(0.0), score))
    issues = F.when(perfect, F.array(F.lit("Perfect key column - ideal for matching!"))).otherwise(F.filter(F.array(
        F.when(null_pct > 5, F.lit("Missing data reduces matching accuracy")),
        F.when(unique < 80, F.format_string("Low uniqueness (%.1f%%) may cause multiple matches", unique))), lambda x: x.isNotNull()))
    return one.select(F.lit(c).alias("column"), score.alias("matching_quality"), F.when(score >= 80, "Excellent").when(score >= 60, "Good")
                      .otherwise("Needs Attention").alias("band"), issues.alias("issues"))


def dataset_diff(a: DataFrame, b: DataFrame, name_a: str = "A", name_b: str = "B") -> DataFrame:
    """B against A: row and column difference (B - A), ratio of their cells (B / A; 0 without cells in A), missing-% difference."""
    sa = attach(shape(a), missing_summary(a).drop("total_cells"))
    sb = attach(shape(b), missing_summary(b).drop("total_cells"))
    x = sa.select(*[F.col(c).alias(f"a_{c}") for c in sa.columns])
    y = sb.select(*[F.col(c).alias(f"b_{c}") for c in sb.columns])
    j = attach(x, y)
    return j.select(
        F.lit(name_a).alias("dataset_a"), F.lit(name_b).alias("dataset_b"),
        F.col("a_total_rows").alias("rows_a"), F.col("b_total_rows").alias("rows_b"),
        (F.col("b_total_rows") - F.col("a_total_rows")).alias("row_difference"),
        (F.col("b_total_columns") - F.col("a_total_columns")).alias("column_difference"),
        F.coalesce(F.try_divide(F.col("b_total_rows") * F.col("b_total_columns"), F.col("a_total_rows") * F.col("a_total_columns")), F.lit(0.0))
        .alias("size_ratio"),
        (F.col("b_overall_missing_percentage") - F.col("a_overall_missing_percentage")).alias("missing_difference"))


def bar_feed(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Group by x (and colour) -> sum, mean, count of y."""
    keys = [x] + ([color] if color else [])
    return (df.filter(col(x).isNotNull()).groupBy(*[col(k) for k in keys])
            .agg(F.sum(col(y)).alias("sum"), F.avg(col(y)).alias("mean"), F.count(col(y)).alias("count")))


def category_feed(a: DataFrame, b: DataFrame, c: str, k: int = 10) -> DataFrame:
    """Top-k categories of each table aligned by a full outer join, 0 where absent, share %."""
    def topk(df, tag):
        vc = df.filter(col(c).isNotNull()).groupBy(col(c).cast("string").alias("category")).agg(
            F.count(F.lit(1)).alias(f"count_{tag}"))
        tot = vc.agg(F.sum(f"count_{tag}").alias("_t"))
        best = vc.orderBy(F.desc(f"count_{tag}"), F.asc("category")).limit(k)
        return (attach(best, tot)
                .withColumn(f"share_{tag}", F.try_divide(F.col(f"count_{tag}") * 100.0, F.col("_t"))).drop("_t"))
    j = topk(a, "a").join(topk(b, "b"), "category", "full")
    return j.na.fill(0, ["count_a", "count_b"]).na.fill(0.0, ["share_a", "share_b"])


def null_patterns(df: DataFrame) -> DataFrame:
    """Distinct null masks with their row counts (the heat-map feed without a row cap)."""
    mask = F.concat_ws("", *[F.when(_missing(df, c), "1").otherwise("0") for c in df.columns])
    return df.groupBy(mask.alias("null_mask")).agg(F.count(F.lit(1)).alias("rows"))


def time_series_feed(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """X coerced to a date (bad values dropped), points summed by date and colour."""
    dt = df.schema[x].dataType
    d = col(x).cast("date") if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)) else \
        F.coalesce(F.try_to_timestamp(col(x).cast("string"), F.lit("yyyy-MM-dd")),
                   F.try_to_timestamp(col(x).cast("string"), F.lit("MM/dd/yyyy"))).cast("date")
    keys = [d.alias("date")] + ([col(color)] if color else [])
    return df.filter(d.isNotNull()).groupBy(*keys).agg(F.sum(col(y)).alias("value"), F.count(F.lit(1)).alias("points"))


def summary_cards(df: DataFrame) -> DataFrame:
    """Rows, columns, completeness %, numeric / text / date / other column counts."""
    fields = df.schema.fields
    n_num = sum(isinstance(f.dataType, NUMERIC) for f in fields)
    n_txt = sum(isinstance(f.dataType, T.StringType) for f in fields)
    n_dt = sum(isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) for f in fields)
    ms = missing_summary(df)
    return ms.select(
        (F.col("total_cells") / max(len(fields), 1)).cast("long").alias("rows"), F.lit(len(fields)).alias("columns"),
        F.when(F.col("total_cells") > 0, 100.0 - F.col("overall_missing_percentage")).alias("completeness"),
        F.lit(n_num).alias("numeric_columns"), F.lit(n_txt).alias("text_columns"),
        F.lit(n_dt).alias("date_columns"), F.lit(len(fields) - n_num - n_txt - n_dt).alias("other_columns"))


def _date_types():
    return (T.DateType, T.TimestampType, T.TimestampNTZType)


def data_types(df: DataFrame, samples: int = 3, date_formats=None, core: DataFrame | None = None) -> DataFrame:
    """Per column current type, unique and null counts, recommended type and the smallest ``samples`` values.

    A6 rule: > 50% null -> cleaning advice; numeric types -> numeric, date types -> datetime (D15: typed columns keep
    their type); text: all values numeric -> numeric, all parse as dates -> datetime; unique ratio < 0.1 and fewer than
    50 values -> categorical; else text.
    """
    fields = df.schema.fields
    core = core if core is not None else _checkpoint(text_core(df))
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    is_text, v = F.col("column").isin(texts), F.col("value")
    # dates and numbers in text are looked for once for each distinct value
    found = core.groupBy("column").agg(
        F.count(F.lit(1)).alias("_u"), F.min(F.when(is_text, v.try_cast("double").isNotNull())).alias("_num"),
        F.min(F.when(is_text, parse_date(v, date_formats).isNotNull())).alias("_dt"))
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(_missing(df, f.name)).alias(f"z{i}") for i, f in enumerate(fields)])

    def kind(f):
        return ("numeric" if isinstance(f.dataType, NUMERIC) else "datetime" if isinstance(f.dataType, _date_types())
                else "string" if isinstance(f.dataType, T.StringType) else "other")

    rows = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("current_type"),
                     F.col(f"z{i}").alias("null_values"), F.lit(kind(f)).alias("_kind")) for i, f in enumerate(fields)]
    x = one.select("_n", F.explode(F.array(*rows)).alias("r")).select("_n", "r.*").join(F.broadcast(found), "column", "left")
    u, k = F.coalesce("_u", F.lit(0)), F.col("_kind")
    cat = F.when((F.try_divide(u, F.col("_n")) < 0.1) & (u < 50), "categorical").otherwise("text")
    typed = (F.when(k.isin("numeric", "datetime"), k).when((k == "string") & F.col("_num"), "numeric")
             .when((k == "string") & F.col("_dt"), "datetime").otherwise(cat))
    rec = F.when(F.try_divide(F.col("null_values"), F.col("_n")) > 0.5, "High null percentage - consider data cleaning").otherwise(typed)
    types = x.select("column", "position", "current_type", u.alias("unique_values"), "null_values", rec.alias("recommended_type"))
    smallest = top_k(core.select("column", "value"), ["column"], [F.asc("value")], samples).groupBy("column").agg(
        F.array_sort(F.collect_list("value")).alias("sample_values"))
    return types.join(smallest, "column", "left")


def box_stats(df: DataFrame, cols: list[str] | None = None, core: DataFrame | None = None) -> DataFrame:
    """Five-number summary and IQR fences per numeric column (box-plot feed)."""
    core = core if core is not None else numeric_core(df, cols)
    x = core.groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"), ranks.quantile(0.25).alias("q1"),
                                   ranks.quantile(0.5).alias("median"), ranks.quantile(0.75).alias("q3"))
    return (x.withColumn("lower_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
            .withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))


def outlier_points(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The values outside the IQR fences, per column (the box plots' outlier points)."""
    cols = cols or numeric_columns(df)
    b = box_stats(df, cols).select("column", "lower_fence", "upper_fence")
    long = to_long(df, cols)
    return (long.join(F.broadcast(b), "column")
            .filter((F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence")))
            .select("column", "value"))


#: Fixed output texts of the overview's recommendations.
TYPE_ALIGNMENT = "Data Type Alignment: Consider standardizing data types for common columns to enable better analysis and merging."
DATA_QUALITY = "Data Quality: Address missing data patterns, especially in the dataset with higher missing percentages."
SCHEMA_REVIEW = "Schema Review: Low column overlap suggests these datasets may serve different purposes or need schema alignment."
SIZE_DISPARITY = ("Size Disparity: Significant size difference between datasets - consider if this is expected or requires "
                  "investigation.")
WELL_ALIGNED = "Well Aligned: The datasets appear to be well-structured and comparable for analysis."


def overview_alignment(a: DataFrame, b: DataFrame, name_a: str = "A", name_b: str = "B") -> DataFrame:
    """Type-class counts per table, column overlap %, row gap (B - A) in % of A's rows, missing-% gap (B - A), columns
    whose types differ, and as arrays the insights (size, missing data above 5 points, overlap) and the recommendations
    (types differ, missing gap above 10 points, overlap below 50%, row gap above 10% of A, else well aligned)."""
    def classes(df):
        fs = df.schema.fields
        return (sum(isinstance(f.dataType, NUMERIC) for f in fs), sum(isinstance(f.dataType, T.StringType) for f in fs),
                sum(isinstance(f.dataType, _date_types()) for f in fs))
    na, ta, da = classes(a)
    nb, tb, db = classes(b)
    shared = set(a.columns) & set(b.columns)
    common, union = len(shared), len(set(a.columns) | set(b.columns))
    overlap = common * 100.0 / union if union else 0.0
    mismatches = sorted(c for c in shared if a.schema[c].dataType != b.schema[c].dataType)
    side = lambda df, t: attach(df.agg(F.count(F.lit(1)).alias(f"rows_{t}")),
                                missing_summary(df).select(F.col("overall_missing_percentage").alias(f"missing_{t}")))
    x = attach(side(a, "a"), side(b, "b"))
    rows, gone = F.col("rows_b") - F.col("rows_a"), F.col("missing_b") - F.col("missing_a")
    insights = F.array(
        F.when(rows > 0, F.format_string(f"{name_b} has %s more rows than {name_a}", F.format_number(rows, 0)))
        .when(rows < 0, F.format_string(f"{name_a} has %s more rows than {name_b}", F.format_number(-rows, 0)))
        .otherwise(F.format_string("Both datasets have the same number of rows (%s)", F.format_number("rows_a", 0))),
        F.when(gone > 5, F.format_string(f"{name_b} has significantly more missing data (%+.1f%%)", gone))
        .when(gone < -5, F.format_string(f"{name_a} has significantly more missing data (%.1f%%)", -gone)),
        F.lit(f"Column overlap: {overlap:.1f}% ({common} of {union} total unique columns)"))
    advice = F.filter(F.array(F.when(F.lit(bool(mismatches)), TYPE_ALIGNMENT), F.when(F.abs(gone) > 10, DATA_QUALITY),
                              F.when(F.lit(overlap < 50), SCHEMA_REVIEW), F.when(F.abs(rows) > F.col("rows_a") * 0.1, SIZE_DISPARITY)), F.isnotnull)
    return x.select("rows_a", "rows_b", F.lit(na).alias("numeric_a"), F.lit(ta).alias("text_a"), F.lit(da).alias("date_a"),
                    F.lit(nb).alias("numeric_b"), F.lit(tb).alias("text_b"), F.lit(db).alias("date_b"),
                    F.lit(overlap).alias("column_overlap"), F.try_divide(rows * 100.0, F.col("rows_a")).alias("row_gap"),
                    gone.alias("missing_gap"), F.concat_ws(", ", *map(F.lit, mismatches)).alias("type_mismatches"),
                    F.concat_ws("; ", insights).alias("insights"),
                    F.concat_ws("; ", F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(WELL_ALIGNED)))).alias("recommendations"))


def analyze_table(df: DataFrame, name: str = "table") -> dict[str, DataFrame]:
    """The whole column profile of one table as named DataFrames (A1-A12). Two cores are written while it is built, one of
    all columns as text and one of the numeric columns with places; the parts are read from them."""
    nums, strs = numeric_columns(df), string_columns(df)
    texts = _checkpoint(text_core(df))
    out = {"shape": shape(df), "missing": missing(df), "missing_summary": missing_summary(df), "types": data_types(df, core=texts)}
    if nums:
        core = numeric_core(df, nums)
        d = describe(df, nums, core)
        out.update({"descriptive": d, "outliers": outliers(df, nums, core), "box": box_stats(df, nums, core),
                    "histogram": histogram(df, nums), "normality": normality(d), "correlation": correlations(df, nums)})
    if strs:
        out["categorical"] = categorical(df, strs, core=texts)
    return out
