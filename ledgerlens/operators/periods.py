"""Historical comparison of period tables.

Periods arrive as one long DataFrame tagged by a period column (sheets of
agreeing schemas), so every statistic is one grouped aggregate over
(period, column) - one shuffle whatever the number of periods. Period order
is the rank of an order key per period (given, or the period name).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import col
from . import ranks
from .profile import NUMERIC

# Month and quarter spellings searched in table names, and the sequential pattern.
MONTH_PATTERNS = [("jan", "January"), ("feb", "February"), ("mar", "March"), ("apr", "April"), ("may", "May"),
                  ("jun", "June"), ("jul", "July"), ("aug", "August"), ("sep", "September"), ("oct", "October"),
                  ("nov", "November"), ("dec", "December"), ("january", "January"), ("february", "February"),
                  ("march", "March"), ("april", "April"), ("june", "June"), ("july", "July"), ("august", "August"),
                  ("september", "September"), ("october", "October"), ("november", "November"), ("december", "December")]
QUARTER_PATTERNS = [("q1", "Q1"), ("q2", "Q2"), ("q3", "Q3"), ("q4", "Q4"), ("quarter 1", "Q1"), ("quarter 2", "Q2"),
                    ("quarter 3", "Q3"), ("quarter 4", "Q4")]
SEQUENTIAL_RE = r"(week|month|period|day|phase|step)[\s]*(\d+)"


def _first_match(low, patterns):
    expr = None
    for p, full in patterns:
        cond = F.instr(low, p) > 0
        expr = F.when(cond, F.lit(full)) if expr is None else expr.when(cond, F.lit(full))
    return expr


def detect_time_patterns(names: DataFrame, name_col: str = "sheet", years: range | None = None) -> DataFrame:
    """(sheet, pattern_type, period) for pattern types matched by at least two table names.

    A year is the smallest number from 1900 to 2099 within the name, or one of ``years`` if given; the clock plays no part.
    """
    low = F.lower(col(name_col))
    found = F.regexp_extract_all(low, F.lit(r"(?=((?:19|20)\d\d))"), 1)
    seq = F.regexp_extract(low, SEQUENTIAL_RE, 0)
    seq_label = F.concat(F.initcap(F.regexp_extract(low, SEQUENTIAL_RE, 1)), F.lit(" "), F.regexp_extract(low, SEQUENTIAL_RE, 2))
    kinds = [("Monthly Time Series", _first_match(low, MONTH_PATTERNS)),
             ("Quarterly Time Series", _first_match(low, QUARTER_PATTERNS)),
             ("Yearly Time Series", F.array_min(found if years is None else F.array_intersect(
                 found, F.array(*[F.lit(str(y)) for y in years])))),
             ("Sequential Time Series", F.when(seq != "", seq_label))]
    long = names.select(col(name_col).alias("sheet"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("pattern_type"), e.alias("period")) for k, e in kinds])).alias("x")).select("sheet", "x.*")
    hits = long.filter(F.col("period").isNotNull())
    n = hits.groupBy("pattern_type").agg(F.count(F.lit(1)).alias("_n"))
    return hits.join(n, "pattern_type").filter(F.col("_n") >= 2).drop("_n")


def _period_no(df: DataFrame, period: str, order: str | None) -> DataFrame:
    """Small table (period, period_no) ranked by ``order`` (or the period name)."""
    o = order or period
    p = df.groupBy(col(period).alias("period")).agg(F.min(col(o)).alias("_o"))
    # one row per period: the rank runs over the (small) period list
    return p.withColumn("period_no", F.row_number().over(Window.orderBy("_o", "period"))).drop("_o")


def structure(tables: dict[str, DataFrame]) -> DataFrame:
    """Per period table its rows, its columns that some other table lacks, the number of columns common to all, and the
    compatibility score: common columns in % of all columns."""
    names = {p: set(df.columns) for p, df in tables.items()}
    every = set().union(*names.values())
    common = set.intersection(*names.values()) if names else set()
    score = len(common) / len(every) * 100 if every else 0.0
    rows = [df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(p).alias("period"), "rows", F.lit(len(common)).alias("common_columns"),
        F.concat_ws(", ", *map(F.lit, sorted(names[p] - common))).alias("unique_columns"), F.lit(score).alias("compatibility_score"))
        for p, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def trends(df: DataFrame, period: str, numeric: list[str] | None = None, text: list[str] | None = None) -> DataFrame:
    """Per period x numeric column mean, median, sum, count, min, max; one grouped pass + exact medians."""
    numeric = numeric if numeric is not None else [f.name for f in df.schema.fields
                                                   if isinstance(f.dataType, NUMERIC) and f.name != period]
    items = [F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value")) for c in numeric]
    long = (df.select(col(period).alias("period"), F.explode(F.array(*items)).alias("kv")).select("period", "kv.*")
            .filter(F.col("value").isNotNull() & ~F.isnan("value")))
    g = long.groupBy("period", "column").agg(F.avg("value").alias("mean"), F.sum("value").alias("sum"),
                                             F.count(F.lit(1)).alias("count"), F.min("value").alias("min"),
                                             F.max("value").alias("max"))
    keyed = long.select(F.concat_ws("\u0001", "period", "column").alias("g"), "value")
    med = ranks.quantile_wide(keyed, {"median": 0.5}, group="g").select(
        F.split("g", "\u0001").getItem(0).alias("period"), F.split("g", "\u0001").getItem(1).alias("column"), "median")
    return g.join(med, ["period", "column"])


def text_trends(df: DataFrame, period: str, text: list[str]) -> DataFrame:
    """Per period x text column unique count, most common value (smallest on ties), count, nulls."""
    parts = []
    for c in text:
        x = df.select(col(period).alias("period"), col(c).cast("string").alias("v"))
        vc = x.filter(F.col("v").isNotNull()).groupBy("period", "v").agg(F.count(F.lit(1)).alias("n"))
        mode = vc.groupBy("period").agg(F.count(F.lit(1)).alias("unique_count"),
                                        F.min_by("v", F.struct((-F.col("n")).alias("a"), F.col("v").alias("b"))).alias("most_common"))
        cnt = x.groupBy("period").agg(F.count("v").alias("count"),
                                      F.sum(F.when(F.col("v").isNull(), 1).otherwise(0)).alias("null_count"))
        parts.append(cnt.join(mode, "period", "left").withColumn("column", F.lit(c)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def pooled_variance(df: DataFrame, period: str, numeric: list[str]) -> DataFrame:
    """Std, variance, CV % and range per numeric column over all periods together."""
    items = [F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value")) for c in numeric]
    long = df.select(F.explode(F.array(*items)).alias("kv")).select("kv.*").filter(F.col("value").isNotNull())
    g = long.groupBy("column").agg(F.stddev_samp("value").alias("std_dev"), F.var_samp("value").alias("variance"),
                                   F.avg("value").alias("_m"), (F.max("value") - F.min("value")).alias("range"))
    return g.select("column", "std_dev", "variance", F.when(F.col("_m") != 0, F.col("std_dev") / F.col("_m") * 100)
                    .otherwise(0.0).alias("coefficient_variation"), "range")


def period_changes(df: DataFrame, period: str, numeric: list[str], order: str | None = None) -> DataFrame:
    """T4: per numeric column, change and growth % of the column sum from each period to the next (0 if previous is 0)."""
    pn = _period_no(df, period, order)
    items = [F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value")) for c in numeric]
    long = df.select(col(period).alias("period"), F.explode(F.array(*items)).alias("kv")).select("period", "kv.*")
    sums = long.groupBy("period", "column").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("sum"))
    s = sums.join(pn, "period")
    w = Window.partitionBy("column").orderBy("period_no")  # periods x columns rows only
    s = s.withColumn("previous_period", F.lag("period").over(w)).withColumn("previous_sum", F.lag("sum").over(w))
    return (s.filter(F.col("previous_period").isNotNull())
            .select("column", F.concat(F.col("previous_period"), F.lit(" → "), F.col("period")).alias("period_key"),
                    "period_no", (F.col("sum") - F.col("previous_sum")).alias("change"),
                    F.when(F.col("previous_sum") != 0, (F.col("sum") - F.col("previous_sum")) / F.col("previous_sum") * 100)
                    .otherwise(0.0).alias("growth_rate")))


def baseline_comparison(df: DataFrame, period: str, baseline: str, numeric: list[str], text: list[str]) -> DataFrame:
    """T5: per period and column: sum (numeric) or non-null count (text) against the baseline period; difference and %."""
    items = ([F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value"), F.lit(True).alias("_num"))
              for c in numeric] +
             [F.struct(F.lit(c).alias("column"), F.when(col(c).isNotNull(), 1.0).alias("value"), F.lit(False).alias("_num"))
              for c in text])
    long = df.select(col(period).alias("period"), F.explode(F.array(*items)).alias("kv")).select("period", "kv.*")
    v = long.groupBy("period", "column").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    base = v.filter(F.col("period") == baseline).select("column", F.col("value").alias("baseline_value"))
    j = v.filter(F.col("period") != baseline).join(base, "column")
    diff = F.col("value") - F.col("baseline_value")
    return j.select("period", "column", "value", "baseline_value", diff.alias("difference"),
                    F.when(F.col("baseline_value") != 0, diff / F.col("baseline_value") * 100).otherwise(0.0)
                    .alias("percent_change"))


def historical_report(df: DataFrame, period: str, mode: str, include_variance: bool = True) -> DataFrame:
    """Periods analysed, total records, mode and variance flag."""
    return df.agg(F.count_distinct(col(period)).alias("periods_analyzed"), F.count(F.lit(1)).alias("total_records")).select(
        "periods_analyzed", "total_records", F.lit(mode).alias("analysis_mode"), F.lit(include_variance).alias("include_variance"))
