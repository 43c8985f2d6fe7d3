"""Filters and views over a result table (pushed into the plan as ordinary predicates)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import col
from .frames import attach

BANDS = {"High": (80.0, 100.0), "Medium": (60.0, 79.0), "Low": (0.0, 59.0)}


def text_search(df: DataFrame, pattern: str) -> DataFrame:
    """Rows where any string column matches ``pattern`` (regex, case-insensitive)."""
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cond = reduce(lambda a, b: a | b, [F.coalesce(col(c).rlike(f"(?i){pattern}"), F.lit(False)) for c in strs])
    return df.filter(cond)


def score_range(df: DataFrame, lo: float, hi: float, score: str = "similarity_score") -> DataFrame:
    """P5: similarity between lo and hi (inclusive)."""
    return df.filter(col(score).between(lo, hi))


def match_types(df: DataFrame, types: list[str]) -> DataFrame:
    """Keep the listed match types."""
    return df.filter(F.col("match_type").isin(*types))


def confidence_bands(df: DataFrame, bands: list[str], score: str = "similarity_score") -> DataFrame:
    """High 80-100, Medium 60-79, Low 0-59 (the 79-80 gap is the reference's)."""
    cond = reduce(lambda a, b: a | b, [col(score).between(*BANDS[b]) for b in bands])
    return df.filter(cond)


def column_search(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose ``column`` (as text) matches ``pattern`` case-insensitively."""
    return df.filter(F.coalesce(col(column).cast("string").rlike(f"(?i){pattern}"), F.lit(False)))


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without nulls."""
    return df.na.drop(how="any")


def length_range(df: DataFrame, column: str, lo: int, hi: int) -> DataFrame:
    """P10: text length of ``column`` between lo and hi."""
    return df.filter(F.length(col(column).cast("string")).between(lo, hi))


def filter_stats(original: DataFrame, filtered: DataFrame) -> DataFrame:
    """Original rows, kept rows and the share kept."""
    x = attach(original.agg(F.count(F.lit(1)).alias("original_rows")), filtered.agg(F.count(F.lit(1)).alias("filtered_rows")))
    return x.withColumn("percentage_shown", F.when(F.col("original_rows") > 0,
                                                   F.col("filtered_rows") * 100.0 / F.col("original_rows")).otherwise(0.0))


def by_source(df: DataFrame, sources: list[str], source_col: str = "_source_sheet") -> DataFrame:
    """Rows of the chosen source tables (partition pruning when the output is partitioned by source)."""
    return df.filter(col(source_col).isin(*sources))


def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """First n rows under an explicit order."""
    return df.orderBy(*order_by).limit(n)


def score_band(score) -> F.Column:
    """Band of a similarity score: >= 95 green, >= 80 yellow, else red (shown next to the score)."""
    s = col(score) if isinstance(score, str) else score
    return F.when(s >= 95, "green").when(s >= 80, "yellow").otherwise("red")
