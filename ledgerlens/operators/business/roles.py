"""Detect column roles from the schema plus one aggregate of distinct ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.dates import parse_date
from ...functions.normalize import col
from ..profile import NUMERIC

# The reference's role keywords.
DATE_WORDS = ["date", "time", "created", "updated", "order"]
AMOUNT_WORDS = ["amount", "price", "cost", "revenue", "sales", "value", "total"]
CATEGORY_WORDS = ["category", "type", "status", "region", "product", "department", "rep"]
RATING_WORDS = ["rating", "score", "satisfaction", "quality"]
ID_WORDS = ["id", "key", "number", "code"]
CUSTOMER_WORDS = ["customer", "client", "user", "buyer", "account"]
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _has(name: str, words) -> bool:
    n = name.lower()
    return any(w in n for w in words)


def roles(df: DataFrame, date_formats=None) -> DataFrame:
    """One row per column: type, unique ratio and role flags (date, amount, category, rating, id, customer).

    Dates need a date/timestamp type, or a date keyword and text values that
    parse (integers never count as dates: D7).
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        aggs.append(F.count_distinct(col(f.name)).alias(f"u{i}"))
        if isinstance(f.dataType, T.StringType) and _has(f.name, DATE_WORDS):
            parsed = parse_date(col(f.name), date_formats)
            aggs.append(F.min(F.when(col(f.name).isNull() | parsed.isNotNull(), 1).otherwise(0)).alias(f"d{i}"))
    one = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        numeric = isinstance(f.dataType, NUMERIC)
        text = isinstance(f.dataType, T.StringType)
        ratio = F.try_divide(F.col(f"u{i}"), F.col("_n"))
        if isinstance(f.dataType, DATE_TYPES):
            is_date = F.lit(True)
        elif text and _has(f.name, DATE_WORDS):
            is_date = F.col(f"d{i}") == 1
        else:
            is_date = F.lit(False)
        is_cat = (ratio < 0.1) | F.lit(_has(f.name, CATEGORY_WORDS) and text)
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            ratio.alias("unique_ratio"), is_date.alias("is_date"),
            F.lit(_has(f.name, AMOUNT_WORDS) and numeric).alias("is_amount"), is_cat.alias("is_category"),
            F.lit(_has(f.name, RATING_WORDS) and numeric).alias("is_rating"),
            (F.lit(_has(f.name, ID_WORDS)) & (ratio > 0.8)).alias("is_id"),
            F.lit(_has(f.name, CUSTOMER_WORDS)).alias("is_customer")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def first_numeric_by_keywords(df: DataFrame, keywords: list[str]) -> str | None:
    """First numeric column whose name (``_``/``-`` as spaces) contains a keyword (also normalised: D6)."""
    for f in df.schema.fields:
        name = f.name.lower().replace("_", " ").replace("-", " ")
        if isinstance(f.dataType, NUMERIC) and any(k.lower().replace("_", " ") in name for k in keywords):
            return f.name
    return None
