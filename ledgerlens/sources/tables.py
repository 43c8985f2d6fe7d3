"""Reading tables, clean reads and validation checks.

A "workbook" in the reference is a dict of sheets; here a table set is an
ordered ``dict[str, DataFrame]`` (or one DataFrame with a ``_source`` column
where the schemas agree).
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read one table from any Spark file source."""
    reader = spark.read.options(**options)
    return reader.format(fmt).load(path)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def register_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> None:
    """Expose the base tables as temp views (used by the fixture SQL)."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def table_names(tables: dict[str, DataFrame]) -> list[str]:
    """List of table names, in the order the caller gave them."""
    return list(tables)


def clean_read(df: DataFrame) -> DataFrame:
    """Drop rows that are all null, then columns that are all null.

    One aggregate decides which columns are empty; its result is a single
    row of counts, the only thing that reaches the driver.
    """
    rows = df.na.drop(how="all")
    if not rows.columns:
        return rows
    counts = rows.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(rows.columns)]).first()
    empty = [c for i, c in enumerate(rows.columns) if counts[f"c{i}"] == 0]
    return rows.drop(*empty) if empty else rows


def validate(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """S3: one row per check: table non-empty, each column present and not all null."""
    columns = list(columns or [])
    present = [c for c in columns if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(present)]
    one = df.agg(*aggs)
    checks = [F.struct(F.lit("table").alias("check"), F.lit(None).cast("string").alias("column"),
                       (F.col("_rows") > 0).alias("passed"),
                       F.when(F.col("_rows") > 0, F.lit("ok")).otherwise(F.lit("table is empty")).alias("message"))]
    for i, c in enumerate(present):
        checks.append(F.struct(F.lit("column").alias("check"), F.lit(c).alias("column"),
                               (F.col(f"n{i}") > 0).alias("passed"),
                               F.when(F.col(f"n{i}") > 0, F.lit("ok")).otherwise(F.lit("column is all null")).alias("message")))
    for c in columns:
        if c not in df.columns:
            checks.append(F.struct(F.lit("column").alias("check"), F.lit(c).alias("column"), F.lit(False).alias("passed"),
                                   F.lit("column not found").alias("message")))
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")
