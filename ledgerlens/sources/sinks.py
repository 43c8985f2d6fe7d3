"""Writing results with Spark's own writers (no driver-side file building)."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import attach
from ..operators.profile import numeric_columns, missing_summary, outliers, shape


def write_categorised(result: DataFrame, path: str, reports: dict[str, DataFrame] | None = None,
                      fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Match rows partitioned by ``category`` (matched / suggested / unmatched) plus one folder per report table."""
    result.write.mode(mode).partitionBy("category").format(fmt).save(f"{path}/rows")
    for name, df in (reports or {}).items():
        df.write.mode(mode).format(fmt).save(f"{path}/{name}")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row (one file per partition)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines of a (tidy) report table."""
    df.write.mode(mode).json(path)


def statistical_summary(df: DataFrame, name: str) -> DataFrame:
    """Text summary lines: shape, missing cells, most variable column (by CV) and total IQR outliers."""
    sh = shape(df)
    ms = missing_summary(df).select("total_missing_cells", "overall_missing_percentage")
    nums = numeric_columns(df)
    base = attach(sh, ms)
    if nums:
        cv = df.agg(*[F.try_divide(F.stddev_samp(F.col(f"`{c}`")), F.abs(F.avg(F.col(f"`{c}`")))).alias(f"cv{i}")
                      for i, c in enumerate(nums)])
        best = cv.select(F.explode(F.array(*[F.struct(F.col(f"cv{i}").alias("cv"), F.lit(c).alias("column"))
                                            for i, c in enumerate(nums)])).alias("x")).select("x.*")
        top = best.filter(F.col("cv").isNotNull()).agg(F.max_by("column", "cv").alias("most_variable"))
        out = outliers(df, nums).agg(F.sum("outliers_count").alias("total_outliers"))
        base = attach(attach(base, top), out)
    else:
        base = base.withColumn("most_variable", F.lit(None).cast("string")).withColumn("total_outliers", F.lit(0))
    lines = [
        F.format_string("Dataset: %s", F.lit(name)),
        F.format_string("Rows: %d, Columns: %d, Cells: %d", "total_rows", "total_columns", "total_cells"),
        F.format_string("Missing cells: %d (%.2f%%)", "total_missing_cells", "overall_missing_percentage"),
        F.format_string("Most variable column: %s", F.coalesce("most_variable", F.lit("n/a"))),
        F.format_string("Total outliers (IQR): %d", F.coalesce("total_outliers", F.lit(0))),
    ]
    return base.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def write_text(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The summary lines as a text file, in order."""
    lines.orderBy("line_no").select("line").coalesce(1).write.mode(mode).text(path)


def export_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write consolidated / historical outputs, one folder per table."""
    for name, df in tables.items():
        df.write.mode(mode).format(fmt).save(f"{path}/{name}")
