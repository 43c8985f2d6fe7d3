"""Consolidating many tables (a "workbook") into one.

A table set is an ordered ``dict[str, DataFrame]``. Schema work (C1, C4's
types) reads only ``df.schema``; everything that touches rows is a union,
a grouped aggregate or a join, so it scales with the data, not the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import col
from .frames import attach
from .profile import unique_counts
from .ranks import _checkpoint

SOURCE = "_source_sheet"


def _spark(tables: dict[str, DataFrame]):
    return next(iter(tables.values())).sparkSession


def common_columns(tables: dict[str, DataFrame]) -> list[str]:
    """Columns present in every table, in the first table's order."""
    first = next(iter(tables.values())).columns
    return [c for c in first if all(c in df.columns for df in tables.values())]


def schema_analysis(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column: tables holding it, common flag, types per table, type clash flag, rows of those tables and
    the values they hold (one counting pass over each table)."""
    seen = list(dict.fromkeys(c for df in tables.values() for c in df.columns))
    parts = []
    for k, (name, df) in enumerate(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
        cells = F.array(*[F.struct(F.lit(seen.index(c)).alias("position"), F.lit(c).alias("column"), F.lit(k).alias("k"), F.lit(name).alias("name"),
                                   F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.col("_n").alias("n"), F.col(f"c{i}").alias("v"))
                          for i, c in enumerate(df.columns)])
        parts.append(one.select(F.explode(cells).alias("x")).select("x.*"))
    per = reduce(lambda a, b: a.unionByName(b), parts).groupBy("position", "column").agg(
        F.array_sort(F.collect_list(F.struct("k", "name", "type"))).alias("held"), F.sum("n").alias("rows"), F.sum("v").alias("values"))
    return per.select(
        "position", "column", F.size("held").alias("tables"), (F.size("held") == len(tables)).alias("is_common"),
        F.array_join("held.name", ";").alias("present_in"), F.array_join("held.type", ";").alias("types"),
        (F.size(F.array_distinct("held.type")) > 1).alias("type_mismatch"), "rows", "values")


def schema_advice(tables: dict[str, DataFrame]) -> DataFrame:
    """Union vs key-merge advice from the share of common columns (< 50% -> union)."""
    sa = schema_analysis(tables)
    one = sa.agg(F.sum(F.when(F.col("is_common"), 1).otherwise(0)).alias("common_columns"),
                 F.count(F.lit(1)).alias("all_columns"), F.sum(F.when(F.col("type_mismatch"), 1).otherwise(0)).alias("issues"),
                 F.try_divide(F.sum("values") * 100.0, F.sum("rows")).alias("filled"))
    advice = (F.when(F.col("common_columns") == 0, "No common columns: use union with source tracking.")
              .when(F.col("common_columns") < F.col("all_columns") * 0.5, "Few common columns: union recommended over key merge.")
              .otherwise("Good column alignment: key-based merge is viable."))
    return one.select(F.col("common_columns").cast("long"), F.col("all_columns").cast("long"),
                      F.col("issues").cast("long").alias("compatibility_issues"), F.col("filled").alias("filled_percentage"),
                      advice.alias("recommendation"))


def union_tables(tables: dict[str, DataFrame], include_source: bool = True, missing: str = "fill",
                 duplicates: str = "keep", default_value: str = "DEFAULT_VALUE") -> DataFrame:
    """Stack tables by column name.

    ``missing``: ``fill`` (absent columns null), ``inner`` (common columns
    only), ``default`` (everything as text, nulls -> ``default_value``).
    ``duplicates``: ``keep``, ``remove`` (distinct rows) or ``mark``
    (``_is_duplicate`` true on every member of a repeated row, source
    included in the comparison, as in the reference).
    """
    parts = []
    common = common_columns(tables)
    for name, df in tables.items():
        d = df.select(*[col(c) for c in common]) if missing == "inner" else df
        parts.append(d.withColumn(SOURCE, F.lit(name)) if include_source else d)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if missing == "default":
        out = out.select(*[col(c).cast("string").alias(c) for c in out.columns]).na.fill(default_value)
    if duplicates == "remove":
        out = out.distinct()
    elif duplicates == "mark":
        keys = out.columns
        counts = (out.groupBy(*[col(c) for c in keys]).agg(F.count(F.lit(1)).alias("_copies"))
                  .select(*[col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_copies"))
        cond = reduce(lambda a, b: a & b, [col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
        out = out.join(counts, cond, "left").select(*[col(c) for c in keys], (F.col("_copies") > 1).alias("_is_duplicate"))
    return out


def merge_on_key(tables: dict[str, DataFrame], key: str | None = None, include_source: bool = True) -> DataFrame:
    """Full outer merge of all tables on a key; clashing columns get ``_from_<table>``; ``_sources`` lists where the key
    occurs (D3 fixed: presence, not every later table). Falls back to a union when no column is common (C6).

    A full outer join can't be split where a key is hot. So one pre-aggregated pass finds which keys occur in which tables, each
    table gets a row of nulls for every key that it lacks, and the merge is a chain of inner joins, whose hot keys (null among
    them, which matches null) the adaptive skew join splits on either side.
    """
    common = common_columns(tables)
    if not common:
        return union_tables(tables, include_source)
    key = key or common[0]
    names = list(tables)
    found = reduce(DataFrame.unionByName, [df.select(col(key).alias("_k"), F.lit(i).alias("_t")).distinct() for i, df in enumerate(tables.values())])
    keys = _checkpoint(found.groupBy("_k").agg(F.collect_set("_t").alias("_in")))
    acc = None
    for i, name in enumerate(names):
        taken = acc.columns if acc is not None else []
        right = tables[name].select(*[col(c).alias(c if c == key or c not in taken else f"{c}_from_{name}") for c in tables[name].columns])
        lacking = keys.where(~F.array_contains("_in", i)).select(F.col("_k").alias(key))
        right = right.withColumn(f"_in_{i}", F.lit(True)).unionByName(lacking, allowMissingColumns=True)
        if acc is None:
            acc = right
            continue
        right = right.withColumnRenamed(key, "_right_key")
        acc = acc.join(right, col(key).eqNullSafe(F.col("_right_key"))).drop("_right_key")
    first = [key, *[c for c in acc.columns if c != key]]
    acc = acc.select(*[col(c) for c in first])
    flags = [F.when(F.col(f"_in_{i}"), F.lit(n)) for i, n in enumerate(names)]
    out = acc.withColumn("_sources", F.concat_ws(";", *flags)) if include_source else acc
    return out.drop(*[f"_in_{i}" for i in range(len(names))])


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """C4: per table and column: type, non-null, null, unique counts and a sample (smallest non-null value)."""
    parts = []
    for name, df in tables.items():
        aggs = []
        for i, c in enumerate(df.columns):
            aggs += [F.count(col(c)).alias(f"nn{i}"), F.min(col(c).cast("string")).alias(f"s{i}")]
        one = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
        rows = F.explode(F.array(*[F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
            F.col(f"nn{i}").alias("non_null_count"), (F.col("_n") - F.col(f"nn{i}")).alias("null_count"),
            F.coalesce(F.col(f"s{i}"), F.lit("N/A")).alias("sample_value"))
            for i, c in enumerate(df.columns)]))
        x = one.select(F.lit(name).alias("sheet"), rows.alias("r")).select("sheet", "r.*")
        parts.append(x.join(F.broadcast(unique_counts(df, df.columns)), "column"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def consolidation_report(tables: dict[str, DataFrame], result: DataFrame, strategy: str) -> DataFrame:
    """Tables, input rows, output rows, row efficiency %, common / total columns, issues, strategy."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")) for df in tables.values()]
    inp = reduce(lambda a, b: a.unionByName(b), counts).agg(F.sum("n").alias("total_input_rows"))
    out = result.agg(F.count(F.lit(1)).alias("final_output_rows"))
    adv = schema_advice(tables)
    x = attach(attach(inp, out), adv)
    return x.select(F.lit(len(tables)).alias("total_sheets"), F.col("total_input_rows").cast("long"), "final_output_rows",
                    F.when(F.col("total_input_rows") > 0, F.col("final_output_rows") * 100.0 / F.col("total_input_rows"))
                    .otherwise(0.0).alias("row_efficiency"), "common_columns", F.col("all_columns").alias("total_unique_columns"),
                    "compatibility_issues", F.lit(strategy).alias("strategy_used"))


def consolidate(tables: dict[str, DataFrame], strategy: str = "union", **kw) -> DataFrame:
    """Run one strategy: ``union``, ``merge`` (key-based, falls back to union) or ``schema`` (catalogue only)."""
    if strategy == "union":
        return union_tables(tables, **kw)
    if strategy == "merge":
        return merge_on_key(tables, **kw)
    if strategy == "schema":
        return catalogue(tables)
    raise ValueError(strategy)
