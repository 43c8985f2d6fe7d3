"""Formatting and structure differences between two workbooks held as attribute tables.

``cell_attrs(book, sheet, cell, category, attr, value)``: one row per cell
attribute (font name, fill colour, border, alignment, number format,
protection ...). ``objects(sheet, kind, id, attr, value)``: merged ranges,
column / row sizes and hidden flags, sheet properties, conditional-format
rules. Every diff is a full outer join on the attribute key with a
null-safe comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import attach, top_k

# The reference's per-category significance weights.
CATEGORY_WEIGHTS = {"font": 2, "fill": 3, "border": 2, "alignment": 1, "number_format": 2, "protection": 1}


def attribute_diff(a: DataFrame, b: DataFrame, keys=("sheet", "cell", "category", "attr")) -> DataFrame:
    """G1: every differing attribute: modified (both present, values differ), only_in_a, only_in_b."""
    k = list(keys)
    x = a.select(*k, F.col("value").alias("value_a")).withColumn("_a", F.lit(True))
    y = b.select(*k, F.col("value").alias("value_b")).withColumn("_b", F.lit(True))
    j = x.join(y, k, "full")
    change = (F.when(F.col("_a").isNull(), "only_in_b").when(F.col("_b").isNull(), "only_in_a")
              .when(~F.col("value_a").eqNullSafe(F.col("value_b")), "modified"))
    return j.select(*k, "value_a", "value_b", change.alias("change")).filter(F.col("change").isNotNull())


def cell_presence(a: DataFrame, b: DataFrame) -> DataFrame:
    """G1: cells present only in A or only in B (by cell, any attribute)."""
    ca = a.select("sheet", "cell").distinct().withColumn("_a", F.lit(True))
    cb = b.select("sheet", "cell").distinct().withColumn("_b", F.lit(True))
    j = ca.join(cb, ["sheet", "cell"], "full")
    return (j.filter(F.col("_a").isNull() | F.col("_b").isNull())
            .select("sheet", "cell", F.when(F.col("_a").isNull(), "only_in_b").otherwise("only_in_a").alias("presence")))


def diff_summary(diff: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Changes per category with the share of compared attributes and the total."""
    keys = ["sheet", "cell", "category", "attr"]
    # dealt by key before they are made distinct: hardly any key repeats within a task that reads, and its map of all keys would grow with the split
    compared = a.select(*keys).union(b.select(*keys)).repartition(*keys).distinct()
    tot = compared.groupBy("category").agg(F.count(F.lit(1)).alias("compared"))
    ch = diff.groupBy("category").agg(F.count(F.lit(1)).alias("changes"),
                                      F.sum(F.when(F.col("change") == "modified", 1).otherwise(0)).cast("long").alias("modified"))
    return (tot.join(ch, "category", "left").na.fill(0, ["changes", "modified"])
            .withColumn("change_percentage", F.try_divide(F.col("changes") * 100.0, F.col("compared"))))


def diff_examples(diff: DataFrame, k: int = 5) -> DataFrame:
    """The first k changed cells per category (by sheet, cell, attribute)."""
    return top_k(diff, ["category"], [F.asc("sheet"), F.asc("cell"), F.asc("attr")], k, rank_col="example_no")


def _cell_scores(diff: DataFrame, min_score: float) -> DataFrame:
    w = diff.sparkSession.createDataFrame(list(CATEGORY_WEIGHTS.items()), "category string, weight int")
    return (diff.join(F.broadcast(w), "category", "left").na.fill(1, ["weight"])
            .groupBy("sheet", "cell").agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("changes"))
            .filter(F.col("score") > min_score))


def significance(diff: DataFrame, min_score: float = 3, top: int = 20) -> DataFrame:
    """Per cell weighted change score (all cells, no sample cap), kept above ``min_score``, best ``top``;
    impact by the mean score of the kept cells (> 8 high, > 5 medium)."""
    s = _cell_scores(diff, min_score)
    best = s.orderBy(F.desc("score"), F.asc("sheet"), F.asc("cell")).limit(top)
    m = s.agg(F.avg("score").alias("_mean"), F.count(F.lit(1)).alias("significant_cells"))
    return (attach(best, m).withColumn("impact", F.when(F.col("_mean") > 8, "high").when(F.col("_mean") > 5, "medium")
                                       .otherwise("low")).drop("_mean"))


def change_impact(diff: DataFrame, min_score: float = 3) -> DataFrame:
    """One row: impact level of the significant cells (none without any), their number and mean score."""
    s = _cell_scores(diff, min_score).agg(F.count(F.lit(1)).alias("total_significant_changes"), F.avg("score").alias("average_significance_score"))
    mean = F.col("average_significance_score")
    return s.withColumn("impact_level", F.when(mean.isNull(), "none").when(mean > 8, "high").when(mean > 5, "medium").otherwise("low"))


def structure_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences in merged ranges, column / row sizes and hidden flags, sheet properties and protection."""
    return attribute_diff(a, b, keys=("sheet", "kind", "id", "attr"))


def formatted_cell_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Formatted cells per category (font, fill, border, ...) in A and B and the difference."""
    ca = a.groupBy("category").agg(F.count_distinct("sheet", "cell").alias("cells_a"))
    cb = b.groupBy("category").agg(F.count_distinct("sheet", "cell").alias("cells_b"))
    return (ca.join(cb, "category", "full").na.fill(0, ["cells_a", "cells_b"])
            .withColumn("difference", F.col("cells_b") - F.col("cells_a")))


def rule_counts(a: DataFrame, b: DataFrame, kind: str = "conditional_format") -> DataFrame:
    """Number of rules of one object kind per sheet in A and B and the difference."""
    ra = a.filter(F.col("kind") == kind).groupBy("sheet").agg(F.count_distinct("id").alias("rules_a"))
    rb = b.filter(F.col("kind") == kind).groupBy("sheet").agg(F.count_distinct("id").alias("rules_b"))
    return (ra.join(rb, "sheet", "full").na.fill(0, ["rules_a", "rules_b"])
            .withColumn("difference", F.col("rules_b") - F.col("rules_a")))


def compare_formats(a: DataFrame, b: DataFrame, objects_a: DataFrame | None = None,
                    objects_b: DataFrame | None = None) -> dict[str, DataFrame]:
    """The bundle of format and structure diffs as named DataFrames."""
    d = attribute_diff(a, b)
    out = {"diff": d, "presence": cell_presence(a, b), "summary": diff_summary(d, a, b), "examples": diff_examples(d),
           "significance": significance(d), "formatted_cells": formatted_cell_stats(a, b)}
    if objects_a is not None and objects_b is not None:
        out["structure"] = structure_diff(objects_a, objects_b)
        out["rules"] = rule_counts(objects_a, objects_b)
    return out
