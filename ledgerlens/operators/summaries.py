"""M1-M9: summaries of a match result (one DataFrame with ``category``, ``match_type``, ``similarity_score``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import col, norm_key
from ..functions.rules import Rule, rules
from .frames import attach


def _counts(result: DataFrame, *more) -> DataFrame:
    c = F.col("category")
    return result.agg(
        *more,
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(c == "matched", 1).otherwise(0)).alias("matched"),
        F.sum(F.when(c == "suggested", 1).otherwise(0)).alias("suggested"),
        F.sum(F.when(c == "unmatched", 1).otherwise(0)).alias("unmatched"),
        F.sum(F.when((c == "matched") & F.col("match_type").isin("Exact", "Multi-Field Exact"), 1).otherwise(0)).alias("exact"),
        F.sum(F.when((c == "matched") & ~F.col("match_type").isin("Exact", "Multi-Field Exact"), 1).otherwise(0)).alias("fuzzy"),
        F.avg(F.when(c != "unmatched", F.col("similarity_score"))).alias("avg_similarity"))


def quality_score(result: DataFrame) -> DataFrame:
    """M2: 70 * match rate + 20 * exact share - 10 * unmatched share + 10 * mean similarity / 100, clamped 0-100."""
    k = _counts(result)
    t = F.col("total")
    raw = (F.try_divide("matched", "total") * 70 + F.try_divide("exact", "total") * 20 - F.try_divide("unmatched", "total") * 10
           + F.coalesce(F.col("avg_similarity"), F.lit(0.0)) / 100 * 10)
    return k.select("*", F.when(t == 0, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))).alias("quality_score"))


def executive_summary(result: DataFrame) -> DataFrame:
    """M1: totals, exact / fuzzy / high-confidence / suggested / unmatched counts, match rate, quality score, and a status of each."""
    q = quality_score(result)
    t = F.col("total")
    rate = F.when(t > 0, F.col("matched") * 100.0 / t).otherwise(0.0)
    return q.select(
        F.col("total").alias("total_records"), F.col("exact").cast("long").alias("exact_matches"),
        F.col("fuzzy").cast("long").alias("fuzzy_matches"), F.col("matched").cast("long").alias("high_confidence_matches"),
        F.col("suggested").cast("long").alias("suggested_reviews"), F.col("unmatched").cast("long").alias("unmatched_records"),
        rate.alias("match_rate"), "quality_score",
        F.when(t > 0, "Complete").otherwise("No Data").alias("total_status"),
        F.when(F.col("fuzzy") > 0, "Good").otherwise("None").alias("fuzzy_status"),
        F.when(F.col("suggested") > 0, "Review Required").otherwise("None").alias("suggested_status"),
        F.when(F.col("matched") > t * 0.9, "Excellent").when(F.col("matched") > t * 0.7, "Good").otherwise("Poor").alias("rate_status"),
        F.when(F.col("exact") > t * 0.7, "High").when(F.col("exact") > t * 0.3, "Medium").otherwise("Low").alias("exact_status"),
        F.when(F.col("matched") > t * 0.8, "Excellent").when(F.col("matched") > t * 0.5, "Good").otherwise("Needs Review")
        .alias("match_status"),
        F.when(F.col("unmatched") > t * 0.2, "Action Required").when(F.col("unmatched") > 0, "Some Issues").otherwise("Perfect")
        .alias("unmatched_status"),
        F.when(F.col("quality_score") > 80, "High").when(F.col("quality_score") > 60, "Medium").otherwise("Low")
        .alias("quality_status"))


def quality_table(result: DataFrame, key: str) -> DataFrame:
    """M3: rates against targets; completeness is computed (share of rows with a key), not the fixed 95%."""
    x = _counts(result, F.try_divide(F.count(col(key)) * 100.0, F.count(F.lit(1))).alias("completeness"))
    t = F.col("total")
    rows = [
        ("Overall Match Rate", F.try_divide(F.col("matched") * 100.0, t), "> 85%", F.try_divide(F.col("matched") * 100.0, t) > 85),
        ("Exact Match Rate", F.when(F.col("matched") > 0, F.col("exact") * 100.0 / F.col("matched")), "> 70%",
         F.try_divide(F.col("exact") * 100.0, F.col("matched")) > 70),
        ("Fuzzy Match Rate", F.when(F.col("matched") > 0, F.col("fuzzy") * 100.0 / F.col("matched")), "< 30%",
         F.try_divide(F.col("fuzzy") * 100.0, F.col("matched")) < 30),
        ("Review Required Rate", F.try_divide(F.col("suggested") * 100.0, t), "< 15%", F.try_divide(F.col("suggested") * 100.0, t) < 15),
        ("Data Completeness", F.col("completeness"), "> 90%", F.col("completeness") > 90),
        ("Confidence Score Average", F.col("avg_similarity"), "> 80%", F.col("avg_similarity") > 80),
    ]
    st = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("metric"), v.cast("double").alias("value"),
                                      F.lit(tg).alias("target"), F.coalesce(ok, F.lit(False)).alias("meets_target"))
                             for i, (n, v, tg, ok) in enumerate(rows)]))
    return x.select(st.alias("r")).select("r.*")


#: Fixed output texts: the action of each recommendation, in rule order.
ACTIONS = [
    "Review key columns for inconsistent formatting, typos, or missing data",
    "Review suggested matches starting with highest confidence scores",
    "Investigate if data exists in different format or location",
    "Establish data quality standards and validation processes",
    "Schedule periodic comparisons to track data quality over time",
]


def recommendations(result: DataFrame) -> DataFrame:
    """M4: rule rows with their action: match rate < 0.7, suggested > 20%, unmatched > 30%, plus the two standing process
    items."""
    k = _counts(result)
    t = F.col("total")
    items = [
        Rule(F.try_divide(F.col("matched"), t) < 0.7, "High", "Data Quality", "Low match rate detected. Consider data cleansing before comparison."),
        Rule(F.col("suggested") > t * 0.2, "Medium", "Manual Review", "High number of suggested matches require manual verification."),
        Rule(F.col("unmatched") > t * 0.3, "High", "Coverage", "Significant unmatched records indicate potential data gaps."),
        Rule(F.lit(True), "Low", "Process Improvement", "Consider implementing automated data validation rules."),
        Rule(F.lit(True), "Medium", "Monitoring", "Set up regular comparison monitoring for data drift detection."),
    ]
    return rules(k, items).withColumn("action", F.element_at(F.array(*[F.lit(x) for x in ACTIONS]), F.col("rule_no")))


def batch_summary(batch: DataFrame, targets: list[str], target_col: str = "_target") -> DataFrame:
    """M5 of match_batch_readers: per target a status (match rate >= 80 High, >= 50 Medium, else Low; null where it failed), the
    first best and the first worst target in the order of `targets` (rates at one decimal; only if two succeeded), and the
    success rate: succeeded in % of all targets."""
    b = batch.withColumn("_pos", F.array_position(F.array(*[F.lit(t) for t in targets]), col(target_col)))
    rate, ok = F.round("match_rate", 1), F.col("outcome") == "success"
    n = b.agg(F.count_if(ok).alias("_ok"), F.count(F.lit(1)).alias("_all"))
    m = attach(b.filter(ok).agg(F.min_by("_pos", F.struct(-rate, F.col("_pos"))).alias("_best"),
                                F.min_by("_pos", F.struct(rate, F.col("_pos"))).alias("_worst")), n)
    two = ok & (F.col("_ok") > 1)
    return (attach(b, m)
            .withColumn("status", F.when(F.col("match_rate") >= 80, "High").when(F.col("match_rate") >= 50, "Medium").when(ok, "Low"))
            .withColumn("is_best", two & (F.col("_pos") == F.col("_best"))).withColumn("is_worst", two & (F.col("_pos") == F.col("_worst")))
            .withColumn("success_rate", F.col("_ok") * 100.0 / F.col("_all")).drop("_best", "_worst", "_ok", "_all", "_pos"))


def field_performance(multi_result: DataFrame) -> DataFrame:
    """M6: per field mapping avg / min / max / count of field scores; best / worst field; band 80 / 60; whether the worst needs
    attention (average below 70)."""
    e = multi_result.select(F.explode("field_breakdown").alias("f")).select("f.field", "f.score")
    g = e.groupBy("field").agg(F.avg("score").alias("avg_score"), F.min("score").alias("min_score"),
                               F.max("score").alias("max_score"), F.count(F.lit(1)).alias("count"))
    m = g.agg(F.max("avg_score").alias("_b"), F.min("avg_score").alias("_w"))
    return (attach(g, m).withColumn("is_best", F.col("avg_score") == F.col("_b"))
            .withColumn("is_worst", F.col("avg_score") == F.col("_w"))
            .withColumn("band", F.when(F.col("avg_score") >= 80, "Excellent").when(F.col("avg_score") >= 60, "Good")
                        .otherwise("Needs Review"))
            .withColumn("needs_attention", F.col("is_worst") & (F.col("avg_score") < 70)).drop("_b", "_w"))


def type_distribution(result: DataFrame) -> DataFrame:
    """M7: rows per match type and their share."""
    g = result.groupBy("match_type").agg(F.count(F.lit(1)).alias("count"))
    # the window is over a row per match type
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return g.withColumn("percentage", F.try_divide(F.col("count") * 100.0, total))


def suggested_scores(result: DataFrame) -> DataFrame:
    """M8: average / min / max score of the suggested rows."""
    s = result.filter(F.col("category") == "suggested")
    return s.agg(F.count(F.lit(1)).alias("suggested"), F.avg("similarity_score").alias("avg_score"),
                 F.min("similarity_score").alias("min_score"), F.max("similarity_score").alias("max_score"))


def key_readiness(a: DataFrame, key_a: str, b: DataFrame, key_b: str, ignore_case: bool = True) -> DataFrame:
    """M9: unique keys on each side, keys present on both (potential exact matches), null %, and readiness = 100 - null % of both sides pooled, at least 0."""
    ka = a.select(norm_key(key_a, ignore_case).alias("k"))
    kb = b.select(norm_key(key_b, ignore_case).alias("k"))
    def side(k, tag):
        rows, empty = F.count(F.lit(1)), F.count(F.lit(1)) - F.count("k")
        return k.agg(F.count_distinct("k").alias(f"unique_{tag}"), F.try_divide(empty * 100.0, rows).alias(f"null_pct_{tag}"),
                     empty.alias(f"_z_{tag}"), rows.alias(f"_n_{tag}"))
    pa, pb = side(ka, "a"), side(kb, "b")
    both = (ka.filter(F.col("k").isNotNull()).distinct().join(kb.filter(F.col("k").isNotNull()).distinct(), "k")
            .agg(F.count(F.lit(1)).alias("potential_matches")))
    x = attach(attach(pa, pb), both)
    pooled = F.try_divide((F.col("_z_a") + F.col("_z_b")) * 100.0, F.col("_n_a") + F.col("_n_b"))
    return x.withColumn("readiness_score", F.greatest(F.lit(0.0), 100 - F.coalesce(pooled, F.lit(0.0)))).drop("_z_a", "_z_b", "_n_a", "_n_b")
