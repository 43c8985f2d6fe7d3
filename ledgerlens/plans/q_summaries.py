"""Queries for match summaries (M1-M9), result filters (P1-P14) over the J4 / J6 / J7 results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import clean_values, norm_key
from ..operators import filters as P
from ..operators import summaries as M
from ..operators.match import match_batch_readers, match_multi
from ..sources.fixtures import fixture
from .common import round_doubles, sig, sql_norm
from .q_match import J6_SQL, J7_SQL, match_items, match_result_ctes
from .q_profile import W
from .registry import register
from .sqlparts import build


def S(x, alias=None):
    return f"{sig(x)} AS {alias or x}"


_K = """(SELECT count(*) AS total, sum(CASE WHEN category = 'matched' THEN 1 ELSE 0 END) AS matched,
  sum(CASE WHEN category = 'suggested' THEN 1 ELSE 0 END) AS suggested,
  sum(CASE WHEN category = 'unmatched' THEN 1 ELSE 0 END) AS unmatched,
  sum(CASE WHEN category = 'matched' AND match_type IN ('Exact', 'Multi-Field Exact') THEN 1 ELSE 0 END) AS exact,
  sum(CASE WHEN category = 'matched' AND match_type NOT IN ('Exact', 'Multi-Field Exact') THEN 1 ELSE 0 END) AS fuzzy,
  avg(CASE WHEN category <> 'unmatched' THEN similarity_score END) AS avg_similarity FROM mres)"""
_Q = ("least(100.0, greatest(0.0, matched * 1.0 / total * 70 + exact * 1.0 / total * 20 - unmatched * 1.0 / total * 10 "
      "+ coalesce(avg_similarity, 0.0) / 100 * 10))")


def M_SQL(body):
    return build(body, match_result_ctes())


@register("M1_executive_summary", M_SQL(f"""
SELECT total AS total_records, CAST(exact AS BIGINT) AS exact_matches, CAST(fuzzy AS BIGINT) AS fuzzy_matches,
  CAST(matched AS BIGINT) AS high_confidence_matches, CAST(suggested AS BIGINT) AS suggested_reviews,
  CAST(unmatched AS BIGINT) AS unmatched_records, {S('matched * 100.0 / total', 'match_rate')}, {S(_Q, 'quality_score')},
  CASE WHEN exact > total * 0.7 THEN 'High' WHEN exact > total * 0.3 THEN 'Medium' ELSE 'Low' END AS exact_status,
  CASE WHEN matched > total * 0.8 THEN 'Excellent' WHEN matched > total * 0.5 THEN 'Good' ELSE 'Needs Review' END AS match_status,
  CASE WHEN unmatched > total * 0.2 THEN 'Action Required' WHEN unmatched > 0 THEN 'Some Issues' ELSE 'Perfect' END AS unmatched_status,
  CASE WHEN total > 0 THEN 'Complete' ELSE 'No Data' END AS total_status, CASE WHEN fuzzy > 0 THEN 'Good' ELSE 'None' END AS fuzzy_status,
  CASE WHEN suggested > 0 THEN 'Review Required' ELSE 'None' END AS suggested_status,
  CASE WHEN matched > total * 0.9 THEN 'Excellent' WHEN matched > total * 0.7 THEN 'Good' ELSE 'Poor' END AS rate_status,
  CASE WHEN {_Q} > 80 THEN 'High' WHEN {_Q} > 60 THEN 'Medium' ELSE 'Low' END AS quality_status
FROM {_K}"""))
def q_m1(spark, sf):
    return round_doubles(M.executive_summary(match_items(spark, sf)))


@register("M2_quality_score", M_SQL(f"""
SELECT total, CAST(matched AS BIGINT) AS matched, CAST(suggested AS BIGINT) AS suggested, CAST(unmatched AS BIGINT) AS unmatched,
  CAST(exact AS BIGINT) AS exact, CAST(fuzzy AS BIGINT) AS fuzzy, {S('avg_similarity')}, {S(_Q, 'quality_score')} FROM {_K}"""))
def q_m2(spark, sf):
    q = M.quality_score(match_items(spark, sf))
    return round_doubles(q.select("total", *[F.col(c).cast("long") for c in ["matched", "suggested", "unmatched", "exact", "fuzzy"]],
                                  "avg_similarity", "quality_score"))


@register("M3_quality_table", M_SQL(f"""
SELECT CAST(position AS INTEGER) AS position, metric, {S('value')}, target, coalesce(ok, false) AS meets_target FROM (
  SELECT 0 AS position, 'Overall Match Rate' AS metric, matched * 100.0 / total AS value, '> 85%' AS target,
    matched * 100.0 / total > 85 AS ok FROM k UNION ALL
  SELECT 1, 'Exact Match Rate', CASE WHEN matched > 0 THEN exact * 100.0 / matched END, '> 70%', exact * 100.0 / matched > 70 FROM k
  UNION ALL SELECT 2, 'Fuzzy Match Rate', CASE WHEN matched > 0 THEN fuzzy * 100.0 / matched END, '< 30%',
    fuzzy * 100.0 / matched < 30 FROM k UNION ALL
  SELECT 3, 'Review Required Rate', suggested * 100.0 / total, '< 15%', suggested * 100.0 / total < 15 FROM k UNION ALL
  SELECT 4, 'Data Completeness', (SELECT count(item) * 100.0 / count(*) FROM mres), '> 90%',
    (SELECT count(item) * 100.0 / count(*) FROM mres) > 90 FROM k UNION ALL
  SELECT 5, 'Confidence Score Average', avg_similarity, '> 80%', avg_similarity > 80 FROM k)""".replace(
    "FROM k", f"FROM {_K} k")))
def q_m3(spark, sf):
    return round_doubles(M.quality_table(match_items(spark, sf), "item"))


_RULES_M4 = [
    ("matched * 1.0 / total < 0.7", "High", "Data Quality", "Low match rate detected. Consider data cleansing before comparison."),
    ("suggested > total * 0.2", "Medium", "Manual Review", "High number of suggested matches require manual verification."),
    ("unmatched > total * 0.3", "High", "Coverage", "Significant unmatched records indicate potential data gaps."),
    ("true", "Low", "Process Improvement", "Consider implementing automated data validation rules."),
    ("true", "Medium", "Monitoring", "Set up regular comparison monitoring for data drift detection."),
]


@register("M4_match_recommendations", M_SQL(" UNION ALL ".join(
    f"SELECT {n} AS rule_no, '{p}' AS priority, '{c}' AS category, '{m}' AS message, '{M.ACTIONS[n - 1]}' AS action FROM {_K} WHERE {cond}"
    for n, (cond, p, c, m) in enumerate(_RULES_M4, 1))))
def q_m4(spark, sf):
    return M.recommendations(match_items(spark, sf))


def batch(spark, sf):
    """Three sheets of fx_batch and one that isn't there."""
    t = fixture(spark, sf, "fx_batch")
    readers = {n: (lambda n=n: t.filter(F.col("target") == n)) for n in ("T0", "T1", "T2")}
    readers["T3"] = lambda: spark.read.parquet(f"{sf}/no such sheet.parquet")
    return match_batch_readers(fixture(spark, sf, "fx_match_a"), readers, "item", "item", threshold=80, target_order="id")


@register("M5_batch_summary", f"""
SELECT b.*, 'success' AS outcome, CASE WHEN match_rate >= 80 THEN 'High' WHEN match_rate >= 50 THEN 'Medium' ELSE 'Low' END AS status,
  _target = first_value(_target) OVER (ORDER BY round(match_rate, 1) DESC, _target) AS is_best,
  _target = first_value(_target) OVER (ORDER BY round(match_rate, 1), _target) AS is_worst, {S('75.0', 'success_rate')}
FROM (SELECT * REPLACE ({S('match_rate')}) FROM ({J7_SQL})) b
UNION ALL SELECT 'T3', NULL, NULL, NULL, NULL, NULL, NULL, 'error', NULL, false, false, {S('75.0', 'success_rate')}""")
def q_m5(spark, sf):
    return round_doubles(M.batch_summary(batch(spark, sf), ["T0", "T1", "T2", "T3"]).drop("error"))


@register("M6_field_performance", f"""
WITH e AS (SELECT unnest(['name → name', 'brand → brand']) AS field, unnest([s_name, s_brand]) AS score FROM ({J6_SQL}) WHERE s_name IS NOT NULL),
g AS (SELECT field, avg(score) AS av, min(score) AS mi, max(score) AS ma, count(*) AS n FROM e GROUP BY 1)
SELECT field, {S('av', 'avg_score')}, {S('mi', 'min_score')}, {S('ma', 'max_score')}, n AS count, av = (SELECT max(av) FROM g) AS is_best,
  av = (SELECT min(av) FROM g) AS is_worst, CASE WHEN av >= 80 THEN 'Excellent' WHEN av >= 60 THEN 'Good' ELSE 'Needs Review' END AS band,
  av = (SELECT min(av) FROM g) AND av < 70 AS needs_attention
FROM g""")
def q_m6(spark, sf):
    a, b = fixture(spark, sf, "fx_match_a"), fixture(spark, sf, "fx_match_b")
    r = match_multi(a, b, ["name", "brand"], ["name", "brand"], threshold=80, b_order="id")
    return round_doubles(M.field_performance(r))


@register("M7_match_type_distribution", M_SQL(f"""
SELECT match_type, count(*) AS count, {S('count(*) * 100.0 / (SELECT count(*) FROM mres)', 'percentage')} FROM mres GROUP BY 1"""))
def q_m7(spark, sf):
    return round_doubles(M.type_distribution(match_items(spark, sf)))


@register("M8_suggested_scores", M_SQL(f"""
SELECT count(*) AS suggested, {S('avg(similarity_score)', 'avg_score')}, {S('min(similarity_score)', 'min_score')},
  {S('max(similarity_score)', 'max_score')} FROM mres WHERE category = 'suggested'"""))
def q_m8(spark, sf):
    return round_doubles(M.suggested_scores(match_items(spark, sf)))


@register("M9_key_readiness", W(f"""
SELECT (SELECT count(DISTINCT k) FROM a) AS unique_a, {S('(SELECT (count(*) - count(k)) * 100.0 / count(*) FROM a)', 'null_pct_a')},
  (SELECT count(DISTINCT k) FROM b) AS unique_b, {S('(SELECT (count(*) - count(k)) * 100.0 / count(*) FROM b)', 'null_pct_b')},
  (SELECT count(*) FROM (SELECT DISTINCT k FROM a WHERE k IS NOT NULL) JOIN (SELECT DISTINCT k FROM b WHERE k IS NOT NULL)
    USING (k)) AS potential_matches,
  {S('greatest(0.0, 100 - (SELECT (count(*) - count(k)) * 100.0 / count(*) FROM (SELECT k FROM a UNION ALL SELECT k FROM b)))', 'readiness_score')}
""", "fx_match_a", "fx_match_b", ctes=(("a", f"SELECT {sql_norm('item')} AS k FROM fx_match_a"),
                                       ("b", f"SELECT {sql_norm('item')} AS k FROM fx_match_b"))))
def q_m9(spark, sf):
    a, b = fixture(spark, sf, "fx_match_a"), fixture(spark, sf, "fx_match_b")
    return round_doubles(M.key_readiness(a, "item", b, "item"))


@register("P1_P2_key_normalisation", W(f"""
SELECT id, {sql_norm('item')} AS norm_key,
  regexp_replace(regexp_replace(lower(CAST(item AS VARCHAR)), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS clean_value
FROM fx_match_b""", "fx_match_b"))
def q_p1(spark, sf):
    b = fixture(spark, sf, "fx_match_b")
    return b.select("id", norm_key("item").alias("norm_key"), clean_values("item").alias("clean_value"))


_FILTERED = ("SELECT * FROM mres WHERE (regexp_matches(item, '(?i)anvil') OR regexp_matches(coalesce(matched_key, ''), '(?i)anvil') "
             "OR regexp_matches(name, '(?i)anvil') OR regexp_matches(brand, '(?i)anvil') OR regexp_matches(match_type, '(?i)anvil') "
             "OR regexp_matches(category, '(?i)anvil')) AND similarity_score BETWEEN 60 AND 100 "
             "AND match_type IN ('Exact', 'Fuzzy') AND (similarity_score BETWEEN 80 AND 100 OR similarity_score BETWEEN 60 AND 79) "
             "AND regexp_matches(CAST(brand AS VARCHAR), '(?i)brand#1') AND length(CAST(item AS VARCHAR)) BETWEEN 10 AND 40")


def _filtered(spark, sf):
    r = match_items(spark, sf)
    f = P.text_search(r, "anvil")
    f = P.score_range(f, 60, 100)
    f = P.match_types(f, ["Exact", "Fuzzy"])
    f = P.confidence_bands(f, ["High", "Medium"])
    f = P.column_search(f, "brand", "brand#1")
    return r, P.length_range(f, "item", 10, 40)


@register("P4_P10_result_filters", build(f"""
SELECT id, item, match_type, {S('similarity_score')}, category,
  CASE WHEN similarity_score >= 95 THEN 'green' WHEN similarity_score >= 80 THEN 'yellow' ELSE 'red' END AS score_band
FROM ({_FILTERED})""", match_result_ctes()))
def q_p4(spark, sf):
    _, f = _filtered(spark, sf)
    return round_doubles(f.select("id", "item", "match_type", "similarity_score", "category",
                                  P.score_band("similarity_score").alias("score_band")))


@register("P9_complete_rows", build("""
SELECT count(*) AS complete_rows FROM mres WHERE id IS NOT NULL AND item IS NOT NULL AND name IS NOT NULL AND brand IS NOT NULL
  AND price IS NOT NULL AND SheetB_id IS NOT NULL AND size IS NOT NULL AND match_type IS NOT NULL
  AND similarity_score IS NOT NULL AND matched_key IS NOT NULL AND category IS NOT NULL""", match_result_ctes()))
def q_p9(spark, sf):
    return P.complete_rows(match_items(spark, sf)).agg(F.count(F.lit(1)).alias("complete_rows"))


@register("P11_filter_stats", build(f"""
SELECT (SELECT count(*) FROM mres) AS original_rows, (SELECT count(*) FROM ({_FILTERED})) AS filtered_rows,
  {S('(SELECT count(*) FROM (' + _FILTERED + ')) * 100.0 / (SELECT count(*) FROM mres)', 'percentage_shown')}""",
    match_result_ctes()))
def q_p11(spark, sf):
    r, f = _filtered(spark, sf)
    return round_doubles(P.filter_stats(r, f))


@register("P12_filter_by_source", W("""
SELECT key, name, '{s}' AS _source_sheet FROM fx_cons_supplier""".replace("{s}", "suppliers"), "fx_cons_supplier"))
def q_p12(spark, sf):
    from ..operators.consolidate import union_tables
    t = {"customers": fixture(spark, sf, "fx_cons_customer"), "suppliers": fixture(spark, sf, "fx_cons_supplier")}
    return P.by_source(union_tables(t, True, "fill"), ["suppliers"]).select("key", "name", "_source_sheet")


@register("P13_preview_top_scores", build(f"""
SELECT id, item, {S('similarity_score')} FROM mres ORDER BY similarity_score DESC, id LIMIT 10""", match_result_ctes()))
def q_p13(spark, sf):
    r = match_items(spark, sf)
    return round_doubles(P.preview(r, [F.desc("similarity_score"), F.asc("id")], 10).select("id", "item", "similarity_score"))
