"""Queries for data quality (Q1-Q16) and text patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import textpatterns as X
from ..sources.fixtures import fixture
from ..sources.tables import load
from .common import round_doubles, sig
from .q_profile import NULL_COLS, W
from .registry import register

STR_COLS = ["num_text", "date_text", "flag_text", "email"]


def S(x, alias=None):
    return f"{sig(x)} AS {alias or x}"


def nulls(spark, sf):
    return fixture(spark, sf, "fx_nulls").select(*NULL_COLS)


_MISS_UNPIVOT = (f"SELECT n, position, \"column\", missing_count FROM (SELECT count(*) AS n, "
                 + ", ".join(f"CAST(count(*) - count({c}) AS BIGINT) AS {c}" for c in NULL_COLS)
                 + f" FROM fx_nulls) UNPIVOT (missing_count FOR \"column\" IN ({', '.join(NULL_COLS)})) "
                 + "JOIN (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(NULL_COLS))
                 + ") AS pos(cname, position) ON pos.cname = \"column\"")


@register("Q1_missing_columns", W(f"""
SELECT "column", missing_count, {S('round(missing_count * 100.0 / n, 2)', 'missing_percentage')},
  CASE WHEN rk <= 5 THEN CAST(rk AS INTEGER) END AS worst_rank, missing_count = 0 AS fully_present,
  missing_count * 100.0 / n > 90 AS mostly_empty
FROM (SELECT *, row_number() OVER (ORDER BY round(missing_count * 100.0 / n, 2) DESC, position) AS rk FROM u)""",
    "fx_nulls", ctes=(("u", _MISS_UNPIVOT),)))
def q_q1c(spark, sf):
    return round_doubles(Q.missing_columns(nulls(spark, sf)))


_RN = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in NULL_COLS)


@register("Q1_missing_overview", W(f"""
SELECT count(*) AS total_rows, {len(NULL_COLS)} AS total_columns,
  CAST(sum(CASE WHEN rn > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows_with_missing_data,
  CAST(sum(CASE WHEN rn = {len(NULL_COLS)} THEN 1 ELSE 0 END) AS BIGINT) AS completely_empty_rows,
  {S(f'round((count(*) * {len(NULL_COLS)} - sum(rn)) * 100.0 / (count(*) * {len(NULL_COLS)}), 2)', 'overall_completeness')},
  CAST(sum(rn) AS BIGINT) AS total_missing_cells,
  CAST({' + '.join(f'max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)' for c in NULL_COLS)} AS BIGINT) AS columns_with_missing_data
FROM (SELECT *, {_RN} AS rn FROM fx_nulls)""", "fx_nulls"))
def q_q1o(spark, sf):
    return round_doubles(Q.missing_overview(nulls(spark, sf)))


@register("Q3_null_runs_by_group", W(f"""
SELECT grp, max(len) AS max_consecutive_missing, count(*) AS total_runs, {S('avg(len)', 'avg_run_length')},
  'num' AS "column"
FROM (SELECT grp, run, count(*) AS len FROM (
  SELECT grp, pos - row_number() OVER (ORDER BY pos) AS run FROM (
    SELECT grp, num, row_number() OVER (ORDER BY grp, src_order) AS pos FROM fx_nulls) WHERE num IS NULL)
  GROUP BY grp, run) GROUP BY grp""", "fx_nulls"))
def q_q3g(spark, sf):
    df = fixture(spark, sf, "fx_nulls")
    return round_doubles(Q.null_runs(df, ["num"], ["src_order"], partition_by="grp"))


@register("Q3_null_runs_whole_column", W(f"""
SELECT max(len) AS max_consecutive_missing, count(*) AS total_runs, {S('avg(len)', 'avg_run_length')},
  'num' AS "column"
FROM (SELECT run, count(*) AS len FROM (
  SELECT pos - row_number() OVER (ORDER BY pos) AS run FROM (
    SELECT num, row_number() OVER (ORDER BY src_order) AS pos FROM fx_nulls) WHERE num IS NULL) GROUP BY run)""",
    "fx_nulls"))
def q_q3(spark, sf):
    df = fixture(spark, sf, "fx_nulls")
    return round_doubles(Q.null_runs(df, ["num"], ["src_order"]))


@register("Q4_duplicates_by_nation_and_segment", f"""
SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
  {S('round(sum(c - 1) * 100.0 / sum(c), 2)', 'duplicate_percentage')}, count(*) AS unique_rows
FROM (SELECT c_nationkey, c_mktsegment, count(*) AS c FROM customer GROUP BY ALL)""")
def q_q4(spark, sf):
    return round_doubles(Q.duplicates(load(spark, sf, "customer").select("c_nationkey", "c_mktsegment")))


@register("Q4_duplicate_groups_by_nation_and_segment_top10", """
SELECT c_nationkey, c_mktsegment, count(*) AS copies FROM customer GROUP BY ALL HAVING count(*) > 1
ORDER BY copies DESC, c_nationkey NULLS FIRST, c_mktsegment NULLS FIRST LIMIT 10""")
def q_q4g(spark, sf):
    return Q.duplicate_groups(load(spark, sf, "customer").select("c_nationkey", "c_mktsegment"), 10)


@register("Q4_duplicates_customer", f"""
SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
  {S('round(sum(c - 1) * 100.0 / sum(c), 2)', 'duplicate_percentage')}, count(*) AS unique_rows
FROM (SELECT *, count(*) AS c FROM customer GROUP BY ALL)""")
def q_q4_all(spark, sf):
    return round_doubles(Q.duplicates(load(spark, sf, "customer")))


@register("Q4_duplicate_groups_top10", """
SELECT *, count(*) AS copies FROM customer GROUP BY ALL HAVING count(*) > 1
ORDER BY copies DESC, c_custkey NULLS FIRST LIMIT 10""")
def q_q4g_all(spark, sf):
    return Q.duplicate_groups(load(spark, sf, "customer"), 10)


@register("Q5_text_column_duplicates", W(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count(DISTINCT {c}) - max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) "
    f"AS BIGINT) AS duplicate_count, count(DISTINCT {c}) AS unique_values, "
    f"{S(f'round((count(*) - count(DISTINCT {c}) - max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) * 100.0 / count(*), 2)', 'duplicate_percentage')} "
    f"FROM fx_nulls" for c in STR_COLS), "fx_nulls"))
def q_q5(spark, sf):
    return round_doubles(Q.column_duplicates(nulls(spark, sf), STR_COLS))


@register("Q6_key_candidates", W(f"""
SELECT CAST(rk AS INTEGER) AS candidate_rank, "column", duplicate_count, unique_values, {S('duplicate_percentage')} FROM (
  SELECT *, row_number() OVER (ORDER BY position) AS rk FROM d WHERE unique_values * 1.0 / n > 0.7) WHERE rk <= 3""",
    "fx_nulls", ctes=(("d", " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS n, "
        f"CAST(count(*) - count(DISTINCT {c}) - max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_count, "
        f"count(DISTINCT {c}) AS unique_values, round((count(*) - count(DISTINCT {c}) - "
        f"max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) * 100.0 / count(*), 2) AS duplicate_percentage FROM fx_nulls"
        for i, c in enumerate(NULL_COLS))),)))
def q_q6(spark, sf):
    return round_doubles(Q.key_candidates(nulls(spark, sf)).select(
        "candidate_rank", "column", "duplicate_count", "unique_values", "duplicate_percentage"))


_DATE_SQL = "coalesce(" + ", ".join(f"try_strptime(v, '{f}')" for _, f in Q.DATE_FORMATS) + ")"
_BOOL = ", ".join(f"'{w}'" for w in Q.BOOLEAN_WORDS)
_CONV = " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS n,
  sum(CASE WHEN TRY_CAST(regexp_replace(v, '[,$%\\s]', '', 'g') AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) AS num,
  max(CASE WHEN strpos(v, '.') > 0 THEN 1 ELSE 0 END) AS dot,
  sum(CASE WHEN {_DATE_SQL} IS NOT NULL THEN 1 ELSE 0 END) AS dt,
  count(DISTINCT lower(trim(v))) AS bd, min(CASE WHEN lower(trim(v)) IN ({_BOOL}) THEN 1 ELSE 0 END) AS ba
FROM (SELECT CAST({c} AS VARCHAR) AS v FROM fx_nulls WHERE {c} IS NOT NULL)""" for c in STR_COLS)


@register("Q7_Q9_text_conversions", W(f"""
SELECT "column", {S('num * 1.0 / n', 'numeric_rate')}, num * 1.0 / n > 0.8 AS numeric_convertible,
  CASE WHEN num * 1.0 / n > 0.8 THEN CASE WHEN dot = 1 THEN 'float64' ELSE 'int64' END END AS numeric_type,
  {S('dt * 1.0 / n', 'date_rate')}, dt * 1.0 / n > 0.7 AS date_convertible, ba = 1 AND bd <= 4 AS boolean_convertible
FROM conv""", "fx_nulls", ctes=(("conv", _CONV),)))
def q_q7(spark, sf):
    return round_doubles(Q.conversions(nulls(spark, sf), STR_COLS))


_NUMC = ["grp", "seq", "src_order", "num"]
_TYPES = {"grp": "bigint", "seq": "bigint", "src_order": "bigint", "num": "double"}
_OUTL = " UNION ALL ".join(f"""
SELECT '{c}' AS "column", '{_TYPES[c]}' AS current_type, sum(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)
  THEN 1 ELSE 0 END) AS oc FROM (SELECT CAST({c} AS DOUBLE) AS v FROM fx_nulls WHERE {c} IS NOT NULL),
  (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM fx_nulls)
  GROUP BY q1, q3""" for c in _NUMC)
_VALID = f"""
SELECT "column", 'string' AS current_type,
  CASE WHEN ba = 1 AND bd <= 4 THEN 'bool' WHEN dt * 1.0 / n > 0.7 THEN 'datetime64[ns]'
    WHEN num * 1.0 / n > 0.8 THEN CASE WHEN dot = 1 THEN 'float64' ELSE 'int64' END END AS recommended_type,
  list_filter([CASE WHEN num * 1.0 / n > 0.8 THEN 'Numeric data stored as text - can convert to ' ||
      CASE WHEN dot = 1 THEN 'float64' ELSE 'int64' END END,
    CASE WHEN dt * 1.0 / n > 0.7 THEN 'Date data stored as text - can convert to datetime' END,
    CASE WHEN ba = 1 AND bd <= 4 THEN 'Boolean data stored as text - can convert to bool' END], lambda x: x IS NOT NULL) AS issues
FROM conv
UNION ALL
SELECT "column", current_type, CAST(NULL AS VARCHAR),
  list_filter([CASE WHEN oc > 0 THEN 'Contains ' || CAST(oc AS VARCHAR) || ' potential outliers' END], lambda x: x IS NOT NULL)
FROM outl"""


@register("Q10_type_validation", W("SELECT *, recommended_type IS NOT NULL AS conversion_possible FROM valid", "fx_nulls",
                                   ctes=(("conv", _CONV), ("outl", _OUTL), ("valid", _VALID))))
def q_q10(spark, sf):
    return Q.type_validation(nulls(spark, sf))


_TSUM = ("SELECT count(*) AS total_columns_analyzed, CAST(sum(CASE WHEN len(issues) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS "
         "columns_with_issues, CAST(sum(len(issues)) AS BIGINT) AS total_issues_found, CAST(sum(CASE WHEN recommended_type "
         "IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS convertible_columns, CAST(greatest(0, 100 - sum(len(issues)) * 10) "
         "AS BIGINT) AS data_quality_score FROM valid")


@register("Q10_type_summary", W(_TSUM, "fx_nulls", ctes=(("conv", _CONV), ("outl", _OUTL), ("valid", _VALID))))
def q_q10s(spark, sf):
    return Q.type_summary(Q.type_validation(nulls(spark, sf)))


_REPORT_CTES = (("conv", _CONV), ("outl", _OUTL), ("valid", _VALID), ("ts", _TSUM),
                ("mo", f"SELECT round((count(*) * 8 - sum(rn)) * 100.0 / (count(*) * 8), 2) AS oc "
                       f"FROM (SELECT {_RN} AS rn FROM fx_nulls)"),
                ("du", "SELECT round(sum(c - 1) * 100.0 / sum(c), 2) AS dp FROM (SELECT count(*) AS c FROM fx_nulls "
                       f"GROUP BY {', '.join(NULL_COLS)})"),
                ("rep", "SELECT greatest(0.0, oc) AS ms, greatest(0.0, 100 - dp) AS ds, CAST(data_quality_score AS DOUBLE) "
                        "AS tsc, oc, dp, convertible_columns FROM mo, du, ts"))


@register("Q11_quality_report", W(f"""
SELECT {S('round(ms, 1)', 'missing_data_score')}, {S('round(ds, 1)', 'duplicate_score')},
  {S('round(tsc, 1)', 'data_type_score')}, {S('round((ms + ds + tsc) / 3, 1)', 'overall_quality_score')},
  {S('oc', 'overall_completeness')}, {S('dp', 'duplicate_percentage')}, convertible_columns FROM rep""",
    "fx_nulls", ctes=_REPORT_CTES))
def q_q11(spark, sf):
    return round_doubles(Q.quality_report(nulls(spark, sf)))


@register("Q12_quality_recommendations", W("""
SELECT * FROM (
  SELECT 1 AS rule_no, 'High' AS priority, 'completeness' AS category,
    printf('Data completeness is only %s%%; investigate missing data sources.', CAST(oc AS VARCHAR)) AS message FROM rep WHERE oc < 90
  UNION ALL SELECT 2, 'High', 'missing', printf('Column ''%s'' is %s%% missing; remove or impute it.', "column", CAST(p AS VARCHAR))
    FROM (SELECT "column", round(missing_count * 100.0 / n, 2) AS p FROM miss WHERE missing_count > 0 ORDER BY p DESC, position LIMIT 1)
  UNION ALL SELECT 3, 'Medium', 'duplicates', printf('%s%% exact duplicates found; deduplicate.', CAST(dp AS VARCHAR)) FROM rep WHERE dp > 5
  UNION ALL SELECT 4, 'Medium', 'types', printf('%d columns can be converted to better types.', convertible_columns) FROM rep WHERE convertible_columns > 0
  UNION ALL SELECT 5, 'Low', 'columns', printf('%d columns are mostly empty (>90%% missing); consider removing them.', k)
    FROM (SELECT count(*) AS k FROM miss WHERE missing_count * 100.0 / n > 90) WHERE k > 0)""", "fx_nulls",
    ctes=_REPORT_CTES + (("miss", _MISS_UNPIVOT),)))
def q_q12(spark, sf):
    return Q.quality_recommendations(nulls(spark, sf))


@register("Q13_completeness_grades", W(f"""
SELECT "column", {S('100 - round(missing_count * 100.0 / n, 2)', 'completeness')},
  CASE WHEN 100 - round(missing_count * 100.0 / n, 2) >= 95 THEN 'A' WHEN 100 - round(missing_count * 100.0 / n, 2) >= 85
    THEN 'B' WHEN 100 - round(missing_count * 100.0 / n, 2) >= 70 THEN 'C' ELSE 'D' END AS grade,
  CAST(row_number() OVER (ORDER BY 100 - round(missing_count * 100.0 / n, 2) DESC, "column") AS INTEGER) AS rank
FROM u""", "fx_nulls", ctes=(("u", _MISS_UNPIVOT),)))
def q_q13(spark, sf):
    return round_doubles(Q.completeness_grade(Q.missing_columns(nulls(spark, sf))))


_RISK_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("Q16_risk_profile_lineitem", f"""
WITH m AS (SELECT ({' + '.join(f'stddev_samp({c})' for c in _RISK_COLS)}) / 8 AS vol, ({' + '.join(f'var_samp({c})' for c in _RISK_COLS)}) / 8 AS v,
  ({' + '.join(f'avg({c})' for c in _RISK_COLS)}) / 8 AS a FROM lineitem),
r AS (SELECT vol, 1 - v / (a + 1) AS st, least(100.0, greatest(0.0, vol * 0.3 + v / (a + 1) * 0.4)) AS score FROM m),
o AS ({' UNION ALL '.join(f"SELECT sum(CASE WHEN {c} + 0.0 < q1 - 1.5 * (q3 - q1) OR {c} + 0.0 > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) * 100.0 / count(*) AS p FROM lineitem, (SELECT quantile_cont({c} + 0.0, 0.25) AS q1, quantile_cont({c} + 0.0, 0.75) AS q3 FROM lineitem) GROUP BY q1, q3" for c in _RISK_COLS[:3])})
SELECT {S('vol', 'volatility')}, {S('st', 'trend_stability')}, {S('100.0', 'completeness')}, {S('score', 'risk_score')},
  CASE WHEN score < 30 THEN 'Low' WHEN score < 70 THEN 'Medium' ELSE 'High' END AS risk_level,
  (SELECT count(*) FROM o WHERE p > 10) AS columns_with_many_outliers, false AS missing_warning FROM r""")
def q_q16(spark, sf):
    return round_doubles(Q.risk_profile(load(spark, sf, "lineitem").select(*_RISK_COLS)))


@register("Q16_risk_profile_small", W(f"""
SELECT {S('vol', 'volatility')}, {S('st', 'trend_stability')}, {S('dq', 'completeness')}, {S('score', 'risk_score')},
  CASE WHEN score < 30 THEN 'Low' WHEN score < 70 THEN 'Medium' ELSE 'High' END AS risk_level, 0 AS columns_with_many_outliers,
  100 - dq > 10 AS missing_warning
FROM (SELECT *, least(100.0, greatest(0.0, vol * 0.3 + (1 - st) * 0.4 + (100 - dq) * 0.3)) AS score FROM (
  SELECT (stddev_samp(grp) + stddev_samp(k)) / 2 AS vol, 1 - (var_samp(grp) + var_samp(k)) / 2 / ((avg(grp) + avg(k)) / 2 + 1) AS st,
    (count(grp) + count(k) + count(num_text)) * 100.0 / (count(*) * 3) AS dq FROM (SELECT grp, seq % 7 AS k, num_text FROM fx_nulls)))""", "fx_nulls"))
def q_q16s(spark, sf):
    df = nulls(spark, sf).selectExpr("grp", "seq % 7 AS k", "num_text")
    return round_doubles(Q.risk_profile(df).withColumn("columns_with_many_outliers", F.col("columns_with_many_outliers").cast("int")))


@register("Q10_every_column", W("""
SELECT 'flag' AS "column", 'boolean' AS current_type, NULL::VARCHAR AS recommended_type, []::VARCHAR[] AS issues, false AS conversion_possible
UNION ALL SELECT 'nothing', 'double', NULL, ['Column is completely empty'], false
UNION ALL SELECT 'no_text', 'string', NULL, ['Column is completely empty'], false
UNION ALL SELECT 'no_date', 'date', NULL, ['Column is completely empty'], false
UNION ALL SELECT 'seq', 'bigint', NULL, CASE WHEN n > 0 THEN ['Contains ' || n || ' potential outliers'] ELSE [] END, false
FROM (SELECT count(*) FILTER (seq < q1 - 1.5 * (q3 - q1) OR seq > q3 + 1.5 * (q3 - q1)) AS n
  FROM fx_nulls, (SELECT quantile_cont(seq, 0.25) AS q1, quantile_cont(seq, 0.75) AS q3 FROM fx_nulls))""", "fx_nulls"))
def q_q10e(spark, sf):
    df = nulls(spark, sf).selectExpr("flag_text = 'yes' AS flag", "cast(null AS double) AS nothing", "cast(null AS string) AS no_text",
                                     "cast(null AS date) AS no_date", "cast(seq AS bigint) AS seq")
    return Q.type_validation(df)


_X1_COLS = ["num_text", "date_text", "flag_text", "email"]


def _x1_sql():
    names = ", ".join(f"'{w}'" for w in X.NAME_WORDS)
    addrs = ", ".join(f"'{w}'" for w in X.ADDRESS_WORDS)
    parts = []
    for c in _X1_COLS:
        v = f"CAST({c} AS VARCHAR)"
        low = f"lower(trim({v}))"
        flags = {
            "email_pattern": f"regexp_matches({v}, '{X.EMAIL_RE}')",
            "phone_pattern": f"regexp_matches({v}, '{X.PHONE_RE}')",
            "date_pattern": f"regexp_matches({v}, '{X.DATE_RE}')",
            "number_pattern": f"regexp_matches({v}, '{X.NUMBER_RE}')",
            "id_pattern": f"(regexp_matches({v}, '{X.ID_RE}') AND regexp_matches({v}, '[A-Za-z]') AND "
                          f"regexp_matches({v}, '[0-9]'))",
            "name_pattern": f"(list_bool_or(list_transform([{names}], lambda w: strpos({low}, w) > 0)) OR "
                            f"regexp_matches({v}, '\\S+\\s+\\S+'))",
            "address_pattern": f"list_bool_or(list_transform([{addrs}], lambda w: strpos({low}, w) > 0))",
        }
        parts.append(f"SELECT '{c}' AS \"column\", " + ", ".join(
            f"{S(f'avg(CASE WHEN {f} THEN 1.0 ELSE 0.0 END) * 100', k)}" for k, f in flags.items())
            + f" FROM fx_nulls WHERE {c} IS NOT NULL")
    return W(" UNION ALL ".join(parts), "fx_nulls")


@register("X1_pattern_shares", _x1_sql())
def q_x1(spark, sf):
    return round_doubles(X.pattern_shares(nulls(spark, sf), _X1_COLS))


@register("X2_pattern_counts_email", W("SELECT pattern, count, " + S("round(count * 100.0 / n, 1)", "percentage")
                                       + " FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS pattern, CAST(sum(CASE WHEN regexp_matches(email, '{rx}') THEN 1 ELSE 0 END) AS BIGINT) AS count, "
    f"count(*) AS n FROM fx_nulls" for name, rx in X.X2_PATTERNS) + ") WHERE count > 0", "fx_nulls"))
def q_x2(spark, sf):
    return round_doubles(X.pattern_counts(nulls(spark, sf), "email"))


_OV = ("SELECT na AS n_a, nb AS n_b, ov AS overlap, na + nb - ov AS total_unique, "
       "CASE WHEN na + nb - ov > 0 THEN ov * 100.0 / (na + nb - ov) ELSE 0.0 END AS overlap_percentage FROM "
       "(SELECT count(*) AS na FROM va), (SELECT count(*) AS nb FROM vb), (SELECT count(*) AS ov FROM va JOIN vb USING (v))")
_OV_CTES = (("va", "SELECT DISTINCT lower(trim(item)) AS v FROM fx_match_a WHERE item IS NOT NULL"),
            ("vb", "SELECT DISTINCT lower(trim(item)) AS v FROM fx_match_b WHERE item IS NOT NULL"), ("ov", _OV))


@register("X3_key_compatibility", W(f"""
SELECT 'string' AS type_a, 'string' AS type_b, 'identical types' AS type_relation, overlap, total_unique,
  {S('overlap_percentage')}, CASE WHEN overlap_percentage >= 30 THEN 'high' WHEN overlap_percentage >= 10 THEN 'medium'
  ELSE 'low' END AS overlap_band FROM ov""", "fx_match_a", "fx_match_b", ctes=_OV_CTES))
def q_x3(spark, sf):
    a, b = fixture(spark, sf, "fx_match_a"), fixture(spark, sf, "fx_match_b")
    return round_doubles(X.compatibility(a, "item", b, "item"))


_X4 = [
    ("(na - nna) * 100.0 / na > 20 OR (nb - nnb) * 100.0 / nb > 20", "High", "Data Cleaning", "High missing data detected; clean data before matching."),
    ("ua = na AND ub = nb AND t < 90", "Medium", "Threshold", "Keys are unique on both sides; a threshold of 90%+ gives better precision."),
    ("NOT (ua = na AND ub = nb) AND (ua * 1.0 / na < 0.8 OR ub * 1.0 / nb < 0.8) AND t > 70", "Medium", "Threshold",
     "High duplicate rate; a threshold of 60-70% gives better recall."),
    ("abs(la - lb) > 10", "Low", "Strategy", "Large key length difference; consider multi-column matching."),
    ("t < 80", "Low", "Performance", "Thresholds of 80%+ usually work well for names and IDs."),
]


def _x4_sql(a: str, b: str, t: int) -> str:
    side = lambda c, x: f"SELECT count(*) AS n{x}, count({c}) AS nn{x}, count(DISTINCT {c}) AS u{x}, avg(length({c})) AS l{x} FROM k"
    return " UNION ALL ".join(f"SELECT {n} AS rule_no, '{p}' AS priority, '{g}' AS category, '{m}' AS message FROM s{t} WHERE {cond}"
                              for n, (cond, p, g, m) in enumerate(_X4, 1)), (f"s{t}", f"SELECT *, {t} AS t FROM ({side(a, 'a')}), ({side(b, 'b')})")


_X4_KEYS = ("SELECT CASE WHEN src_order % 3 > 0 THEN CAST(grp AS VARCHAR) END AS few, CAST(src_order AS VARCHAR) AS id, "
            "CAST(src_order AS VARCHAR) || ' of a long key' AS long_id FROM fx_nulls")
_X4_CASES = [("few", "long_id", 75), ("id", "id", 70), ("id", "long_id", 85)]


@register("X4_matching_advice", W(" UNION ALL ".join(f"SELECT '{a} {b} {t}' AS keys, * FROM ({_x4_sql(a, b, t)[0]})" for a, b, t in _X4_CASES),
                                  "fx_nulls", ctes=(("k", _X4_KEYS), *[_x4_sql(*c)[1] for c in _X4_CASES])))
def q_x4(spark, sf):
    """X4 for three pairs of keys and thresholds that between them fire every rule."""
    k = nulls(spark, sf).selectExpr("CASE WHEN src_order % 3 > 0 THEN CAST(grp AS STRING) END AS few", "CAST(src_order AS STRING) AS id",
                                    "concat(CAST(src_order AS STRING), ' of a long key') AS long_id")
    parts = [X.matching_advice(k, a, k, b, t).select(F.lit(f"{a} {b} {t}").alias("keys"), "*") for a, b, t in _X4_CASES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
