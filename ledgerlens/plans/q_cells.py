"""Queries for formula analysis (F1-F10) and formatting diffs (G1-G6) over cell tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import formats as G
from ..sources.fixtures import fixture
from .common import round_doubles, sig
from .q_profile import W
from .registry import register


def S(x, alias=None):
    return f"{sig(x)} AS {alias or x}"


def parsed(spark, sf, name="fx_cells"):
    return C.parse_formulas(fixture(spark, sf, name))


_FUNCS = "list_filter(fl, lambda x, i: list_position(fl, x) = i)"
_DEPTH = ("coalesce(list_max(list_transform(generate_series(1, length(formula)), lambda i: "
          "length(regexp_replace(substring(formula, 1, i), '[^(]', '', 'g')) - "
          "length(regexp_replace(substring(formula, 1, i), '[^)]', '', 'g')))), 0)")
_OPS = " + ".join(f"(length(formula) - length(replace(formula, '{o}', '')))" for o in C.OPERATORS)
_ARR = " OR ".join(f"strpos(upper(formula), '{fn}') > 0" for fn in C.ARRAY_FUNCTIONS)


def parsed_sql(table: str) -> str:
    return f"""
SELECT book, sheet, cell, formula, funcs AS functions, coalesce(funcs[1], 'SIMPLE') AS main_function, refs, depth,
  CAST(floor(length(formula) / 10) + len(funcs) * 2 + depth * 3 + len(refs) + ops AS INTEGER) AS complexity,
  ({_ARR}) OR (strpos(formula, '{{') > 0 AND strpos(formula, '}}') > 0) AS is_array,
  list_transform(refs, lambda r: replace(CASE WHEN strpos(r, '!') > 0 THEN r ELSE sheet || '!' || r END, '$', '')) AS qrefs
FROM (SELECT *, {_FUNCS} AS funcs FROM (SELECT *, regexp_extract_all(upper(formula), '{C.FUNCTION_RE}', 1) AS fl,
  regexp_extract_all(formula, '{C.CELL_REF_RE}', 0) AS refs, {_DEPTH} AS depth, {_OPS} AS ops
  FROM {table} WHERE starts_with(formula, '=')))"""


WCELLS = ("fx_cells",)


@register("F1_F5_parsed_formulas", W("""
SELECT cell, functions, main_function, CAST(depth AS INTEGER) AS depth, len(refs) AS n_references, complexity,
  complexity > 10 AS is_complex, is_array FROM p""", *WCELLS, ctes=(("p", parsed_sql("fx_cells")),)))
def q_f1(spark, sf):
    p = parsed(spark, sf)
    return p.select("cell", "functions", "main_function", "depth", F.size("cell_references").alias("n_references"),
                    "complexity", "is_complex", "is_array")


@register("F1_F5_sheet_counts", W("""
SELECT book, sheet, main_function, count(*) AS formulas, CAST(sum(CASE WHEN complexity > 10 THEN 1 ELSE 0 END) AS BIGINT) AS complex,
  CAST(sum(CASE WHEN is_array THEN 1 ELSE 0 END) AS BIGINT) AS array_formulas FROM p GROUP BY 1, 2, 3""",
    *WCELLS, ctes=(("p", parsed_sql("fx_cells")),)))
def q_f1s(spark, sf):
    return C.sheet_counts(parsed(spark, sf))


_EDGES = "SELECT DISTINCT book, sheet || '!' || cell AS src, unnest(qrefs) AS dst FROM p"


@register("F6_validation_summary", W(f"""
SELECT count(*) AS total_formulas_validated, CAST(sum(CASE WHEN cyc THEN 1 ELSE 0 END) AS BIGINT) AS circular_references_count,
  CAST(sum(mr) AS BIGINT) AS missing_references_count, CAST(sum(nf) AS BIGINT) AS non_formula_references_count,
  CAST(0 AS BIGINT) AS external_dependencies_count,
  {S('round(greatest(0.0, 100 - (sum(CASE WHEN cyc THEN 1 ELSE 0 END) + sum(mr) + sum(nf)) / count(*) * 100), 1)', 'validation_score')}
FROM (SELECT p.book, p.sheet || '!' || p.cell AS src,
  coalesce((SELECT sum(CASE WHEN c.formula IS NULL THEN 1 ELSE 0 END) FROM e LEFT JOIN fx_cells c
    ON c.sheet || '!' || c.cell = e.dst WHERE e.src = p.sheet || '!' || p.cell), 0) AS mr,
  coalesce((SELECT sum(CASE WHEN c.formula IS NOT NULL AND NOT starts_with(c.formula, '=') THEN 1 ELSE 0 END) FROM e
    LEFT JOIN fx_cells c ON c.sheet || '!' || c.cell = e.dst WHERE e.src = p.sheet || '!' || p.cell), 0) AS nf,
  EXISTS (SELECT 1 FROM e e1 JOIN e e2 ON e2.src = e1.dst AND e2.dst = e1.src WHERE e1.src = p.sheet || '!' || p.cell) AS cyc
  FROM p)""", *WCELLS, ctes=(("p", parsed_sql("fx_cells")), ("e", _EDGES))))
def q_f6(spark, sf):
    c = fixture(spark, sf, "fx_cells")
    p = C.parse_formulas(c)
    return round_doubles(C.validation_summary(C.validation(c, p)))


@register("F7_direct_dependents", W("""
SELECT book, dst AS cell, count(*) AS direct_dependents, count(*) >= 5 AS highly_connected FROM e GROUP BY 1, 2""",
    *WCELLS, ctes=(("p", parsed_sql("fx_cells")), ("e", _EDGES))))
def q_f7d(spark, sf):
    return C.direct_dependents(parsed(spark, sf))


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_REACH = (("p", parsed_sql("fx_cells")), ("e", _EDGES), ("fc", "SELECT book, sheet || '!' || cell AS src FROM p"),
          ("reach", "SELECT book, src AS x, dst AS y FROM e UNION SELECT r.book, r.x, e.dst FROM reach r JOIN e ON e.book = r.book AND e.src = r.y"))


@register("F7_dependency_levels", _recursive(W("""
SELECT fc.book, fc.src AS cell, CAST(max(d) AS INTEGER) AS level, max(d) IS NULL AS on_or_behind_cycle
FROM fc LEFT JOIN lv ON lv.book = fc.book AND lv.cell = fc.src GROUP BY 1, 2""", *WCELLS, ctes=_REACH + (
    ("bad", "SELECT DISTINCT r.book, r.x FROM reach r JOIN (SELECT book, x FROM reach WHERE x = y) c ON c.book = r.book AND c.x = r.y"),
    ("ok", "SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.book = e.book AND bad.x = e.src)"),
    ("base", "SELECT DISTINCT book, dst AS cell, 0 AS d FROM e ANTI JOIN fc ON fc.book = e.book AND fc.src = e.dst "
             "UNION ALL SELECT book, src, 1 FROM fc ANTI JOIN e ON e.book = fc.book AND e.src = fc.src"),
    ("lv", "SELECT * FROM base UNION SELECT ok.book, ok.src, lv.d + 1 FROM lv JOIN ok ON ok.book = lv.book AND ok.dst = lv.cell")))))
def q_f7(spark, sf):
    c = fixture(spark, sf, "fx_cells")
    return C.dependency_levels(c, C.parse_formulas(c))


@register("F7_cascade_sizes", _recursive(W("""
SELECT d.book, d.cell, direct_dependents, coalesce(n, 0) AS cascade_size,
  CASE WHEN coalesce(n, 0) > 10 THEN 'high' WHEN coalesce(n, 0) > 5 THEN 'medium' ELSE 'low' END AS impact,
  direct_dependents >= 5 AS highly_connected
FROM (SELECT book, dst AS cell, count(*) AS direct_dependents FROM e GROUP BY 1, 2) d
LEFT JOIN (SELECT book, y AS cell, count(*) AS n FROM reach WHERE x <> y GROUP BY 1, 2) r ON r.book = d.book AND r.cell = d.cell""",
    *WCELLS, ctes=_REACH)))
def q_f7c(spark, sf):
    return C.dependents(parsed(spark, sf))


@register("F7_impact_summary", _recursive(W(f"""
SELECT count(*) FILTER (n > 10) AS total_high_impact_cells, {S('coalesce(avg(n), 0.0)', 'average_cascade_size')},
  coalesce(max(n), 0) AS max_cascade_size
FROM (SELECT d.cell, coalesce(n, 0) AS n FROM (SELECT book, dst AS cell FROM e GROUP BY 1, 2 HAVING count(*) >= 3) d
  LEFT JOIN (SELECT book, y AS cell, count(*) AS n FROM reach WHERE x <> y GROUP BY 1, 2) r ON r.book = d.book AND r.cell = d.cell)""",
    *WCELLS, ctes=_REACH)))
def q_f7i(spark, sf):
    """The table's cells have at most four dependents, so three count as many here."""
    deps = C.dependents(parsed(spark, sf))
    return round_doubles(C.impact_summary(deps.withColumn("highly_connected", F.col("direct_dependents") >= 3)))


@register("F9_dependency_metrics", _recursive(W(f"""
SELECT count(*) FILTER (len(refs) = 0) AS independent_cells,
  (SELECT count(*) FROM (SELECT dst FROM e JOIN fc ON fc.src = e.dst GROUP BY 1 HAVING count(*) >= 5)) AS highly_connected_cells,
  (SELECT max(d)::INTEGER FROM lv JOIN fc ON fc.src = lv.cell) AS max_dependency_level,
  {S('round(avg(len(refs)), 1)', 'average_precedents')},
  {S('(SELECT round(greatest(0.0, 100 - ((SELECT count(*) FROM two) + (SELECT count(*) FROM lost)) * 100.0 / (SELECT count(*) FROM p)), 1))', 'validation_score')},
  {S('round((SELECT count(*) FROM lost) * 100.0 / count(*), 1)', 'error_rate')}, {S('0.0', 'external_dependency_rate')},
  CASE WHEN (SELECT count(*) FROM two) > 0 THEN 'HIGH' ELSE 'LOW' END AS circular_reference_risk
FROM (SELECT qrefs AS refs FROM p)""", *WCELLS, ctes=_REACH + (
    ("lost", "SELECT * FROM e ANTI JOIN fc ON fc.src = e.dst"),
    ("two", "SELECT DISTINCT e.src FROM e JOIN e f ON f.src = e.dst AND f.dst = e.src"),
    ("bad", "SELECT DISTINCT r.book, r.x FROM reach r JOIN (SELECT book, x FROM reach WHERE x = y) c ON c.book = r.book AND c.x = r.y"),
    ("ok", "SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.book = e.book AND bad.x = e.src)"),
    ("base", "SELECT DISTINCT book, dst AS cell, 0 AS d FROM e ANTI JOIN fc ON fc.book = e.book AND fc.src = e.dst "
             "UNION ALL SELECT book, src, 1 FROM fc ANTI JOIN e ON e.book = fc.book AND e.src = fc.src"),
    ("lv", "SELECT * FROM base UNION SELECT ok.book, ok.src, lv.d + 1 FROM lv JOIN ok ON ok.book = lv.book AND ok.dst = lv.cell")))))
def q_f9d(spark, sf):
    c = fixture(spark, sf, "fx_cells")
    p = C.parse_formulas(c)
    return round_doubles(C.dependency_metrics(c, p, C.dependency_levels(c, p)))


@register("F8_formula_diff", W("""
SELECT coalesce(a.sheet, b.sheet) AS sheet, coalesce(a.cell, b.cell) AS cell, a.formula AS formula_a, b.formula AS formula_b,
  CASE WHEN b.formula IS NULL THEN 'only_in_a' WHEN a.formula IS NULL THEN 'only_in_b' WHEN a.formula = b.formula THEN 'unchanged'
    ELSE 'changed' END AS status,
  CASE WHEN a.formula IS NULL OR b.formula IS NULL OR a.formula = b.formula THEN NULL
    WHEN abs(length(a.formula) - length(b.formula)) > 20 THEN 'major change' WHEN length(a.formula) <> length(b.formula) THEN 'minor change'
    WHEN list_sort(a.functions) = list_sort(b.functions) THEN 'reference change' ELSE 'function change' END AS change_type
FROM pa a FULL JOIN pb b ON a.sheet = b.sheet AND a.cell = b.cell""", "fx_cells", "fx_cells_b",
    ctes=(("pa", parsed_sql("fx_cells")), ("pb", parsed_sql("fx_cells_b")))))
def q_f8(spark, sf):
    return C.formula_diff(parsed(spark, sf), parsed(spark, sf, "fx_cells_b"))


@register("F8_function_overlap", W(f"""
SELECT na AS functions_a, nb AS functions_b, nc AS common_functions,
  {S('CASE WHEN na + nb - nc > 0 THEN nc * 100.0 / (na + nb - nc) ELSE 0.0 END', 'function_overlap')}
FROM (SELECT count(*) AS na FROM fa), (SELECT count(*) AS nb FROM fb), (SELECT count(*) AS nc FROM fa JOIN fb USING (f))""",
    "fx_cells", "fx_cells_b", ctes=(("pa", parsed_sql("fx_cells")), ("pb", parsed_sql("fx_cells_b")),
                                    ("fa", "SELECT DISTINCT unnest(functions) AS f FROM pa"),
                                    ("fb", "SELECT DISTINCT unnest(functions) AS f FROM pb"))))
def q_f8o(spark, sf):
    return round_doubles(C.function_overlap(parsed(spark, sf), parsed(spark, sf, "fx_cells_b")))


@register("F8_advice", W("""
SELECT 1 AS rule_no, 'Medium' AS priority, 'coverage' AS category,
  printf('Sheet A has %d more formulas than Sheet B. Consider if these are necessary.', na) AS message FROM s WHERE na > nb
UNION ALL SELECT 2, 'Medium', 'differences', printf('Found %d formula differences in common cells. Review for consistency.', nc) FROM s WHERE nc > 0
UNION ALL SELECT 3, 'Low', 'functions', 'Low function overlap between sheets suggests different calculation approaches. Consider standardization.'
  FROM s WHERE o < 70""", "fx_cells", "fx_cells_b", ctes=(("pa", parsed_sql("fx_cells")), ("pb", parsed_sql("fx_cells_b")),
    ("fa", "SELECT DISTINCT unnest(functions) AS f FROM pa"), ("fb", "SELECT DISTINCT unnest(functions) AS f FROM pb"),
    ("s", "SELECT (SELECT count(*) FROM pa ANTI JOIN pb USING (sheet, cell)) AS na, (SELECT count(*) FROM pb ANTI JOIN pa USING (sheet, cell)) AS nb, "
          "(SELECT count(*) FROM pa JOIN pb USING (sheet, cell) WHERE pa.formula <> pb.formula) AS nc, "
          "(SELECT count(*) FROM fa JOIN fb USING (f)) * 100.0 / (SELECT count(*) FROM (SELECT f FROM fa UNION SELECT f FROM fb)) AS o"))))
def q_f8a(spark, sf):
    a, b = parsed(spark, sf), parsed(spark, sf, "fx_cells_b")
    return C.diff_advice(C.formula_diff(a, b), C.function_overlap(a, b))


@register("F9_formula_statistics", W(f"""
SELECT count(*) AS total_formulas, count(DISTINCT (book, sheet)) AS total_sheets_with_formulas,
  {S('round(count(*) * 1.0 / count(DISTINCT (book, sheet)), 1)', 'average_formulas_per_sheet')},
  (SELECT count(DISTINCT f) FROM calls) AS unique_functions_used, max(complexity) AS most_complex_formula_score,
  {S('round(avg(complexity), 1)', 'average_complexity')}, {S('round(quantile_cont(complexity, 0.5), 1)', 'median_complexity')},
  {S('round(stddev_pop(complexity), 1)', 'complexity_std')},
  CAST(sum(CASE WHEN complexity <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS simple_formulas,
  CAST(sum(CASE WHEN complexity > 5 AND complexity <= 15 THEN 1 ELSE 0 END) AS BIGINT) AS moderate_formulas,
  CAST(sum(CASE WHEN complexity > 15 THEN 1 ELSE 0 END) AS BIGINT) AS complex_formulas,
  (SELECT count(*) FROM calls) AS total_function_calls,
  {S('round((SELECT count(DISTINCT f) FROM calls) * 100.0 / (SELECT count(*) FROM calls), 1)', 'function_diversity_score')}
FROM p""", *WCELLS, ctes=(("p", parsed_sql("fx_cells")), ("calls", "SELECT unnest(functions) AS f FROM p"))))
def q_f9(spark, sf):
    return round_doubles(C.formula_statistics(parsed(spark, sf)))


@register("F9_top_functions", W("""
SELECT f AS function, count(*) AS calls, CAST(row_number() OVER (ORDER BY count(*) DESC, f) AS INTEGER) AS rank
FROM (SELECT unnest(functions) AS f FROM p) GROUP BY 1 QUALIFY rank <= 10""", *WCELLS,
                                       ctes=(("p", parsed_sql("fx_cells_b".replace("_b", ""))),)))
def q_f9t(spark, sf):
    return C.top_functions(parsed(spark, sf))


WA = ("fx_attrs_a", "fx_attrs_b")
_DIFF = """
SELECT coalesce(a.sheet, b.sheet) AS sheet, coalesce(a.cell, b.cell) AS cell, coalesce(a.category, b.category) AS category,
  coalesce(a.attr, b.attr) AS attr, a.value AS value_a, b.value AS value_b,
  CASE WHEN a.cell IS NULL THEN 'only_in_b' WHEN b.cell IS NULL THEN 'only_in_a' ELSE 'modified' END AS change
FROM fx_attrs_a a FULL JOIN fx_attrs_b b ON a.sheet = b.sheet AND a.cell = b.cell AND a.category = b.category AND a.attr = b.attr
WHERE a.cell IS NULL OR b.cell IS NULL OR a.value IS DISTINCT FROM b.value"""


def attrs(spark, sf):
    return fixture(spark, sf, "fx_attrs_a"), fixture(spark, sf, "fx_attrs_b")


@register("G1_attribute_diff", W(_DIFF, *WA))
def q_g1(spark, sf):
    a, b = attrs(spark, sf)
    return G.attribute_diff(a, b)


@register("G1_cell_presence", W("""
SELECT coalesce(a.sheet, b.sheet) AS sheet, coalesce(a.cell, b.cell) AS cell,
  CASE WHEN a.cell IS NULL THEN 'only_in_b' ELSE 'only_in_a' END AS presence
FROM (SELECT DISTINCT sheet, cell FROM fx_attrs_a) a FULL JOIN (SELECT DISTINCT sheet, cell FROM fx_attrs_b) b
  ON a.sheet = b.sheet AND a.cell = b.cell WHERE a.cell IS NULL OR b.cell IS NULL""", *WA))
def q_g1p(spark, sf):
    a, b = attrs(spark, sf)
    return G.cell_presence(a, b)


@register("G2_diff_summary", W(f"""
SELECT t.category, t.compared, coalesce(d.changes, 0) AS changes, CAST(coalesce(d.modified, 0) AS BIGINT) AS modified,
  {S('coalesce(d.changes, 0) * 100.0 / t.compared', 'change_percentage')}
FROM (SELECT category, count(*) AS compared FROM (SELECT sheet, cell, category, attr FROM fx_attrs_a UNION
  SELECT sheet, cell, category, attr FROM fx_attrs_b) GROUP BY 1) t
LEFT JOIN (SELECT category, count(*) AS changes, sum(CASE WHEN change = 'modified' THEN 1 ELSE 0 END) AS modified FROM d
  GROUP BY 1) d USING (category)""", *WA, ctes=(("d", _DIFF),)))
def q_g2(spark, sf):
    a, b = attrs(spark, sf)
    return round_doubles(G.diff_summary(G.attribute_diff(a, b), a, b))


@register("G2_diff_examples", W("""
SELECT sheet, cell, category, attr, value_a, value_b, change, CAST(rn AS INTEGER) AS example_no FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY sheet, cell, attr) AS rn FROM d) WHERE rn <= 5""",
    *WA, ctes=(("d", _DIFF),)))
def q_g2e(spark, sf):
    a, b = attrs(spark, sf)
    return G.diff_examples(G.attribute_diff(a, b))


_W = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in G.CATEGORY_WEIGHTS.items()) + ") AS w(category, weight)"


@register("G3_significance", W(f"""
SELECT sheet, cell, score, changes, (SELECT count(*) FROM s) AS significant_cells,
  CASE WHEN (SELECT avg(score) FROM s) > 8 THEN 'high' WHEN (SELECT avg(score) FROM s) > 5 THEN 'medium' ELSE 'low' END AS impact
FROM s ORDER BY score DESC, sheet, cell LIMIT 20""", *WA, ctes=(
    ("d", _DIFF),
    ("s", f"SELECT sheet, cell, sum(coalesce(w.weight, 1)) AS score, count(*) AS changes FROM d LEFT JOIN {_W} "
          f"USING (category) GROUP BY 1, 2 HAVING sum(coalesce(w.weight, 1)) > 3"))))
def q_g3(spark, sf):
    a, b = attrs(spark, sf)
    return G.significance(G.attribute_diff(a, b)).select("sheet", "cell", F.col("score").cast("long"), "changes",
                                                          "significant_cells", "impact")


@register("G3_change_impact", W(f"""
SELECT count(*) AS total_significant_changes, {S('avg(score)', 'average_significance_score')},
  CASE WHEN count(*) = 0 THEN 'none' WHEN avg(score) > 8 THEN 'high' WHEN avg(score) > 5 THEN 'medium' ELSE 'low' END AS impact_level
FROM s""", *WA, ctes=(
    ("d", _DIFF),
    ("s", f"SELECT sheet, cell, CAST(sum(coalesce(w.weight, 1)) AS DOUBLE) AS score FROM d LEFT JOIN {_W} USING (category) "
          f"GROUP BY 1, 2 HAVING sum(coalesce(w.weight, 1)) > 3"))))
def q_g3i(spark, sf):
    a, b = attrs(spark, sf)
    return round_doubles(G.change_impact(G.attribute_diff(a, b)))


@register("G4_structure_diff", W("""
SELECT coalesce(a.sheet, b.sheet) AS sheet, coalesce(a.kind, b.kind) AS kind, coalesce(a.id, b.id) AS id,
  coalesce(a.attr, b.attr) AS attr, a.value AS value_a, b.value AS value_b,
  CASE WHEN a.id IS NULL THEN 'only_in_b' WHEN b.id IS NULL THEN 'only_in_a' ELSE 'modified' END AS change
FROM fx_objects_a a FULL JOIN fx_objects_b b ON a.sheet = b.sheet AND a.kind = b.kind AND a.id = b.id AND a.attr = b.attr
WHERE a.id IS NULL OR b.id IS NULL OR a.value IS DISTINCT FROM b.value""", "fx_objects_a", "fx_objects_b"))
def q_g4(spark, sf):
    return G.structure_diff(fixture(spark, sf, "fx_objects_a"), fixture(spark, sf, "fx_objects_b"))


@register("G5_formatted_cells", W("""
SELECT coalesce(a.category, b.category) AS category, coalesce(a.n, 0) AS cells_a, coalesce(b.n, 0) AS cells_b,
  coalesce(b.n, 0) - coalesce(a.n, 0) AS difference
FROM (SELECT category, count(DISTINCT (sheet, cell)) AS n FROM fx_attrs_a GROUP BY 1) a
FULL JOIN (SELECT category, count(DISTINCT (sheet, cell)) AS n FROM fx_attrs_b GROUP BY 1) b USING (category)""", *WA))
def q_g5(spark, sf):
    a, b = attrs(spark, sf)
    return G.formatted_cell_stats(a, b)


@register("G5_rule_counts", W("""
SELECT coalesce(a.sheet, b.sheet) AS sheet, coalesce(a.n, 0) AS rules_a, coalesce(b.n, 0) AS rules_b,
  coalesce(b.n, 0) - coalesce(a.n, 0) AS difference
FROM (SELECT sheet, count(DISTINCT id) AS n FROM fx_objects_a WHERE kind = 'conditional_format' GROUP BY 1) a
FULL JOIN (SELECT sheet, count(DISTINCT id) AS n FROM fx_objects_b WHERE kind = 'conditional_format' GROUP BY 1) b USING (sheet)""",
    "fx_objects_a", "fx_objects_b"))
def q_g5r(spark, sf):
    return G.rule_counts(fixture(spark, sf, "fx_objects_a"), fixture(spark, sf, "fx_objects_b"))
