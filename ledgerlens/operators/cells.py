"""Formula analysis over a cell table ``cells(book, sheet, cell, row_no, col_no, formula)``.

Parsing is regular-expression extraction in Catalyst (no Python); the
dependency graph is an edge DataFrame. Dependency levels are computed by
frontier propagation until no cell is new; each round's frontier and
state are written to the checkpoint folder so lineage stays one round
deep and a lost executor recomputes at most one round; cells never levelled sit on or behind a
cycle. Cascades are counted by ``reach``: runs of single dependents by
doubling, the rest with 64 start cells to a word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rule, rules
from . import reach
from .frames import attach, top_k
from .ranks import _round

# The reference's formula patterns, operator characters and array-formula functions.
FUNCTION_RE = r"([A-Z][A-Z0-9]*)\s*\("
CELL_REF_RE = r"(?:([A-Za-z_][A-Za-z0-9_]*!)?)(\$?[A-Z]+\$?[0-9]+)"
EXTERNAL_RE = r"\[([^\]]+)\]([^!]+)!"
OPERATORS = ["+", "-", "*", "/", "^", "&", ">", "<", "="]
ARRAY_FUNCTIONS = ["TRANSPOSE", "MMULT", "INDEX", "MATCH", "SUMPRODUCT"]


def _count_char(s, ch):
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))


def parse_formulas(cells: DataFrame) -> DataFrame:
    """Formula cells with functions (distinct, in order), main function, raw and qualified references,
    external links, nesting depth, complexity score, complex and array flags."""
    f = cells.filter(F.col("formula").startswith("="))
    funcs = F.array_distinct(F.regexp_extract_all(F.upper("formula"), F.lit(FUNCTION_RE), 1))
    refs = F.regexp_extract_all("formula", F.lit(CELL_REF_RE), 0)
    ext = F.transform(F.regexp_extract_all("formula", F.lit(EXTERNAL_RE), 0), lambda x: F.substring_index(x, "!", 1))
    steps = F.transform(F.split("formula", ""), lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("cur"), F.lit(0).alias("mx")),
                        lambda acc, d: F.struct((acc["cur"] + d).alias("cur"), F.greatest(acc["mx"], acc["cur"] + d).alias("mx")),
                        lambda acc: acc["mx"])
    ops = reduce(lambda a, b: a + b, [_count_char(F.col("formula"), o) for o in OPERATORS])
    qualified = F.transform(refs, lambda r: F.replace(F.when(F.instr(r, "!") > 0, r)
                                                      .otherwise(F.concat(F.col("sheet"), F.lit("!"), r)), F.lit("$"), F.lit("")))
    up = F.upper("formula")
    is_array = reduce(lambda a, b: a | b, [F.instr(up, fn) > 0 for fn in ARRAY_FUNCTIONS]) | \
        ((F.instr("formula", "{") > 0) & (F.instr("formula", "}") > 0))
    out = (f.withColumn("functions", funcs).withColumn("cell_references", refs).withColumn("references", qualified)
           .withColumn("external_references", ext).withColumn("depth", depth))
    cx = (F.floor(F.length("formula") / 10) + F.size("functions") * 2 + F.col("depth") * 3 + F.size("cell_references") + ops)
    return (out.withColumn("complexity", cx.cast("int"))
            .withColumn("main_function", F.coalesce(F.try_element_at("functions", F.lit(1)), F.lit("SIMPLE")))
            .withColumn("is_complex", F.col("complexity") > 10).withColumn("is_array", is_array))


def sheet_counts(parsed: DataFrame) -> DataFrame:
    """formulas per sheet, complex / array counts, and counts per main function."""
    return parsed.groupBy("book", "sheet", "main_function").agg(
        F.count(F.lit(1)).alias("formulas"), F.sum(F.when(F.col("is_complex"), 1).otherwise(0)).cast("long").alias("complex"),
        F.sum(F.when(F.col("is_array"), 1).otherwise(0)).cast("long").alias("array_formulas"))


def edges(parsed: DataFrame) -> DataFrame:
    """dependency edges (book, src formula cell, dst referenced cell), both sheet-qualified, '$' stripped."""
    return (parsed.select("book", F.concat("sheet", F.lit("!"), "cell").alias("src"), F.explode("references").alias("dst"))
            .distinct())


def validation(cells: DataFrame, parsed: DataFrame) -> DataFrame:
    """F6 per formula cell: references to plain cells, to no cell at all (D10), external links, 2-cycle flag."""
    e = edges(parsed)
    allc = cells.select("book", F.concat("sheet", F.lit("!"), "cell").alias("dst"),
                        F.col("formula").startswith("=").alias("_is_formula"))
    je = e.join(allc, ["book", "dst"], "left")
    per = je.groupBy("book", "src").agg(
        F.sum(F.when(F.col("_is_formula").isNull(), 1).otherwise(0)).alias("missing_refs"),
        F.sum(F.when(~F.col("_is_formula"), 1).otherwise(0)).alias("non_formula_refs"))
    back = e.select("book", F.col("src").alias("dst"), F.col("dst").alias("src"))
    cyc = e.join(back, ["book", "src", "dst"], "left_semi").select("book", "src").distinct().withColumn("in_2_cycle", F.lit(True))
    base = parsed.select("book", F.concat("sheet", F.lit("!"), "cell").alias("src"),
                         F.size("external_references").alias("external_links"))
    return (base.join(per, ["book", "src"], "left").join(cyc, ["book", "src"], "left")
            .select("book", F.col("src").alias("cell"), F.coalesce("missing_refs", F.lit(0)).cast("long").alias("missing_refs"),
                    F.coalesce("non_formula_refs", F.lit(0)).cast("long").alias("non_formula_refs"), "external_links",
                    F.coalesce("in_2_cycle", F.lit(False)).alias("in_2_cycle")))


def validation_summary(v: DataFrame) -> DataFrame:
    """totals and score = max(0, 100 - issues / formulas * 100) with issues = 2-cycle cells + references that
    hit no formula cell (the reference's definition), 1 dp."""
    s = v.agg(F.count(F.lit(1)).alias("total_formulas_validated"),
              F.sum(F.when(F.col("in_2_cycle"), 1).otherwise(0)).cast("long").alias("circular_references_count"),
              F.sum("missing_refs").cast("long").alias("missing_references_count"),
              F.sum("non_formula_refs").cast("long").alias("non_formula_references_count"),
              F.sum(F.when(F.col("external_links") > 0, 1).otherwise(0)).cast("long").alias("external_dependencies_count"))
    issues = F.col("circular_references_count") + F.col("missing_references_count") + F.col("non_formula_references_count")
    return s.withColumn("validation_score", F.when(F.col("total_formulas_validated") == 0, 100.0).otherwise(
        F.round(F.greatest(F.lit(0.0), 100 - issues / F.col("total_formulas_validated") * 100), 1)))


def dependency_levels(cells: DataFrame, parsed: DataFrame) -> DataFrame:
    """level of every formula cell: plain or absent precedents are level 0; a formula cell is 1 + the max level of
    its precedents once all are known. Cells still unknown after convergence are on or behind a cycle (level null).

    Frontier propagation (topological layering) until the frontier is empty, however deep the longest chain: each
    round joins only the cells levelled in the previous round with the edges pointing at them, decrements the
    unresolved-precedent count of their dependents and keeps a running max; dependents reaching zero form the next
    frontier. Edges are computed once; resolved cells leave the state. State and frontier are written each round.
    """
    e = _round(edges(parsed).repartition("book", "dst"))
    formula_cells = parsed.select("book", F.concat("sheet", F.lit("!"), "cell").alias("src"))
    need = e.groupBy("book", "src").agg(F.count(F.lit(1)).alias("_need"))
    fc = formula_cells.join(need, ["book", "src"], "left").na.fill(0, ["_need"])
    plain = (e.select("book", "dst").distinct().join(formula_cells.withColumnRenamed("src", "dst"), ["book", "dst"], "left_anti")
             .select("book", F.col("dst").alias("cell"), F.lit(0).alias("level")))
    roots = _round(fc.filter(F.col("_need") == 0).select("book", F.col("src").alias("cell"), F.lit(1).alias("level")))
    frontier = _round(plain.unionByName(roots))
    state = _round(fc.filter(F.col("_need") > 0).select("book", "src", F.col("_need").alias("_left"),
                                                            F.lit(-1).alias("_mx")))
    levelled = [roots]
    while True:
        contrib = (e.join(frontier.withColumnRenamed("cell", "dst"), ["book", "dst"])
                   .groupBy("book", "src").agg(F.count(F.lit(1)).alias("_k"), F.max("level").alias("_m")))
        upd = (state.join(contrib, ["book", "src"], "left")
               .select("book", "src", (F.col("_left") - F.coalesce("_k", F.lit(0))).alias("_left"),
                       F.greatest(F.col("_mx"), F.coalesce("_m", F.lit(-1))).alias("_mx")))
        upd = _round(upd)
        frontier = upd.filter(F.col("_left") == 0).select("book", F.col("src").alias("cell"), (F.col("_mx") + 1).alias("level"))
        if frontier.isEmpty():
            break
        levelled.append(frontier)
        if len(levelled) == 64:  # keep the final plan small
            levelled = [_round(reduce(lambda a, b: a.unionByName(b), levelled))]
        state = upd.filter(F.col("_left") > 0)
    known = reduce(lambda a, b: a.unionByName(b), levelled)
    return (formula_cells.withColumnRenamed("src", "cell").join(known, ["book", "cell"], "left")
            .withColumn("on_or_behind_cycle", F.col("level").isNull()))


def direct_dependents(parsed: DataFrame) -> DataFrame:
    """per referenced cell the number of formulas that name it, and the highly connected flag (>= 5)."""
    d = edges(parsed).groupBy("book", F.col("dst").alias("cell")).agg(F.count(F.lit(1)).alias("direct_dependents"))
    return d.withColumn("highly_connected", F.col("direct_dependents") >= 5)


def dependents(parsed: DataFrame) -> DataFrame:
    """per referenced cell: direct dependents, distinct transitive dependents (cascade, the cell itself not counted), impact
    band (above 10 / above 5), highly connected flag (>= 5 direct dependents). Counted by `reach`, whose state isn't the closure."""
    out = direct_dependents(parsed).join(reach.cascade_sizes(edges(parsed)), ["book", "cell"], "left").na.fill(0, ["cascade_size"])
    return out.withColumn("impact", F.when(F.col("cascade_size") > 10, "high").when(F.col("cascade_size") > 5, "medium")
                          .otherwise("low")).select("book", "cell", "direct_dependents", "cascade_size", "impact", "highly_connected")


def formula_statistics(parsed: DataFrame) -> DataFrame:
    """totals, complexity mean / median / population std (1 dp), bands 5 / 15, function calls and diversity."""
    med = parsed.agg(F.percentile(F.col("complexity").cast("double"), 0.5).alias("_med"))
    calls = parsed.select(F.explode("functions").alias("fn"))
    fs = calls.agg(F.count(F.lit(1)).alias("total_function_calls"), F.count_distinct("fn").alias("unique_functions_used"))
    s = parsed.agg(F.count(F.lit(1)).alias("total_formulas"), F.count_distinct("book", "sheet").alias("total_sheets_with_formulas"),
                   F.max("complexity").alias("most_complex_formula_score"),
                   F.round(F.avg("complexity"), 1).alias("average_complexity"),
                   F.round(F.stddev_pop("complexity"), 1).alias("complexity_std"),
                   F.sum(F.when(F.col("complexity") <= 5, 1).otherwise(0)).cast("long").alias("simple_formulas"),
                   F.sum(F.when((F.col("complexity") > 5) & (F.col("complexity") <= 15), 1).otherwise(0)).cast("long")
                   .alias("moderate_formulas"),
                   F.sum(F.when(F.col("complexity") > 15, 1).otherwise(0)).cast("long").alias("complex_formulas"))
    x = attach(attach(s, med), fs)
    return x.select("total_formulas", "total_sheets_with_formulas",
                    F.round(F.try_divide("total_formulas", "total_sheets_with_formulas"), 1).alias("average_formulas_per_sheet"),
                    "unique_functions_used", "most_complex_formula_score", "average_complexity",
                    F.round("_med", 1).alias("median_complexity"), "complexity_std", "simple_formulas", "moderate_formulas",
                    "complex_formulas", "total_function_calls",
                    F.round(F.try_divide("unique_functions_used", "total_function_calls") * 100, 1).alias("function_diversity_score"))


def impact_summary(deps: DataFrame) -> DataFrame:
    """over the highly connected cells, how many have a high impact, and the mean and largest cascade (0 if there are none)."""
    return deps.filter("highly_connected").agg(
        F.count_if(F.col("impact") == "high").alias("total_high_impact_cells"),
        F.coalesce(F.avg("cascade_size"), F.lit(0.0)).alias("average_cascade_size"),
        F.coalesce(F.max("cascade_size"), F.lit(0)).alias("max_cascade_size"))


def dependency_metrics(cells: DataFrame, parsed: DataFrame, levels: DataFrame) -> DataFrame:
    """formula cells without precedents, highly connected formula cells, the deepest level (a formula without precedents
    has level 1 here), mean number of precedents (1 dp); validation score, error rate (references to cells without formula
    in % of formulas), external rate, circular risk. Formulas that Excel itself reports as broken don't occur in cell tables."""
    n = parsed.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.size("references") == 0).alias("independent_cells"),
                   F.round(F.coalesce(F.avg(F.size("references")), F.lit(0.0)), 1).alias("average_precedents"))
    formulas = parsed.select("book", F.concat("sheet", F.lit("!"), "cell").alias("cell"))
    hubs = direct_dependents(parsed).filter("highly_connected").join(formulas, ["book", "cell"], "left_semi").agg(
        F.count(F.lit(1)).alias("highly_connected_cells"))
    deepest = levels.agg(F.coalesce(F.max("level"), F.lit(0)).alias("max_dependency_level"))
    v = validation_summary(validation(cells, parsed))
    x = attach(attach(attach(n, hubs), deepest), v)
    rate = lambda k: F.coalesce(F.round(F.try_divide(k * 100.0, F.col("_n")), 1), F.lit(0.0))
    return x.select("independent_cells", "highly_connected_cells", "max_dependency_level", "average_precedents", "validation_score",
                    rate(F.col("missing_references_count") + F.col("non_formula_references_count")).alias("error_rate"),
                    rate(F.col("external_dependencies_count")).alias("external_dependency_rate"),
                    F.when(F.col("circular_references_count") > 0, "HIGH").otherwise("LOW").alias("circular_reference_risk"))


def top_functions(parsed: DataFrame, k: int = 10) -> DataFrame:
    """the k most used functions (calls counted once per formula), ties by name."""
    c = parsed.select(F.explode("functions").alias("function")).groupBy("function").agg(F.count(F.lit(1)).alias("calls"))
    return top_k(c.withColumn("_g", F.lit(0)), ["_g"], [F.desc("calls"), F.asc("function")], k).drop("_g")


def formula_diff(parsed_a: DataFrame, parsed_b: DataFrame) -> DataFrame:
    """F8 per cell: only in A / only in B / unchanged / changed, and the change type for changed formulas
    (different lengths: major above a gap of 20, else minor; same length: reference change when the functions are the
    same, else function change)."""
    a = parsed_a.select("sheet", "cell", F.col("formula").alias("formula_a"), F.col("functions").alias("fa"))
    b = parsed_b.select("sheet", "cell", F.col("formula").alias("formula_b"), F.col("functions").alias("fb"))
    j = a.join(b, ["sheet", "cell"], "full")
    status = (F.when(F.col("formula_b").isNull(), "only_in_a").when(F.col("formula_a").isNull(), "only_in_b")
              .when(F.col("formula_a") == F.col("formula_b"), "unchanged").otherwise("changed"))
    ctype = (F.when(status != "changed", F.lit(None))
             .when(F.abs(F.length("formula_a") - F.length("formula_b")) > 20, "major change")
             .when(F.length("formula_a") != F.length("formula_b"), "minor change")
             .when(F.array_sort("fa") == F.array_sort("fb"), "reference change").otherwise("function change"))
    return j.select("sheet", "cell", "formula_a", "formula_b", status.alias("status"), ctype.alias("change_type"))


def function_overlap(parsed_a: DataFrame, parsed_b: DataFrame) -> DataFrame:
    """F8: distinct functions of each sheet, common count and overlap % (common / union)."""
    fa = parsed_a.select(F.explode("functions").alias("f")).distinct()
    fb = parsed_b.select(F.explode("functions").alias("f")).distinct()
    na = fa.agg(F.count(F.lit(1)).alias("functions_a"))
    nb = fb.agg(F.count(F.lit(1)).alias("functions_b"))
    nc = fa.join(fb, "f").agg(F.count(F.lit(1)).alias("common_functions"))
    x = attach(attach(na, nb), nc)
    u = F.col("functions_a") + F.col("functions_b") - F.col("common_functions")
    return x.withColumn("function_overlap", F.when(u > 0, F.col("common_functions") * 100.0 / u).otherwise(0.0))


def diff_advice(diff: DataFrame, overlap: DataFrame) -> DataFrame:
    """F8: advice rows: more formulas only in A than only in B, differences in common cells, function overlap below 70%."""
    s = diff.agg(F.count_if(F.col("status") == "only_in_a").alias("_a"), F.count_if(F.col("status") == "only_in_b").alias("_b"),
                 F.count_if(F.col("status") == "changed").alias("_c"))
    m = attach(s, overlap.select("function_overlap"))
    return rules(m, [
        Rule(F.col("_a") > F.col("_b"), "Medium", "coverage", F.format_string(
            "Sheet A has %d more formulas than Sheet B. Consider if these are necessary.", F.col("_a"))),
        Rule(F.col("_c") > 0, "Medium", "differences", F.format_string(
            "Found %d formula differences in common cells. Review for consistency.", F.col("_c"))),
        Rule(F.col("function_overlap") < 70, "Low", "functions",
             "Low function overlap between sheets suggests different calculation approaches. Consider standardization.")])


def analyze(cells: DataFrame) -> dict[str, DataFrame]:
    """the full bundle as named DataFrames (levels and cascades run their rounds while it is built)."""
    p = parse_formulas(cells)
    v = validation(cells, p)
    return {"formulas": p, "per_sheet": sheet_counts(p), "validation": v, "validation_summary": validation_summary(v),
            "levels": dependency_levels(cells, p), "dependents": dependents(p), "statistics": formula_statistics(p),
            "top_functions": top_functions(p)}
