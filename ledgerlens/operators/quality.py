"""Q1-Q16 data quality: missing data, null runs, duplicates, type checks, scores, advice.

Pass 1 is one wide aggregate per table (counts, nulls, distinct counts,
conversion rates); duplicates are a ``groupBy`` over all columns; null runs
use range-partitioned row positions (no single-partition window even when
the input has no grouping column).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import col
from ..functions.rules import Rule, rules
from . import ranks
from ..functions.dates import DATE_FORMATS, parse_date  # noqa: F401
from .frames import attach
from .profile import NUMERIC, _missing, numeric_columns, string_columns, unique_counts

# The reference's boolean words, its text-to-number strip set and key-name words.
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0", "y", "n", "t", "f"]
NUMBER_STRIP = r"[,$%\s]"
KEY_NAME_WORDS = ["id", "key", "code", "number"]


def _n_missing(df: DataFrame, c: str) -> F.Column:
    return F.sum(F.when(_missing(df, c), 1).otherwise(0))


def missing_columns(df: DataFrame, worst: int = 5) -> DataFrame:
    """Q1/Q2 per column: missing count, % (2 dp), rank among the ``worst`` columns, fully present, mostly empty (>90%)."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[_n_missing(df, c).alias(f"m{i}") for i, c in enumerate(cols)])
    long = one.select("_n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.coalesce(F.col(f"m{i}"), F.lit(0)).cast("long")
                 .alias("missing_count")) for i, c in enumerate(cols)])).alias("r")).select("_n", "r.*")
    pct = F.round(F.try_divide(F.col("missing_count") * 100.0, F.col("_n")), 2)
    from pyspark.sql.window import Window
    # one row per column: this window is over the column list, not over data rows
    w = Window.orderBy(F.desc("missing_percentage"), F.asc("position"))
    out = long.withColumn("missing_percentage", pct)
    return (out.withColumn("_r", F.row_number().over(w))
            .select("column", "missing_count", "missing_percentage",
                    F.when(F.col("_r") <= worst, F.col("_r")).alias("worst_rank"),
                    (F.col("missing_count") == 0).alias("fully_present"),
                    (F.try_divide(F.col("missing_count") * 100.0, F.col("_n")) > 90).alias("mostly_empty")))


def missing_overview(df: DataFrame) -> DataFrame:
    """Q1: rows with any missing, fully empty rows, completeness % (2 dp), missing cells, columns with missing."""
    cols = df.columns
    flags = [F.when(_missing(df, c), 1).otherwise(0) for c in cols]
    rn = reduce(lambda x, y: x + y, flags)
    per = df.select(rn.alias("_rn"), *[f.alias(f"c{i}") for i, f in enumerate(flags)])
    agg = per.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.sum(F.when(F.col("_rn") > 0, 1).otherwise(0)).alias("rows_with_missing_data"),
                  F.sum(F.when(F.col("_rn") == len(cols), 1).otherwise(0)).alias("completely_empty_rows"),
                  F.sum("_rn").alias("total_missing_cells"), *[F.max(f"c{i}").alias(f"h{i}") for i in range(len(cols))])
    cells = F.col("total_rows") * len(cols)
    return agg.select(
        "total_rows", F.lit(len(cols)).alias("total_columns"),
        F.coalesce("rows_with_missing_data", F.lit(0)).cast("long").alias("rows_with_missing_data"),
        F.coalesce("completely_empty_rows", F.lit(0)).cast("long").alias("completely_empty_rows"),
        F.round(F.try_divide((cells - F.coalesce("total_missing_cells", F.lit(0))) * 100.0, cells), 2).alias("overall_completeness"),
        F.coalesce("total_missing_cells", F.lit(0)).cast("long").alias("total_missing_cells"),
        reduce(lambda x, y: x + y, [F.coalesce(F.col(f"h{i}"), F.lit(0)) for i in range(len(cols))]).cast("long")
        .alias("columns_with_missing_data"))


def _joined(x: list, y: list) -> list:
    """Two neighbouring stretches of rows as one. A stretch: rows, leading run, trailing run, and of the runs that touch neither
    end their number, their rows and the longest. In a stretch that is one run, leading and trailing run are all its rows."""
    if x[1] == x[0]:
        return [x[0] + y[0], x[0] + y[1], x[0] + y[0] if y[2] == y[0] else y[2], *y[3:]]
    if y[2] == y[0]:
        return [x[0] + y[0], x[1], x[2] + y[0], *x[3:]]
    middle = x[2] + y[1]
    return [x[0] + y[0], x[1], y[2], x[3] + y[3] + (middle > 0), x[4] + y[4] + middle, max(x[5], y[5], middle)]


def _stretch(gone: np.ndarray) -> list:
    ends = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    starts, stops = ends[::2], ends[1::2]
    n, sizes = len(gone), stops - starts
    first = int(sizes[0]) if len(sizes) and starts[0] == 0 else 0
    last = int(sizes[-1]) if len(sizes) and stops[-1] == n else 0
    inner = sizes[(starts > 0) & (stops < n)]
    return [n, first, last, len(inner), int(inner.sum()), int(inner.max(initial=0))]


def null_runs(df: DataFrame, cols: list[str] | None, order_by: list[str], partition_by: str | None = None) -> DataFrame:
    """Q3: runs of consecutive missing values per column (and group): longest, number of runs, mean length.

    One exchange for any number of columns: rows are dealt in ranges of (group, order); a task walks its rows and gives, for each
    group and column, its stretch: rows, leading run, trailing run and a summary of the runs between. Stretches of neighbouring
    tasks are joined in order by a fold (a run that crosses a border is the trailing run of one and the leading run of the next),
    over at most one stretch for each task. Rows that tie in (group, order) come in any order.
    """
    cols = cols or [c for c in numeric_columns(df) if c != partition_by and c not in order_by]
    group = col(partition_by) if partition_by else F.lit(0)
    keyed = df.select(group.alias("_g"), *[col(k).alias(f"_o{i}") for i, k in enumerate(order_by)],
                      *[F.coalesce(_missing(df, c), F.lit(False)).alias(f"_m{i}") for i, c in enumerate(cols)])
    order = ["_g", *[f"_o{i}" for i in range(len(order_by))]]
    first_flag = len(order)
    names = ["g", "seq", "c", "n", "head", "tail", "runs", "rows", "longest"]

    def run(batches):
        def made(rows):
            values, numbers = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(values), *[pa.array(x, pa.int64()) for x in zip(*numbers)]], names=names)

        key, held, seq, out = None, None, 0, []
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0)
            x, y = g.slice(0, len(g) - 1), g.slice(1)
            same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(~same.astype(bool)) + 1).tolist(), len(g)]
            gone = [b.column(first_flag + i).to_numpy(zero_copy_only=False) for i in range(len(cols))]
            for low, high in zip(edges, edges[1:]):
                now = [_stretch(flags[low:high]) for flags in gone]
                value = g.slice(low, 1)
                if held is not None and value.equals(key):
                    held = [_joined(s, t) for s, t in zip(held, now)]
                    continue
                if held is not None:
                    out += [(key, [seq, i, *s]) for i, s in enumerate(held)]
                    seq += 1
                    if len(out) > 4096:
                        yield made(out)
                        out = []
                key, held = value, now
        if held is not None:
            yield made(out + [(key, [seq, i, *s]) for i, s in enumerate(held)])

    kind = keyed.schema["_g"].dataType.simpleString()
    parts = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, f"g {kind}, seq long, c long, n long, head long, tail long, runs long, rows long, longest long")
    s = F.struct(F.spark_partition_id().alias("part"), "seq", "n", "head", "tail", "runs", "rows", "longest")
    state = F.struct(*[F.lit(0).cast("long").alias(k) for k in ("open", "runs", "rows", "longest")])

    def step(acc, x):
        closed = acc["open"] + x["head"]
        all_gone = x["head"] == x["n"]
        return F.struct(F.when(all_gone, closed).otherwise(x["tail"]).alias("open"),
                        F.when(all_gone, acc["runs"]).otherwise(acc["runs"] + x["runs"] + (closed > 0).cast("long")).alias("runs"),
                        F.when(all_gone, acc["rows"]).otherwise(acc["rows"] + x["rows"] + closed).alias("rows"),
                        F.when(all_gone, acc["longest"]).otherwise(F.greatest(acc["longest"], x["longest"], closed)).alias("longest"))

    folded = parts.select("g", "c", s.alias("s")).groupBy("g", "c").agg(F.array_sort(F.collect_list("s")).alias("s")).select(
        "g", "c", F.aggregate("s", state, step).alias("a"))
    total, rows = F.col("a.runs") + (F.col("a.open") > 0).cast("long"), F.col("a.rows") + F.col("a.open")
    out = folded.select(*([F.col("g").alias(partition_by)] if partition_by else []), F.greatest("a.longest", "a.open").alias("max_consecutive_missing"),
                        total.alias("total_runs"), F.try_divide(rows, total).alias("avg_run_length"),
                        F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("c").cast("int") + 1).alias("column"), rows.alias("_rows"))
    return out.where("_rows > 0").drop("_rows")


def duplicates(df: DataFrame) -> DataFrame:
    """Q4: exact duplicate rows (all but the first of each group), %, unique rows."""
    g = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))
    one = g.agg(F.sum("_c").alias("rows"), F.sum(F.col("_c") - 1).alias("duplicate_rows"),
                F.count(F.lit(1)).alias("unique_rows"))
    return one.select(F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
                      F.coalesce("duplicate_rows", F.lit(0)).cast("long").alias("duplicate_rows"),
                      F.round(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("rows")), 2).alias("duplicate_percentage"),
                      "unique_rows")


def duplicate_groups(df: DataFrame, k: int = 10) -> DataFrame:
    """Q4: the most repeated rows (count > 1), largest first, ties by the row values."""
    g = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
    return g.orderBy(F.desc("copies"), *[F.asc_nulls_first(col(c)) for c in df.columns]).limit(k)


def column_duplicates(df: DataFrame, cols: list[str] | None = None, core: DataFrame | None = None) -> DataFrame:
    """Q5 (and Q6 per key column): duplicate count (nulls count as one value), unique non-null values, %."""
    cols = cols or string_columns(df)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.max(F.when(col(c).isNull(), 1).otherwise(0)).alias(f"z{i}") for i, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"z{i}"), F.lit(0)).alias("_z"))
                               for i, c in enumerate(cols)]))
    x = one.select("_n", rows.alias("r")).select("_n", "r.*").join(F.broadcast(unique_counts(df, cols, core)), "column")
    dup = F.col("_n") - F.col("unique_values") - F.col("_z")
    return x.select("column", dup.cast("long").alias("duplicate_count"), "unique_values",
                    F.round(F.try_divide(dup * 100.0, F.col("_n")), 2).alias("duplicate_percentage"))


def key_candidates(df: DataFrame, first: int = 3) -> DataFrame:
    """Q6: columns named like keys or with unique ratio > 0.7 (first ``first`` in schema order) and their duplicates."""
    dups = column_duplicates(df, df.columns)
    places = df.sparkSession.createDataFrame([(i, c, any(w in c.lower() for w in KEY_NAME_WORDS)) for i, c in enumerate(df.columns)],
                                             "_i int, column string, _named boolean")
    x = attach(dups.join(F.broadcast(places), "column"), df.agg(F.count(F.lit(1)).alias("_n")))
    chosen = x.where(F.col("_named") | (F.try_divide("unique_values", "_n") > 0.7)).orderBy("_i").limit(first)
    # a row for each column of the schema at most
    return chosen.select("column", F.row_number().over(Window.orderBy("_i")).alias("candidate_rank"), "duplicate_count",
                         "unique_values", "duplicate_percentage")


def conversions(df: DataFrame, cols: list[str] | None = None, date_formats=None) -> DataFrame:
    """Q7/Q8/Q9 per text column over all non-null values: number rate (>0.8 -> int64/float64), date rate (>0.7),
    boolean set. Dates by the shared format list, or by ``date_formats``. One aggregate (one scan) for all columns."""
    cols = cols or string_columns(df)
    flags, aggs = [], []
    for i, c in enumerate(cols):
        v = col(c).cast("string")
        nn = v.isNotNull()
        low = F.lower(F.trim(v))
        # per-row flags in a projection; the aggregate below only sums / maxes small integers
        flags += [F.when(nn, 1).otherwise(0).alias(f"f_n{i}"),
                  F.when(nn & F.regexp_replace(v, NUMBER_STRIP, "").try_cast("double").isNotNull(), 1).otherwise(0)
                  .alias(f"f_num{i}"),
                  F.when(F.instr(v, ".") > 0, 1).otherwise(0).alias(f"f_dot{i}"),
                  F.when(nn & parse_date(v, date_formats).isNotNull(), 1).otherwise(0).alias(f"f_dt{i}"),
                  F.when(nn, F.when(low.isin(*BOOLEAN_WORDS), 1).otherwise(0)).alias(f"f_ba{i}"),
                  F.when(low.isin(*BOOLEAN_WORDS), F.array_position(F.array(*[F.lit(w) for w in BOOLEAN_WORDS]), low))
                  .alias(f"f_bw{i}")]
        aggs += [F.sum(f"f_n{i}").alias(f"n{i}"), F.sum(f"f_num{i}").alias(f"num{i}"), F.max(f"f_dot{i}").alias(f"dot{i}"),
                 F.sum(f"f_dt{i}").alias(f"dt{i}"), F.min(f"f_ba{i}").alias(f"ba{i}"),
                 # distinct count only matters when every value is a boolean word: presence bits per word
                 reduce(lambda x, y: x + y, [F.max(F.when(F.col(f"f_bw{i}") == k, 1).otherwise(0))
                                             for k in range(1, len(BOOLEAN_WORDS) + 1)]).alias(f"bd{i}")]
    df = df.select(*flags)
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"n{i}").alias("_n"), F.col(f"num{i}").alias("_num"), F.col(f"dot{i}").alias("_dot"),
        F.col(f"dt{i}").alias("_date"), F.col(f"bd{i}").alias("_bool_distinct"), F.col(f"ba{i}").alias("_bool_all"))
        for i, c in enumerate(cols)]))
    x = one.select(rows.alias("r")).select("r.*")
    num_rate = F.try_divide(F.col("_num"), F.col("_n"))
    date_rate = F.try_divide(F.col("_date"), F.col("_n"))
    return x.select(
        "column", num_rate.alias("numeric_rate"), (num_rate > 0.8).alias("numeric_convertible"),
        F.when(num_rate > 0.8, F.when(F.col("_dot") == 1, "float64").otherwise("int64")).alias("numeric_type"),
        date_rate.alias("date_rate"), (date_rate > 0.7).alias("date_convertible"),
        ((F.col("_bool_all") == 1) & (F.col("_bool_distinct") <= 4)).alias("boolean_convertible"))


def type_validation(df: DataFrame) -> DataFrame:
    """Q10, a row for every column: current type, recommended type (number, then date, then boolean: last hit wins),
    issues; a column without any value has the one issue that it is empty."""
    str_cols, num_cols = string_columns(df), numeric_columns(df)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    n = df.agg(*[F.count(F.when(col(c).isNotNull() & ~F.isnan(col(c)), 1) if types[c] in ("double", "float") else col(c)).alias(f"n{i}")
                 for i, c in enumerate(df.columns)])
    every = n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("current_type"),
                                                  F.col(f"n{i}").alias("_n")) for i, c in enumerate(df.columns)])).alias("r")).select("r.*")
    some = []
    if str_cols:
        issues = F.filter(F.array(
            F.when(F.col("numeric_convertible"), F.concat(F.lit("Numeric data stored as text - can convert to "),
                                                           F.col("numeric_type"))),
            F.when(F.col("date_convertible"), F.lit("Date data stored as text - can convert to datetime")),
            F.when(F.col("boolean_convertible"), F.lit("Boolean data stored as text - can convert to bool"))),
            lambda x: x.isNotNull())
        rec = (F.when(F.col("boolean_convertible"), F.lit("bool"))
               .when(F.col("date_convertible"), F.lit("datetime64[ns]"))
               .when(F.col("numeric_convertible"), F.col("numeric_type")))
        some.append(conversions(df, str_cols).select("column", rec.alias("recommended_type"), issues.alias("_issues")))
    if num_cols:
        o = ranks_outliers(df, num_cols)
        some.append(o.select("column", F.lit(None).cast("string").alias("recommended_type"),
                             F.filter(F.array(F.when(F.col("outliers_count") > 0, F.concat(
                                 F.lit("Contains "), F.col("outliers_count").cast("string"),
                                 F.lit(" potential outliers")))), lambda x: x.isNotNull()).alias("_issues")))
    none = F.array().cast("array<string>")
    if some:
        every = every.join(reduce(lambda a, b: a.unionByName(b), some), "column", "left")
    else:
        every = every.withColumn("recommended_type", F.lit(None).cast("string")).withColumn("_issues", none)
    empty = F.col("_n") == 0
    return every.select("column", "current_type", F.when(~empty, F.col("recommended_type")).alias("recommended_type"),
                        F.when(empty, F.array(F.lit("Column is completely empty"))).otherwise(F.coalesce("_issues", none)).alias("issues")
                        ).withColumn("conversion_possible", F.col("recommended_type").isNotNull())


def ranks_outliers(df: DataFrame, cols: list[str]) -> DataFrame:
    from .profile import outliers
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    o = outliers(df, cols)
    tmap = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    return o.withColumn("current_type", tmap[F.col("column")])


def type_summary(validation: DataFrame) -> DataFrame:
    """Q10 summary: columns analysed, with issues, total issues, convertible, score = max(0, 100 - 10 * issues)."""
    one = validation.agg(F.count(F.lit(1)).alias("total_columns_analyzed"),
                         F.sum(F.when(F.size("issues") > 0, 1).otherwise(0)).alias("columns_with_issues"),
                         F.sum(F.size("issues")).alias("total_issues_found"),
                         F.sum(F.when(F.col("conversion_possible"), 1).otherwise(0)).alias("convertible_columns"))
    return one.select("total_columns_analyzed", F.col("columns_with_issues").cast("long"),
                      F.col("total_issues_found").cast("long"), F.col("convertible_columns").cast("long"),
                      F.greatest(F.lit(0), 100 - F.col("total_issues_found") * 10).cast("long").alias("data_quality_score"))


def quality_report(df: DataFrame) -> DataFrame:
    """Q11: missing score (overall completeness, D4), duplicate score, type score and their mean (1 dp)."""
    mo = missing_overview(df).select("overall_completeness")
    du = duplicates(df).select("duplicate_percentage")
    ts = type_summary(type_validation(df)).select("data_quality_score", "convertible_columns")
    x = attach(attach(mo, du), ts)
    ms = F.greatest(F.lit(0.0), F.col("overall_completeness"))
    ds = F.greatest(F.lit(0.0), 100 - F.col("duplicate_percentage"))
    tsc = F.col("data_quality_score").cast("double")
    return x.select(F.round(ms, 1).alias("missing_data_score"), F.round(ds, 1).alias("duplicate_score"),
                    F.round(tsc, 1).alias("data_type_score"), F.round((ms + ds + tsc) / 3, 1).alias("overall_quality_score"),
                    "overall_completeness", "duplicate_percentage", "convertible_columns")


def quality_recommendations(df: DataFrame) -> DataFrame:
    """Q12: advice from completeness, worst column, duplicates, convertible and mostly-empty columns."""
    rep = quality_report(df)
    mc = missing_columns(df)
    worst = mc.filter(F.col("worst_rank") == 1).select(F.col("column").alias("_worst"),
                                                       F.col("missing_percentage").alias("_worst_pct"))
    empty = mc.agg(F.sum(F.when(F.col("mostly_empty"), 1).otherwise(0)).alias("_empty"))
    m = attach(attach(rep, worst), empty)
    items = [
        Rule(F.col("overall_completeness") < 90, "High", "completeness",
             F.format_string("Data completeness is only %s%%; investigate missing data sources.", F.col("overall_completeness"))),
        Rule(F.col("_worst").isNotNull(), "High", "missing",
             F.format_string("Column '%s' is %s%% missing; remove or impute it.", F.col("_worst"), F.col("_worst_pct"))),
        Rule(F.col("duplicate_percentage") > 5, "Medium", "duplicates",
             F.format_string("%s%% exact duplicates found; deduplicate.", F.col("duplicate_percentage"))),
        Rule(F.col("convertible_columns") > 0, "Medium", "types",
             F.format_string("%d columns can be converted to better types.", F.col("convertible_columns"))),
        Rule(F.col("_empty") > 0, "Low", "columns",
             F.format_string("%d columns are mostly empty (>90%% missing); consider removing them.", F.col("_empty"))),
    ]
    r = rules(m, items)
    fallback = rules(m, [Rule(F.lit(True), "Info", "overall", "Data shows good quality across all checks.")])
    return r.unionByName(fallback.join(r.select("rule_no").limit(1), how="left_anti"))


def completeness_grade(missing_cols: DataFrame) -> DataFrame:
    """Q13: per-column completeness grade A >= 95, B >= 85, C >= 70, else D; ranked best first."""
    from pyspark.sql.window import Window
    comp = 100 - F.col("missing_percentage")
    g = F.when(comp >= 95, "A").when(comp >= 85, "B").when(comp >= 70, "C").otherwise("D")
    w = Window.orderBy(F.desc("completeness"), F.asc("column"))  # one row per column
    return (missing_cols.select("column", comp.alias("completeness"), g.alias("grade"))
            .withColumn("rank", F.row_number().over(w)))


def risk_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Q16 over all numeric columns: volatility = mean standard deviation; stability = 1 - mean variance / (mean of the
    means + 1); completeness of all cells; score = 0.3 volatility + 0.4 (1 - stability) + 0.3 missing %, within 0-100;
    level 30 / 70. Warnings: missing above 10%; which of the first three numeric columns have over 10% outliers."""
    cols = cols or numeric_columns(df)
    k = len(cols)
    mean = lambda p: reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{p}{i}"), F.lit(0.0)) for i in range(k)]) / F.greatest(
        F.lit(1), reduce(lambda a, b: a + b, [F.col(f"{p}{i}").isNotNull().cast("int") for i in range(k)]))
    mom = df.agg(*[f(col(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(cols)
                   for p, f in (("s", F.stddev_samp), ("v", F.var_samp), ("m", F.avg))],
                 (F.lit(100.0) - F.try_divide(reduce(lambda a, b: a + b, [_n_missing(df, c) for c in df.columns]) * 100.0,
                                              F.count(F.lit(1)) * len(df.columns))).alias("completeness"))
    one = mom.select(mean("s").alias("volatility"), (1 - F.try_divide(mean("v"), mean("m") + 1)).alias("trend_stability"), "completeness")
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("volatility") * 0.3 + (1 - F.col("trend_stability")) * 0.4
                                             + (100 - F.col("completeness")) * 0.3))
    one = one.withColumn("risk_score", score).withColumn(
        "risk_level", F.when(score < 30, "Low").when(score < 70, "Medium").otherwise("High"))
    warn = ranks_outliers(df, cols[:3]).filter(F.col("outliers_percentage") > 10).agg(
        F.count(F.lit(1)).alias("columns_with_many_outliers"))
    return attach(one, warn).withColumn("missing_warning", 100 - F.col("completeness") > 10)


def issue_counts(validation: DataFrame) -> DataFrame:
    """Q15: number of issues per column and its type class (the quality-dashboard feed)."""
    return validation.select("column", F.when(F.col("current_type") == "string", "text").otherwise("numeric")
                             .alias("type_class"), F.size("issues").alias("issue_count"))


def compare_quality(a: DataFrame, b: DataFrame, name_a: str = "A", name_b: str = "B") -> DataFrame:
    """Q14: the Q11 scores of two tables with a combined plan: missing score < 80, duplicate score < 90 or type score < 85
    on either table; overall scores more than 20 apart (naming the better and the worse); else one row of praise."""
    names = ["missing_data_score", "duplicate_score", "data_type_score", "overall_quality_score"]
    side = lambda df, t: quality_report(df).select(*[F.col(c).alias(f"{c}_{t}") for c in names])
    m = attach(side(a, "a"), side(b, "b"))
    below = lambda c, t: F.least(f"{c}_a", f"{c}_b") < t
    sa, sb = F.col("overall_quality_score_a"), F.col("overall_quality_score_b")

    def gap(x, nx, y, ny):
        return F.format_string(f"{nx} has significantly better quality (%.1f) than {ny} (%.1f). Focus improvement efforts on {ny}.", x, y)
    conds = [below("missing_data_score", 80), below("duplicate_score", 90), below("data_type_score", 85), sa - sb > 20, sb - sa > 20]
    items = [
        Rule(conds[0], "High", "Missing Data", "Both datasets have significant missing data. Consider data collection improvements or "
                                               "imputation strategies."),
        Rule(conds[1], "Medium", "Duplicates", "Implement data deduplication processes before analysis."),
        Rule(conds[2], "Medium", "Data Types", "Standardize data entry formats and implement type validation."),
        Rule(conds[3], "Medium", "Quality Gap", gap(sa, name_a, sb, name_b)),
        Rule(conds[4], "Medium", "Quality Gap", gap(sb, name_b, sa, name_a)),
        Rule(~reduce(lambda x, y: x | y, conds), "Info", "Excellent Overall Quality",
             "Both datasets show good quality metrics across all dimensions!"),
    ]
    return rules(m, items, keep=[c for c in m.columns])


