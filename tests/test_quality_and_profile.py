import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.dates import parse_date
from ledgerlens.operators import profile as P
from ledgerlens.operators import quality as Q


def test_null_runs_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 3), i, None if rnd.random() < 0.4 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, o int, v double")
    got = {r.g: (r.max_consecutive_missing, r.total_runs) for r in Q.null_runs(df, ["v"], ["o"], "g").collect()}
    for g in range(4):
        seq = [v is None for gg, o, v in sorted(rows, key=lambda x: x[1]) if gg == g]
        runs, cur = [], 0
        for x in seq:
            if x:
                cur += 1
            elif cur:
                runs.append(cur)
                cur = 0
        if cur:
            runs.append(cur)
        if runs:
            assert got[g] == (max(runs), len(runs))


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "x int, y string")
    r = Q.duplicates(df).collect()[0]
    assert (r.rows, r.duplicate_rows, r.unique_rows) == (6, 3, 3)


def test_edge_frames(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert P.shape(empty).collect()[0].total_rows == 0
    assert P.missing(empty).count() == 2
    one = spark.createDataFrame([(1.0, "x")], "a double, b string")
    d = P.describe(one, ["a"]).collect()[0]
    assert d["count"] == 1 and d["median"] == 1.0 and d["std_dev"] is None
    allnull = spark.createDataFrame([(None, "x"), (None, "y")], "a double, b string")
    m = {r.column: r.missing_count for r in P.missing(allnull).collect()}
    assert m == {"a": 2, "b": 0}
    nan = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "a double")
    assert P.missing(nan).collect()[0].missing_count == 2  # NaN counts as missing, like pandas isnull
    const = spark.createDataFrame([(2.0,), (2.0,), (2.0,)], "a double")
    h = P.histogram(const, ["a"], bins=4).orderBy("bin").collect()
    assert sum(r["count"] for r in h) == 3 and h[0].lower == 1.5


def test_clean_read_drops_empty(spark):
    from ledgerlens.sources.tables import clean_read
    df = spark.createDataFrame([(None, None), (1, None), (None, None)], "a int, b int")
    out = clean_read(df)
    assert out.columns == ["a"] and out.count() == 1


def test_ties_in_top_values(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), ("b",)], "x string")
    t = [r.value for r in P.top_values(df, ["x"], k=2).orderBy("rank").collect()]
    assert t == ["a", "b"]


def test_date_shape_precheck_is_lossless(spark):
    """Every value one of the fixed formats parses must pass the cheap shape test that guards the parser."""
    import datetime
    vals = []
    for d in [datetime.datetime(1995, 1, 2, 3, 4, 5), datetime.datetime(2001, 12, 31, 23, 59, 59)]:
        vals += [d.strftime(f) for _, f in Q.DATE_FORMATS]
    vals += ["$899,000", "yes", "1995-13-45", "2024/02/30", "u5@mail.com", " ", "12-31-1999"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    unguarded = F.coalesce(*[F.try_to_timestamp(F.col("v"), F.lit(f)) for f, _ in Q.DATE_FORMATS])
    rows = df.select("v", unguarded.isNotNull().alias("raw"), parse_date(F.col("v")).isNotNull().alias("guarded")).collect()
    assert all(r.raw == r.guarded for r in rows)
    assert sum(r.raw for r in rows) >= 10


@pytest.mark.parametrize("partitions", [1, 7])
def test_null_runs_across_tasks(spark, partitions):
    """Runs that cross the borders of tasks, all columns at once, against a plain walk; groups by text with null."""
    import random
    rnd = random.Random(partitions)
    rows, o = [], 0
    for g in ["a", "b", None, "c", "long"]:
        for _ in range(400 if g == "long" else 60):
            rows.append((g, o, None if rnd.random() < 0.5 else 1.0, None if g == "a" or rnd.random() < 0.9 else 2.0, 3.0))
            o += 1
    df = spark.createDataFrame(rows, "g string, o long, x double, y double, z double").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {(r["g"], r["column"]): (r["max_consecutive_missing"], r["total_runs"], r["avg_run_length"])
               for r in Q.null_runs(df, ["x", "y", "z"], ["o"], "g").collect()}
        whole = {r["column"]: (r["max_consecutive_missing"], r["total_runs"]) for r in Q.null_runs(df, ["x", "y"], ["o"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

    def runs(values):
        sizes, n = [], 0
        for v in [*values, 0]:
            if v is None:
                n += 1
            elif n:
                sizes.append(n)
                n = 0
        return sizes

    want = {}
    for g in ["a", "b", None, "c", "long"]:
        for k, c in enumerate("xyz", 2):
            if sizes := runs([r[k] for r in rows if r[0] == g]):
                want[g, c] = (max(sizes), len(sizes), sum(sizes) / len(sizes))
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)
    assert whole == {c: (max(s), len(s)) for c, s in (("x", runs([r[2] for r in rows])), ("y", runs([r[3] for r in rows])))}


def test_null_runs_take_one_exchange(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "id AS o", "if(id % 2 = 0, null, 1.0D) AS x", "if(id % 5 = 0, null, 1.0D) AS y")
    plan = Q.null_runs(df, ["x", "y"], ["o"], "g")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and plan.count("Exchange") <= 2
