import numpy as np
import pandas as pd
import pytest

from ledgerlens.operators import consolidate, profile, quality


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one value; nulls, NaN, both zeros, an empty column, text that looks like numbers and dates."""
    rng = np.random.default_rng(5)
    n = 900
    x = np.where(rng.random(n) < 0.34, 7.0, rng.normal(0, 30, n).round(1))
    rows = [(int(i), None if i % 11 == 0 else float("nan") if i % 13 == 0 else -0.0 if i % 17 == 0 else float(x[i]),
             int(rng.integers(0, 5)), str(i % 40), f"2024-01-{1 + i % 28:02d}", None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, k int, s string, d string, e string").repartition(7)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_describe_and_outliers_against_pandas(skewed):
    pdf = skewed.select("id", "x", "k").toPandas()
    got = {r["column"]: r for r in profile.describe(skewed, ["x", "k"]).collect()}
    out = {r["column"]: r for r in profile.outliers(skewed, ["x", "k"]).collect()}
    for c in ("x", "k"):
        v = pdf[c].dropna().astype(float)
        q1, med, q3 = v.quantile([0.25, 0.5, 0.75])
        r, o = got[c], out[c]
        assert r["count"] == len(v) and r["mode"] == v.mode().min()
        np.testing.assert_allclose([r["mean"], r["std_dev"], r["q1"], r["median"], r["q3"]], [v.mean(), v.std(), q1, med, q3], atol=1e-9)
        np.testing.assert_allclose([r["skewness"], r["kurtosis"]], [((v - v.mean()) ** 3).mean() / v.std(ddof=0) ** 3,
                                                                    ((v - v.mean()) ** 4).mean() / v.std(ddof=0) ** 4 - 3], rtol=1e-9)
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert o["outliers_count"] == ((v < low) | (v > high)).sum() and o["unique_values"] == v.nunique()
        assert (o["zeros_count"], o["negative_count"], o["positive_count"]) == ((v == 0).sum(), (v < 0).sum(), (v > 0).sum())


def test_moments_of_constant_and_single_values(spark):
    df = spark.createDataFrame([(0.1, 5.0 if i == 0 else None, None) for i in range(3)], "c double, one double, none double")
    got = {r["column"]: r for r in profile.describe(df).collect()}
    assert set(got) == {"c", "one"}
    assert (got["c"]["mean"], got["c"]["variance"], got["c"]["skewness"], got["c"]["kurtosis"]) == (0.1, 0.0, None, None)
    assert (got["one"]["count"], got["one"]["mean"], got["one"]["std_dev"]) == (1, 5.0, None)


def test_types_uniques_and_catalogue_agree(skewed):
    types = {r["column"]: r for r in profile.data_types(skewed).collect()}
    assert {c: r["recommended_type"] for c, r in types.items()} == {
        "id": "numeric", "x": "numeric", "k": "numeric", "s": "numeric", "d": "datetime",
        "e": "High null percentage - consider data cleaning"}
    assert types["e"]["unique_values"] == 0 and types["e"]["sample_values"] is None and types["s"]["sample_values"] == ["0", "1", "10"]
    unique = {c: skewed.select(c).dropna().distinct().count() for c in ("id", "k", "s", "d", "e")}
    sheets = {r["column"]: r["unique_values"] for r in consolidate.catalogue({"t": skewed}).collect()}
    twice = {r["column"]: r["duplicate_count"] for r in quality.column_duplicates(skewed, list(unique)).collect()}
    for c, u in unique.items():
        assert types[c]["unique_values"] == sheets[c] == u
        assert twice[c] == 900 - u - (c == "e")


def test_values_that_look_alike_stay_apart(spark):
    df = spark.createDataFrame([(["a", "b"], bytearray(b"\xff"), 0.0), (["a, b"], bytearray(b"\xfe"), -0.0), (None, None, None)],
                               "l array<string>, b binary, z double")
    assert {r["column"]: r["unique_values"] for r in profile.unique_counts(df, df.columns).collect()} == {"l": 2, "b": 2, "z": 1}


def test_no_expand_and_one_core(skewed):
    for df in (profile.describe(skewed, ["x", "k"]), profile.outliers(skewed, ["x", "k"]), profile.data_types(skewed),
               quality.column_duplicates(skewed), quality.key_candidates(skewed), consolidate.catalogue({"t": skewed})):
        assert "Expand" not in plan(df)
    parts = profile.analyze_table(skewed)
    assert {"types", "descriptive", "outliers", "box", "categorical"} <= set(parts)
    assert pd.Series([r["column"] for r in parts["box"].collect()]).is_unique
    assert "Scan ExistingRDD" in plan(parts["outliers"]) and "Generate" not in plan(parts["outliers"])
