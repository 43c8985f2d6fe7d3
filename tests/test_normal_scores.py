from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators.normal_scores import inverse_normal, shapiro_francia


def brute(x):
    x = np.sort(np.asarray(x, float))
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    w = ((x - x.mean()) @ m) ** 2 / ((m @ m) * ((x - x.mean()) ** 2).sum())
    u, v = np.log(n), np.log(np.log(n))
    z = (np.log(1 - w) - (-1.2725 + 1.0521 * (v - u))) / (1.0308 - 0.26758 * (v + 2 / u))
    return w, z, 1 - NormalDist().cdf(z)


def test_inverse_normal(spark):
    ps = [1e-300, 1e-40, 1e-12, 1e-5, 0.01, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.9249, 0.9251, 0.999, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", inverse_normal(F.col("p")).alias("x")).collect()
    np.testing.assert_allclose([r["x"] for r in got], [NormalDist().inv_cdf(r["p"]) for r in got], rtol=1e-13, atol=1e-15)


def test_columns_against_numpy(spark):
    """Normal, uniform and skewed columns, one of few values, one with a third of its rows in one value, empty and constant ones."""
    rng = np.random.default_rng(3)
    n = 5000
    data = {"normal": rng.normal(5, 2, n), "uniform": rng.random(n), "skewed": rng.exponential(1, n), "few": rng.integers(0, 6, n) * 1.0,
            "hot": np.where(rng.random(n) < 0.34, 1.5, rng.normal(0, 1, n))}
    rows = [(*[float(v[i]) if i % 50 else None for v in data.values()], 4.0, None, float(i) if i < 7 else float("nan")) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*data, "constant", "empty", "seven"]))
    got = {r["column"]: r for r in shapiro_francia(df, chunk=64).collect()}
    for c, v in data.items():
        kept = [v[i] for i in range(n) if i % 50]
        w, z, p = brute(kept)
        assert got[c]["count"] == len(kept)
        np.testing.assert_allclose([got[c]["w"], got[c]["z"]], [w, z], rtol=1e-8)
        np.testing.assert_allclose(got[c]["p_value"], p, atol=1e-9)
        assert got[c]["is_normal"] == (p > 0.05)
    assert got["normal"]["is_normal"] and not got["uniform"]["is_normal"]
    assert "empty" not in got
    for c in ("constant", "seven"):
        assert got[c]["w"] is None and got[c]["p_value"] is None and got[c]["is_normal"] is None
