import math

from ledgerlens.functions.pvalues import betainc, ks_two_sided, normal_two_sided, t_two_sided
from ledgerlens.operators import twosample as H


def test_known_pvalues():
    assert abs(normal_two_sided(1.959963984540054) - 0.05) < 1e-9
    assert abs(t_two_sided(2.0, 10) - 0.07338803477074) < 1e-9
    assert abs(t_two_sided(2.228138851986, 10) - 0.05) < 1e-9
    assert abs(betainc(2.0, 3.0, 0.4) - 0.5248) < 1e-9
    assert 0.0 <= ks_two_sided(0.1, 100, 100) <= 1.0
    assert ks_two_sided(0.0, 10, 10) == 1.0


def test_t_and_mann_whitney_small(spark):
    a = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    b = spark.createDataFrame([(3.0,), (4.0,), (5.0,), (6.0,), (7.0,)], "x double")
    long = H.pooled_long(a, b, ["x"])
    t = H.t_test(long).collect()[0]
    m1, m2 = 2.5, 5.0
    v1, v2 = 5 / 3, 2.5
    sp = ((3 * v1 + 4 * v2) / 7) * (1 / 4 + 1 / 5)
    assert abs(t.t_statistic - (m1 - m2) / math.sqrt(sp)) < 1e-12
    u = H.mann_whitney(long).collect()[0]
    # pooled ranks: 1,2,3.5,5.5 for sample 1 -> R1 = 12, U1 = 12 - 10 = 2
    assert abs(u.u_statistic - 2.0) < 1e-12
    d = H.ks_test(long).collect()[0]
    assert abs(d.ks_statistic - 0.6) < 1e-12


def test_kendall_brute_force(spark):
    import itertools
    import random
    from collections import Counter
    from ledgerlens.operators.kendall import kendall_tau_b
    rnd = random.Random(8)
    rows = [(float(rnd.randint(0, 20)), float(rnd.randint(0, 6))) for _ in range(250)] + [(3.0, 2.0)] * 40
    df = spark.createDataFrame(rows, "a double, b double")
    r = kendall_tau_b(df, "a", "b").collect()[0]
    nc = sum(1 for p, q in itertools.combinations(rows, 2) if (p[0] - q[0]) * (p[1] - q[1]) > 0)
    nd = sum(1 for p, q in itertools.combinations(rows, 2) if (p[0] - q[0]) * (p[1] - q[1]) < 0)
    n = len(rows)
    n0 = n * (n - 1) / 2
    n1 = sum(t * (t - 1) / 2 for t in Counter(x for x, _ in rows).values())
    n2 = sum(t * (t - 1) / 2 for t in Counter(y for _, y in rows).values())
    assert (r.concordant, r.discordant) == (nc, nd)
    assert abs(r.tau_b - (nc - nd) / math.sqrt((n0 - n1) * (n0 - n2))) < 1e-12


def test_kendall_over_many_tasks_and_empty(spark):
    """Running totals are stitched over tasks; columns exchange freely; no rows and one value are defined."""
    import random
    from ledgerlens.operators.kendall import kendall_tau_b
    from ledgerlens.operators.profile import correlations
    rnd = random.Random(9)
    rows = [(float(rnd.randint(0, 60)), rnd.gauss(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double")
    nd = sum(1 for i, p in enumerate(rows) for q in rows[:i] if (p[0] - q[0]) * (p[1] - q[1]) < 0)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        one, two = kendall_tau_b(df, "a", "b").first(), kendall_tau_b(df, "b", "a").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert one["discordant"] == nd and one == two
    assert kendall_tau_b(df.limit(0), "a", "b").first()["tau_b"] is None
    assert kendall_tau_b(df.selectExpr("a", "1.0D AS b"), "a", "b").first()["tau_b"] is None
    assert correlations(df, ["a", "b"], "kendall").first()["r"] == one["tau_b"]


def test_exact_distributions_by_enumeration():
    """All ways to deal distinct values to two small samples."""
    import itertools
    from ledgerlens.functions.pvalues import ks_exact, mann_whitney_exact
    for n1, n2 in ((1, 3), (3, 3), (4, 3), (2, 6), (4, 4)):
        us, ds = [], []
        for mine in itertools.combinations(range(n1 + n2), n1):
            other = [k for k in range(n1 + n2) if k not in mine]
            us.append(sum(a > b for a in mine for b in other))
            ds.append(max(abs(sum(a <= k for a in mine) / n1 - sum(b <= k for b in other) / n2) for k in range(n1 + n2)))
        for u in set(us):
            high = max(u, n1 * n2 - u)
            want = min(1.0, 2 * sum(x >= high for x in us) / len(us))
            assert abs(mann_whitney_exact(u, n1, n2) - want) < 1e-12
        for d in set(ds):
            assert abs(ks_exact(d, n1, n2) - sum(x >= d - 1e-9 for x in ds) / len(ds)) < 1e-12


def test_the_rule_that_chooses_the_distribution(spark):
    """Mann-Whitney: exact if a sample has at most 8 values and no value repeats; Kolmogorov-Smirnov: up to 10,000 values."""
    from ledgerlens.functions import pvalues as pv
    a = spark.createDataFrame([(3 * k + 0.5, float(k % 2)) for k in range(6)], "x double, tied double")
    b = spark.createDataFrame([(float(2 * k * k + 1), float(k % 3)) for k in range(40)], "x double, tied double")
    rows = {r["column"]: r for r in H.compare_tests(a, b).collect()}
    assert abs(rows["x"]["mw_p_value"] - pv.mann_whitney_exact(rows["x"]["u_statistic"], 6, 40)) < 1e-12
    assert abs(rows["tied"]["mw_p_value"] - pv.normal_two_sided(rows["tied"]["z"])) < 1e-12
    assert all(abs(r["ks_p_value"] - pv.ks_exact(r["ks_statistic"], 6, 40)) < 1e-12 for r in rows.values())
    assert abs(pv.ks_exact(0.02, 9000, 10_000) - pv.ks_two_sided(0.02, 9000, 10_000)) < 2e-3
    big = pv.mann_whitney_exact(5 * 20_000 * 0.6, 5, 20_000)
    assert 0.4 < big < 0.5
