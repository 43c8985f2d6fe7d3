"""Queries for the two-sample tests (H1-H7): lineitem rows with return flag 'A' against 'R'."""

from __future__ import annotations

from ..operators import twosample as H
from ..sources.fixtures import fixture
from .common import round_doubles, sig
from .q_profile import W
from .registry import register

COLS = ["quantity", "price", "discount", "tax"]
_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {s} AS sample, CAST({c} AS DOUBLE) + 0.0 AS value FROM {t} WHERE {c} IS NOT NULL"
    for c in COLS for s, t in ((1, "fx_sample_a"), (2, "fx_sample_r")))


def S(x, alias=None):
    return f"{sig(x)} AS {alias or x}"


def samples(spark, sf):
    return fixture(spark, sf, "fx_sample_a"), fixture(spark, sf, "fx_sample_r")


def WT(body, ctes=()):
    return W(body, "fx_sample_a", "fx_sample_r", ctes=(("l", _LONG),) + tuple(ctes))


@register("H1_ttest_statistics", WT(f"""
SELECT "column", n1, n2, {S('mean1')}, {S('mean2')}, {S('mean2 - mean1', 'mean_difference')},
  {S('(mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))', 't_statistic')},
  CAST(n1 + n2 - 2 AS DOUBLE) AS dof
FROM (SELECT "column", count(*) FILTER (WHERE sample = 1) AS n1, count(*) FILTER (WHERE sample = 2) AS n2,
  avg(value) FILTER (WHERE sample = 1) AS mean1, avg(value) FILTER (WHERE sample = 2) AS mean2,
  var_samp(value) FILTER (WHERE sample = 1) AS v1, var_samp(value) FILTER (WHERE sample = 2) AS v2 FROM l GROUP BY 1)"""))
def q_h1(spark, sf):
    a, b = samples(spark, sf)
    return round_doubles(H.t_test(H.pooled_long(a, b, COLS)))


@register("H2_pooled_average_ranks", WT(f"""
SELECT "column", value, cnt, {S('before + (cnt + 1) / 2.0', 'avg_rank')} FROM (
  SELECT "column", value, cnt, coalesce(sum(cnt) OVER (PARTITION BY "column" ORDER BY value
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT "column", value, count(*) AS cnt FROM l GROUP BY 1, 2))"""))
def q_h2(spark, sf):
    a, b = samples(spark, sf)
    return round_doubles(H.pooled_ranks(H.pooled_long(a, b, COLS)))


@register("H3_mann_whitney", WT(f"""
SELECT "column", {S('u1', 'u_statistic')},
  {S('(greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))', 'z')},
  CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2 FROM (
  SELECT "column", r1 - n1 * (n1 + 1) / 2 AS u1, n1, n - n1 AS n2, n, ties FROM (
    SELECT "column", sum(c1 * avg_rank) AS r1, CAST(sum(c1) AS DOUBLE) AS n1, CAST(sum(cnt) AS DOUBLE) AS n,
      sum(pow(cnt, 3) - cnt) AS ties FROM (
      SELECT "column", value, cnt, c1, coalesce(sum(cnt) OVER (PARTITION BY "column" ORDER BY value
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (cnt + 1) / 2.0 AS avg_rank
      FROM (SELECT "column", value, count(*) AS cnt, count(*) FILTER (WHERE sample = 1) AS c1 FROM l GROUP BY 1, 2))
    GROUP BY 1))"""))
def q_h3(spark, sf):
    a, b = samples(spark, sf)
    return round_doubles(H.mann_whitney(H.pooled_long(a, b, COLS)))


@register("H4_ks_statistic", WT(f"""
SELECT "column", {S('max(abs(f1 - f2))', 'ks_statistic')}, max(n1) AS n1, max(n2) AS n2 FROM (
  SELECT "column", sum(c1) OVER w / sum(c1) OVER (PARTITION BY "column") AS f1,
    sum(c2) OVER w / sum(c2) OVER (PARTITION BY "column") AS f2,
    CAST(sum(c1) OVER (PARTITION BY "column") AS BIGINT) AS n1, CAST(sum(c2) OVER (PARTITION BY "column") AS BIGINT) AS n2
  FROM (SELECT "column", value, count(*) FILTER (WHERE sample = 1) AS c1, count(*) FILTER (WHERE sample = 2) AS c2
    FROM l GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY "column" ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
GROUP BY 1"""))
def q_h4(spark, sf):
    a, b = samples(spark, sf)
    return round_doubles(H.ks_test(H.pooled_long(a, b, COLS)))


@register("H6_compare_tests", None)
def q_h6(spark, sf):
    """H6: t / Mann-Whitney / KS statistics with p-values (p-values have no SQL oracle)."""
    a, b = samples(spark, sf)
    return round_doubles(H.compare_tests(a, b, COLS))


@register("H7_significance_counts", None)
def q_h7(spark, sf):
    a, b = samples(spark, sf)
    return H.significance_counts(H.compare_tests(a, b, COLS))


_H6_CTES = (
    ("t", """SELECT "column", n1, n2, mean1, mean2, mean2 - mean1 AS mean_difference, n1 + n2 - 2 AS dof,
      (mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t_statistic
      FROM (SELECT "column", count(*) FILTER (sample = 1) AS n1, count(*) FILTER (sample = 2) AS n2, avg(value) FILTER (sample = 1) AS mean1,
        avg(value) FILTER (sample = 2) AS mean2, var_samp(value) FILTER (sample = 1) AS v1, var_samp(value) FILTER (sample = 2) AS v2 FROM l GROUP BY 1)"""),
    ("c", """SELECT "column", value, count(*) AS cnt, count(*) FILTER (sample = 1) AS c1, count(*) FILTER (sample = 2) AS c2 FROM l GROUP BY 1, 2"""),
    ("r", """SELECT *, sum(cnt) OVER w - cnt + (cnt + 1) / 2.0 AS rk, sum(c1) OVER w AS s1, sum(c2) OVER w AS s2, sum(c1) OVER p AS n1, sum(c2) OVER p AS n2
      FROM c WINDOW w AS (PARTITION BY "column" ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY "column")"""),
    ("u", """SELECT "column", sum(c1 * rk) - any_value(n1) * (any_value(n1) + 1) / 2 AS u1, any_value(n1)::DOUBLE AS n1, any_value(n2)::DOUBLE AS n2,
      sum(pow(cnt, 3) - cnt) AS ties, max(abs(s1 / n1 - s2 / n2)) AS ks FROM r GROUP BY 1"""))


@register("H6_test_statistics", WT(f"""
SELECT "column", t.n1, t.n2, {S('mean1')}, {S('mean2')}, {S('mean_difference')}, {S('t_statistic')}, CAST(dof AS DOUBLE) AS dof,
  {S('u1', 'u_statistic')}, {S('(greatest(u1, u.n1 * u.n2 - u1) - u.n1 * u.n2 / 2 - 0.5) / sqrt(u.n1 * u.n2 / 12 * ((u.n1 + u.n2 + 1) - ties / ((u.n1 + u.n2) * (u.n1 + u.n2 - 1))))', 'z')},
  {S('ks', 'ks_statistic')} FROM t JOIN u USING ("column")""", ctes=_H6_CTES))
def q_h6s(spark, sf):
    """H6 without its p-values, which pytest compares with published values."""
    a, b = samples(spark, sf)
    return round_doubles(H.compare_tests(a, b, COLS).select(
        "column", "n1", "n2", "mean1", "mean2", "mean_difference", "t_statistic", "dof", "u_statistic", "z", "ks_statistic"))
