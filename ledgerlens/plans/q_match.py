"""Queries for record matching (J1-J7) over the part-derived key fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.match import match, match_batch, match_multi
from ..sources.fixtures import FIXTURE_SQL, fixture
from .common import round_doubles, sig, sql_norm
from .registry import register
from .sqlparts import build, fuzzy_best_ctes

T = 80


def fx(*names):
    return [(n, FIXTURE_SQL[n]) for n in names]


def match_result_ctes(t: float = T) -> list[tuple[str, str]]:
    """Oracle CTEs ending in ``mres``: the J1-J4 result of fx_match_a against fx_match_b on ``item``."""
    return fx("fx_match_a", "fx_match_b") + [
        ("ma", f"SELECT id, item, name, brand, price, {sql_norm('item')} AS k FROM fx_match_a"),
        ("mb", f"SELECT id, item, size, {sql_norm('item')} AS k FROM fx_match_b"),
        ("bk", "SELECT k, min(id) AS pos, arg_max(item, id) AS orig, arg_max(id, id) AS bid, arg_max(size, id) AS bsize "
               "FROM mb GROUP BY k"),
        ("ak", "SELECT DISTINCT k FROM ma"),
        ("ex", "SELECT k, k AS bk, CAST(100.0 AS DOUBLE) AS score, 'Exact' AS t FROM ak WHERE k IN (SELECT k FROM bk)"),
        ("rest", "SELECT k FROM ak WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM bk WHERE k IS NOT NULL)"),
    ] + fuzzy_best_ctes("rest", "bk", t) + [
        ("res", "SELECT k, bk, score, t FROM ex UNION ALL SELECT k, bk, score, 'Fuzzy' AS t FROM fz_best"),
        ("mres", "SELECT ma.id, ma.item, ma.name, ma.brand, ma.price, bk.bid AS SheetB_id, bk.bsize AS size, "
                 "coalesce(res.t, 'No Match') AS match_type, coalesce(res.score, 0.0) AS similarity_score, "
                 "CAST(bk.orig AS VARCHAR) AS matched_key, "
                 "CASE WHEN res.t = 'Exact' THEN 'matched' WHEN res.score >= 90 THEN 'matched' "
                 "WHEN res.t IS NOT NULL THEN 'suggested' ELSE 'unmatched' END AS category "
                 "FROM ma LEFT JOIN res ON ma.k = res.k LEFT JOIN bk ON bk.k = res.bk"),
    ]


def match_items(spark, sf, threshold=T):
    a = fixture(spark, sf, "fx_match_a")
    b = fixture(spark, sf, "fx_match_b")
    return match(a, b, "item", "item", extract=["id", "size"], threshold=threshold, b_order="id")


@register("J4_match_items", build(
    "SELECT id, item, SheetB_id, size, match_type, SIGSCORE AS similarity_score, matched_key, "
    "category FROM mres".replace("SIGSCORE", sig("similarity_score")), match_result_ctes()))
def q_match_items(spark, sf):
    """Exact then fuzzy best match of every A row, categorised."""
    r = match_items(spark, sf)
    return round_doubles(r.select("id", "item", "SheetB_id", "size", "match_type", "similarity_score",
                                  "matched_key", "category"))


@register("J2_exact_join_orders_customers", """
SELECT o.o_orderkey AS o_orderkey, o.o_custkey AS o_custkey, c.c_name AS c_name, c.c_mktsegment AS c_mktsegment,
  CASE WHEN c.c_custkey IS NULL THEN 'No Match' ELSE 'Exact' END AS match_type
FROM orders o LEFT JOIN (
  SELECT lower(CAST(c_custkey AS VARCHAR)) AS k, arg_max(c_name, c_custkey) AS c_name,
    arg_max(c_mktsegment, c_custkey) AS c_mktsegment, max(c_custkey) AS c_custkey FROM customer GROUP BY 1) c
ON lower(CAST(o.o_custkey AS VARCHAR)) = c.k""")
def q_exact_orders(spark, sf):
    """J1+J2: exact key match of orders.o_custkey to customer (threshold 100 disables fuzzy)."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    c = spark.read.parquet(f"{sf}/customer.parquet")
    r = match(o, c, "o_custkey", "c_custkey", extract=["c_name", "c_mktsegment"], threshold=100.01,
              b_order="c_custkey")
    return r.select("o_orderkey", "o_custkey", "c_name", "c_mktsegment", "match_type")


MULTI_SQL = build("""
SELECT id, item, match_type, SIGSCORE AS similarity_score, m_name, m_brand, m_id, category,
  SIGSN AS s_name, SIGSB AS s_brand
FROM mm""", fx("fx_match_a", "fx_match_b") + [
    ("ma", f"SELECT id, item, coalesce({sql_norm('name')}, 'nan') AS v0, coalesce({sql_norm('brand')}, 'nan') AS v1 "
           "FROM fx_match_a"),
    ("mb", f"SELECT id, name, brand, coalesce({sql_norm('name')}, 'nan') AS v0, coalesce({sql_norm('brand')}, 'nan') AS v1 "
           "FROM fx_match_b"),
    ("bt", "SELECT v0, v1, min(id) AS pos, arg_min(name, id) AS oname, arg_min(brand, id) AS obrand, "
           "arg_min(id, id) AS bid FROM mb GROUP BY v0, v1"),
    ("atp", "SELECT DISTINCT v0, v1 FROM ma"),
    ("ex", "SELECT v0, v1, v0 AS w0, v1 AS w1, CAST(100.0 AS DOUBLE) AS score, 'Multi-Field Exact' AS t, "
           "CAST(100.0 AS DOUBLE) AS s0, CAST(100.0 AS DOUBLE) AS s1 FROM atp SEMI JOIN bt USING (v0, v1)"),
    ("rest", "SELECT v0, v1 FROM atp ANTI JOIN bt USING (v0, v1)"),
    ("r0", "SELECT DISTINCT v0 AS k FROM rest"), ("k0", "SELECT DISTINCT v0 AS k, 0 AS pos FROM bt"),
    ("r1", "SELECT DISTINCT v1 AS k FROM rest"), ("k1", "SELECT DISTINCT v1 AS k, 0 AS pos FROM bt"),
] + fuzzy_best_ctes("r0", "k0", T, "f0")[:-1] + fuzzy_best_ctes("r1", "k1", T, "f1")[:-1] + [
    ("cand", "SELECT r.v0, r.v1, b.v0 AS w0, b.v1 AS w1 FROM rest r JOIN f0_ok o ON o.ka = r.v0 JOIN bt b ON b.v0 = o.kb "
             "UNION SELECT r.v0, r.v1, b.v0, b.v1 FROM rest r JOIN f1_ok o ON o.ka = r.v1 JOIN bt b ON b.v1 = o.kb"),
    ("sc", "SELECT c.*, CASE WHEN length(v0) + length(w0) = 0 THEN 100.0 ELSE "
           "CAST(" + "LCS0" + " AS DOUBLE) * 200 / (length(v0) + length(w0)) END AS s0, "
           "CASE WHEN length(v1) + length(w1) = 0 THEN 100.0 ELSE "
           "CAST(" + "LCS1" + " AS DOUBLE) * 200 / (length(v1) + length(w1)) END AS s1 FROM cand c"),
    ("sc2", "SELECT sc.*, s0 * 0.5 + s1 * 0.5 AS score, bt.pos FROM sc JOIN bt ON bt.v0 = sc.w0 AND bt.v1 = sc.w1 "
            "WHERE s0 * 0.5 + s1 * 0.5 >= 80"),
    ("fz", "SELECT v0, v1, w0, w1, score, CASE WHEN score >= 90 THEN 'Multi-Field High Confidence' "
           "ELSE 'Multi-Field Suggested' END AS t, s0, s1 FROM sc2 "
           "QUALIFY row_number() OVER (PARTITION BY v0, v1 ORDER BY score DESC, pos) = 1"),
    ("res", "SELECT * FROM ex UNION ALL SELECT * FROM fz"),
    ("mm", "SELECT ma.id, ma.item, coalesce(res.t, 'No Multi-Field Match') AS match_type, res.score AS similarity_score, "
           "bt.oname AS m_name, bt.obrand AS m_brand, bt.bid AS m_id, res.s0 AS s_name, res.s1 AS s_brand, "
           "CASE WHEN res.t = 'Multi-Field Exact' THEN 'matched' WHEN res.score >= 90 THEN 'matched' "
           "WHEN res.t IS NOT NULL THEN 'suggested' ELSE 'unmatched' END AS category "
           "FROM ma LEFT JOIN res ON ma.v0 = res.v0 AND ma.v1 = res.v1 LEFT JOIN bt ON bt.v0 = res.w0 AND bt.v1 = res.w1"),
])


def _lcs_fill(sql: str) -> str:
    from .sqlparts import lcs_sql
    return sql.replace("LCS0", lcs_sql("v0", "w0")).replace("LCS1", lcs_sql("v1", "w1"))


J6_SQL = (_lcs_fill(MULTI_SQL).replace("SIGSCORE", sig("similarity_score")).replace("SIGSN", sig("s_name"))
          .replace("SIGSB", sig("s_brand")))


@register("J6_match_multi_name_brand", J6_SQL)
def q_match_multi(spark, sf):
    """Two-field (name, brand) exact, else weighted fuzzy best match with breakdown."""
    a = fixture(spark, sf, "fx_match_a")
    b = fixture(spark, sf, "fx_match_b")
    r = match_multi(a, b, ["name", "brand"], ["name", "brand"], extract=["id"], threshold=T, b_order="id")
    bd = F.col("field_breakdown")
    return round_doubles(r.select(
        "id", "item", "match_type", "similarity_score",
        F.col("matched_keys.name").alias("m_name"), F.col("matched_keys.brand").alias("m_brand"),
        F.col("SheetB_id").alias("m_id"), "category",
        F.element_at(bd, 1).getField("score").alias("s_name"), F.element_at(bd, 2).getField("score").alias("s_brand")))


J7_SQL = build("""
SELECT target AS _target, sum(n) AS rows, sum(CASE WHEN t = 'Exact' THEN n ELSE 0 END) AS exact,
  sum(CASE WHEN t = 'Fuzzy' AND score >= 90 THEN n ELSE 0 END) AS fuzzy_matched,
  sum(CASE WHEN t = 'Fuzzy' AND score < 90 THEN n ELSE 0 END) AS suggested,
  sum(CASE WHEN t IS NULL THEN n ELSE 0 END) AS unmatched,
  round((sum(CASE WHEN t = 'Exact' THEN n ELSE 0 END) + sum(CASE WHEN t = 'Fuzzy' AND score >= 90 THEN n ELSE 0 END))
    * 100.0 / sum(n), 2) AS match_rate
FROM (SELECT a.target, a.n, CASE WHEN a.k IS NULL THEN nu.t ELSE r.t END AS t, r.score FROM ak2 a LEFT JOIN res r ON r.k = a.tk
  LEFT JOIN (SELECT DISTINCT target, 'Exact' AS t FROM fx_batch WHERE item IS NULL) nu ON nu.target = a.target) GROUP BY target""",
    fx("fx_match_a", "fx_batch") + [
        ("ak0", f"SELECT {sql_norm('item')} AS k, count(*) AS n FROM fx_match_a GROUP BY 1"),
        ("ak2", "SELECT t.target || chr(1) || k AS tk, k, n, t.target FROM ak0, "
                "(VALUES ('T0'), ('T1'), ('T2')) AS t(target)"),
        ("bk", f"SELECT target || chr(1) || {sql_norm('item')} AS k, min(id) AS pos FROM fx_batch WHERE item IS NOT NULL GROUP BY 1"),
        ("ex", "SELECT tk AS k, CAST(100.0 AS DOUBLE) AS score, 'Exact' AS t FROM ak2 WHERE tk IN (SELECT k FROM bk)"),
        ("rest0", "SELECT tk AS k, target FROM ak2 WHERE tk NOT IN (SELECT k FROM bk)"),
        ("rest", "SELECT k FROM rest0"),
        ("fzp", "SELECT r.k AS ka, b.k AS kb FROM rest0 r JOIN bk b ON split_part(b.k, chr(1), 1) = r.target"),
    ] + [("fz_pairs", "SELECT ka, kb, la, lb, pos FROM (SELECT r.k AS ka, b.k AS kb, "
                      "length(split_part(r.k, chr(1), 2)) AS la, length(split_part(b.k, chr(1), 2)) AS lb, b.pos "
                      "FROM rest0 r JOIN bk b ON split_part(b.k, chr(1), 1) = r.target) "
                      "WHERE least(la, lb) * 200.0 >= 80.0 * (la + lb)"),
         ("fz_ca", "SELECT k, c, count(*) AS n FROM (SELECT k, unnest(string_split(split_part(k, chr(1), 2), '')) AS c "
                   "FROM rest) GROUP BY k, c"),
         ("fz_cb", "SELECT k, c, count(*) AS n FROM (SELECT k, unnest(string_split(split_part(k, chr(1), 2), '')) AS c "
                   "FROM bk) GROUP BY k, c"),
         ("fz_ov", "SELECT p.ka, p.kb, sum(least(x.n, y.n)) AS o FROM fz_pairs p JOIN fz_ca x ON x.k = p.ka "
                   "JOIN fz_cb y ON y.k = p.kb AND y.c = x.c GROUP BY p.ka, p.kb"),
         ("fz_sc", "SELECT p.ka, p.kb, p.pos, p.la + p.lb AS n, LCSB AS l FROM fz_pairs p JOIN fz_ov o "
                   "ON o.ka = p.ka AND o.kb = p.kb WHERE o.o * 200.0 >= 80.0 * (p.la + p.lb)"),
         ("fz_best", "SELECT ka AS k, kb AS bk, CAST(l AS DOUBLE) * 200 / n AS score FROM fz_sc WHERE l * 200.0 >= 80.0 * n "
                     "QUALIFY row_number() OVER (PARTITION BY ka ORDER BY CAST(l AS DOUBLE) * 200 / n DESC, pos) = 1"),
         ("res", "SELECT k, score, t FROM ex UNION ALL SELECT k, score, 'Fuzzy' FROM fz_best")]).replace(
    "LCSB", __import__("ledgerlens.plans.sqlparts", fromlist=["lcs_sql"]).lcs_sql(
        "split_part(p.ka, chr(1), 2)", "split_part(p.kb, chr(1), 2)"))


@register("J7_batch_targets", J7_SQL)
def q_batch(spark, sf):
    """fx_match_a against three target sheets in one job."""
    a = fixture(spark, sf, "fx_match_a")
    t = fixture(spark, sf, "fx_batch")
    return match_batch(a, t, "item", "item", target_names=["T0", "T1", "T2"], target_col="target",
                       threshold=T, target_order="id").withColumnRenamed("target", "_target")
