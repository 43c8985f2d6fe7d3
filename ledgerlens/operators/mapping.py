"""Suggest which column of table B corresponds to each column of table A.

Column names and types are schema metadata (a handful of strings per
table); everything computed from values - pattern shares and value overlap
over *all* values (no sample caps) - is distributed: one aggregate per table
for patterns, and one join on the value itself for the overlaps of every
column pair at once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import col
from ..functions.similarity import ratio
from .textpatterns import pattern_shares

# The reference's synonym families for column names.
SYNONYMS = {
    "name": ["name", "full_name", "customer_name", "client_name", "person_name", "user_name"],
    "email": ["email", "e_mail", "email_address", "mail", "contact_email"],
    "phone": ["phone", "telephone", "mobile", "contact_number", "phone_number"],
    "id": ["id", "identifier", "customer_id", "client_id", "user_id", "account_id"],
    "address": ["address", "street_address", "home_address", "mailing_address"],
    "date": ["date", "created_date", "modified_date", "birth_date", "registration_date"],
    "amount": ["amount", "price", "cost", "value", "total", "sum"],
    "status": ["status", "state", "condition", "stage"],
}
PATTERNS = ["email_pattern", "phone_pattern", "date_pattern", "number_pattern", "id_pattern", "name_pattern",
            "address_pattern"]


def _letters(s: str) -> str:
    return re.sub(r"[^a-z]", "", s.lower())


def semantic_score(a: str, b: str) -> float:
    """90 when both names contain a variant of the same family (both sides stripped to letters: D13), else 0."""
    ca, cb = _letters(a), _letters(b)
    for variants in SYNONYMS.values():
        vs = [_letters(v) for v in variants]
        if any(v in ca for v in vs) and any(v in cb for v in vs):
            return 90.0
    return 0.0


def value_overlap_parts(a: DataFrame, b: DataFrame):
    """J13 parts for every column pair: intersections of distinct lower-cased, trimmed values, and per-column distinct counts."""
    def long(df, tag):
        items = [F.struct(F.lit(c).alias(f"col_{tag}"), F.lower(F.trim(col(c).cast("string"))).alias("v")) for c in df.columns]
        return (df.select(F.explode(F.array(*items)).alias("x")).select("x.*").filter(F.col("v").isNotNull()).distinct())
    la, lb = long(a, "a"), long(b, "b")
    na = la.groupBy("col_a").agg(F.count(F.lit(1)).alias("n_a"))
    nb = lb.groupBy("col_b").agg(F.count(F.lit(1)).alias("n_b"))
    inter = la.join(lb, "v").groupBy("col_a", "col_b").agg(F.count(F.lit(1)).alias("overlap"))
    return inter, na, nb


def column_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Name (indel ratio of lower-cased names), semantic, pattern, type and value similarity and their weighted sum."""
    spark = a.sparkSession
    rows = []
    for i, ca in enumerate(a.columns):
        for j, cb in enumerate(b.columns):
            rows.append((i, j, ca, cb, float(ratio(ca.lower(), cb.lower())), semantic_score(ca, cb),
                         100.0 if a.schema[ca].dataType == b.schema[cb].dataType else 0.0))
    pairs = spark.createDataFrame(rows, "pos_a int, pos_b int, col_a string, col_b string, name_similarity double, "
                                        "semantic_similarity double, type_similarity double")
    pa = pattern_shares(a, a.columns).select(F.col("column").alias("col_a"), *[F.col(p).alias(f"a_{p}") for p in PATTERNS])
    pb = pattern_shares(b, b.columns).select(F.col("column").alias("col_b"), *[F.col(p).alias(f"b_{p}") for p in PATTERNS])
    inter, na, nb = value_overlap_parts(a, b)
    x = (pairs.join(F.broadcast(pa), "col_a", "left").join(F.broadcast(pb), "col_b", "left")
         .join(inter, ["col_a", "col_b"], "left").join(F.broadcast(na), "col_a", "left").join(F.broadcast(nb), "col_b", "left")
         .na.fill(0, ["overlap", "n_a", "n_b"]))
    pat = sum([F.when((F.col(f"a_{p}") > 10) & (F.col(f"b_{p}") > 10), F.least(F.col(f"a_{p}"), F.col(f"b_{p}")))
               .otherwise(0.0) for p in PATTERNS[1:]],
              F.when((F.col(f"a_{PATTERNS[0]}") > 10) & (F.col(f"b_{PATTERNS[0]}") > 10),
                     F.least(F.col(f"a_{PATTERNS[0]}"), F.col(f"b_{PATTERNS[0]}"))).otherwise(0.0))
    union = F.col("n_a") + F.col("n_b") - F.col("overlap")
    val = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0) | (union == 0), 0.0).otherwise(F.col("overlap") * 100.0 / union)
    x = x.withColumn("pattern_similarity", pat).withColumn("value_similarity", val)
    overall = (F.col("name_similarity") * 0.3 + F.col("semantic_similarity") * 0.2 + F.col("pattern_similarity") * 0.2
               + F.col("type_similarity") * 0.1 + F.col("value_similarity") * 0.2)
    return x.select("pos_a", "pos_b", "col_a", "col_b", overall.alias("overall_score"), "name_similarity",
                    "semantic_similarity", "pattern_similarity", "type_similarity", "value_similarity")


def reasons(sim: DataFrame) -> F.Column:
    """Reason strings for a mapping, joined with '; '."""
    r = F.filter(F.array(
        F.when(F.col("name_similarity") > 70, F.format_string("Column names are very similar (%d%% match)",
                                                              F.round("name_similarity").cast("int")))
        .when(F.col("name_similarity") > 40, F.format_string("Column names are somewhat similar (%d%% match)",
                                                             F.round("name_similarity").cast("int"))),
        F.when(F.col("semantic_similarity") > 80, F.lit("Columns appear to contain the same type of data")),
        F.when(F.col("pattern_similarity") > 30, F.format_string("Data patterns are similar (%d%% match)",
                                                                 F.round("pattern_similarity").cast("int"))),
        F.when(F.col("value_similarity") > 20, F.format_string("Contains overlapping values (%d%% overlap)",
                                                               F.round("value_similarity").cast("int"))),
        F.when(F.col("type_similarity") > 90, F.lit("Compatible data types"))), lambda x: x.isNotNull())
    return F.when(F.size(r) == 0, F.lit("Basic compatibility detected")).otherwise(F.array_join(r, "; "))


def suggest_mappings(a: DataFrame, b: DataFrame, top_n: int = 3, limit: int = 10) -> DataFrame:
    """Pairs scoring > 20, best ``top_n`` B columns per A column, then the best ``limit`` overall."""
    sim = column_similarity(a, b).filter(F.col("overall_score") > 20)
    # one row per column pair: windows over the (small) pair table
    w = Window.partitionBy("col_a").orderBy(F.desc("overall_score"), F.asc("pos_b"))
    per = sim.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_n)
    g = Window.orderBy(F.desc("overall_score"), F.asc("pos_a"), F.asc("pos_b"))
    return (per.withColumn("rank", F.row_number().over(g)).filter(F.col("rank") <= limit)
            .select("rank", "col_a", "col_b", F.col("overall_score").alias("confidence"), reasons(per).alias("reasons")))


def align_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer alignment by column name: missing % and type on each side, present-in-both flag, missing gap."""
    def prof(df, tag):
        one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
        st = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias(f"type_{tag}"),
                                          F.try_divide((F.col("_n") - F.col(f"c{i}")) * 100.0, F.col("_n")).alias(f"missing_{tag}"))
                                 for i, c in enumerate(df.columns)]))
        return one.select(st.alias("r")).select("r.*")
    j = prof(a, "a").join(prof(b, "b"), "column", "full")
    return j.withColumn("in_both", F.col("type_a").isNotNull() & F.col("type_b").isNotNull()).withColumn(
        "missing_difference", F.col("missing_a") - F.col("missing_b"))
