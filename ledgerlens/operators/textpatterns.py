"""Text pattern shares, pattern counts, key compatibility and matching advice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import col
from ..functions.rules import Rule, rules
from .frames import attach
from .profile import NUMERIC

# The reference's pattern regexes and indicator words.
EMAIL_RE = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_RE = r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
DATE_RE = r"\b\d{1,4}[-/]\d{1,2}[-/]\d{1,4}\b"
NUMBER_RE = r"^\d+\.?\d*$"
ID_RE = r"^[A-Za-z0-9]{4,20}$"
NAME_WORDS = ["john", "jane", "smith", "johnson", "brown", "davis", "miller", "wilson", "moore", "taylor"]
ADDRESS_WORDS = ["street", "st", "avenue", "ave", "road", "rd", "drive", "dr", "lane", "ln", "blvd"]
# The pattern-count regexes.
X2_PATTERNS = [("email", r"@\w+\.\w+"), ("phone", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"),
               ("date", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"), ("id", r"^[A-Za-z0-9]+$"), ("number", r"^\d+$")]


def _contains_any(low: F.Column, words: list[str]) -> F.Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | (F.instr(low, w) > 0)
    return cond


def pattern_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """X1 per column: % of non-null values showing each of seven patterns (all values, no sample cap)."""
    def flags(c):
        v = col(c).cast("string")
        low = F.lower(F.trim(v))
        return {
            "email_pattern": v.rlike(EMAIL_RE),
            "phone_pattern": v.rlike(PHONE_RE),
            "date_pattern": v.rlike(DATE_RE),
            "number_pattern": v.rlike(NUMBER_RE),
            "id_pattern": v.rlike(ID_RE) & v.rlike("[A-Za-z]") & v.rlike("[0-9]"),
            "name_pattern": _contains_any(low, NAME_WORDS) | v.rlike(r"\S+\s+\S+"),
            "address_pattern": _contains_any(low, ADDRESS_WORDS),
        }

    found = [(c, flags(c)) for c in cols]
    # one scan: a flag is null where the value is, so its mean is over the non-null values
    one = df.agg(*[(F.avg(flag.cast("int")) * 100).alias(f"{k}_{i}") for i, (_, named) in enumerate(found) for k, flag in named.items()])
    rows = [F.struct(F.lit(c).alias("column"), *[F.coalesce(F.col(f"{k}_{i}"), F.lit(0.0)).alias(k) for k in named])
            for i, (c, named) in enumerate(found)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pattern_counts(df: DataFrame, c: str) -> DataFrame:
    """Count and % of rows (of all rows) per pattern; only patterns that occur."""
    v = col(c).cast("string")
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.when(v.rlike(rx), 1).otherwise(0)).alias(name) for name, rx in X2_PATTERNS])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("pattern"), F.col(name).cast("long").alias("count"))
                               for name, _ in X2_PATTERNS]))
    x = one.select("_n", rows.alias("r")).select("_n", "r.*")
    return (x.filter(F.col("count") > 0)
            .select("pattern", "count", F.round(F.try_divide(F.col("count") * 100.0, F.col("_n")), 1).alias("percentage")))


def _type_class(dt) -> str:
    if isinstance(dt, T.StringType):
        return "text"
    if isinstance(dt, NUMERIC):
        return "numeric"
    return dt.simpleString()


def value_overlap(a: DataFrame, ca: str, b: DataFrame, cb: str) -> DataFrame:
    """Jaccard % of distinct lower-cased (trimmed) values; all values, no sample cap."""
    va = a.select(F.lower(F.trim(col(ca).cast("string"))).alias("v")).filter(F.col("v").isNotNull()).distinct()
    vb = b.select(F.lower(F.trim(col(cb).cast("string"))).alias("v")).filter(F.col("v").isNotNull()).distinct()
    na = va.agg(F.count(F.lit(1)).alias("n_a"))
    nb = vb.agg(F.count(F.lit(1)).alias("n_b"))
    inter = va.join(vb, "v").agg(F.count(F.lit(1)).alias("overlap"))
    x = attach(attach(na, nb), inter)
    union = F.col("n_a") + F.col("n_b") - F.col("overlap")
    return x.select("n_a", "n_b", "overlap", union.alias("total_unique"),
                    F.when(union > 0, F.col("overlap") * 100.0 / union).otherwise(0.0).alias("overlap_percentage"))


def compatibility(a: DataFrame, ca: str, b: DataFrame, cb: str) -> DataFrame:
    """Type relation of two key columns and value overlap band (>= 30 high, >= 10 medium, else low)."""
    ta, tb = a.schema[ca].dataType, b.schema[cb].dataType
    if ta == tb:
        rel = "identical types"
    elif _type_class(ta) == _type_class(tb) == "numeric":
        rel = "compatible numeric types"
    elif _type_class(ta) == _type_class(tb) == "text":
        rel = "both text"
    else:
        rel = "different types"
    ov = value_overlap(a, ca, b, cb)
    pct = F.col("overlap_percentage")
    return ov.select(F.lit(ta.simpleString()).alias("type_a"), F.lit(tb.simpleString()).alias("type_b"),
                     F.lit(rel).alias("type_relation"), "overlap", "total_unique", "overlap_percentage",
                     F.when(pct >= 30, "high").when(pct >= 10, "medium").otherwise("low").alias("overlap_band"))


def matching_advice(a: DataFrame, ca: str, b: DataFrame, cb: str, threshold: float) -> DataFrame:
    """Advice from null % (>20), key uniqueness vs threshold, mean length gap (>10) and threshold level."""
    def prof(df, c, tag):
        return df.agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.count(col(c)).alias(f"nn_{tag}"),
                      F.count_distinct(col(c)).alias(f"u_{tag}"),
                      F.avg(F.length(col(c).cast("string"))).alias(f"len_{tag}"))
    m = attach(prof(a, ca, "a"), prof(b, cb, "b"))
    both_text = isinstance(a.schema[ca].dataType, T.StringType) and isinstance(b.schema[cb].dataType, T.StringType)
    null_a = F.try_divide((F.col("n_a") - F.col("nn_a")) * 100.0, F.col("n_a"))
    null_b = F.try_divide((F.col("n_b") - F.col("nn_b")) * 100.0, F.col("n_b"))
    unique_all = (F.col("u_a") == F.col("n_a")) & (F.col("u_b") == F.col("n_b"))
    low_unique = (F.try_divide("u_a", "n_a") < 0.8) | (F.try_divide("u_b", "n_b") < 0.8)
    t = F.lit(float(threshold))
    items = [
        Rule((null_a > 20) | (null_b > 20), "High", "Data Cleaning",
             "High missing data detected; clean data before matching."),
        Rule(unique_all & (t < 90), "Medium", "Threshold",
             "Keys are unique on both sides; a threshold of 90%+ gives better precision."),
        Rule(~unique_all & low_unique & (t > 70), "Medium", "Threshold",
             "High duplicate rate; a threshold of 60-70% gives better recall."),
        Rule(F.lit(both_text) & (F.abs(F.col("len_a") - F.col("len_b")) > 10), "Low", "Strategy",
             "Large key length difference; consider multi-column matching."),
        Rule(F.lit(both_text) & (t < 80), "Low", "Performance",
             "Thresholds of 80%+ usually work well for names and IDs."),
    ]
    return rules(m, items)
