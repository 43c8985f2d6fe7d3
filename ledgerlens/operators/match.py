"""Exact and fuzzy record matching of table A against table B.

Plan shape (single column, ``match``):

1. build side (J1): B grouped by normalised key; the key's position is its
   first row, its payload the *last* row (``max_by``), as in the reference's
   dictionary build. Partial aggregation makes a hot key cheap.
2. exact (J2): distinct A keys semi-joined to B keys.
3. fuzzy (J3): remaining distinct A keys against all distinct B keys through
   the lossless candidate join; best by (score desc, B position asc).
4. classify (J4) and join the resolved key map back to every A row: the only
   row-level join, on the normalised key (AQE broadcasts the map when it is
   small and splits skewed A partitions otherwise).

No fuzzy work is ever repeated for duplicate keys, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from ..functions.similarity import indel_ratio

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import col, norm_key
from .candidates import _ids, scored_pairs
from .ranks import _checkpoint
from .segments import best_matches

MATCHED, SUGGESTED, UNMATCHED = "matched", "suggested", "unmatched"


def _order_expr(df: DataFrame, order_by) -> F.Column:
    if order_by is None:  # by content, whatever the partitioning; rows that tie are equal
        return F.to_json(F.struct(*[col(c) for c in df.columns]))
    if isinstance(order_by, str):
        return col(order_by)
    cols = list(order_by)
    return col(cols[0]) if len(cols) == 1 else F.struct(*[col(c) for c in cols])


def _extract_names(a_cols, extract, prefix):
    return {c: (f"{prefix}{c}" if c in a_cols else c) for c in extract}


def _block_expr(block):
    return F.lit(0) if block is None else col(block).cast("string")


def build_side(b: DataFrame, key_b: str, extract=(), ignore_case: bool = True, b_order=None,
               null_keys: str = "match", block=None) -> DataFrame:
    """One row per (block, normalised B key): first-seen position and the last row's payload."""
    kb = b.select(_block_expr(block).alias("_blk"), norm_key(key_b, ignore_case).alias("_k"), col(key_b).alias("_orig"),
                  _order_expr(b, b_order).alias("_pos"), *[col(c).alias(c) for c in extract])
    if null_keys == "never":
        kb = kb.filter(F.col("_k").isNotNull())
    return kb.groupBy("_blk", "_k").agg(
        F.min("_pos").alias("_pos"),
        F.max_by(F.struct("_orig", *[F.col(f"`{c}`") for c in extract]), "_pos").alias("_payload"))


def best_fuzzy(a_keys: DataFrame, b_keys: DataFrame, threshold: float, native: bool = False, method: str = "index") -> DataFrame:
    """For each A key, the best B key at or above ``threshold``; ties go to the first B key.

    ``a_keys``: (_blk, _k) distinct; ``b_keys``: (_blk, _k, _pos). Output (_blk, _k, _bk, _score). ``method``: 'index' (inverted
    index of segments, rising threshold), or 'grid' / 'prefix' of ``candidates``; all are exact.
    """
    if method == "index" and not native and threshold > 0:
        best = best_matches(a_keys.select(F.col("_blk").alias("blk"), F.col("_k").alias("ka")),
                            b_keys.select(F.col("_blk").alias("blk"), F.col("_k").alias("kb"), F.col("_pos").alias("pos")), threshold)
        return best.select(F.col("blk").alias("_blk"), F.col("ka").alias("_k"), F.col("kb").alias("_bk"), F.col("score").alias("_score"))
    method = "grid" if method == "index" else method
    pairs = scored_pairs(a_keys.select(F.col("_blk").alias("blk"), F.col("_k").alias("ka")),
                         b_keys.select(F.col("_blk").alias("blk"), F.col("_k").alias("kb")), threshold, native=native, method=method)
    pos = b_keys.select(F.col("_blk").alias("blk"), F.col("_k").alias("kb"), F.col("_pos"))
    best = (pairs.join(pos, ["blk", "kb"]).groupBy("blk", "ka")
            .agg(F.min_by(F.struct("kb", "score"), F.struct((-F.col("score")).alias("s"), F.col("_pos").alias("p")))
                 .alias("_b")))
    return best.select(F.col("blk").alias("_blk"), F.col("ka").alias("_k"),
                       F.col("_b.kb").alias("_bk"), F.col("_b.score").alias("_score"))


def match(a: DataFrame, b: DataFrame, key_a: str, key_b: str, extract=(), threshold: float = 80,
          ignore_case: bool = True, b_order=None, null_keys: str = "match", native: bool = False,
          prefix: str = "SheetB_", block_a: str | None = None, block_b: str | None = None, method: str = "index") -> DataFrame:
    """Every A row with its match type, score, matched B key, extracted B columns and category.

    ``b_order`` gives B's row order (first-seen position / last-row payload);
    ``null_keys='match'`` lets null keys match each other exactly (the
    reference turns them into the same text), ``'never'`` leaves them
    unmatched. ``block_a``/``block_b`` restrict matching to rows whose block
    values are equal (exact inside a block), which is how batch matching keeps
    each target separate and how very large sides stay tractable.
    """
    extract = list(extract)
    side = build_side(b, key_b, extract, ignore_case, b_order, null_keys, block_b)
    a2 = a.withColumn("_k", norm_key(key_a, ignore_case)).withColumn("_blk", _block_expr(block_a))
    a_keys = a2.select("_blk", "_k").distinct()
    sk = side.select(F.col("_blk").alias("_sb"), F.col("_k").alias("_sk"))
    key_eq = (F.col("_k") == F.col("_sk")) if null_keys == "never" else F.col("_k").eqNullSafe(F.col("_sk"))
    exact_keys = a_keys.join(sk, (F.col("_blk") == F.col("_sb")) & key_eq, "left_semi")
    exact = exact_keys.select("_blk", "_k", F.col("_k").alias("_bk"), F.lit(100.0).alias("_score"),
                              F.lit("Exact").alias("_type"))
    rest = a_keys.filter(F.col("_k").isNotNull()).join(side.select("_blk", "_k"), ["_blk", "_k"], "left_anti")
    if threshold > 100:
        # no ratio exceeds 100: exact matching only, no fuzzy stage in the plan
        fuzzy = exact.limit(0).withColumn("_type", F.lit("Fuzzy"))
    else:
        fuzzy = (best_fuzzy(rest, side.filter(F.col("_k").isNotNull()).select("_blk", "_k", "_pos"), threshold,
                            native, method).withColumn("_type", F.lit("Fuzzy")))
    pay = side.select(F.col("_blk").alias("_pb"), F.col("_k").alias("_pk"), "_payload")
    resolved = (exact.unionByName(fuzzy)
                .join(pay, (F.col("_blk") == F.col("_pb")) & F.col("_bk").eqNullSafe(F.col("_pk")), "left")
                .select(F.col("_blk").alias("_rb"), F.col("_k").alias("_rk"), "_score", "_type", "_payload"))
    joined = a2.join(resolved, (a2["_blk"] == resolved["_rb"]) & a2["_k"].eqNullSafe(resolved["_rk"]), "left")
    names = _extract_names(a.columns, extract, prefix)
    score = F.coalesce(F.col("_score"), F.lit(0.0))
    mtype = F.coalesce(F.col("_type"), F.lit("No Match"))
    category = (F.when(F.col("_type") == "Exact", F.lit(MATCHED))
                .when(F.col("_score") >= 90, F.lit(MATCHED))
                .when(F.col("_type").isNotNull(), F.lit(SUGGESTED))
                .otherwise(F.lit(UNMATCHED)))
    out_cols = [col(c) for c in a.columns]
    out_cols += [F.col("_payload").getField(c).alias(names[c]) for c in extract]
    out_cols += [mtype.alias("match_type"), score.alias("similarity_score"),
                 F.col("_payload").getField("_orig").cast("string").alias("matched_key"), category.alias("category")]
    return joined.select(*out_cols)


# ---------------------------------------------------------------- multi-column

def default_weights(n: int) -> list[float]:
    """Reference default: first field 0.5, the rest share 0.5; then normalised to sum 1."""
    w = [0.5] + [0.5 / (n - 1)] * (n - 1) if n > 1 else [1.0]
    s = sum(w)
    return [x / s for x in w]


#: A field is worth driving the candidate search alone if pairs need at least this score there.
DRIVING = 50.0


def _needs(weights: list[float], t: float) -> list[float]:
    """The least score of each field in a pair whose weighted score reaches t: all other fields may have 100."""
    return [(t - 100.0 * (1 - w)) / w if w > 0 else float("-inf") for w in weights]


def _sum(terms: list):
    """The sum with its rounding errors added back, as Python's: what plain addition rounds differently is no tie."""
    total, error = terms[0], F.lit(0.0)
    for x in terms[1:]:
        now = total + x
        error = error + F.when(F.abs(total) >= F.abs(x), (total - now) + x).otherwise((x - now) + total)
        total = now
    return total + error


class _Tuples:
    """Distinct tuples of both sides with an id for each tuple and for each distinct value of a field, all pairs as ids."""

    def __init__(self, a: DataFrame, b: DataFrame, k: int, native: bool):
        self.k, self.native = k, native
        self.values = [(_ids(a.select(F.col(f"_v{j}").alias("ka")).distinct(), f"a{j}"), _ids(b.select(F.col(f"_v{j}").alias("kb")).distinct(), f"b{j}"))
                       for j in range(k)]
        self.b = self._numbered(b, 1, "_tb")
        self.a = self._numbered(a, 0, "_ta")

    def _numbered(self, df, side, name):
        for j, pair in enumerate(self.values):
            df = df.join(pair[side].withColumnRenamed("ka" if side == 0 else "kb", f"_v{j}"), f"_v{j}")
        return _ids(df, name)

    def best(self, a: DataFrame, weights: list[float], t: float) -> DataFrame:
        """(_ta, _tb, _s0.., _score): for each tuple of `a` the best partner at or above t, ties to the least position.

        A pair that reaches t has at least _needs() in every field, and t in some field. If one field's need is high, its value
        pairs alone are found and lead to the tuples; else those of all fields at t are united. The other scores are computed
        once for each pair of values that occurs, field by field, and pairs that can't reach t any more go at once.
        """
        needs = _needs(weights, t)
        lead = max(range(self.k), key=lambda j: needs[j])
        leads, level = ([lead], needs[lead]) if needs[lead] >= DRIVING else (list(range(self.k)), t)
        found = []
        for j in leads:
            va, vb = self.values[j]
            blk = F.lit("0").alias("blk")
            sp = scored_pairs(va.join(a.select(f"a{j}").distinct(), f"a{j}").select(blk, "ka"), vb.select(blk, "kb"), max(level, 0.0), self.native)
            sp = sp.join(va, "ka").join(vb, "kb").select(f"a{j}", f"b{j}")
            found.append(a.select("_ta", f"a{j}").join(sp, f"a{j}").join(self.b.select("_tb", f"b{j}"), f"b{j}").select("_ta", "_tb"))
        pairs = found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).distinct()
        sums, left = F.lit(0.0), 1.0
        for j in sorted(range(self.k), key=lambda j: (j not in leads, -weights[j])):
            va, vb = self.values[j]
            pairs = _checkpoint(pairs.join(a.select("_ta", f"a{j}"), "_ta").join(self.b.select("_tb", f"b{j}"), "_tb"))
            scores = pairs.select(f"a{j}", f"b{j}").distinct().join(va, f"a{j}").join(vb, f"b{j}").select(
                f"a{j}", f"b{j}", indel_ratio(F.col("ka"), F.col("kb"), self.native).alias(f"_s{j}"))
            pairs = pairs.join(scores, [f"a{j}", f"b{j}"]).drop(f"a{j}", f"b{j}")
            sums, left = sums + F.col(f"_s{j}") * F.lit(weights[j]), left - weights[j]
            pairs = pairs.where(sums + F.lit(100.0 * left + 1e-9) >= F.lit(t))
        total = _sum([F.col(f"_s{j}") * F.lit(weights[j]) for j in range(self.k)])
        s = [f"_s{j}" for j in range(self.k)]
        ranked = pairs.withColumn("_score", total).where(F.col("_score") >= F.lit(float(t))).join(self.b.select("_tb", "_pos"), "_tb")
        return ranked.groupBy("_ta").agg(F.min_by(F.struct("_tb", *s, "_score"), F.struct((-F.col("_score")).alias("s"), F.col("_pos").alias("p"))).alias("m")
                                         ).select("_ta", "m.*")


def match_multi(a: DataFrame, b: DataFrame, keys_a: list[str], keys_b: list[str], extract=(),
                threshold: float = 80, weights: list[float] | None = None, ignore_case: bool = True,
                b_order=None, native: bool = False, prefix: str = "SheetB_", report_best: bool = False) -> DataFrame:
    """Multi-column exact match, else weighted fuzzy best match with a per-field breakdown.

    Exact: all normalised keys equal; the *first* B row wins. Fuzzy: weighted sum of per-field ratios, best first-row wins on
    ties; kept if >= threshold. ``report_best``: unmatched rows report their best score below the threshold (D2), looked for at
    three quarters, half and a quarter of the threshold and then, for what is left, without one: that last step compares every
    tuple left with every B tuple.
    """
    if len(keys_a) != len(keys_b):
        raise ValueError("keys_a and keys_b must have the same length")
    extract = list(extract)
    w = [x / sum(weights) for x in weights] if weights else default_weights(len(keys_a))
    k = len(keys_a)
    fields = [f"{ka} → {kb}" for ka, kb in zip(keys_a, keys_b)]

    def norm_any(c):
        return F.coalesce(norm_key(c, ignore_case), F.lit("nan"))

    bt = b.select(*[norm_any(c).alias(f"_v{i}") for i, c in enumerate(keys_b)],
                  F.struct(*[col(c).alias(c) for c in keys_b]).alias("_orig"),
                  _order_expr(b, b_order).alias("_pos"), *[col(c).alias(c) for c in extract])
    vcols = [f"_v{i}" for i in range(k)]
    b_tuples = bt.groupBy(*vcols).agg(
        F.min("_pos").alias("_pos"),
        F.min_by(F.struct("_orig", *[F.col(f"`{c}`") for c in extract]), "_pos").alias("_payload"))
    a2 = a.select("*", *[norm_any(c).alias(f"_v{i}") for i, c in enumerate(keys_a)])
    a_tuples = a2.select(*vcols).distinct()

    exact = a_tuples.join(b_tuples.select(*vcols), vcols, "left_semi")
    exact = exact.select(*vcols, *[F.col(v).alias(f"_w{i}") for i, v in enumerate(vcols)],
                         F.lit(100.0).alias("_score"), F.lit("Multi-Field Exact").alias("_type"),
                         F.array(*[F.struct(F.lit(fields[i]).alias("field"), F.lit(100.0).alias("score"))
                                   for i in range(k)]).alias("_breakdown"))
    rest = a_tuples.join(b_tuples.select(*vcols), vcols, "left_anti")

    t = float(threshold)
    tuples = _Tuples(rest, b_tuples.select(*vcols, "_pos"), k, native)
    best = [_checkpoint(tuples.best(tuples.a, w, t).withColumn("_low", F.lit(False)))]
    if report_best:
        left = tuples.a
        for level in (t * 0.75, t * 0.5, t * 0.25, 0.0):
            left = left.join(best[-1], "_ta", "left_anti")
            best.append(_checkpoint(tuples.best(left, w, level).withColumn("_low", F.lit(True))))
    best = reduce(DataFrame.unionByName, best)
    named = best.join(tuples.a.select("_ta", *vcols), "_ta").join(
        tuples.b.select("_tb", *[F.col(v).alias(f"_w{i}") for i, v in enumerate(vcols)]), "_tb")
    low = F.col("_low")
    fuzzy = named.select(*vcols, *[F.when(~low, F.col(f"_w{j}")).alias(f"_w{j}") for j in range(k)], "_score",
                         F.when(low, F.lit(None)).when(F.col("_score") >= 90, F.lit("Multi-Field High Confidence"))
                         .otherwise(F.lit("Multi-Field Suggested")).alias("_type"),
                         F.when(~low, F.array(*[F.struct(F.lit(fields[j]).alias("field"), F.col(f"_s{j}").alias("score"))
                                                for j in range(k)])).alias("_breakdown"))
    resolved = exact.unionByName(fuzzy)
    bpay = b_tuples.select(*[F.col(v).alias(f"_w{j}") for j, v in enumerate(vcols)], "_payload")
    resolved = resolved.join(bpay, [f"_w{j}" for j in range(k)], "left").drop(*[f"_w{j}" for j in range(k)])
    joined = a2.join(resolved, vcols, "left")
    names = _extract_names(a.columns, extract, prefix)
    category = (F.when(F.col("_type") == "Multi-Field Exact", F.lit(MATCHED))
                .when(F.col("_type").isNotNull() & (F.col("_score") >= 90), F.lit(MATCHED))
                .when(F.col("_type").isNotNull(), F.lit(SUGGESTED)).otherwise(F.lit(UNMATCHED)))
    out = [col(c) for c in a.columns]
    out += [F.col("_payload").getField(c).alias(names[c]) for c in extract]
    out += [F.coalesce(F.col("_type"), F.lit("No Multi-Field Match")).alias("match_type"),
            F.col("_score").alias("similarity_score"),
            F.col("_payload").getField("_orig").alias("matched_keys"),
            F.col("_breakdown").alias("field_breakdown"), category.alias("category")]
    return joined.select(*out)


# ---------------------------------------------------------------- batch

def readable(readers: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The tables that can be read, and the error of each that can't. A table is readable if its schema and a first row are."""
    tables, errors = {}, {}
    for name, reader in readers.items():
        try:
            df = reader()
            df.limit(1).collect()
            tables[name] = df
        except Exception as e:  # whatever a source raises becomes that table's result
            errors[name] = str(e).strip().split("\n")[0][:200]
    return tables, errors


def match_batch_readers(ref: DataFrame, readers: dict[str, Callable[[], DataFrame]], key_ref: str, key_target: str,
                        threshold: float = 80, target_order: str | None = None, target_col: str = "_target", **kw) -> DataFrame:
    """J7 over tables that may fail to load: match_batch of those that can be read, with outcome 'success', and a row with
    outcome 'error' and the message, its counts null, for every other. All rows are matched in one job."""
    tables, errors = readable(readers)
    spark = ref.sparkSession
    order = [] if target_order is None else [col(target_order).alias("_order")]
    parts = [df.select(F.lit(name).alias(target_col), col(key_target).cast("string").alias("_key"), *order) for name, df in tables.items()]
    failed = spark.createDataFrame(list(errors.items()), f"`{target_col}` string, error string").withColumn("outcome", F.lit("error"))
    if not parts:
        return failed
    done = match_batch(ref, reduce(DataFrame.unionByName, parts), key_ref, "_key", list(tables), target_col, threshold,
                       target_order="_order" if order else None, **kw)
    return done.withColumn("outcome", F.lit("success")).unionByName(failed, allowMissingColumns=True)


def match_batch(ref: DataFrame, targets: DataFrame, key_ref: str, key_target: str, target_names: list[str],
                target_col: str = "_target", threshold: float = 80, ignore_case: bool = True,
                target_order=None, null_keys: str = "match", method: str = "index") -> DataFrame:
    """One reference table against every target at once, summarised per target.

    Targets arrive as one DataFrame tagged by ``target_col``; the target name
    is the match block, so all targets share one plan and one shuffle instead
    of N sequential jobs. ``target_names`` is the caller's sheet list: a
    target with no rows still gets its (all unmatched) row. One row per
    target: rows, exact, fuzzy matched, suggested, unmatched, match rate.
    """
    a = (ref.select(norm_key(key_ref, ignore_case).alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
         .withColumn("_t", F.explode(F.array(*[F.lit(t) for t in target_names]))))
    m = match(a, targets, "_k", key_target, threshold=threshold, ignore_case=ignore_case, b_order=target_order,
              null_keys=null_keys, prefix="_b_", block_a="_t", block_b=target_col, method=method)
    return (m.groupBy(F.col("_t").alias(target_col)).agg(
        F.sum("_n").alias("rows"),
        F.sum(F.when(F.col("match_type") == "Exact", F.col("_n")).otherwise(0)).alias("exact"),
        F.sum(F.when((F.col("match_type") == "Fuzzy") & (F.col("category") == MATCHED), F.col("_n")).otherwise(0))
        .alias("fuzzy_matched"),
        F.sum(F.when(F.col("category") == SUGGESTED, F.col("_n")).otherwise(0)).alias("suggested"),
        F.sum(F.when(F.col("category") == UNMATCHED, F.col("_n")).otherwise(0)).alias("unmatched"))
        .withColumn("match_rate", F.round(F.try_divide((F.col("exact") + F.col("fuzzy_matched")) * 100.0, F.col("rows")), 2)))
