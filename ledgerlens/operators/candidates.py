"""Lossless candidate generation for best-match on the indel ratio.

For a pair (a, b) with n = |a| + |b| and threshold t (percent), ``ratio >= t``
means LCS >= t*n/200, i.e. indel distance D <= d = (1 - t/100) * n. Three
necessary conditions prune pairs without losing any match:

* length: ``200 * min(|a|, |b|) >= t * n``;
* q-gram count: a deletion breaks at most q q-grams of ``a`` and an insertion at
  most q-1, so shared q-grams (as multisets) >= (n - 2q + 2 - (2q - 1) * d) / 2;
* character bag: LCS <= sum over characters of min(count_a, count_b); merging
  characters into 64 slots only raises that sum, so the test stays lossless.

Candidates come from the q-gram *prefix filter* of set-similarity joins: with a
global gram order (rare first, occurrences numbered so bags act as sets), two
sets sharing >= k grams share a gram inside their first ``|G| - k + 1``
grams. Each key uses the smallest k over all partner lengths it can have,
which only lengthens its prefix and keeps the filter exact. Pairs for which
the gram bound is not positive (very short strings, or t <= 2/3 of the
length-weighted bound) come from a length-band equi-join instead.

Everything below is joins, windows and aggregates over *distinct keys*; no
key set is ever collected. The only Python is the LCS scorer, applied to
surviving pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import lcs_len_native, lcs_len_udf

BAG_SLOTS = 64


def _slot(c):
    """Character -> bag slot: a-z 1..26, 0-9 27..36, space 0, anything else hashed into 37..63."""
    code = F.ascii(c)
    return (F.when((code >= 97) & (code <= 122), code - 96)
            .when((code >= 48) & (code <= 57), code - 21)
            .when(code == 32, F.lit(0))
            .otherwise(F.pmod(code, F.lit(27)) + 37))


def gram_need_factor(t: float, q: int) -> tuple[float, float]:
    """Shared q-grams >= slope * n + intercept for pairs at threshold t."""
    d_frac = (100.0 - t) / 100.0
    slope = (1.0 - (2 * q - 1) * d_frac) / 2.0
    intercept = (-2.0 * q + 2.0) / 2.0
    return slope, intercept


def _min_partner_len(length, t: float):
    return F.ceil(length * F.lit(t / (200.0 - t)))


def _with_profile(keys: DataFrame, key: str, t: float, q: int) -> DataFrame:
    """Per distinct key: length, character bag, and the gram need of its smallest pair."""
    slope, icpt = gram_need_factor(t, q)
    chars = F.split(F.col(key), "")
    bag = F.transform(F.sequence(F.lit(0), F.lit(BAG_SLOTS - 1)),
                      lambda i: F.size(F.filter(chars, lambda c: _slot(c) == i)))
    n_min = F.col("_len") + _min_partner_len(F.col("_len"), t)
    return (keys.withColumn("_len", F.length(F.col(key)))
            .withColumn("_bag", F.when(F.col("_len") > 0, bag).otherwise(F.array_repeat(F.lit(0), BAG_SLOTS)))
            .withColumn("_need", F.ceil(n_min * F.lit(slope) + F.lit(icpt))))


def _grams(prof: DataFrame, key: str, q: int) -> DataFrame:
    """Explode numbered q-grams: gram text + '#' + occurrence number."""
    g = (prof.filter(F.col("_len") >= q)
         .select("blk", key, "_len", "_need",
                 F.posexplode(F.transform(F.sequence(F.lit(1), F.col("_len") - q + 1),
                                          lambda i: F.substring(F.col(key), i, q))).alias("_p", "_g")))
    occ = F.row_number().over(Window.partitionBy("blk", key, "_g").orderBy("_p"))
    return g.withColumn("_tok", F.concat(F.col("_g"), F.lit("#"), occ.cast("string"))).drop("_g", "_p")


def _prefixes(grams: DataFrame, freq: DataFrame, key: str, q: int) -> DataFrame:
    """Keep each key's rarest ``|G| - need + 1`` grams (all grams when need <= 0)."""
    ranked = grams.join(freq, "_tok")
    w = Window.partitionBy("blk", key).orderBy("_f", "_tok")
    n_grams = F.col("_len") - q + 1
    plen = F.least(n_grams, n_grams - F.col("_need") + 1)
    return ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= plen).select("blk", key, "_len", "_tok")


def _length_ok(la, lb, t: float):
    return F.least(la, lb) * F.lit(200.0) >= F.lit(float(t)) * (la + lb)


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float, q: int = 2) -> DataFrame:
    """All (ka, kb) pairs that *may* reach ``threshold``; never drops a true match.

    ``left`` has columns (blk, ka) and ``right`` (blk, kb), distinct keys per
    block; pairs only form inside a block. Output: blk, ka, kb, la, lb, bag_a, bag_b.
    """
    t = float(threshold)
    slope, icpt = gram_need_factor(t, q)
    pa = _with_profile(left, "ka", t, q)
    pb = _with_profile(right, "kb", t, q)

    parts = []
    if slope > 0:
        # largest pair length for which the gram bound gives nothing: n <= n0
        n0 = math.floor((1e-9 - icpt) / slope) if slope > 0 else None
        ga = _grams(pa, "ka", q)
        gb = _grams(pb, "kb", q)
        freq = (ga.select("_tok").unionAll(gb.select("_tok")).groupBy("_tok").agg(F.count(F.lit(1)).alias("_f")))
        xa = _prefixes(ga, freq, "ka", q).withColumnRenamed("_len", "la")
        xb = _prefixes(gb, freq, "kb", q).withColumnRenamed("_len", "lb")
        gram_pairs = (xa.join(xb, ["_tok", "blk"]).filter(_length_ok(F.col("la"), F.col("lb"), t))
                      .select("blk", "ka", "kb").distinct())
        parts.append(gram_pairs)
        short_a = pa.filter(F.col("_len") <= n0)
        max_b = F.lit(n0) - F.col("_len")
    else:
        short_a = pa
        max_b = None
    # length-band equi-join for pairs the gram bound cannot see
    lo = _min_partner_len(F.col("_len"), t)
    hi = F.floor(F.least(F.lit(100_000_000.0), F.col("_len") * F.lit((200.0 - t) / max(t, 1e-6))))
    if max_b is not None:
        hi = F.least(hi, max_b)
    band = (short_a.select("blk", "ka", F.explode(F.sequence(lo.cast("int"), F.greatest(lo, hi).cast("int"))).alias("lb"),
                           F.col("_len").alias("la"), lo.alias("_lo"), hi.alias("_hi"))
            .filter(F.col("lb") <= F.col("_hi")))
    band_pairs = (band.join(pb.select("blk", "kb", F.col("_len").alias("lb")), ["lb", "blk"])
                  .filter(_length_ok(F.col("la"), F.col("lb"), t)).select("blk", "ka", "kb"))
    parts.append(band_pairs)
    pairs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct()
    return (pairs.join(pa.select("blk", "ka", F.col("_len").alias("la"), F.col("_bag").alias("bag_a")), ["blk", "ka"])
            .join(pb.select("blk", "kb", F.col("_len").alias("lb"), F.col("_bag").alias("bag_b")), ["blk", "kb"]))


def bag_overlap(bag_a, bag_b):
    return F.aggregate(F.zip_with(bag_a, bag_b, lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)


def scored_pairs(left: DataFrame, right: DataFrame, threshold: float, native: bool = False,
                 method: str = "grid") -> DataFrame:
    """Pairs at or above ``threshold`` with their exact LCS and ratio (lossless).

    Output: blk, ka, kb, lcs, score (0-100). ``method='grid'`` evaluates all
    length-compatible pairs vectorised (best when keys share a small
    vocabulary); ``'prefix'`` generates candidates by the q-gram prefix join
    (best for diverse keys, where it prunes almost everything). ``native``
    forces the prefix path with the JVM-only LCS.
    """
    t = float(threshold)
    if method == "grid" and not native:
        return grid_scored_pairs(left, right, t).withColumn("blk", F.col("blk"))
    c = candidate_pairs(left, right, t)
    n = F.col("la") + F.col("lb")
    c = c.filter(bag_overlap(F.col("bag_a"), F.col("bag_b")) * F.lit(200.0) >= F.lit(t) * n)
    lcs = lcs_len_native(F.col("ka"), F.col("kb")) if native else lcs_len_udf(F.col("ka"), F.col("kb"))
    scored = c.select("blk", "ka", "kb", "la", "lb", lcs.alias("lcs"))
    n = F.col("la") + F.col("lb")
    return (scored.filter(F.col("lcs") * F.lit(200.0) >= F.lit(t) * n)
            .select("blk", "ka", "kb", "lcs",
                    F.when(n == 0, F.lit(100.0)).otherwise(F.col("lcs") * F.lit(200.0) / n).alias("score")))


# ---------------------------------------------------------------- grid evaluator
#
# When keys share one small vocabulary the prefix filter hardly prunes (every
# key holds common grams), and evaluating ~all pairs row by row is slow. The
# grid evaluator keeps the same exact filters but runs them vectorised:
# B keys are bucketed by length; each A key is routed to every B length its
# length filter allows; a bucket is split into an (i, j) grid of chunks sized
# from its row counts, so a hot bucket spreads over many tasks. Inside a task
# matrix products bound the common characters and 2-grams of a whole chunk at
# once and the bit-parallel LCS runs only on survivors. Only true matches leave the task.

GRID_CHUNK = 1500
#: Places that the grid evaluator hashes 2-grams to.
GRAM_SLOTS = 192


def lcs_batch(pat_masks, pat_len, text_idx):
    """Vectorised bit-parallel LCS for many (pattern, text) pairs at once (patterns of at most 64 characters).

    ``pat_masks``: (P, V) uint64 match masks per vocabulary symbol for each pair's pattern; ``pat_len``: (P,)
    pattern lengths; ``text_idx``: (P, L) symbol ids of each pair's text, -1 as padding.
    """
    import numpy as np
    n = pat_masks.shape[0]
    full = np.where(pat_len >= 64, np.uint64(0xFFFFFFFFFFFFFFFF),
                    (np.uint64(1) << pat_len.astype(np.uint64)) - np.uint64(1))
    v = full.copy()
    rows = np.arange(n)
    for k in range(text_idx.shape[1]):
        c = text_idx[:, k]
        m = np.where(c >= 0, pat_masks[rows, np.maximum(c, 0)], np.uint64(0))
        u = v & m
        v = ((v + u) | (v - u)) & full
    return pat_len - np.bitwise_count(v).astype(np.int64)


def _grid_fn(threshold: float, distinct_only: bool):
    import numpy as np
    import pandas as pd

    from ..functions.similarity import lcs_at_least

    t = float(threshold)

    def encode(keys, vocab):
        """Lengths, symbol numbers (-1 as padding), and features whose inner products bound the common characters and
        2-grams of two keys from above: one 0/1 feature for each (symbol, occurrence up to a limit), the occurrences
        beyond the limit summed apart. Hashed 2-grams that collide only raise the bound."""
        lens = np.array([len(s) for s in keys], dtype=np.int64)
        width = max(int(lens.max()) if len(keys) else 0, 1)
        idx = np.full((len(keys), width), -1, dtype=np.int32)
        for r, s in enumerate(keys):
            idx[r, :len(s)] = [vocab[ch] for ch in s]
        grams = np.where((idx[:, :-1] >= 0) & (idx[:, 1:] >= 0), (idx[:, :-1] * 7919 + idx[:, 1:]) % GRAM_SLOTS, -1)
        return lens, idx, counted(idx, len(vocab), 4), counted(grams, GRAM_SLOTS, 2)

    def counted(symbols, size, limit):
        rows = np.repeat(np.arange(len(symbols)), (symbols >= 0).sum(axis=1))
        counts = np.bincount(rows * size + symbols[symbols >= 0], minlength=len(symbols) * size).reshape(len(symbols), size)
        feats = np.concatenate([counts > k for k in range(limit)], axis=1).astype(np.float32)
        return feats, np.maximum(counts - limit, 0).sum(axis=1).astype(np.float32)

    def masks_of(idx, lens, nvocab):
        m = np.zeros((idx.shape[0], nvocab), dtype=np.uint64)
        for r in range(idx.shape[0]):
            for p in range(min(int(lens[r]), 64)):
                m[r, idx[r, p]] |= np.uint64(1) << np.uint64(p)
        return m

    def fn(pa: pd.DataFrame, pb: pd.DataFrame) -> pd.DataFrame:
        if pa.empty or pb.empty:
            return pd.DataFrame({"ida": np.array([], dtype=np.int64), "idb": np.array([], dtype=np.int64),
                                 "lcs": np.array([], dtype=np.int32), "score": np.array([], dtype=np.float64)})
        ka = pa["ka"].tolist()
        kb = pb["kb"].tolist()
        ida = pa["ida"].to_numpy()
        idb = pb["idb"].to_numpy()
        vocab = {}
        for s in ka + kb:
            for ch in s:
                if ch not in vocab:
                    vocab[ch] = len(vocab)
        nv = max(len(vocab), 1)
        la, xa, (ca, ea), (ga, ha) = encode(ka, vocab)
        lb, xb, (cb, eb), (gb, hb) = encode(kb, vocab)
        ma = masks_of(xa, la, nv)
        slope, icpt = gram_need_factor(t, 2)
        out_a, out_b, out_l = [], [], []
        step = max(1, 2_000_000 // max(1, len(kb)))
        for s0 in range(0, len(ka), step):
            sl = slice(s0, s0 + step)
            n = la[sl, None] + lb[None, :]
            common = ca[sl] @ cb.T + np.minimum(ea[sl, None], eb[None, :])
            ok = (np.minimum(la[sl, None], lb[None, :]) * 200.0 >= t * n) & (common * 200.0 >= t * n)
            if slope > 0 and ok.any():
                shared = ga[sl] @ gb.T + np.minimum(ha[sl, None], hb[None, :])
                ok &= shared >= n * slope + icpt - 1e-6
            if distinct_only:
                ok &= np.array(ka[sl], dtype=object)[:, None] < np.array(kb, dtype=object)[None, :]
            ii, jj = np.nonzero(ok)
            ii = ii + s0
            short = la[ii] <= 64
            if short.any():
                si, sj = ii[short], jj[short]
                for b0 in range(0, len(si), 200_000):
                    bi, bj = si[b0:b0 + 200_000], sj[b0:b0 + 200_000]
                    lcs = lcs_batch(ma[bi], la[bi], xb[bj])
                    out_a.append(bi)
                    out_b.append(bj)
                    out_l.append(lcs)
            for i, j in zip(ii[~short].tolist(), jj[~short].tolist()):
                out_a.append(np.array([i]))
                out_b.append(np.array([j]))
                out_l.append(np.array([lcs_at_least(ka[i], kb[j], t * (la[i] + lb[j]) / 200.0 - 1e-9)]))
        if not out_a:
            return fn(pa.iloc[0:0], pb)
        ai, bj, lc = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_l)
        nn = la[ai] + lb[bj]
        keep = lc * 200.0 >= t * nn
        ai, bj, lc, nn = ai[keep], bj[keep], lc[keep], nn[keep]
        score = np.where(nn == 0, 100.0, lc * 200.0 / np.maximum(nn, 1))
        return pd.DataFrame({"ida": ida[ai].astype(np.int64), "idb": idb[bj].astype(np.int64),
                             "lcs": lc.astype(np.int32), "score": score.astype(np.float64)})

    return fn


def grid_scored_pairs(left: DataFrame, right: DataFrame, threshold: float, distinct_only: bool = False,
                      chunk: int = GRID_CHUNK) -> DataFrame:
    """Exact scored pairs (ratio >= threshold) by the vectorised grid; same output as ``scored_pairs``.

    ``distinct_only`` keeps only pairs with ka < kb (self-join use).
    """
    t = float(threshold)
    # compact unique ids for the distinct keys; materialised once so ids stay stable for the join back
    ka_ids = _ids(left.select(F.col("blk").cast("string").alias("blk"), "ka").distinct(), "ida")
    kb_ids = _ids(right.select(F.col("blk").cast("string").alias("blk"), "kb").distinct(), "idb")
    a = ka_ids.withColumn("la", F.length("ka"))
    b = kb_ids.withColumn("lb", F.length("kb"))
    # only lengths that occur: with a low threshold every length is allowed, and the bound itself may be beyond int
    lo = _min_partner_len(F.col("la"), t).cast("long")
    hi = F.floor(F.least(F.lit(float(1 << 40)), F.col("la") * F.lit((200.0 - t) / max(t, 1e-6)))).cast("long")
    lens = b.groupBy("blk").agg(F.array_sort(F.collect_set(F.col("lb").cast("long"))).alias("_lens"))  # a row per block: its lengths
    a = (a.join(lens, "blk").withColumn("_lo", lo).withColumn("_hi", hi)
         .withColumn("lb", F.explode(F.expr("filter(_lens, x -> x >= _lo AND x <= _hi)"))).drop("_lens", "_lo", "_hi")
         .withColumn("lb", F.col("lb").cast("int")))
    # grid sizes per (block, length) bucket from a small count table (one row per bucket)
    ca = a.groupBy("blk", "lb").agg(F.count(F.lit(1)).alias("_na"))
    cb = b.groupBy("blk", "lb").agg(F.count(F.lit(1)).alias("_nb"))
    sizes = (ca.join(cb, ["blk", "lb"])
             .select("blk", "lb", F.ceil(F.col("_na") / F.lit(chunk)).cast("int").alias("_sa"),
                     F.ceil(F.col("_nb") / F.lit(chunk)).cast("int").alias("_sb")))
    ga = (a.join(sizes, ["blk", "lb"])
          .withColumn("_i", F.pmod(F.xxhash64("ka"), F.col("_sa")).cast("int"))
          .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_sb") - 1)))
          .select("blk", "lb", "_i", "_j", "ka", "ida"))
    gb = (b.join(sizes, ["blk", "lb"])
          .withColumn("_j", F.pmod(F.xxhash64("kb"), F.col("_sb")).cast("int"))
          .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_sa") - 1)))
          .select("blk", "lb", "_i", "_j", "kb", "idb"))
    schema = "ida long, idb long, lcs int, score double"
    # the scoring stage is compute-heavy on little data: pin the partition count so adaptive coalescing cannot
    # fold all chunk pairs into one Python task (both sides share the partitioning, so no extra exchange)
    parts = python_parallelism(left.sparkSession)
    keys = ["blk", "lb", "_i", "_j"]
    ga, gb = ga.repartition(parts, *keys), gb.repartition(parts, *keys)
    hits = (ga.groupBy("blk", "lb", "_i", "_j").cogroup(gb.groupBy("blk", "lb", "_i", "_j"))
            .applyInPandas(_grid_fn(t, distinct_only), schema))
    return (hits.join(ka_ids, "ida").join(kb_ids.drop("blk"), "idb")
            .select("blk", "ka", "kb", "lcs", "score"))


def python_parallelism(spark) -> int:
    """Partitions for Python-heavy stages: the shuffle setting, at least twice the default parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 2 * spark.sparkContext.defaultParallelism)


def _ids(keys: DataFrame, name: str) -> DataFrame:
    from .ranks import _checkpoint
    return _checkpoint(keys.withColumn(name, F.monotonically_increasing_id()))
