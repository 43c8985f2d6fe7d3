"""Best match by an inverted index of segments, with a rising threshold.

A pair (a, b) with ratio >= t has an indel distance of at most d = (1 - t / 100) * (|a| + |b|). b is cut into d + 1 even segments;
d edits leave one of them whole, and it stands in a at a place that the edits on its left and right bound: with i segments on its
left some whole segment has at most i edits there and d - i on its right (else an earlier or a later one would be whole), so it is
moved by s with |s| <= i and |(|a| - |b|) - s| <= d - i. The index holds (length, segment number, hash of the segment) of every b key;
a probes the substrings that may be equal, for each length its bound allows. That loses no pair, and needs no pair of keys that
share nothing: with segments of four characters and more, posting lists grow with the keys that agree there, not with the table.

The higher the threshold the longer the segments, so best matches are looked for at 95, 90 and 85 % first. A level finds all pairs
at its threshold; a key that has one has its best match, and takes no part in lower levels. Pairs travel as two ids. A crowded
posting list is split by the adaptive skew join.

Where keys are made of one small vocabulary, segments are words that many keys share, and the index brings nearly all pairs. So
before a level is run its pairs are counted from the lengths of the posting lists; above CROWDED of all pairs, and at thresholds
below 85 %, where segments are of two characters, what is left goes to the chunked evaluator of ``candidates``, length by length.
Both are exact: the choice changes time, never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import lcs_len_udf
from .candidates import _ids, grid_scored_pairs, python_parallelism
from .ranks import _checkpoint

#: Thresholds tried before the caller's; the least at which segments are long enough to prune.
LEVELS = (95.0, 90.0, 85.0)
LEAST = 85.0
#: Share of all pairs above which the index isn't worth its joins.
CROWDED = 0.002


def _edits(length, t: float):
    """The most edits between a key of this length and any partner at threshold t."""
    return F.floor(length * F.lit(2 * (100.0 - t) / t) + F.lit(1e-9)).cast("int")


def _segments(df: DataFrame, lb, t: float) -> DataFrame:
    """A row for each segment of a key of length lb: number, start (from 0) and size of it, and the edits d."""
    out = df.withColumn("d", _edits(lb, t)).withColumn("q", F.floor(lb / (F.col("d") + 1)).cast("int")).withColumn(
        "r", (lb % (F.col("d") + 1)).cast("int"))
    longer = F.greatest(F.lit(0), F.col("i") - (F.col("d") + 1 - F.col("r")))
    return out.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d")))).withColumn("start", F.col("i") * F.col("q") + longer).withColumn(
        "size", F.col("q") + (F.col("i") >= F.col("d") + 1 - F.col("r")).cast("int")).drop("q", "r")


def _lists(a: DataFrame, b: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """The probes (KEY, ida) of the A keys and the index (KEY, idb) of the B keys."""
    if t <= 200 / 3:
        raise ValueError("segments need a threshold over 66.7")
    index = _segments(b.withColumn("lb", F.length("kb")).where("lb > 0"), F.col("lb"), t).select(
        "blk", "lb", "i", F.xxhash64(F.col("kb").substr(F.col("start") + 1, F.col("size"))).alias("h"), "idb")
    la, wide = F.length("ka"), (200.0 - t) / t
    lengths = F.sequence(F.ceil(la / F.lit(wide) - F.lit(1e-9)).cast("int"), F.floor(la * F.lit(wide) + F.lit(1e-9)).cast("int"))
    probes = _segments(a.where("length(ka) > 0").select("blk", "ka", "ida", F.explode(lengths).alias("lb")).where("lb > 0"), F.col("lb"), t)
    more = F.length("ka") - F.col("lb")
    low = F.greatest(-F.col("i"), more - (F.col("d") - F.col("i")), -F.col("start"))
    high = F.least(F.col("i"), more + (F.col("d") - F.col("i")), F.length("ka") - F.col("size") - F.col("start"))
    probes = probes.withColumns({"low": low, "high": high}).where("low <= high").withColumn("s", F.explode(F.sequence("low", "high"))).select(
        "blk", "lb", "i", F.xxhash64(F.col("ka").substr(F.col("start") + F.col("s") + 1, F.col("size"))).alias("h"), "ida").distinct()
    return probes, index


KEY = ["blk", "lb", "i", "h"]


def segment_pairs(a: DataFrame, b: DataFrame, t: float) -> DataFrame:
    """(ida, idb) of all pairs that may reach t (over 200 / 3), each once; a: (blk, ka, ida), b: (blk, kb, idb), blk text."""
    probes, index = _lists(a, b, t)
    return probes.join(index, KEY).select("ida", "idb").distinct()


def crowding(a: DataFrame, b: DataFrame, t: float) -> float:
    """Pairs that the index would bring together (a pair counts once for each segment), as a share of all pairs."""
    probes, index = _lists(a, b, t)
    met = probes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("na")).join(index.groupBy(*KEY).agg(F.count(F.lit(1)).alias("nb")), KEY)
    pairs = met.agg(F.sum(F.col("na") * F.col("nb").cast("double"))).first()[0] or 0.0
    every = a.groupBy("blk").agg(F.count(F.lit(1)).alias("na")).join(b.groupBy("blk").agg(F.count(F.lit(1)).alias("nb")), "blk")
    return pairs / max(1.0, every.agg(F.sum(F.col("na") * F.col("nb").cast("double"))).first()[0] or 0.0)


def scored(pairs: DataFrame, a: DataFrame, b: DataFrame, t: float) -> DataFrame:
    """(ida, idb, score) of the pairs with ratio >= t."""
    named = pairs.join(a.select("ida", "ka"), "ida").join(b.select("idb", "kb"), "idb").repartition(
        python_parallelism(pairs.sparkSession), "ida", "idb")
    n = F.length("ka") + F.length("kb")
    return named.select("ida", "idb", n.alias("n"), lcs_len_udf("ka", "kb").alias("lcs")).where(F.col("lcs") * 200.0 >= F.lit(t) * F.col("n")).select(
        "ida", "idb", (F.col("lcs") * 200.0 / F.col("n")).alias("score"))


def best_matches(a_keys: DataFrame, b_keys: DataFrame, threshold: float, crowded: float = CROWDED) -> DataFrame:
    """(blk, ka, kb, score): for each A key the best B key of its block at or above threshold, ties to the least position.

    a_keys: (blk, ka) distinct; b_keys: (blk, kb, pos) distinct in (blk, kb). crowded: 0 never uses the index, 1 and more always.
    """
    t = float(threshold)
    a = rest = _ids(a_keys.select(F.col("blk").cast("string").alias("blk"), "ka"), "ida")
    b = _ids(b_keys.select(F.col("blk").cast("string").alias("blk"), "kb", "pos"), "idb")
    found = []
    for level in [x for x in LEVELS if x > t] + [t]:
        indexed = level >= LEAST and crowded > 0 and (crowded >= 1 or crowding(rest, b, level) <= crowded)
        if indexed:
            at = scored(segment_pairs(rest, b, level), a, b, level)
        else:  # for all that is left, at the caller's threshold
            level = t
            at = grid_scored_pairs(rest.select("blk", "ka"), b.select("blk", "kb"), level).join(rest, ["blk", "ka"]).join(
                b.select("blk", "kb", "idb"), ["blk", "kb"]).select("ida", "idb", "score")
        best = at.join(b.select("idb", "pos"), "idb").groupBy("ida").agg(
            F.min_by(F.struct("idb", "score"), F.struct((-F.col("score")).alias("s"), F.col("pos").alias("p"))).alias("m"))
        found.append(_checkpoint(best.select("ida", "m.idb", "m.score")))
        if level == t:
            break
        rest = rest.join(found[-1], "ida", "left_anti")
    every = reduce(DataFrame.unionByName, found)
    return every.join(a, "ida").join(b.select("idb", "kb"), "idb").select("blk", "ka", "kb", "score")
