"""Mixing sources to target weights: blocks of words, multinomial draws per shard, pseudorandom permutations of block numbers.

The words of a source, its rows in order of (id, size), form one stream that is cut into blocks of `block` words. Each output
shard draws by a multinomial how many of its slots go to each source. A source's slots are numbered through all shards; slot
number j takes, in epoch j div n, block perm(j mod n) of the source's n blocks, where perm is a keyed Feistel permutation of
[0, n). Slots and blocks then meet by (source, block number).

Draws scatter around the targets, and a source whose target is `most` times its size has no blocks to spare. So what a source
drew beyond its quota (its target in blocks, rounded) goes, slot by slot, to the sources that drew too little: the shards keep
their sizes, each source takes its quota exactly, no block is taken more than `most` times. Taken words differ from the target
by at most two blocks of words.

Everything is a function of the rows and `seed`. A source holding most rows is no hot key: its rows are dealt by ranges, its
blocks by number. Sources may be many: draws go first to groups of SOURCES_AT_ONCE sources, then inside each group.

Defined cases: a null or empty text has size 0 and is never taken. Null sources form one source, the last. Rows that repeat or
lack an id count each for itself. If there are no words at all, every target is 0. An empty table gives no rows. Only the id,
source and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import running_sums, sliced, written

#: Words of a block, slots of an output shard, sources that one multinomial deals with.
BLOCK = 64
PER_SHARD = 65_536
SOURCES_AT_ONCE = 1024
#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)


def sizes(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(row, id, source, size) of each row; row is a number of its own."""
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in sliced(batches):
            # bytes.split without argument parts at exactly the six ASCII white-space characters
            size = pa.array([len(t.split()) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), size], names=["id", "source", "size"])

    return written(rows.mapInArrow(run, f"id {kind}, source string, size long").select(
        F.monotonically_increasing_id().alias("row"), "*"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_no, source_size, target) of each source: `share` of all words by weight, at most `most` times its size.

    What a source can't take is dealt again over the others by weight, until none is above.
    """
    ranked = running_sums(sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns(
        {"zero": F.lit(0).cast("long"), "one": F.lit(1).cast("long")}), "zero", [F.col("source").asc_nulls_last()], "one", "source_no")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    each = written(ranked.select("source", "source_no", "source_size", weight.cast("long").alias("weight"),
                                 (most * F.col("source_size")).alias("cap")))
    left = share * (each.agg(F.sum("source_size")).first()[0] or 0)
    total, open_weight, full = left, each.agg(F.sum("weight")).first()[0] or 1, 0
    while True:
        above = F.col("weight") * F.lit(float(left)) > F.col("cap") * F.lit(float(open_weight))
        now = each.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, F.col("cap"))).alias("cap"),
                       F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if now["n"] == full:
            break
        full, left, open_weight = now["n"], total - now["cap"], now["weight"]
        if not open_weight:
            break
    target = F.when(above, F.col("cap").cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(open_weight or 1)))
    return each.select("source", "source_no", "source_size", target.alias("target"))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: 64 well mixed bits of 64 bits."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(at: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """perm(at) for the permutation of [0, n) that key names; all element by element.

    A Feistel network permutes the 2k-bit numbers, 2^2k >= n; results beyond n are permuted again until they fall inside.
    """
    x, key = at.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.int64) + 2) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & low[todo]
        for round_no in range(4):
            left, right = right, left ^ (mixed(right ^ mixed(key[todo] + np.uint64(round_no))) & low[todo])
        x[todo] = (left << half[todo]) | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def draws(quotas: DataFrame, per_shard: int, seed: int) -> DataFrame:
    """(shard, source_no, count): for each shard a multinomial over the sources, with weights `slots` of quotas."""
    spark = quotas.sparkSession
    groups = written(quotas.where("slots > 0").groupBy((F.col("source_no") / SOURCES_AT_ONCE).cast("long").alias("group")).agg(
        F.sum("slots").alias("slots"), F.sort_array(F.collect_list(F.struct("source_no", "slots"))).alias("members")))
    # a row for each SOURCES_AT_ONCE sources
    totals = sorted((r["group"], r["slots"]) for r in groups.select("group", "slots").collect())
    total = sum(n for _, n in totals)
    shards = -(-total // per_shard)

    def over_groups(batches):
        weights = np.array([n for _, n in totals], float)
        for b in batches:
            out = [[], [], []]
            for shard in b.column(0).to_pylist():
                n = min(per_shard, total - shard * per_shard)
                for (group, _), count in zip(totals, np.random.default_rng([seed, shard]).multinomial(n, weights / weights.sum()).tolist()):
                    if count:
                        for column, x in zip(out, (shard, group, count)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["shard", "group", "count"])

    def over_sources(batches):
        for b in batches:
            out = [[], [], []]
            for shard, group, n, members in zip(*(b.column(k).to_pylist() for k in range(4))):
                weights = np.array([m["slots"] for m in members], float)
                drawn = np.random.default_rng([seed, shard, group + 1]).multinomial(n, weights / weights.sum())
                for at in np.flatnonzero(drawn).tolist():
                    for column, x in zip(out, (shard, members[at]["source_no"], int(drawn[at]))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["shard", "source_no", "count"])

    parted = spark.range(shards).mapInArrow(over_groups, "shard long, group long, count long").join(groups.drop("slots"), "group")
    return parted.select("shard", "group", "count", "members").mapInArrow(over_sources, "shard long, source_no long, count long")


def slots(quotas: DataFrame, per_shard: int = PER_SHARD, seed: int = 13) -> DataFrame:
    """(shard, source_no, number): every slot of every shard, the slots of a source numbered from 0 to its `slots` - 1."""
    drawn = running_sums(draws(quotas, per_shard, seed), "source_no", ["shard"], "count", "start")
    drawn = written(drawn.join(quotas.select("source_no", "slots"), "source_no").withColumn(
        "keep", F.least("count", F.greatest(F.col("slots") - F.col("start"), F.lit(0)))))
    zero = F.lit(0).cast("long")
    over = running_sums(drawn.where("count > keep").select(zero.alias("zero"), "shard", "source_no", (F.col("count") - F.col("keep")).alias("n")),
                        "zero", ["shard", "source_no"], "n", "start")
    had = drawn.groupBy("source_no").agg(F.sum("count").alias("had"))
    lack = quotas.join(had, "source_no", "left").select(zero.alias("zero"), "source_no", F.coalesce("had", zero).alias("had"),
                                                        (F.col("slots") - F.coalesce("had", zero)).alias("n")).where("n > 0")
    lack = running_sums(lack, "zero", ["source_no"], "n", "start")
    one_each = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("k")
    freed = over.select("shard", one_each)
    wanted = lack.select("source_no", "start", "had", one_each).select("k", "source_no", (F.col("had") + F.col("k") - F.col("start")).alias("number"))
    kept = drawn.where("keep > 0").select("shard", "source_no", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("keep") - 1)).alias("number"))
    return kept.union(freed.join(wanted, "k").select("shard", "source_no", "number"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = WEIGHTS,
        share: float = 1.5, most: int = 2, block: int = BLOCK, per_shard: int = PER_SHARD, seed: int = 13) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (row, id, source, size), the sources (source, source_no, source_size, target), and the mix.

    The mix has a row for each part of a row that a slot takes: shard, place (slots of a shard go in order of it), source_no,
    epoch, block, row, first (words of the row before it), words.
    """
    sized = sizes(df, id_col, source_col, text_col)
    sources = written(targets(sized, weights, share, most))
    blocks = F.ceil(F.col("source_size") / block)
    quota = F.least(most * blocks, F.round(blocks * F.col("target") / F.col("source_size")).cast("long"))
    quotas = written(sources.where("source_size > 0").select("source_no", blocks.alias("blocks"), quota.alias("slots")))
    named = sized.where("size > 0").join(sources.select("source", "source_no"), sized["source"].eqNullSafe(sources["source"]))
    laid = running_sums(named.select("row", "id", "source_no", "size"), "source_no", ["id", "size"], "size", "start")
    end = F.col("start") + F.col("size")
    pieces = laid.select("source_no", "row", "start", end.alias("end"), F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"))
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("end"), (F.col("block") + 1) * block)
    pieces = pieces.select("source_no", "block", "row", (low - F.col("start")).alias("first"), (high - low).alias("words"))

    def places(batches):
        for b in batches:
            source_no, number, n = (b.column(k).to_numpy() for k in (1, 2, 3))
            epoch = number // n
            key = mixed(mixed(mixed(np.full(len(n), seed, np.uint64)) + source_no.astype(np.uint64)) + epoch.astype(np.uint64))
            at = permuted(number % n, n, key)
            place = mixed(key + at.astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(epoch), pa.array(at), pa.array(place)],
                                             names=["shard", "source_no", "epoch", "block", "place"])

    numbered = slots(quotas, per_shard, seed).join(quotas.select("source_no", "blocks"), "source_no").select("shard", "source_no", "number", "blocks")
    dealt = numbered.mapInArrow(places, "shard long, source_no long, epoch long, block long, place long")
    return sized, sources, dealt.join(pieces, ["source_no", "block"]).select(
        "shard", "place", "source_no", "epoch", "block", "row", "first", "words")
