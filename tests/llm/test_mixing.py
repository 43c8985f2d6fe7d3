import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing
from ledgerlens.llm.common import running_sums

from .helpers import empty_documents, odd_documents


def corpus(spark, n_docs, sources):
    """sources: words of a document by source."""
    return spark.range(n_docs).select(F.col("id").alias("doc_id"), F.expr(f"element_at(array({', '.join(repr(s) if s is not None else 'cast(null as string)' for s in sources)}), cast(id % {len(sources)} + 1 as int))").alias("source")
                                      ).withColumn("text", F.expr("repeat('w ', cast(1 + (doc_id * 7919) % 60 as int))")).withColumn("size", F.lit("clash"))


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by definition: deal out by weight, stop at the cap, deal the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, left = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        rest = left - sum(most * sizes[s] for s in full)
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if rest * w[s] > most * sizes[s] * total}
        if not over:
            return {s: float(most * sizes[s]) if s in full else rest * w[s] / total for s in order}
        full |= over


@pytest.mark.parametrize("sources", [["a"], ["a", "b", "c", None], ["b"] * 20 + ["a", "é", "Z", None, "b2", "c", "d"]])
def test_mix(spark, sources):
    df = corpus(spark, 3000, sources)
    sized, table, mix = mixing.mix(df, per_shard=300)
    mix = mix.persist()
    words = {r["doc_id"]: len(r["text"].split()) for r in df.collect()}
    rows = {r["row"]: r for r in sized.collect()}
    assert {r["id"]: r["size"] for r in rows.values()} == words
    sizes = {}
    for r in rows.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = filled(sizes)
    got = {r["source"]: r for r in table.collect()}
    assert {s: r["source_size"] for s, r in got.items()} == sizes
    assert {s: r["target"] for s, r in got.items()} == pytest.approx(want)
    taken = {r["row"]: r["n"] for r in mix.groupBy("row").agg(F.sum("words").alias("n")).collect()}
    assert all(n <= 2 * rows[k]["size"] for k, n in taken.items())
    by_source = {}
    for k, n in taken.items():
        by_source[rows[k]["source"]] = by_source.get(rows[k]["source"], 0) + n
    for s, target in want.items():
        assert abs(by_source.get(s, 0) - target) <= 2 * mixing.BLOCK
    # shards are full but for the last, and blocks are whole but for the last of a source
    slots = mix.groupBy("shard", "source_no", "epoch", "block").agg(F.sum("words").alias("n"))
    per_shard = sorted(r["count"] for r in slots.groupBy("shard").count().collect())
    assert per_shard[1:] == [300] * (len(per_shard) - 1)
    assert slots.where(f"n < {mixing.BLOCK}").select("source_no", "block").distinct().count() <= len(sizes)
    # every epoch takes a block once, and the first epoch all blocks before the second starts
    assert slots.groupBy("source_no", "epoch", "block").count().where("count > 1").count() == 0
    # pieces of a row are apart: no word twice in an epoch
    assert mix.groupBy("row", "epoch").agg(F.sum("words").alias("n")).join(sized, "row").where("n > size").count() == 0
    again = mixing.mix(df.repartition(5), per_shard=300)
    count = lambda s, m: sorted((r["id"], r["n"]) for r in m.groupBy("row").agg(F.sum("words").alias("n")).join(s, "row").collect())
    assert count(again[0], again[2]) == count(sized, mix)
    mix.unpersist()


def test_draws_differ_between_shards_and_settle(spark):
    quotas = spark.createDataFrame([(0, 10_000, 10_000), (1, 500, 1000), (2, 30_000, 3000), (2000, 50, 100)], "source_no long, blocks long, slots long")
    drawn = mixing.draws(quotas, 500, 1).groupBy("shard").pivot("source_no", [0, 1, 2, 2000]).sum("count").fillna(0).collect()
    assert sum(sum(r[1:]) for r in drawn) == 14_100 and len({r["0"] for r in drawn}) > 5
    got = mixing.slots(quotas, 500, 1)
    numbers = {r["source_no"]: r for r in got.groupBy("source_no").agg(F.count("*").alias("n"), F.countDistinct("number").alias("d"), F.max("number").alias("m")).collect()}
    assert {s: (r["n"], r["d"], r["m"]) for s, r in numbers.items()} == {s: (n, n, n - 1) for s, n in ((0, 10_000), (1, 1000), (2, 3000), (2000, 100))}
    assert {r["count"] for r in got.groupBy("shard").count().collect()} <= {500, 100}


def test_permutations():
    rng = np.random.default_rng(0)
    for n in [1, 2, 3, 4, 5, 16, 17, 1000, 1024, 1025]:
        a, b = (mixing.permuted(np.arange(n), np.full(n, n), np.full(n, k)) for k in (1, 2))
        assert sorted(a) == sorted(b) == list(range(n))
        assert n < 16 or (a != b).any() and (a != np.arange(n)).any()
    n = rng.integers(1, 1 << 40, 500)
    at = rng.integers(0, n)
    assert ((x := mixing.permuted(at, n, at)) >= 0).all() and (x < n).all()


def test_running_sums(spark):
    """One key holds most rows, which spread over tasks."""
    df = spark.range(5000).selectExpr("if(id % 10 < 7, 3, id % 10) AS k", "id % 11 AS v", "id AS o", "'x' AS _x")
    seen = {}
    want = []
    for r in sorted(df.collect(), key=lambda r: (r["k"], r["o"])):
        want.append((r["k"], r["o"], seen.get(r["k"], 0)))
        seen[r["k"]] = seen.get(r["k"], 0) + r["v"]
    out = running_sums(df, "k", ["o"], "v", "s")
    assert sorted((r["k"], r["o"], r["s"]) for r in out.collect()) == want


def test_odd_and_empty(spark):
    df = odd_documents(spark)
    sized, table, mix = mixing.mix(df)
    assert sized.count() == df.count()
    taken = mix.groupBy("row").agg(F.sum("words").alias("n")).join(sized, "row")
    assert taken.where("n > 2 * size").count() == 0
    sized, table, mix = mixing.mix(empty_documents(spark))
    assert sized.count() == table.count() == mix.count() == 0
    blank = spark.createDataFrame([(1, None, " "), (2, "a", None)], "doc_id long, source string, text string")
    sized, table, mix = mixing.mix(blank)
    assert [r["target"] for r in table.collect()] == [0.0, 0.0] and mix.count() == 0
