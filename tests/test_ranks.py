import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import ranks


def test_quantiles_match_numpy(spark):
    rnd = random.Random(1)
    vals = [float(rnd.choice(range(40))) for _ in range(997)] + [5.0] * 300  # heavy ties and a hot value
    df = spark.createDataFrame([("c", v) for v in vals], "column string, value double")
    q = {r.p: r.q for r in ranks.quantiles(df, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]).collect()}
    for p, v in q.items():
        assert abs(v - float(np.percentile(vals, p * 100))) < 1e-9


def test_row_positions_total_order(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 20), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int")
    got = sorted((r._pos, r.k, r.i) for r in ranks.row_positions(df, ["k", "i"], partitions=7).collect())
    exp = sorted(rows)
    assert [g[0] for g in got] == list(range(500))
    assert [(g[1], g[2]) for g in got] == exp


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([("c", v) for v in [1.0, 2.0, 2.0, 3.0, 3.0, 3.0]], "column string, value double")
    r = {x.value: x.avg_rank for x in ranks.average_ranks(df).collect()}
    assert r == {1.0: 1.0, 2.0: 2.5, 3.0: 5.0}


def test_quantiles_per_group_independent_of_partitions(spark):
    df = spark.range(0, 1000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("column"),
                                     (F.col("id") % 37).cast("double").alias("value"))
    q1 = sorted(ranks.quantiles(df, [0.5], cum=ranks.cumulative_counts(df, partitions=3)).collect())
    q2 = sorted(ranks.quantiles(df, [0.5], cum=ranks.cumulative_counts(df, partitions=11)).collect())
    assert q1 == q2
