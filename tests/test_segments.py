"""The segment index loses no pair, whatever the edits, and best_matches equals brute force."""
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.similarity import ratio
from ledgerlens.operators.segments import CROWDED, best_matches, crowding, segment_pairs


def edited(rng, s, share):
    out = []
    for ch in s:
        x = rng.random()
        if x < share / 2:
            continue
        out.append(ch)
        if x > 1 - share / 2:
            out.append(rng.choice("abcdef "))
    return "".join(out)


def keys(seed, n, alphabet):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    other = [edited(rng, rng.choice(base), rng.choice([0, 0.02, 0.1, 0.2])) for _ in range(n)]
    return sorted({x for x in base if x}), sorted({x for x in other if x})


@pytest.mark.parametrize("t", [70.0, 80.0, 90.0, 95.0])
def test_no_pair_is_lost(spark, t):
    a, b = keys(int(t), 120, "abcd")
    got = segment_pairs(spark.createDataFrame([("0", k, i) for i, k in enumerate(a)], "blk string, ka string, ida long"),
                        spark.createDataFrame([("0", k, i) for i, k in enumerate(b)], "blk string, kb string, idb long"), t)
    got = [tuple(r) for r in got.collect()]
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if ratio(x, y) >= t}
    assert len(got) == len(set(got)) and want <= set(got) and want
    with pytest.raises(ValueError):
        segment_pairs(None, None, 60.0)


@pytest.mark.parametrize("t, crowded", [(60.0, 2.0), (80.0, 2.0), (88.0, 2.0), (80.0, 0.002)])
def test_best_matches(spark, t, crowded):
    a, b = keys(5, 150, "abc def")
    rows_a = [(str(i % 2), k) for i, k in enumerate(a)] + [("0", "")]
    rows_b = [(str(i % 2), k, 1000 - i) for i, k in enumerate(b)]
    got = {(r["blk"], r["ka"]): (r["kb"], r["score"]) for r in best_matches(
        spark.createDataFrame(rows_a, "blk string, ka string"), spark.createDataFrame(rows_b, "blk string, kb string, pos long"), t, crowded).collect()}
    want = {}
    for blk, k in rows_a:
        hits = [(-ratio(k, y), pos, y) for blk2, y, pos in rows_b if blk2 == blk and ratio(k, y) >= t]
        if hits:
            want[blk, k] = (min(hits)[2], -min(hits)[0])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_the_index_is_left_where_keys_share_one_vocabulary(spark):
    rng = random.Random(2)
    words = ["polished", "burnished", "copper", "steel", "promo", "standard"]
    frame = lambda ks, k, i: spark.createDataFrame([("0", x, n) for n, x in enumerate(sorted(set(ks)))], f"blk string, {k} string, {i} long")
    same = [" ".join(rng.choice(words) for _ in range(5)) for _ in range(300)]
    other = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) for _ in range(300)]
    crowded, free = (crowding(frame(ks, "ka", "ida"), frame([k[1:] for k in ks], "kb", "idb"), 95.0) for ks in (same, other))
    assert crowded > 10 * free and crowded > CROWDED


def test_candidates_grow_with_the_table_not_with_its_square(spark):
    """Diverse keys: twice the keys on both sides, about twice the candidates."""
    def count(n):
        rng = random.Random(1)
        base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30)) for _ in range(n)]
        a = spark.createDataFrame([("0", k, i) for i, k in enumerate(base)], "blk string, ka string, ida long")
        b = spark.createDataFrame([("0", k[1:], i) for i, k in enumerate(base)], "blk string, kb string, idb long")
        return segment_pairs(a, b, 90.0).count()

    one, two = count(500), count(1000)
    assert one >= 500 and two <= 2.4 * one
