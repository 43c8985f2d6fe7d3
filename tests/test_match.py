import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.similarity import ratio
from ledgerlens.operators.candidates import candidate_pairs, grid_scored_pairs, scored_pairs
from ledgerlens.operators.match import match, match_multi


def _brute_best(a_keys, b_rows, t):
    """Reference semantics: dict of B keys in first-seen order, payload = last row, best by ratio, ties first."""
    order, payload = [], {}
    for pos, (k, p) in enumerate(b_rows):
        k2 = k.lower().strip()
        if k2 not in payload:
            order.append(k2)
        payload[k2] = p
    out = {}
    for ka in a_keys:
        k = ka.lower().strip()
        if k in payload:
            out[ka] = ("Exact", 100.0, payload[k])
            continue
        best, bk = -1.0, None
        for kb in order:
            r = ratio(k, kb)
            if r > best:
                best, bk = r, kb
        out[ka] = ("Fuzzy", best, payload[bk]) if bk is not None and best >= t else ("No Match", 0.0, None)
    return out


def test_match_equals_brute_force(spark):
    rnd = random.Random(11)
    words = ["red", "blue", "anvil", "gear", "bolt", "small", "hot", "ring"]
    a_keys = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3))) for _ in range(80)]
    b_rows = []
    for i in range(90):
        k = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))
        if rnd.random() < 0.3:
            k = k.upper() + " "
        if rnd.random() < 0.3 and len(k) > 3:
            k = k[1:]
        b_rows.append((k, i))
    a = spark.createDataFrame([(i, k) for i, k in enumerate(a_keys)], "aid int, key string")
    b = spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(b_rows)], "pos int, bkey string, payload int")
    for t in (60, 90):
        got = {r.key: (r.match_type, round(r.similarity_score, 9), r.payload)
               for r in match(a, b, "key", "bkey", extract=["payload"], threshold=t, b_order="pos").collect()}
        exp = _brute_best(a_keys, [(k, p) for k, p in b_rows], t)
        for k in a_keys:
            e = exp[k]
            assert got[k][0] == e[0], (t, k, got[k], e)
            assert abs(got[k][1] - e[1]) < 1e-9
            assert got[k][2] == e[2], (t, k, got[k], e)


def test_prefix_and_grid_agree(spark):
    rnd = random.Random(5)
    keys = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randint(1, 25))) for _ in range(150)]
    left = spark.createDataFrame([("0", k) for k in set(keys[:80])], "blk string, ka string")
    right = spark.createDataFrame([("0", k) for k in set(keys[70:])], "blk string, kb string")
    for t in (70, 90):
        g = {(r.ka, r.kb) for r in grid_scored_pairs(left, right, t).collect()}
        p = {(r.ka, r.kb) for r in scored_pairs(left, right, t, method="prefix").collect()}
        brute = {(x, y) for x in set(keys[:80]) for y in set(keys[70:]) if 200 * __import__(
            "ledgerlens.functions.similarity", fromlist=["lcs_len"]).lcs_len(x, y) >= t * (len(x) + len(y))}
        assert g == brute
        assert p == brute


def test_candidates_are_lossless(spark):
    rnd = random.Random(9)
    keys = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(120)]
    left = spark.createDataFrame([("0", k) for k in set(keys)], "blk string, ka string")
    right = spark.createDataFrame([("0", k) for k in set(keys)], "blk string, kb string")
    cand = {(r.ka, r.kb) for r in candidate_pairs(left, right, 80).select("ka", "kb").collect()}
    for x in set(keys):
        for y in set(keys):
            if ratio(x, y) >= 80:
                assert (x, y) in cand


def test_match_edges(spark):
    a = spark.createDataFrame([(1, "Bob"), (2, None), (3, "x")], "id int, k string")
    empty_b = spark.createDataFrame([], "bid int, k2 string")
    r = match(a, empty_b, "k", "k2", b_order="bid").collect()
    assert all(x.category == "unmatched" and x.similarity_score == 0.0 for x in r)
    b = spark.createDataFrame([(1, None), (2, " BOB "), (3, "bob")], "bid int, k2 string")
    rows = {x.id: x for x in match(a, b, "k", "k2", extract=["bid"], b_order="bid").collect()}
    assert rows[1].match_type == "Exact" and rows[1].bid == 3  # last row with the key wins the payload
    assert rows[2].match_type == "Exact"  # null keys match each other (reference turns both into text)
    rows = {x.id: x for x in match(a, b, "k", "k2", extract=["bid"], b_order="bid", null_keys="never").collect()}
    assert rows[2].category == "unmatched"
    # a clashing extracted column gets the SheetB_ prefix
    b2 = b.withColumnRenamed("bid", "id")
    cols = match(a, b2, "k", "k2", extract=["id"], b_order="id").columns
    assert "SheetB_id" in cols


def test_multi_column_ties_first_row(spark):
    a = spark.createDataFrame([(1, "anvil", "brand#1")], "id int, n string, b string")
    b = spark.createDataFrame([(10, "anvi", "brand#1"), (11, "anvil", "brand#2"), (12, "anvi", "brand#1")],
                              "bid int, n string, b string")
    r = match_multi(a, b, ["n", "b"], ["n", "b"], extract=["bid"], threshold=80, b_order="bid").collect()[0]
    assert r.bid == 10
    assert r.category in ("matched", "suggested")
    assert [f.field for f in r.field_breakdown] == ["n → n", "b → b"]


def test_match_independent_of_shuffle_partitions(spark):
    from ledgerlens.sources.fixtures import fixture
    from conftest import SF
    a = fixture(spark, SF, "fx_match_a")
    b = fixture(spark, SF, "fx_match_b")
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for p in ("3", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", p)
            r = match(a, b, "item", "item", extract=["id"], b_order="id")
            results.append(sorted((x.item, x.match_type, x.similarity_score, x.SheetB_id) for x in r.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]


def _multi_brute(a, b, weights, t):
    """Best partner of each A tuple by definition: (score, B position) or the best score below t."""
    out = {}
    for ra in a:
        best = max(((sum(w * ratio(x, y) for w, x, y in zip(weights, ra[1:], rb[1:])), -rb[0]) for rb in b), default=None)
        out[ra[0]] = best
    return out


@pytest.mark.parametrize("weights, t, report_best", [([0.5, 0.5], 80, True), ([0.4, 0.3, 0.3], 75, False), ([0.8, 0.1, 0.1], 60, False)])
def test_multi_column_equals_brute_force(spark, weights, t, report_best):
    """One field leads, or several are united; unmatched rows report their best score on request."""
    rnd = random.Random(len(weights) * 100 + t)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7)))
    n = len(weights)
    a = [(i, *[word() for _ in range(n)]) for i in range(60)]
    b = [(i, *[word() for _ in range(n)]) for i in range(60)]
    names = [f"f{k}" for k in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} string" for c in names))
    got = {r.id: r for r in match_multi(frame(a), frame(b), names, names, extract=["id"], threshold=t, weights=weights, b_order="id",
                                        report_best=report_best).collect()}
    for i, (score, pos) in _multi_brute(a, b, [w / sum(weights) for w in weights], t).items():
        assert got[i].similarity_score == (pytest.approx(score) if score >= t or report_best else None)
        if got[i].match_type == "Multi-Field Exact":
            continue
        if score >= t:
            assert got[i].SheetB_id == -pos and got[i].match_type.startswith("Multi-Field")
        else:
            assert got[i].match_type == "No Multi-Field Match" and got[i].SheetB_id is None and got[i].category == "unmatched"


def test_unreadable_targets_become_rows(spark, tmpdir_path):
    from ledgerlens.operators.match import match_batch_readers
    from ledgerlens.operators.summaries import batch_summary
    with open(f"{tmpdir_path}/broken.parquet", "wb") as f:
        f.write(b"no parquet")
    ref = spark.createDataFrame([(1, "anvil"), (2, "hammer"), (3, "nail")], "id int, k string")
    good = spark.createDataFrame([(1, "ANVIL"), (2, "hamer")], "id int, k string")
    readers = {"a": lambda: good, "broken": lambda: spark.read.parquet(f"{tmpdir_path}/broken.parquet"),
               "absent": lambda: spark.read.parquet(f"{tmpdir_path}/absent.parquet"), "b": lambda: good, "raises": lambda: 1 / 0}
    out = match_batch_readers(ref, readers, "k", "k", target_order="id")
    rows = {r["_target"]: r for r in batch_summary(out, list(readers)).collect()}
    assert {n: r["outcome"] for n, r in rows.items()} == {"a": "success", "b": "success", "broken": "error", "absent": "error", "raises": "error"}
    assert rows["raises"]["error"] == "division by zero" and rows["broken"]["match_rate"] is None and rows["broken"]["status"] is None
    assert (rows["a"]["exact"], rows["a"]["rows"]) == (1, 3)
    assert rows["a"]["success_rate"] == 40.0 and rows["a"]["is_best"] and rows["a"]["is_worst"] and not rows["b"]["is_best"]
    nothing = match_batch_readers(ref, {"raises": lambda: 1 / 0}, "k", "k")
    assert [r["outcome"] for r in nothing.collect()] == ["error"]
