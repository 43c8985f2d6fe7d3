import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mtree


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.selectExpr("*", "'clash' AS id", "'clash' AS v", "'clash' AS rank", "'clash' AS tree")


def plain(vectors, k, every, ids=None):
    ids = list(range(len(vectors))) if ids is None else ids
    usable = [(i, np.floor(1024 * np.array(v, np.float32).astype(float))) for i, v in zip(ids, vectors)
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if i % every == 0:
            found = sorted((-int(q @ x), j) for j, x in usable if j != i and len(x) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def got(df, k=10, every=20, **more):
    return sorted(tuple(r) for r in mtree.top_k(df, F.col("id") % every == 0, k, 1024, **more).collect())


@pytest.mark.parametrize("kind", ["random", "clusters", "scaled"])
def test_same_as_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 12))
    if kind == "clusters":
        v = rng.normal(size=(6, 12))[rng.integers(0, 6, 900)] + 0.05 * v
    if kind == "scaled":
        v *= rng.exponential(size=(900, 1)) * 3
    vectors = v.astype(np.float32).tolist()
    assert got(frame(spark, vectors), rows=200, queries=16) == plain(vectors, 10, 20)


def test_many_equal_vectors(spark):
    """A third of all rows are one vector: ties go to the smaller id, and its rows spread over several trees."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 8))
    v[rng.choice(600, 250, replace=False)] = v[0]
    vectors = v.astype(np.float32).tolist()
    assert got(frame(spark, vectors), rows=100) == plain(vectors, 10, 20)


def test_bounds_avoid_distances():
    rng = np.random.default_rng(6)
    v = np.floor(1024 * (rng.normal(size=(8, 10))[rng.integers(0, 8, 4000)] + 0.02 * rng.normal(size=(4000, 10))))
    ids = np.arange(4000)
    norm2 = float((v * v).sum(1).max())
    pages = mtree.build(ids, v, norm2)
    children = [[] for _ in pages]
    for p in pages:
        p["vectors"] = np.reshape(p["vectors"], (-1, 10))
        if p["page"]:
            children[p["parent"]].append(p["page"])
    seen = []
    for i in range(0, 4000, 200):
        best = mtree.Best(10, -(2 ** 63))
        seen.append(mtree.search(pages, children, v[i], i, norm2, best))
        scores = v @ v[i]
        expected = sorted((-s, j) for s, j in zip(scores.tolist(), ids.tolist()) if j != i)[:10]
        assert list(zip(best.scores.tolist(), best.ids.tolist())) == [(int(-s), j) for s, j in expected]
    assert np.mean(seen) < 2500


def test_covering_radii():
    rng = np.random.default_rng(7)
    v = np.floor(1024 * rng.normal(size=(700, 6)))
    norm2 = float((v * v).sum(1).max())
    pages = mtree.build(np.arange(700), v, norm2)
    points = mtree.lifted(v, norm2)
    below = {p["page"]: set(np.array(p["ids"]).tolist()) for p in pages}
    for p in reversed(pages[1:]):
        below[p["parent"]] |= below[p["page"]]
    assert below[0] == set(range(700))
    for p in pages:
        at = sorted(below[p["page"]])
        centre = mtree.lifted(p["routing"][None, :], norm2)[0]
        assert mtree.distances(points[at], centre).max() <= p["radius"] + 1e-6 and p["least_id"] == at[0]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], None, [], [1.0, None], [nan, 1.0], [inf, 0.0], [1.0, 2.0, 3.0], [0.5, 0.5], [1.0, 2.0], [-1.0, 0.0], [2e8, 1.0]]
    ids = [0, 20, 40, 60, 80, 100, 120, 7, 8, 9, None]
    assert got(frame(spark, vectors, ids)) == plain(vectors, 10, 20, ids)
    assert got(frame(spark, [])) == []
    twice = [[1.0, 2.0], [1.0, 2.0], [3.0, 4.0], [3.0, 4.0]]
    rows = got(frame(spark, twice, [0, 0, 1, 1]))
    assert [r[:3] for r in rows] == [(0, 1, 1), (0, 2, 1)]


def test_large_components_stay_exact():
    a = np.array([[2.0 ** 40, 3.0, 1.0]])
    assert mtree.products(a, np.array([2.0 ** 20, 1.0, 1.0])).tolist() == [2 ** 60 + 4]
