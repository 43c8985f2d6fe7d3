import numpy as np
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from ledgerlens.llm import simhash
from ledgerlens.llm.common import components
from tests.llm.helpers import documents, empty_documents, odd_documents


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)]
    hashes = [xxh64_intdigest(p, seed=42) for p in parts] if words else []
    return sum(1 << k for k in range(64) if 2 * sum((h >> k) & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, bits):
    group = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= bits and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    least = {}
    for g, i in zip(group, ids):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [least.get(g) for g in group]


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{k}" for k in rng.integers(0, 500, 60)) for _ in range(25)]
    near = []
    for t in base[:12]:
        for _ in range(4):
            w = t.split()
            w[int(rng.integers(len(w)))] = "changed"
            near.append(" ".join(w))
    texts = base + near + base[:5] + [None, "", "One", "one"]
    got = {r["id"]: (r["fp"] & (2 ** 64 - 1), r["component"]) for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    fps = [plain_fingerprint(t, 4) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == fps
    assert [got[i][1] for i in range(len(texts))] == plain_components(fps, range(len(texts)), 4)


def test_crowded_keys_keep_their_components(spark, monkeypatch):
    """Chains within a crowded range: groups larger than a chunk give the components of all pairs."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = np.random.default_rng(2)
    fps = set()
    for centre in rng.integers(0, 2 ** 63, 3).tolist():
        for _ in range(120):
            x = centre
            for k in rng.choice(64, int(rng.integers(0, 7)), replace=False).tolist():
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2 ** 64 if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    label = [got.get(x, x) for x in signed]
    expected = plain_components(fps, range(len(fps)), 4)
    assert len(set(zip(label, expected))) == len(set(label)) == len(set(expected))
    assert links.count() < 15 * 30 * len(fps)


def test_coordinates_never_discard_a_link():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2 ** 63, 500).astype(np.uint64)
    b = a.copy()
    for k in range(500):
        for bit in rng.choice(64, 4, replace=False).tolist():
            b[k] ^= np.uint64(1 << bit)
    p = simhash.pivots(32)
    ca, cb = (np.bitwise_count(x[None, :] ^ p[:, None]) for x in (a, b))
    i = np.arange(500)
    assert len(simhash._near(a, ca, b, cb, i, i, 4)[0]) == 500


def test_coordinates_are_distances_to_the_pivots(spark):
    fps = np.random.default_rng(4).integers(-2 ** 63, 2 ** 63, 50)
    p = simhash.pivots(16)
    rows = simhash.with_coordinates(spark.createDataFrame([(int(x),) for x in fps], "fp long"), p).toPandas()
    got = simhash.coordinates([rows["c0"].to_numpy(), rows["c1"].to_numpy()])
    assert (got == np.bitwise_count(rows["fp"].to_numpy().view(np.uint64)[None, :] ^ p[:, None])).all()


def test_odd_rows(spark):
    df = odd_documents(spark)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == df.count()
    zero = [r for r in rows if r["fp"] == 0]
    assert {r["component"] for r in zero} == {0} and len(zero) >= 3
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
    nothing = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert [r["component"] for r in simhash.near_duplicates(nothing).collect()] == [None, None]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[1001 + i] == 1000 for i in range(300))
    none = spark.createDataFrame([], T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    assert components(none).count() == 0
