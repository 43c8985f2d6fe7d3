import hashlib
import random
import zlib

import pytest

from ledgerlens.llm import prefixtrie
from ledgerlens.llm.common import written


def plain(rows, block, shared):
    """The nodes by definition, from (conv_id, turn, role, text) rows."""
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (
            r[0], r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).hexdigest())):
        own.setdefault(conv, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (shared + 1)
        built[c] = own.get(c - int(c % block if c >= 0 else -(-c % block)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for key, members in nodes.items():
        subtree = [k for k in nodes if k[: len(key)] == key]
        leaf = [k for k in subtree if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in subtree)]
        ends = sorted(c for c in members if len(built[c]) == len(key))
        out.add((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members),
                 sum(len(k) == len(key) + 1 for k in subtree), len(leaf),
                 sum((len(nodes[k]) - 1) * len(k[-1][1].split()) for k in subtree if k),
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "'clash' AS path", "'clash' AS class", "'clash' AS t", "'clash' AS depth", "'clash' AS rim")


def trie(spark, rows, block=20, shared=3):
    paths = written(prefixtrie.conversation_paths(frame(spark, rows)))
    got = prefixtrie.prefix_trie(prefixtrie.with_shared_start(paths, block, shared)).collect()
    out = {(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}
    assert len(out) == len(got)
    return out


def some_rows(seed, n, words="ab", long=12):
    rng = random.Random(seed)
    return [(c, k, rng.choice(["user", "assistant"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 2))))
            for c in range(-5, n) for k in range(rng.choice([0, 1, 2, 3, 5, long]))]


@pytest.mark.parametrize("tasks", [1, 7])
def test_equals_definition(spark, monkeypatch, tasks):
    rows = some_rows(1, 150)
    rows += [(200 + c, k, "user", "same start") for c in range(60) for k in range(4)]  # copies
    rows += [(300, k, "user", f"turn {k % 3}") for k in range(150)]  # a long one
    rows += [(None, 0, "user", "x"), (7, None, None, None), (7, None, None, None), (7, 0, "user", " a b\x0bc")]
    monkeypatch.setattr(prefixtrie, "PER_TASK", 1 << 30 if tasks == 1 else 200)
    monkeypatch.setattr(prefixtrie, "BATCH", 1 << 20 if tasks == 1 else 16)
    monkeypatch.setattr(prefixtrie, "CHUNK", 64)
    assert trie(spark, rows) == plain(rows, 20, 3)


def test_empty_and_turnless(spark):
    assert trie(spark, []) == set()
    assert trie(spark, [(None, 0, "user", "x")]) == set()
    # conversations 21.. lose their only turns to the absent conversation 20
    rows = [(c, 0, "user", "x") for c in range(21, 40)]
    assert trie(spark, rows) == plain(rows, 20, 3)


@pytest.mark.parametrize("seed", range(6))
def test_z_fast_trie_finds_exit_nodes(seed):
    """Compacted nodes and exit nodes against the plain definition, inserted in batches of several sizes."""
    rng = random.Random(seed)
    turn = [bytes([k]) * 16 for k in range(3)]
    paths = list({b"".join(rng.choice(turn[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))) for _ in range(400)})
    t, at = prefixtrie.ZFastTrie(), 0
    while at < len(paths):
        size = rng.choice([1, 7, 100])
        t.insert([(t.hashes(p), p) for p in paths[at: at + size]])
        at += size
    assert sorted(e for e in t.ends if e is not None) == sorted(paths)
    prefixes = {p[: 16 * d] for p in paths for d in range(len(p) // 16 + 1)}
    kids = {x: sum(x + k in prefixes for k in turn) for x in prefixes}
    explicit = {x for x in prefixes if kids[x] != 1 or x in paths or not x}
    assert {t.at(h, e) if e else b"" for h, e in zip(t.of, t.extent)} == {t.hashes(x)[-16:] for x in explicit}
    for _ in range(300):
        p = b"".join(rng.choice(turn) for _ in range(rng.randint(0, 45)))
        _, depth = t.exit(t.hashes(p))
        assert depth == max(d for d in range(len(p) // 16 + 1) if p[: 16 * d] in prefixes)


def test_two_fattest():
    for low in range(70):
        for high in range(low + 1, 71):
            best = max(range(low + 1, high + 1), key=lambda x: x & -x)
            assert prefixtrie.two_fattest(low, high) == best
