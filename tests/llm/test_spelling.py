import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.llm import spelling

from .helpers import LONG, documents, empty_documents, odd_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain(docs, every=97, least_chars=5, least_count=3):
    counts = Counter()
    for key, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            counts[w] += 1
    voc = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}
    out = {}
    for w, n in voc.items():
        close = [x for x in voc if near(w, x)]
        best = min(close, key=lambda x: (-voc[x], x), default=None)
        out[w] = (n, len(close), best if best and voc[best] >= 2 * n else None)
    res = set()
    for w, (n, k, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        res.add((w, n, k, form, voc[form] if form else None, root))
    return res


def got(df, **kw):
    rows = spelling.variants(df, **kw).collect()
    out = {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_equals_definition(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("aabé") for _ in range(rng.randint(4, 8))) for _ in range(150)]
    docs = documents(spark, [" ".join(rng.choice(stems) + rng.choice(["", "s", "A", "É", "-x"]) for _ in range(400)) for _ in range(12)])
    want = plain(texts(docs), every=5)
    assert got(docs, every=5) == want
    assert len({r[5] for r in want if r[3]}) > 3 and any(r[3] and r[5] != r[3] for r in want)


def test_runs_of_a_character_give_each_pair_once(spark):
    df = spark.createDataFrame([("a" * k + "b" * m,) for k in range(1, 5) for m in range(3)] + [("aab",), ("ab" * 3,)], "word string").distinct()
    words = [r["word"] for r in df.collect()]
    pairs = [tuple(r) for r in spelling.near_pairs(df).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in words for b in words if near(a, b)}


def test_states_are_those_of_the_minimal_acceptor(spark):
    words = ["tests", "test", "rests", "rest", "nest", "nests", "toast"]
    prefixes, _ = spelling.composed(spark.createDataFrame([(w,) for w in words], "word string"))
    rests = {w[:k]: frozenset(x[k:] for x in words if x.startswith(w[:k])) for w in words for k in range(len(w) + 1)}
    assert prefixes.count() == len(rests)
    assert prefixes.select("state").distinct().count() == len(set(rests.values()))


def test_odd_rows(spark):
    df = odd_documents(spark)
    assert got(df, least_count=1) == plain(texts(df), least_count=1)
    long = documents(spark, ["x" * 300_000 + " " + "x" * 299_999, LONG, None, ""])
    assert got(long, least_count=1) == plain(texts(long), least_count=1)
    assert got(empty_documents(spark)) == set()


def test_codes(spark):
    """The transducer reads code points: one accented letter is one edit."""
    df = spark.createDataFrame([("señor",), ("senor",), ("seor",), ("señora",)], "word string")
    assert spelling.near_pairs(df).where(F.col("word") == "señor").count() == 3


def test_no_join_broadcasts_what_grows_with_the_words(spark, monkeypatch):
    """Spark took the walks of a small file of words for small as well, and broadcast them."""
    plans, write = [], spelling.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(spelling, "written", lambda df: plans.append(plan(df)) or write(df))
    rows = [f"{stem}{end}" for stem in ("walking", "talking", "taking") for end in ("", "s", "x")]
    out = spelling.variants(documents(spark, [" ".join(rows)] * 4))
    plans.append(plan(out))
    assert out.where("n_near > 0").count() == len(rows)
    assert not any("Broadcast" in p for p in plans) and sum(p.split("Initial Plan")[0].count("SortMergeJoin") for p in plans) >= 8
