import re
import string

import numpy as np

from ledgerlens.llm import decontam
from tests.llm.helpers import LONG, documents, empty_documents, odd_documents


def plain_words(text):
    return re.sub(f"[{re.escape(string.punctuation)}\x00-\x1f\x7f]", " ", (text or "").lower()).split()


def plain_shingles(words, width):
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def plain_leaks(docs, items, threshold=0.8):
    out = {}
    for n, item in items:
        w = plain_words(item)
        x = plain_shingles(w, min(5, len(w))) if w else set()
        for i, t in docs:
            m = len(x & plain_shingles(plain_words(t), min(5, len(w)))) if x else 0
            if x and m >= threshold * len(x) - 1e-9:
                out[i, n] = (m, len(x))
    return out


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'clash' AS id", "'clash' AS item", "1 AS matched")


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{k}" for k in range(300)]
    items = [(n, " ".join(rng.choice(vocab, int(rng.integers(5, 60))))) for n in range(40)]
    items += [(100, "Só três"), (101, "two, words!"), (102, None), (103, "..."), (104, items[3][1]), (105, "one")]
    docs = [" ".join(rng.choice(vocab, 400)) for _ in range(30)]
    for n, t in items[:30]:
        body = rng.choice(vocab, 3000).tolist()
        w = t.split()
        for _ in range(n % 4):  # some changed words
            w[int(rng.integers(len(w)))] = "changed"
        docs.append(" ".join(body[:1000] + w + body[1000:]).upper() if n % 3 else ", ".join(body[:9] + w))
    docs += ["x só três y", "nothing two\nwords here", LONG]
    got = {(r["id"], r["item"]): (r["matched"], r["n_shingles"]) for r in
           decontam.leaks(documents(spark, docs), items_frame(spark, items)).collect()}
    expected = plain_leaks(list(enumerate(docs)), items)
    assert got == expected and len(expected) > 15
    # the same in many blocks of items
    blocks = decontam.leaks(documents(spark, docs), items_frame(spark, items), block=200)
    assert {(r["id"], r["item"]) for r in blocks.collect()} == set(expected)
    kept = decontam.without_leaks(documents(spark, docs), items_frame(spark, items), block=300)
    assert kept.columns == documents(spark, docs).columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(docs))) - {i for i, _ in expected}


def test_shingles_over_part_borders(monkeypatch):
    monkeypatch.setattr(decontam, "PART", 7)
    words = decontam.normalised(" ".join(f"a{k}" for k in range(50)))
    parts = [(h, s, e) for h, s, e in decontam.shingles(words, 5)]
    texts = [words[i:j] for _, s, e in parts for i, j in zip(s.tolist(), e.tolist())]
    assert texts == [" ".join(f"a{k}" for k in range(i, i + 5)).encode() for i in range(46)]
    monkeypatch.setattr(decontam, "PART", 10_000)
    whole = next(decontam.shingles(words, 5))[0]
    assert np.array_equal(np.concatenate([h for h, _, _ in parts]), whole)


def test_odd_rows(spark):
    items = items_frame(spark, [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (None, "the end")])
    df = odd_documents(spark)
    rows = decontam.leaks(df, items).collect()
    assert sorted((r["item"] is None) for r in rows) == [False] * 2 + [True] * 2
    assert decontam.without_leaks(df, items).count() == df.count() - 3
    assert decontam.leaks(empty_documents(spark), items).count() == 0
    assert decontam.leaks(df, items.limit(0)).count() == 0
    assert decontam.without_leaks(df, items.limit(0)).count() == df.count()
