import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import lattice_lm as lm
from ledgerlens.llm.common import crc32_mod
from tests.llm.helpers import documents, empty_documents, odd_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain_marginal(word, number, lp):
    """Sum over all segmentations, by recursion over the rest of the word."""
    marked = b" " + word

    @lru_cache(None)
    def rest(i):
        if i == len(marked):
            return 1.0
        return sum(math.exp(lp[number[marked[i:j]]]) * rest(j) for j in range(i + 1, len(marked) + 1) if marked[i:j] in number)

    return math.log(rest(0)) + lp[number[lm.STOP]]


def test_forward_recursion_sums_all_segmentations():
    pieces, lp = lm.read_pieces(MODEL)
    number = {p: i for i, p in enumerate(pieces)}
    lattice = lm.Lattice(pieces)
    words = [b"the", b"internationalisation", "é".encode(), b"x", b"\xff\xfe", b"aaaaaaaaaa", "日本".encode()]
    got = lattice.marginals(words, lp)
    assert got == pytest.approx([plain_marginal(w, number, lp) for w in words], rel=1e-9)
    assert lattice.marginal_long(b" internationalisation", lp) == pytest.approx(got[1], rel=1e-9)
    best = max(lp[number[b" the"]], -1e9)
    assert got[0] > best + lp[number[lm.STOP]]  # more than the best segmentation alone


def test_expected_counts_are_posteriors():
    pieces = [b" ", b"a", b"b", b" a", b"ab", lm.STOP]
    lp = np.log(np.array([0.2, 0.2, 0.2, 0.1, 0.1, 0.2]))
    lattice = lm.Lattice(pieces)
    # " ab": [ ][a][b], [ a][b], [ ][ab]
    w = np.array([0.2 * 0.2 * 0.2, 0.1 * 0.2, 0.2 * 0.1])
    p = w / w.sum()
    assert lattice.expected([b"ab"], lp) == pytest.approx([p[0] + p[2], p[0], p[0] + p[1], p[1], p[2], 1.0])


def test_scores_are_proper_and_base_is_as_defined(spark):
    texts = [f"the cat {i % 7} sat\non the mat number{i}" for i in range(60)] + [None, "", "THE Cat"]
    rows = lm.score_texts(documents(spark, texts), crc32_mod(F.col("doc_id"), 7) != 2, MODEL, hot=8).collect()
    assert len(rows) == len(texts)
    trained = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    c = Counter(x for i, t in tokens.items() if trained[i] for x in t)
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = tokens[r["id"]]
        assert (r["train"], r["n_tokens"], r["train_tokens"]) == (trained[r["id"]], len(t), n)
        assert r["n_known"] == sum(c[x] > 0 for x in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), abs=1e-9)
        assert r["score"] < 0
    # the same whether words are broadcast or joined
    again = lm.score_texts(documents(spark, texts), crc32_mod(F.col("doc_id"), 7) != 2, MODEL).collect()
    assert {r["id"]: r["score"] for r in again} == pytest.approx({r["id"]: r["score"] for r in rows}, abs=1e-9)


def test_probabilities_of_one_word_texts_add_up_to_less_than_one(spark):
    words = ["a", "b", "ab", "ba", "aa", "bb", "c", "abc"]
    df = documents(spark, ["a b ab", "ab ab a", "ba"] + words)
    rows = {r["id"]: r["score"] for r in lm.score_texts(df, F.col("doc_id") < 3, MODEL).collect()}
    # three of nine training tokens are ends: a text of one word has at most (6 / 9) * (3 / 9)
    assert 0.1 < sum(10 ** rows[3 + k] for k in range(len(words))) < 2 / 9


def test_odd_rows(spark):
    df = odd_documents(spark)
    rows = lm.score_texts(df, F.lit(True), MODEL).collect()
    assert len(rows) == df.count() and all(math.isfinite(r["score"]) for r in rows)
    rows = lm.score_texts(df, F.lit(False), MODEL).collect()
    assert {r["train_tokens"] for r in rows} == {0} and all(math.isfinite(r["score"]) for r in rows)
    assert lm.score_texts(empty_documents(spark), F.lit(True), MODEL).count() == 0
