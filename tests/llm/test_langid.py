import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ledgerlens.llm import langid
from ledgerlens.llm.common import crc32_mod, table
from tests.llm.helpers import documents, empty_documents, odd_documents


def test_held_out_accuracy(spark):
    docs = table(spark, SF01, "documents")
    held_out = crc32_mod(F.col("doc_id"), 3) == 1
    out = langid.predict(docs, langid.fit(docs, ~held_out))
    row = out.join(docs.where(held_out), out.id == docs.doc_id).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert row[0] > 0.98


def test_scores_follow_the_definition(spark):
    texts, langs = ["aa aa bb", "aa cc", "zz yy zz", "zz"], ["p", "p", "q", "q"]
    model = langid.fit(documents(spark, texts, langs), F.lit(True))
    s = langid.SMOOTH
    count = {"aa": (3, 0), "bb": (1, 0), "cc": (1, 0), "zz": (0, 3), "yy": (0, 1)}
    for w, (p, q) in count.items():
        assert model.word_lp[model.place[w]] == pytest.approx([math.log((p + s) / (5 + 4 * s)), math.log((q + s) / (4 + 4 * s))], rel=1e-5)
    # an unseen word: only its order-2 n-grams "aa" and "<a" and order-1 n-grams are known in part
    known = [g for g in langid.grams_of("aax", 3) if g in model.gram_place]
    assert model.unknown(["aax"]) == pytest.approx(model.gram_lp[[model.gram_place[g] for g in known]].mean(axis=0))
    assert model.unknown(["aax", "q9", "aax"]) == pytest.approx(2 * model.unknown(["aax"]) + model.unknown(["q9"]))
    assert langid.grams_of("aax", 3) == ["<aa", "aax", "ax>"] and known == ["<aa"]
    assert model.predict("aa AA")[0] == "p" and model.predict("zzz")[0] == "q"
    assert 0 < model.predict("aa zz")[1] <= 1


def test_words_beyond_the_bound_use_ngrams(spark):
    texts = ["der die das und nicht", "the of and to in"] * 20
    model = langid.fit(documents(spark, texts, ["de", "en"] * 20), F.lit(True), most_words=4)
    assert len(model.place) <= 4
    assert model.predict("nicht und das")[0] == "de" and model.predict("the and of")[0] == "en"


def test_odd_rows(spark):
    df = odd_documents(spark)
    model = langid.fit(df, F.lit(True))
    rows = langid.predict(df, model).collect()
    assert len(rows) == df.count()
    assert {r["lang_pred"] for r in rows} == {"en", "und"} and all(0 <= r["score"] <= 1 for r in rows)
    assert model.predict(None) == ("und", 0.0) and model.predict("12 ² !") == ("und", 0.0)
    assert langid.select(df, model, 0.5).columns == df.columns
    none = langid.fit(empty_documents(spark), F.lit(True))
    assert none.predict("text") == ("und", 0.0)
    assert langid.predict(empty_documents(spark), model).count() == 0


@pytest.mark.parametrize("bounds", [(50, 60), (0, 0)])
def test_bounds_change_no_result(spark, bounds):
    """Words and n-grams beyond the bounds are joined, not dropped."""
    docs = table(spark, SF01, "documents").where("doc_id % 4 = 0 AND length(text) < 2000")
    train = F.col("doc_id") % 8 != 0
    whole, cut = langid.fit(docs, train, most_words=10**9, most_grams=10**9), langid.fit(docs, train, "text", "lang", *bounds)
    assert whole.complete and not cut.complete
    expected = {r["id"]: r for r in langid.predict(docs, whole).collect()}
    got = langid.predict(docs, cut).collect()
    assert len(got) == len(expected) > 100
    for r in got:
        assert r["lang_pred"] == expected[r["id"]]["lang_pred"] and r["score"] == pytest.approx(expected[r["id"]]["score"], abs=1e-4)
    # the hard case: single words, some of them unknown
    words = documents(spark, [w for r in docs.limit(30).collect() for w in r["text"].split()[:20]] + ["qqxx", "9", "", "ünbekanntheit"], None)
    of = {(r["id"], r["lang_pred"]): r["score"] for r in langid.predict(words, whole).collect()}
    assert {(r["id"], r["lang_pred"]): r["score"] for r in langid.predict(words, cut).collect()} == pytest.approx(of, abs=1e-4)
    assert langid.select(words, cut, 0.5).count() == langid.select(words, whole, 0.5).count()


FOREIGN = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän "
          "on toimittava toisiaan kohtaan veljeyden hengessä. " * 3,
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. " * 3,
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. " * 3,
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. " * 3,
}


@pytest.mark.parametrize("bounds", [{}, {"most_words": 300, "most_grams": 500}])
def test_select_wants_a_fit(spark, bounds):
    """Foreign text and random letters go, whatever their posterior; clean text stays, long or short."""
    docs = table(spark, SF01, "documents")
    model = langid.fit(docs, F.lit(True), **bounds)
    assert model.complete == (not bounds)
    rng = random.Random(1)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(50)]
    odd = documents(spark, [*FOREIGN.values(), *junk, None, "", "12 34"])
    assert langid.select(odd, model, 0.5).count() == 0
    clean = docs.join(table(spark, SF01, "labels").where("quality = 1 and toxic = 0"), "doc_id", "left_semi")
    assert langid.select(clean, model, 0.5).count() >= 0.995 * clean.count()
    short = documents(spark, ["the end", "und nicht", "de la"])
    assert langid.select(short, model, 0.0).count() == 3


def test_share_of_common_words(spark):
    """Against the definition on a small model."""
    docs = table(spark, SF01, "documents").limit(200)
    model = langid.fit(docs, F.lit(True))
    rows = docs.where("lang is not null").collect()
    for k, lang in enumerate(model.langs):
        words = [w for r in rows if r["lang"] == lang for w in langid.words_of(r["text"])]
        count = Counter(words)
        common = {w for w, n in count.items() if n >= max(1, len(words) * langid.COMMON)}
        assert {w for w, row in model.common.items() if row[k]} == common
        assert model.usual[k] == pytest.approx(sum(w in common for w in words) / len(words))
        text = " ".join(words[:40])
        found, p = sum(w in common for w in words[:40]), langid.FIT * model.usual[k]
        assert model.fits(text, lang) == (found >= 40 * p - langid.DEVIATIONS * math.sqrt(40 * p * (1 - p)))
