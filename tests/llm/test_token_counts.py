import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import token_counts as tc
from ledgerlens.llm import tokens
from tests.llm.helpers import ODD_TEXTS, documents, empty_documents, odd_documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello there. How are you? Fine!  ok", "naïve café. Ünïcode 日本語。 end", "no border", *[t or "" for t in ODD_TEXTS if t != ODD_TEXTS[8]]]


def plain(text, spans, rule):
    e = Tokenizer.from_file(JSON).encode(text, add_special_tokens=False)
    out = []
    for low, high in spans:
        n, crossing = 0.0, 0
        for s, t in e.offsets:
            if rule == "share":
                n += sum(low <= c < high for c in range(s, t)) / (t - s)
            else:
                n += low <= {"start": s, "end": t - 1, "middle": (s + t - 1) // 2}[rule] < high
            crossing += any(s < b < t for b in (low, high))
        out.append((n, crossing if high > low else 0))
    return out


@pytest.mark.parametrize("rule", tc.RULES)
def test_rules_as_brute_force(spark, rule):
    spans = {i: [(0, 4), (4, 11), (2, 13), (13, 999), (5, 5)] for i in range(len(TEXTS))}
    sections = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in spans[0]])
    rows = tc.section_counts(documents(spark, TEXTS), sections, RANKS, rule).where("section is not null").collect()
    got = {(r["id"], r["section"]): (r["n_tokens"], r["n_crossing"]) for r in rows}
    for i, text in enumerate(TEXTS):
        cut = [(min(a, len(text)), min(b, len(text))) for a, b in spans[i]]
        for k, (n, crossing) in enumerate(plain(text, cut, rule)):
            assert got[i, k][0] == pytest.approx(n), (text[:30], k)
            assert got[i, k][1] == crossing, (text[:30], k)


@pytest.mark.parametrize("rule", tc.RULES)
def test_sentences_hold_every_token_once(spark, rule):
    rows = tc.section_counts(documents(spark, TEXTS), tc.sentence_spans, RANKS, rule).groupBy("id").agg(F.sum("n_tokens").alias("n")).collect()
    tokenizer = Tokenizer.from_file(JSON)
    got = {r["id"]: r["n"] for r in rows}
    for i, text in enumerate(TEXTS):
        assert got.get(i, 0) == pytest.approx(len(tokenizer.encode(text, add_special_tokens=False).ids))


def test_sentence_spans():
    text = "A b. C!  d?e. "
    low, high = tc.sentence_spans(text)
    assert [text[i:j] for i, j in zip(low, high)] == ["A b. ", "C!  ", "d?e. "]
    assert [len(x) for x in tc.sentence_spans("")] == [0, 0]
    assert re.sub(r"\s", "", "x") and np.array_equal(tc.sentence_spans("x")[1], [1])


def test_tokens_of_no_section_and_odd_sections(spark):
    df = documents(spark, ["one two three four", None])
    none = F.lit(None).cast("array<struct<start: bigint, end: bigint>>")
    rows = tc.section_counts(df, none, RANKS, "start").collect()
    assert [(r["id"], r["section"], r["n_tokens"]) for r in rows] == [(0, None, 4.0)]
    odd = F.expr("array(null, named_struct('start', null, 'end', 3L), named_struct('start', 9L, 'end', 2L), named_struct('start', -5L, 'end', null))")
    rows = tc.section_counts(df, odd, RANKS, "start").where("id = 0").collect()
    assert [(r["section"], r["n_tokens"]) for r in rows] == [(0, 1.0), (1, 0.0), (2, 4.0)]
    with pytest.raises(ValueError):
        tc.section_counts(df, odd, RANKS, "any")


def test_odd_rows(spark):
    df = odd_documents(spark)
    assert tc.section_counts(df, tc.sentence_spans, RANKS).where("n_tokens > 0").count() > 0
    assert tc.section_counts(empty_documents(spark), tc.sentence_spans, RANKS).count() == 0


@pytest.mark.parametrize("run", [" " * 1_000_000, "\n" * 1_000_000, " \n" * 10_000, "\u2003" * 12_000, "\x1c" * 12_000])
@pytest.mark.parametrize("frame", ["a{}b. c", "{}", "a{}", "{}5", "x {}!{}"])
def test_long_white_space(run, frame):
    """The pattern engine panics on a million blanks; the ids are those of tokenizers."""
    text = frame.format(run, run)
    assert tokens.ordinary_ids(RANKS, text) == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


def test_document_with_a_million_blanks(spark):
    text = "a" + " " * 1_000_000 + "b. c"
    rows = tc.section_counts(documents(spark, [text]), tc.sentence_spans, RANKS, "end").orderBy("section").collect()
    assert [(r["start"], r["end"]) for r in rows] == [(0, 1_000_004), (1_000_004, 1_000_005)]
    assert sum(r["n_tokens"] for r in rows) == len(Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids)
