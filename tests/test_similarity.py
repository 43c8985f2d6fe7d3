import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.functions.similarity import lcs_len, lcs_len_dp, ratio


@given(st.text(alphabet="abcde xy", max_size=40), st.text(alphabet="abcde xy", max_size=40))
@settings(max_examples=300, deadline=None)
def test_bit_parallel_lcs_equals_dp(a, b):
    assert lcs_len(a, b) == lcs_len_dp(a, b)


def test_ratio_edges():
    assert ratio("", "") == 100.0
    assert ratio("abc", "") == 0.0
    assert ratio("abc", "abc") == 100.0
    # indel, not levenshtein: one substitution costs two edits
    assert abs(ratio("abcd", "abed") - 75.0) < 1e-12


def test_long_strings():
    rnd = random.Random(7)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(700))
    b = "".join(rnd.choice("abcdefgh ") for _ in range(650))
    assert lcs_len(a, b) == lcs_len_dp(a, b)


def test_native_lcs_matches_python(spark):
    from pyspark.sql import functions as F
    from ledgerlens.functions.similarity import lcs_len_native
    rnd = random.Random(3)
    rows = [("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 12))),
             "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 12)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", lcs_len_native(F.col("a"), F.col("b")).alias("l")).collect()
    for r in got:
        assert r.l == lcs_len_dp(r.a, r.b)
