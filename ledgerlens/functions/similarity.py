"""Indel similarity: ``ratio(a, b) = 200 * LCS(a, b) / (|a| + |b|)``; both empty gives 100.

Two implementations of the LCS length:

* ``lcs_len_udf`` - Arrow-batched pandas UDF running the bit-parallel LCS
  (one big-int word per pattern, ``u = v & M[c]; v = (v + u) | (v - u)``).
  This is the default scorer; it only ever sees candidate pairs that passed
  the native length/bag filters.
* ``lcs_len_native`` - the same dynamic programme as Catalyst higher-order
  functions, for deployments that forbid Python workers. Quadratic per pair
  and slower, but stays inside the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def lcs_len(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel, exact)."""
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    bit = 1
    for ch in a:
        masks[ch] = masks.get(ch, 0) | bit
        bit <<= 1
    full = bit - 1
    v = full
    for ch in b:
        m = masks.get(ch)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_at_least(a: str, b: str, least: float, step: int = 256) -> int:
    """lcs_len, or -1 as soon as it is clear that it stays below `least`: what is left of the shorter text can't make up for it."""
    if len(a) < len(b):
        a, b = b, a
    if len(b) < least:
        return -1
    masks: dict[str, int] = {}
    bit = 1
    for ch in a:
        masks[ch] = masks.get(ch, 0) | bit
        bit <<= 1
    v = full = bit - 1
    for at in range(0, len(b), step):
        for ch in b[at: at + step]:
            m = masks.get(ch)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        if len(a) - v.bit_count() + max(0, len(b) - at - step) < least:
            return -1
    return len(a) - v.bit_count()


def lcs_len_dp(a: str, b: str) -> int:
    """Textbook O(|a||b|) LCS, used by tests as the brute-force reference."""
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(cur[j - 1], prev[j]))
        prev = cur
    return prev[-1]


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if n == 0 else 200.0 * lcs_len(a, b) / n


@pandas_udf(T.IntegerType())
def lcs_len_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        out.append(None if x is None or y is None else lcs_len(x, y))
    return pd.Series(out, dtype="Int32")


def lcs_len_native(a: Column, b: Column) -> Column:
    """LCS length with Catalyst higher-order functions only (no Python)."""
    bc = F.split(b, "")
    lb = F.length(b)
    zeros = F.array_repeat(F.lit(0), lb + 1)

    def row_step(prev, ch):
        # new[j] = max(new[j-1], prev[j-1] + 1 if ch == b[j-1] else prev[j])
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(lb, F.lit(1))),
            F.array(F.lit(0)),
            lambda acc, j: F.when(j > lb, acc).otherwise(F.concat(acc, F.array(F.greatest(
                F.element_at(acc, j),
                F.when(F.element_at(bc, j) == ch, F.element_at(prev, j) + 1).otherwise(F.element_at(prev, j + 1)))))),
        )

    last = F.aggregate(F.split(a, ""), zeros, row_step)
    return F.when((F.length(a) == 0) | (lb == 0), F.lit(0)).otherwise(F.element_at(last, -1))


def indel_ratio(a: Column, b: Column, native: bool = False) -> Column:
    """Column expression for the 0-100 indel ratio."""
    n = F.length(a) + F.length(b)
    lcs = lcs_len_native(a, b) if native else lcs_len_udf(a, b)
    return F.when(n == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs / n)
