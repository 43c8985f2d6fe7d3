"""Key normalisation as plain Column expressions (stay in codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE_SPACE = r"^\s+|\s+$"


def col(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def norm_key(c, ignore_case: bool = True) -> Column:
    """Key as text; with ``ignore_case`` lower-cased and stripped of edge whitespace."""
    s = col(c).cast("string")
    if ignore_case:
        s = F.regexp_replace(F.lower(s), _EDGE_SPACE, "")
    return s


def clean_values(c, ignore_case: bool = True) -> Column:
    """Like P1, and runs of inner whitespace collapse to one space."""
    s = col(c).cast("string")
    if ignore_case:
        s = F.regexp_replace(F.regexp_replace(F.lower(s), _EDGE_SPACE, ""), r"\s+", " ")
    return s
