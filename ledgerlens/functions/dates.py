"""Dates held as text: the one list of formats that every operator tries (a parameter everywhere)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark pattern and its DuckDB strptime spelling.
DATE_FORMATS = [("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy/MM/dd", "%Y/%m/%d"), ("MM/dd/yyyy", "%m/%d/%Y"),
                ("dd-MM-yyyy", "%d-%m-%Y"), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S")]
# every format above has this shape: values without it are skipped before the (costly) parse attempts
DATE_SHAPE = r"^\s*\d{1,6}[-/]\d{1,2}[-/]\d{1,6}(\s+\d{1,2}:\d{1,2}:\d{1,2})?\s*$"


def parse_date(c: Column, formats=None) -> Column:
    """The first format that parses, else null. Formats of the caller's own are tried on every value."""
    if formats is not None:
        return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])
    return F.when(c.rlike(DATE_SHAPE), F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f, _ in DATE_FORMATS]))
