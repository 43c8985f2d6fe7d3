"""Small helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# SQL spelling of P1 key normalisation (DuckDB side of the oracle)
SQL_NORM = "regexp_replace(lower(CAST({c} AS VARCHAR)), '^\\s+|\\s+$', '', 'g')"


def sql_norm(c: str) -> str:
    return SQL_NORM.format(c=c)


SIG = 9


def sig_col(c) -> F.Column:
    """Round a double to SIG significant digits (same IEEE steps as ``sig`` in SQL)."""
    x = c if not isinstance(c, str) else F.col(f"`{c}`")
    e = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))).cast("double"))
    m = F.lit(float(10 ** (SIG - 1)))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.floor(x / e * m + F.lit(0.5)).cast("double") / m * e)


def sig(expr: str) -> str:
    """DuckDB spelling of ``sig_col``."""
    e = f"pow(10.0, floor(log10(abs({expr}))))"
    m = f"{float(10 ** (SIG - 1))}::DOUBLE"
    return f"CASE WHEN ({expr}) = 0 THEN 0.0 ELSE CAST(floor(({expr}) / {e} * {m} + 0.5) AS DOUBLE) / {m} * {e} END"


def round_doubles(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Round every double column to SIG significant digits (cross-engine sums differ in the last bits)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(sig_col(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def long_sql(table: str, cols: list[str], cast: str = "DOUBLE", keep: str = "") -> str:
    """DuckDB unpivot to ("column", value) with missing values dropped."""
    k = f"{keep}, " if keep else ""
    add = " + 0.0" if cast == "DOUBLE" else ""
    parts = [f"SELECT {k}'{c}' AS \"column\", CAST({c} AS {cast}){add} AS value FROM {table}" for c in cols]
    cond = "value IS NOT NULL" + (" AND NOT isnan(value)" if cast == "DOUBLE" else "")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE {cond}"
