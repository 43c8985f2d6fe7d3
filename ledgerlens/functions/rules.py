"""The rule layer shared by every recommendation / insight / alert list.

``rules(metrics, [Rule(...), ...])`` turns rows of metrics into one row per
fired rule, in rule order: ``explode(filter(array(when(cond, struct)...)))``.
It is a projection, so it runs wherever the metrics rows are - on a one-row
aggregate, or per group / per column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rule:
    cond: Column
    priority: str
    category: str
    message: Column | str


def rules(metrics: DataFrame, items: list[Rule], keep=(), limit: int | None = None) -> DataFrame:
    """One output row per (input row, fired rule): keep..., rule_no, priority, category, message."""
    structs = []
    for i, r in enumerate(items, 1):
        msg = F.lit(r.message) if isinstance(r.message, str) else r.message
        structs.append(F.when(r.cond, F.struct(F.lit(i).alias("rule_no"), F.lit(r.priority).alias("priority"),
                                               F.lit(r.category).alias("category"), msg.cast("string").alias("message"))))
    fired = F.filter(F.array(*structs), lambda x: x.isNotNull())
    if limit:
        fired = F.slice(fired, 1, limit)
    return metrics.select(*[F.col(k) for k in keep], F.explode(fired).alias("_r")).select(*keep, "_r.*")


def band(value: Column, cuts: list[tuple[float, str]], otherwise: str, inclusive: bool = True) -> Column:
    """``when`` chain: first cut whose threshold the value reaches (>=, or > when not inclusive)."""
    expr = None
    for t, label in cuts:
        cond = value >= t if inclusive else value > t
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise)) if expr is not None else F.lit(otherwise)
