"""Accept and reject gates: the first failing check names the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check that holds, in order; null if none does. A null check does not hold."""
    name, bad = checks[0]
    out = F.when(bad, name)
    for name, bad in checks[1:]:
        out = out.when(bad, name)
    return out


def gate(df: DataFrame, checks: Sequence[tuple[str, Column]], name: str = "reason") -> DataFrame:
    return df.withColumn(name, reason(checks))


def accepted(gated: DataFrame, name: str = "reason") -> DataFrame:
    return gated.filter(F.col(name).isNull()).drop(name)


def rejected(gated: DataFrame, name: str = "reason") -> DataFrame:
    return gated.filter(F.col(name).isNotNull())


def ladder(value: Column, steps: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """An ordered classification."""
    return F.coalesce(reason(steps), F.lit(otherwise))


def bucket(value: Column, edges: Sequence[float]) -> Column:
    """Right-closed buckets from 1, one beyond the last edge; the first holds values up to the first edge."""
    out = F.when(value <= edges[0], 1)
    for k, edge in enumerate(edges[1:], 2):
        out = out.when(value <= edge, k)
    return F.when(value.isNotNull(), out.otherwise(len(edges) + 1))


def capped(df: DataFrame, order: Sequence[str], passes: Column, scanned: int, kept: int) -> DataFrame:
    """The first `kept` rows that pass among the first `scanned` by order: a gate over a source that is read no further
    (both caps are the feature). Each partition gives up its own first rows, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(scanned).filter(passes).orderBy(*order).limit(kept)


def until(df: DataFrame, order: Sequence[str], size: str, rows: int, total: float) -> DataFrame:
    """The first rows by order, at most `rows` of them, up to and with the one whose sizes reach `total`."""
    from pyspark.sql import Window

    first = df.orderBy(*order).limit(rows)
    before = F.coalesce(F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("_before", before).filter(F.col("_before") < total).drop("_before")
