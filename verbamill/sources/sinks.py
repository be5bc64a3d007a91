"""Sinks: manifests, result tables, splits. A write goes to a folder that appears whole or not at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", "true").csv(path)


def vocabulary(df: DataFrame, words: str, path: str) -> None:
    """Sorted distinct words of an array column, one a line."""
    df.select(F.explode(words).alias("word")).distinct().orderBy("word").write.mode("overwrite").text(path)


def splits(df: DataFrame, path: str, split: str, id_col: str) -> None:
    """A folder for each split, rows in order of their id within each file."""
    df.repartition(split).sortWithinPartitions(split, id_col).write.mode("overwrite").partitionBy(split).json(path)


def summary(df: DataFrame, path: str, figures: dict) -> None:
    """One row of named aggregates."""
    df.agg(*[c.alias(n) for n, c in figures.items()]).coalesce(1).write.mode("overwrite").json(path)


def append_missing(df: DataFrame, done: DataFrame, key: str, path: str) -> None:
    """Appends the rows whose key an earlier run has not written."""
    df.join(done.select(key).distinct(), key, "left_anti").write.mode("append").parquet(path)


def markdown(df: DataFrame, columns: Sequence[str], most: int = 100) -> str:
    """The first rows as a table for a report."""
    rows = [[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in df.select(*columns).limit(most).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [list(columns), ["---"] * len(columns), *rows])


def leaderboard(df: DataFrame, rate: str, name: str, columns: Sequence[str], most: int = 100) -> str:
    """A report's table in order of the rate, rows without one last, ties by name."""
    return markdown(df.orderBy(F.asc_nulls_last(rate), name), columns, most)
