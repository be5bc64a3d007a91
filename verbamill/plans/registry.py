"""Named queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan builder (spark, sf_dir) -> DataFrame under a name, with its SQL where there is one."""

    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    from verbamill.plans import builders, curation, evaluation, lexicon, sequences, text_stats  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["corpus_wer_by_category"](spark, sf_dir)
