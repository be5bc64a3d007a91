"""Shared pieces: reading tables, written cuts of the lineage, Arrow mapping over texts, pre-token chunks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from verbamill.session import shared_folder, ship, spread  # noqa: F401

#: Rows turned into Python objects at a time, so that a batch of long texts is not held twice.
ROWS_AT_ONCE = 256
#: Rows of an Arrow batch in plans that run here and now, where texts may be long.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While a plan of our own runs, Arrow batches have at most BATCH_ROWS rows; the session's setting is put back."""
    before = spark.conf.get(BATCH_KEY)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/verbamill/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(batches: Iterator[pa.RecordBatch], at_once: int = ROWS_AT_ONCE) -> Iterator[list[tuple]]:
    """Slices of Arrow batches as lists of row tuples."""
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            part = batch.slice(at, at_once)
            yield list(zip(*(column.to_pylist() for column in part.columns)))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """mapInArrow, with this package on the executors. Spark bounds a batch by its bytes; callers cut it further.
    Workers serve many tasks; what a task held goes back to the system at its end."""
    ship(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, ddl)


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_rows(df: DataFrame, start: Callable[[], Callable[[list[tuple]], tuple | list]], schema: pa.Schema, ddl: str, at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """mapInArrow over slices of rows. start() builds a task's state and returns the function for one slice,
    which gives the output columns (lists or arrays) of that slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for rows in rows_of(batches, at_once):
            columns = each(rows)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(columns, schema)], schema=schema)

    return in_arrow(df, run, ddl)


def filter_rows(df: DataFrame, columns: tuple, start: Callable[[], Callable[[list[tuple]], list[bool]]]) -> DataFrame:
    """The rows of df for which the function that start() builds, given slices of those columns, says so. Batches are
    cut in Arrow; other columns never become Python objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = start()
        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in columns]
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                yield part.filter(pa.array(good(list(zip(*(part.column(i).to_pylist() for i in at)))), pa.bool_()))

    return in_arrow(df, run, df.schema)


class Bounded(dict):
    """A cache by key; missing keys are made by make(key), and it is emptied once it holds `limit` entries."""

    def __init__(self, make: Callable, limit: int = 150_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


_GAP = re.compile(r" \s")
_BREAK = re.compile(r" (?=\S)")


def parts_of(texts: list[str | None]) -> pa.ListArray:
    """Each text cut before each space that a non-space follows, as an array of lists: every later part stands for a space
    and itself. No pre-token of the byte-level pattern crosses such a cut, so parts can be split and looked up one by
    one. A null or empty text has one empty part."""
    gaps = [bool(x) and _GAP.search(x) is not None for x in texts]
    plain = pc.split_pattern(pa.array(["" if g else x or "" for x, g in zip(texts, gaps)], pa.string()), " ")
    if not any(gaps):
        return plain
    odd = pa.array([_BREAK.split(x) for x, g in zip(texts, gaps) if g], pa.list_(pa.string()))
    at, found = [], 0
    for k, g in enumerate(gaps):
        at.append(len(texts) + found if g else k)
        found += g
    return pa.concat_arrays([plain, odd]).take(pa.array(at))
