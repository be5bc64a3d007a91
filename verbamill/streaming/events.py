"""Structured Streaming: trace events, sessions, and upserts into a dimension."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from verbamill.session import ship


def trace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events as they arrive in a folder of JSON Lines; a payload that is not JSON becomes text."""
    return spark.readStream.schema(schema).json(path)


def closed_traces(events: DataFrame, key: str, ts: str, kind: str, sentinel: str) -> DataFrame:
    """(key, events, closed, seconds) of traces that have arrived: how many events came before a trace's first sentinel,
    whether there is one, and the time from the first event to the sentinel, or to the last event."""
    end = F.min(F.when(F.col(kind) == sentinel, F.col(ts)))
    by = events.groupBy(key).agg(end.alias("_end"), F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    until = by.select(key, "_first", F.col("_end").isNotNull().alias("closed"), F.coalesce("_end", "_last").alias("_until"))
    held = events.join(until, key).filter((F.col(kind) != sentinel) & (F.col(ts) <= F.col("_until")))
    counted = held.groupBy(key).agg(F.count("*").alias("events"))
    seconds = F.timestamp_diff("MICROSECOND", "_first", "_until") / 1e6
    return until.join(counted, key, "left").select(key, F.coalesce("events", F.lit(0)).alias("events"), "closed", seconds.alias("seconds"))


class Progress(StreamingQueryListener):
    """The last progress of each running query, by name or id, for whoever polls it: batch, rows, state. Add it with
    spark.streams.addListener."""

    def __init__(self) -> None:
        self.seen: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.seen[event.name or str(event.id)] = {"batch": -1, "rows": 0, "running": True}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        known = self.seen.setdefault(p.name or str(p.id), {"rows": 0})
        known.update(batch=p.batchId, rows=known["rows"] + p.numInputRows, running=True)

    def onQueryTerminated(self, event) -> None:
        for known in self.seen.values():
            known["running"] = False


def session_windows(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key with a gap, for events up to `late` behind the latest."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def latest_wins(batch: DataFrame, into: DataFrame | None, key: str, order: str) -> DataFrame:
    """The dimension with a batch merged: the row of the greatest order for each key."""
    rows = batch if into is None else into.unionByName(batch, allowMissingColumns=True)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("x")).select("x.*")


def run_once(stream: DataFrame, checkpoint: str, out: str) -> None:
    """All that has arrived, to Parquet, exactly once."""
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").outputMode("append").start(out).awaitTermination()


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions below the folder that were written to their end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")) or []
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)


def upserted(stream: DataFrame, folder: str, key: str, order: str) -> DataFrame:
    """A stream's rows merged batch by batch into versions of a dimension below `folder`; returns the last version. The
    folder holds the checkpoint too, so that a later call goes on where an earlier one or its failure left off; a batch
    that is run again replaces the version that it made."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = [v for v in versions(spark, folder) if v < number]
        known = spark.read.parquet(f"{folder}/version={before[-1]}") if before else None
        latest_wins(batch, known, key, order).write.mode("overwrite").parquet(f"{folder}/version={number}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(merge).start().awaitTermination()
    found = versions(spark, folder)
    return spark.read.parquet(f"{folder}/version={found[-1]}") if found else spark.createDataFrame([], stream.schema)


def all_sessions(events: DataFrame, closed: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """The sessions that a stream has closed and those that are still open once all `events` have arrived."""
    every = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    # an anti-join would do, but the optimiser pushes it below the session aggregate, where the sessions' ends differ
    return closed.unionByName(every).distinct()


def first_within(events: DataFrame, keys: list[str], ts: str, ttl: str) -> DataFrame:
    """The events that find no entry of their keys in a cache with a time to live, in the order of their times; each
    makes an entry, which an event more than `ttl` later no longer finds. Takes all events that have arrived, so the
    result depends neither on their batches nor on the order of arrival. Ties go to the least of the other columns;
    null keys are one key; an event without a time finds nothing and makes no entry. A task holds one entry at a time."""
    columns, until = events.columns, f"_until_{uuid.uuid4().hex}"

    def misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = end = None
        for b in batches:
            times, ends = (b.column(b.schema.get_field_index(c)).cast(pa.int64()).to_pylist() for c in (ts, until))
            taken = []
            for key, at, last in zip(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in keys)), times, ends):
                if miss := at is None or key != held or at > end:
                    if at is not None:
                        held, end = key, last
                taken.append(miss)
            yield b.filter(pa.array(taken, pa.bool_())).select(columns)

    ship(events.sparkSession)
    dealt = events.withColumn(until, F.col(ts) + F.expr(f"INTERVAL {ttl}")).repartition(*keys)
    return dealt.sortWithinPartitions(*keys, ts, *[c for c in columns if c not in {*keys, ts}]).mapInArrow(misses, events.schema)
