"""Caches with a time to live against a plain pass over the events in order."""

import os
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest

from verbamill.plans import registry
from verbamill.streaming import events

SF = "/root/testdata/sf0.001"
TTL = timedelta(minutes=5)


def plain(rows):
    """Ids of the misses; rows: (id, user, kind, time)."""
    entry, out = {}, []
    for i, user, kind, at in sorted(rows, key=lambda r: (r[3], r[0])):
        if (user, kind) not in entry or at - entry[user, kind] > TTL:
            entry[user, kind] = at
            out.append(i)
    return sorted(out)


def test_entries_expire_within_a_batch(spark):
    at = datetime(2024, 1, 1)
    seconds = [0, 299, 300, 300.000001, 601, 4000, 100, 3900, 0]
    rows = [(i, k, "x", at + timedelta(seconds=s)) for k in (1, 2, None) for i, s in enumerate(seconds, 100 * (k or 0))]
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    stamps = [(i, u, k, t.strftime("%Y-%m-%d %H:%M:%S.%f")) for i, u, k, t in rows]
    df = spark.createDataFrame(stamps, schema.replace("ts timestamp", "ts string")).selectExpr("event_id", "user_id", "event_type", "to_timestamp(ts) AS ts")
    want = plain(rows)
    assert len(want) == 12  # 0, 300.000001, 601 and 3900 of each key
    for parts in (1, 5):
        got = events.first_within(df.repartition(parts), ["user_id", "event_type"], "ts", "5 minutes")
        assert got.schema == df.schema and sorted(r["event_id"] for r in got.collect()) == want
    timeless = df.limit(1).selectExpr("event_id", "user_id", "event_type", "CAST(NULL AS timestamp) AS ts")
    assert events.first_within(timeless.unionAll(timeless).unionAll(df), ["user_id", "event_type"], "ts", "5 minutes").count() == len(want) + 2
    assert events.first_within(df.limit(0), ["user_id", "event_type"], "ts", "5 minutes").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_ttl_cache_over_all_events(spark):
    rows = pq.read_table(f"{SF}/events.parquet", columns=["event_id", "user_id", "event_type", "ts"]).to_pylist()
    got = registry.queries()["ttl_cache"](spark, SF)
    assert sorted(r["event_id"] for r in got.collect()) == plain([(r["event_id"], r["user_id"], r["event_type"], r["ts"]) for r in rows])
