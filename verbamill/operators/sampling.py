"""Sampling, splitting and mixing. Order comes from a hash of a seed and the id, so it is the same on any cluster."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbamill.session import ship


def shuffled(seed: str, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))


def within(strata: Sequence[str], seed: str, id_col: str):
    return Window.partitionBy(*strata).orderBy(shuffled(seed, id_col), F.col(id_col))


#: Leading digits of the hash, of sixteen values each, that make a block of a stratum.
DIGITS = 3


def placed(df: DataFrame, strata: Sequence[str], seed: str, id_col: str, size: str | None = None) -> DataFrame:
    """Adds _nth (a row's place from 1 in the hashed order of its stratum), _n (the stratum's rows) and, given a size,
    _before (the sizes of the rows before). Blocks of the order are summed first, so that a stratum of any size is
    sorted by many tasks and only its blocks, 16 ** DIGITS at most, pass through one."""
    keyed = df.withColumn("_o", shuffled(seed, id_col)).withColumn("_k", F.struct(*strata, F.left("_o", F.lit(DIGITS)).alias("_b")))
    sums = [F.count("*").alias("_c"), *([F.sum(size).alias("_s")] if size else [])]
    stratum = F.struct(*[F.col(f"_k.{c}") for c in strata], F.lit(0))
    w = Window.partitionBy(stratum).orderBy("_k")
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = keyed.groupBy("_k").agg(*sums).select(
        "_k", F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("_rows"), F.sum("_c").over(Window.partitionBy(stratum)).alias("_n"), *([F.coalesce(F.sum("_s").over(above), F.lit(0)).alias("_sizes")] if size else [])
    )
    inside = Window.partitionBy("_k").orderBy("_o", id_col)
    out = keyed.join(blocks, "_k").withColumn("_nth", F.col("_rows") + F.row_number().over(inside))
    if size:
        out = out.withColumn("_before", F.col("_sizes") + F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop("_o", "_k", "_rows", "_sizes")


def budget(df: DataFrame, strata: Sequence[str], size: str, target: Column, seed: str, id_col: str) -> DataFrame:
    """Rows of each stratum in hashed order until their sizes reach the target; the row that crosses it is kept, rows
    of no size are not."""
    return placed(df.filter(F.col(size) > 0), strata, seed, id_col, size).filter(F.col("_before") < target).drop("_before", "_nth", "_n")


def carve(df: DataFrame, strata: Sequence[str], size: str, share: float, seed: str, id_col: str) -> DataFrame:
    """A share of each stratum's total size, by budget."""
    totals = df.groupBy(*strata).agg((F.sum(size) * share).alias("_want"))
    return budget(df.join(totals, list(strata)), strata, size, F.col("_want"), seed, id_col).drop("_want")


def held_out(df: DataFrame, strata: Sequence[str], share: float, seed: str, id_col: str, most: int | None = None) -> DataFrame:
    """A split column: of a stratum of n rows max(1, round half even of n * share) are validation, none if n is 1, at
    most n - 1 and `most`."""
    n = F.col("_n")
    want = F.greatest(F.lit(1), F.bround(n * share).cast("long"))
    want = F.least(want, n - 1, *([F.lit(most)] if most else []))
    return placed(df, strata, seed, id_col).withColumn("split", F.when(F.col("_nth") <= want, "val").otherwise("train")).drop("_nth", "_n")


def round_robin(df: DataFrame, source: str, seed: str, id_col: str, rounds: int) -> DataFrame:
    """The first `rounds` rows of each source in hashed order, with `turn`: all sources' first, then all second ones."""
    return df.withColumn("turn", F.row_number().over(within([source], seed, id_col))).filter(F.col("turn") <= rounds)


def top_up(df: DataFrame, priority: Column, source: str, seed: str, id_col: str, rounds: int) -> DataFrame:
    """Priority rows first in every source, then others, up to `rounds` of each source."""
    w = Window.partitionBy(source).orderBy(F.when(priority, 0).otherwise(1), shuffled(seed, id_col), F.col(id_col))
    return df.withColumn("first_choice", priority).withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= rounds)


def interleaved(df: DataFrame, tier: str, chunks: dict, seed: str, id_col: str) -> DataFrame:
    """`round`: each tier's rows in chunks of its own size, so that every round mixes the tiers in proportion."""
    size = F.coalesce(F.create_map(*[F.lit(x) for p in chunks.items() for x in p])[F.col(tier)], F.lit(1))
    return placed(df, [tier], seed, id_col).withColumn("round", F.floor((F.col("_nth") - 1) / size).cast("long")).drop("_nth", "_n")


def weighted_draws(df: DataFrame, weight: str, draws: int, seed: str, id_col: str) -> DataFrame:
    """`draws` rows with replacement, each with a chance in proportion to its weight: (draw, id). Cumulative weights
    come from sums by hash bucket first, so that no window sees all rows; a draw meets one bucket, then one row."""
    ready = df.filter(F.col(weight) > 0).select(F.col(id_col).alias("id"), F.col(weight).cast("double").alias("w"), F.pmod(F.xxhash64(id_col), F.lit(1024)).alias("b"))
    buckets = ready.groupBy("b").agg(F.sum("w").alias("total")).withColumn("until", F.sum("total").over(Window.orderBy("b")))
    buckets = buckets.select("b", "total", (F.col("until") - F.col("total")).alias("since"), "until", F.max("until").over(Window.partitionBy()).alias("all"))
    points = df.sparkSession.range(draws).select(F.col("id").alias("draw"), (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("id").cast("string"))), 1, 12), 16, 10).cast("double") / 2.0**48).alias("u"))
    # 1024 rows of sums at most
    at = points.join(F.broadcast(buckets), (F.col("u") * F.col("all") >= F.col("since")) & (F.col("u") * F.col("all") < F.col("until"))).select("draw", "b", (F.col("u") * F.col("all") - F.col("since")).alias("x"))
    w = Window.partitionBy("b").orderBy("id")
    rows = ready.select("b", (F.sum("w").over(w) - F.col("w")).alias("x"), F.col("id").alias("row"), F.lit(None).cast("long").alias("draw"))
    # a draw takes the last row of its bucket that begins at or before it: both in one order, so that none meet all
    both = rows.unionByName(at.select("b", "x", F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "draw"))
    order = Window.partitionBy("b").orderBy("x", F.col("draw").isNotNull(), "row")
    return both.withColumn("row", F.last("row", ignorenulls=True).over(order)).filter("draw IS NOT NULL").select("draw", F.col("row").alias("id"))


def capped_draw(df: DataFrame, source: str, size: str, share: float, seed: str, id_col: str, slack: float = 1.05) -> DataFrame:
    """Rows of each source in hashed order, skipping one that would pass slack times the source's budget and stopping
    once the budget is met. What is skipped depends on what was taken, so each source is one ordered pass, which holds
    two numbers; rows that are larger than all that may be taken are left out before it."""
    ship(df.sparkSession)
    rows = df.select(source, F.col(id_col).alias("_id"), F.col(size).cast("double").alias("_size"), shuffled(seed, id_col).alias("_order"))
    wants = rows.groupBy(source).agg((F.sum("_size") * share).alias("_want"))
    rows = rows.join(wants, source).filter(F.col("_size") <= slack * F.col("_want"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, have = object(), 0.0
        for batch in batches:
            kept = []
            for who, what, want in zip(*(batch.column(c).to_pylist() for c in (source, "_size", "_want"))):
                if who != at:
                    at, have = who, 0.0
                ok = have < want and have + what <= slack * want
                have += what if ok else 0.0
                kept.append(ok)
            yield batch.select([source, "_id"]).filter(pa.array(kept, pa.bool_()))

    kind = dict(rows.dtypes)
    ordered = rows.repartition(source).sortWithinPartitions(source, "_order", "_id")
    return ordered.mapInArrow(take, f"{source} {kind[source]}, _id {kind['_id']}").withColumnRenamed("_id", id_col)


def group_split(df: DataFrame, source: str, group: str, size: str, shares: dict, seed: str) -> DataFrame:
    """(source, group, split): whole groups, each to the split that lacks most of its share of the source's size, the
    largest groups first; splits other than the first are seeded before. Works on one row for each group."""
    ship(df.sparkSession)
    totals = df.groupBy(source, group).agg(F.sum(size).cast("double").alias("total")).withColumn("_order", shuffled(seed, group))
    names = list(shares)

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["total", "_order"], ascending=[False, True])
        want = {n: rows["total"].sum() * shares[n] for n in names}
        have, out = dict.fromkeys(names, 0.0), []
        seeds = [n for n in names[1:] if shares[n] > 0] if len(rows) > len(names) else []
        for k, total in enumerate(rows["total"]):
            to = seeds[k] if k < len(seeds) else max(names, key=lambda n: want[n] - have[n])
            have[to] += total
            out.append(to)
        return pd.DataFrame({source: rows[source], group: rows[group], "split": out})

    kind = dict(totals.dtypes)
    return totals.groupBy(source).applyInPandas(deal, f"{source} {kind[source]}, {group} {kind[group]}, split string")


def proxy_dedup(df: DataFrame, proxy: str, least: int, seed: str, id_col: str) -> DataFrame:
    """One row of each proxy in hashed order; where that leaves fewer than `least`, second rows come in too."""
    ranked = df.withColumn("_nth", F.row_number().over(within([proxy], seed, id_col))).filter("_nth <= 2")
    short = ranked.filter("_nth = 1").agg((F.count("*") < least).alias("_short"))
    return ranked.join(F.broadcast(short)).filter((F.col("_nth") == 1) | (F.col("_short") & (F.col("_nth") == 2))).drop("_nth", "_short")
