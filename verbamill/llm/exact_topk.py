"""Exact top-k search by inner product over a bit-sliced index.

Each component is quantised to an integer. A block of the index holds, for each dimension, bitmaps of its rows, one for
each binary digit of the component; blocks are bounded in rows and bytes and are sliced once, into a written table. A
query's scores for a whole block are sums of such slices, shifted by the set digits of the query's component and added
with carry-save bitmap arithmetic; negative components take the complement of the slices, which shifts every score by
the same amount. The top rows are selected from the most significant slice of the sum downward; rows that tie at the
boundary are resolved by their ids.

Queries are dealt into blocks too. A task holds one block of the index and streams blocks of queries past it, and
returns at most k rows for each query; those are merged by query. A block of the index is sent to several tasks only
where there are fewer blocks than cores.

Vectors that are null or empty, hold a null or a non-finite component, or whose id is null take no part. Neither do
those of another length than the commonest (the longest of those that tie), and those with a component that quantises
beyond +-2^55. Sums are exact and ranked as such at any size; a score beyond a long is given as the nearest long. Rows that repeat an id are all candidates, but not for a query of the same id. Queries without
candidates give no rows, and so do empty tables. Other columns, whatever their names, are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, written

#: Rows of a block of the index and bytes of its components at most, and queries of a block.
BLOCK, BLOCK_BYTES, QUERIES = 32_768, 32 << 20, 256
#: Components are below this; a score is carried as a multiple of 2**LOW and a rest.
LARGEST, LOW = 2.0**55, 62


def quantised(vector: Column, factor: float = 256.0) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def usable(vector: Column, factor: float = 256.0) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * factor) < LARGEST)
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine)


class BitSlices:
    """Slices [dimension][digit] of a block's components less their least, as words of 64 rows."""

    def __init__(self, rows: int, least: int, slices: np.ndarray):
        self.rows, self.least, self.slices, self.digits = rows, least, slices, slices.shape[1]
        self.real = np.packbits(np.arange(slices.shape[2] * 64) < rows, bitorder="little").view(np.uint64)

    @staticmethod
    def of(values: np.ndarray) -> BitSlices:
        rows, least = len(values), int(values.min())
        shifted = np.zeros((values.shape[1], -(-rows // 64) * 64), np.int64)
        shifted[:, :rows] = values.T - least
        digits = max(1, int(shifted.max()).bit_length())
        slices = [np.packbits(shifted >> d & 1 != 0, axis=-1, bitorder="little").view(np.uint64) for d in range(digits)]
        return BitSlices(rows, least, np.ascontiguousarray(np.stack(slices, 1)))

    def sum_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of sum + shift, least digit first, and the shift, which is the same for all rows."""
        waiting: dict[int, list[np.ndarray]] = {}
        most, shift = (1 << self.digits) - 1, 0
        for d in np.flatnonzero(query).tolist():
            q = int(query[d])
            # q * x = q * least + |q| * u, where u is the shifted component, or its complement less the most it can be
            shift += q * self.least if q > 0 else q * (self.least + most)
            slices = self.slices[d] if q > 0 else ~self.slices[d]
            for k in range(abs(q).bit_length()):
                if abs(q) >> k & 1:
                    for j in range(self.digits):
                        waiting.setdefault(k + j, []).append(slices[j])
        out: list[np.ndarray] = []
        while any(waiting.values()):
            column, carry = waiting.pop(len(out), []), waiting.setdefault(len(out) + 1, [])
            while len(column) > 2:  # three bitmaps of a digit make one of it and one of the next
                a, b, c = column.pop(), column.pop(), column.pop()
                x = a ^ b
                carry.append((a & b) | (x & c))
                x ^= c
                column.append(x)
            if len(column) == 2:
                carry.append(column[0] & column[1])
                column = [column[0] ^ column[1]]
            out.append(column[0] if column else np.zeros_like(self.real))
        return out, shift

    def top(self, slices: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
        """Rows of the k highest sums and of all that tie with the last of them."""
        sure, open_ = np.zeros_like(self.real), allowed
        for x in reversed(slices):
            both = open_ & x
            n = int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(both).sum())
            if n > k:
                open_ = both
            elif n < k:
                sure, open_ = sure | both, open_ & ~x
            else:
                sure, open_ = sure | both, np.zeros_like(open_)
                break
        return np.flatnonzero(np.unpackbits((sure | open_).view(np.uint8), bitorder="little"))


def search(index: BitSlices, ids: np.ndarray, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of the best k rows of a block, ties to the smaller id; the query's own id is left out."""
    allowed = index.real.copy()
    for row in np.flatnonzero(ids == query_id).tolist():
        allowed[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
    slices, shift = index.sum_slices(query)
    rows = index.top(slices, allowed, k)
    if not len(rows):
        return []
    small = len(slices) < 62 and abs(shift) < 1 << 61
    scores = np.full(len(rows), shift, np.int64 if small else object)
    for digit, x in enumerate(slices):
        bits = (x[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        scores += bits.astype(np.int64) << digit if small else bits.astype(object) * (1 << digit)
    if small:
        order = np.lexsort((ids[rows], -scores))[:k]
        return list(zip(scores[order].tolist(), ids[rows[order]].tolist()))
    return [(-s, i) for s, i in sorted(zip((-scores).tolist(), ids[rows].tolist()))[:k]]


def dealt(vectors: DataFrame, n: int, make, ddl: str, name: str) -> DataFrame:
    """A written row for each of n blocks of (id, v): its number and what make(ids, values) gives. Rows are dealt evenly,
    whatever their ids are."""
    names = ["block", *[x.split()[0] for x in ddl.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, values = [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            values.append(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), np.int64))
        if sum(map(len, ids)):
            columns = make(np.concatenate(ids), np.concatenate([x for x in values if len(x)]))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), *[pa.array([x]) for x in columns]], names)

    return written(in_arrow(vectors.repartition(n), run, "block long, " + ddl), name)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 256.0) -> DataFrame:
    """(query_id, rank, id_col, score): each query's k best rows of vectors."""
    spark = vectors.sparkSession
    fit = lambda df: df.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col), factor))
    # a row for each length that occurs
    sizes = fit(vectors).groupBy(F.size(vector_col).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    length, total = (sizes["size"], sizes["n"]) if sizes else (1, 0)
    ready = lambda df: fit(df).filter(F.size(vector_col) == length).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), factor).alias("v"))
    asked = ready(queries)
    n, m = max(1, -(-total // max(64, min(BLOCK, BLOCK_BYTES // (8 * length))))), max(1, -(-asked.count() // QUERIES))
    packed = lambda ids, values: (ids.astype("<i8").tobytes(), values.astype("<i8").tobytes())

    def sliced(ids: np.ndarray, values: np.ndarray) -> tuple:
        x = BitSlices.of(values)
        return ids.astype("<i8").tobytes(), x.slices.tobytes(), x.least, x.digits

    index = dealt(ready(vectors), n, sliced, "ids binary, payload binary, least long, digits long", "index")
    asked = dealt(asked, m, packed, "ids binary, payload binary", "queries")
    # blocks of queries go to every block of the index; where those are few, each is held by several lanes of tasks
    lanes = min(m, -(-spark.sparkContext.defaultParallelism * 2 // n))
    numbers = lambda upto: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(upto - 1).cast("long")))
    held = index.select("block", numbers(lanes).alias("lane"), F.lit(-1).cast("long").alias("nth"), "ids", "payload", "least", "digits")
    streamed = asked.select(numbers(n).alias("block"), F.pmod("block", F.lit(lanes)).alias("lane"), F.col("block").alias("nth"), "ids", "payload", F.lit(0).cast("long").alias("least"), F.lit(0).cast("long").alias("digits"))
    met = held.unionAll(streamed).repartition(min(2 * n * lanes, 100_000), "block", "lane").sortWithinPartitions("block", "lane", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at, nth, least, digits = (batch.column(c)[i].as_py() for c in ("block", "nth", "least", "digits"))
                ids, payload = (batch.column(c)[i].as_buffer() for c in ("ids", "payload"))
                ids = np.frombuffer(ids, "<i8")
                if nth < 0:
                    block, own = at, ids
                    index = BitSlices(len(ids), least, np.frombuffer(payload, np.uint64).reshape(length, digits, -1))
                elif at == block:
                    found = [(int(q), s, r) for q, v in zip(ids, np.frombuffer(payload, "<i8").reshape(len(ids), length)) for s, r in search(index, own, int(q), v, k)]
                    columns = [x[0] for x in found], [x[1] >> LOW for x in found], [x[1] & (1 << LOW) - 1 for x in found], [x[2] for x in found]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "high", "low", "id"])

    found = in_arrow(met, run, "query_id long, high long, low long, id long")
    best = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    most = (1 << 63) - 1
    score = F.when(F.col("high") > 1, most).when(F.col("high") < -2, -most - 1).otherwise(F.when(F.col("high").between(-2, 1), F.col("high")) * (1 << LOW) + F.col("low"))
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), score.alias("score"))
