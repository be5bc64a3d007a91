"""Guards against leakage and joins by similarity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbamill.functions.distance import similarity
from verbamill.functions.text import let
from verbamill.session import scratch, ship


def leak_guard(df: DataFrame, ids: Column, held: DataFrame, held_ids: Column, key: str) -> DataFrame:
    """Rows of df none of whose ids (an array) is an id (of an array) of the held-out rows. Rows are known by `key`; all
    that share one go together, and a null key is never leaking."""
    known = held.select(F.explode(held_ids).alias("_held")).filter("_held IS NOT NULL").distinct()
    leaking = df.select(key, F.explode(ids).alias("_held")).join(known, "_held", "left_semi").select(key).distinct()
    return df.join(leaking, key, "left_anti")


def asserted_apart(df: DataFrame, signature: Column, held: DataFrame, held_signature: Column) -> DataFrame:
    """df as it is, in a plan that fails as soon as a row's signature is that of a held-out row; null signatures are
    nobody's."""
    known = held.select(held_signature.alias("_held")).filter("_held IS NOT NULL").distinct().withColumn("_leaks", F.lit(True))
    met = df.withColumn("_held", signature).join(known, "_held", "left")
    bad = F.when(F.col("_leaks"), F.raise_error(F.concat(F.lit("held-out row in training data: "), F.col("_held").cast("string"))).cast("boolean")).otherwise(True)
    return met.filter(bad).select(*df.columns)


def refused(df: DataFrame, column: str, blocked: Sequence[str]) -> DataFrame:
    """df as it is, in a plan that fails on a row whose data set is blocked."""
    bad = F.when(F.col(column).isin(*blocked), F.raise_error(F.concat(F.lit("blocked data set: "), F.col(column))).cast("boolean")).otherwise(True)
    return df.filter(bad)


def sets_overlap(a: Column, b: Column, least: int = 1) -> Column:
    """Do two arrays of tokens share at least so many distinct ones?"""
    return F.size(F.array_intersect(a, b)) >= least


def shared_ngrams(df: DataFrame, words: Column, held: DataFrame, held_words: Column, n: int, id_col: str) -> DataFrame:
    """Ids of df that share a run of n words with a held-out row. Runs meet by a 64-bit hash, and only rows that met are
    looked at again, by their words. Runs of the held side are distinct first; where Spark finds them small it sends
    them out, and the larger side is not shuffled."""
    each = lambda c, make: let(c, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: make(F.slice(w, i, n)))))
    hashed, spelled = lambda r: F.xxhash64(r), lambda r: F.array_join(r, " ")
    known = held.select(F.explode(each(held_words, hashed)).alias("_run")).distinct()
    met = df.select(id_col, F.explode(F.array_distinct(each(words, hashed))).alias("_run")).join(known, "_run", "left_semi").select(id_col).distinct()
    runs = held.select(F.explode(each(held_words, spelled)).alias("_run")).distinct()
    again = df.join(met, id_col, "left_semi").select(id_col, F.explode(each(words, spelled)).alias("_run"))
    return again.join(runs, "_run", "left_semi").select(id_col).distinct()


def banded(left: DataFrame, right: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """Pairs whose lengths differ by at most `most`, by an equi-join on length: the left side stands in a band of
    lengths. Both frames bring their own column names."""
    spread = left.withColumn("_length", F.explode(F.sequence(F.greatest(F.length(a) - most, F.lit(0)), F.length(a) + most)))
    return spread.join(right.withColumn("_length", F.length(b)), "_length").drop("_length")


def proportional(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Pairs whose shorter string has at least the share `least` of the longer one's length, by an equi-join on length:
    whatever has a Levenshtein similarity of `least` is among them. Empty strings have no partner."""
    n = F.length(a)
    spread = left.filter(n > 0).withColumn("_length", F.explode(F.sequence(F.ceil(n * least).cast("int"), F.floor(n / least).cast("int"))))
    return spread.join(right.withColumn("_length", F.length(b)), "_length").drop("_length")


def similar(left: DataFrame, right: DataFrame, a: str, b: str, least: float, k: int, by: Sequence[str], ties: Sequence[Column]) -> DataFrame:
    """The k best right rows of each left row (`by`) at a Levenshtein similarity of at least `least`: `score`, `rank`."""
    scored = proportional(left, right, a, b, least).withColumn("score", similarity(F.col(a), F.col(b))).filter(F.col("score") >= least)
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ngrams(c: Column, n: int = 3) -> Column:
    """Character n-grams of the string between two spaces."""
    grams = lambda p: F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substr(p, i, F.lit(n)))).otherwise(F.array(p))
    return let(F.concat(F.lit(" "), c, F.lit(" ")), grams)


def ngram_cosine(left: DataFrame, right: DataFrame, a: str, b: str, left_id: str, right_id: str, n: int, least: float) -> DataFrame:
    """(left_id, right_id, score) by postings: n-gram counts of length 1, joined on the n-gram and summed."""

    def postings(df, key, text, name):
        counts = df.select(F.col(key).alias(name), F.explode(ngrams(F.lower(F.col(text)), n)).alias("gram")).groupBy(name, "gram").agg(F.count("*").alias("c"))
        norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy(name)))
        return counts.select(name, "gram", (F.col("c") / norm).alias(f"w_{name}"))

    x, y = postings(left, left_id, a, "l"), postings(right, right_id, b, "r")
    scored = x.join(y, "gram").groupBy("l", "r").agg(F.sum(F.col("w_l") * F.col("w_r")).alias("score"))
    return scored.filter(F.col("score") >= least)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, block: int = 16_384, asked_at_once: int = 512) -> DataFrame:
    """(query_id, rank, id, score): each query's k rows of the highest cosine (equal to 9 places), its own id left out,
    ties to the smaller id. Rows are packed into written blocks, each of which a task holds once while blocks of queries
    stream past it as matrix products; only where blocks are fewer than cores is one held by several tasks. Vectors
    must be of one length; null ids and vectors and those without a direction take no part."""
    spark = vectors.sparkSession
    ship(spark)
    ready = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND exists(v, x -> x <> 0)")

    def packed(df: DataFrame, size: int) -> tuple[DataFrame, int]:
        n, path = max(1, -(-df.count() // size)), scratch(spark, "blocks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            ids, values = [], []
            for b in batches:
                ids.append(b.column(0).to_numpy())
                values.append(b.column(1).flatten().to_numpy())
            if sum(map(len, ids)):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.concatenate(ids).tobytes()]), pa.array([np.concatenate(values).tobytes()])], ["block", "ids", "v"])

        out = df.repartition(n).mapInArrow(run, "block long, ids binary, v binary")
        out.write.parquet(path)
        return spark.read.schema(out.schema).parquet(path), n

    (rows, n), (asked, m) = packed(ready(vectors), block), packed(ready(queries), asked_at_once)
    lanes = min(m, -(-spark.sparkContext.defaultParallelism // n))
    upto = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x - 1).cast("long")))
    held = rows.select("block", upto(lanes).alias("lane"), F.lit(-1).cast("long").alias("nth"), "ids", "v")
    met = held.unionAll(asked.select(upto(n).alias("block"), F.pmod("block", F.lit(lanes)).alias("lane"), F.col("block").alias("nth"), "ids", "v"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = None, None
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column("ids")[i].as_buffer(), np.int64)
                x = np.frombuffer(b.column("v")[i].as_buffer()).reshape(len(ids), -1)
                x = x / np.linalg.norm(x, axis=1)[:, None]
                if b.column("nth")[i].as_py() < 0:
                    own, y, at = ids, x, b.column("block")[i].as_py()
                    continue
                if b.column("block")[i].as_py() != at:
                    continue
                out = []
                for q, s in zip(ids.tolist(), x @ y.T):
                    s = np.where(own == q, -np.inf, np.round(s, 9))
                    least = np.partition(s, max(0, len(s) - k))[max(0, len(s) - k)]
                    some = np.flatnonzero((s >= least) & (s > -np.inf))
                    out += [(q, own[j], s[j]) for j in some[np.lexsort((own[some], -s[some]))[:k]]]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "score"])

    found = met.repartition(min(2 * n * lanes, 100_000), "block", "lane").sortWithinPartitions("block", "lane", "nth").mapInArrow(meet, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
