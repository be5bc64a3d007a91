"""Spans and sequences: islands, windows of tokens, selection without overlap, and applying replacements."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbamill.functions.phonetics import skeleton_score
from verbamill.functions.text import consonants
from verbamill.session import ship


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows; `breaks` is true on a row that starts a new one and may use lag over the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_break", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn(name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def merged_overlaps(df: DataFrame, keys: Sequence[str], start: str, end: str, tie: str) -> DataFrame:
    """Spans that touch or overlap as one: (keys, start, end, n)."""
    w = Window.partitionBy(*keys).orderBy(start, tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = df.withColumn("_reach", reach)
    found = islands(found, keys, [start, tie], F.col("_reach").isNull() | (F.col(start) > F.col("_reach")))
    return found.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("island")


def token_windows(df: DataFrame, tokens: str, longest: int, shortest: int = 1) -> DataFrame:
    """A row for each run of shortest to longest tokens: width, at (from 0), window (array)."""
    one = lambda n: F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.struct(F.lit(n).alias("width"), i.alias("at"), F.slice(F.col(tokens), i + 1, n).alias("window"))))
    every = F.flatten(F.filter(F.array(*[one(n) for n in range(longest, shortest - 1, -1)]), lambda x: x.isNotNull()))
    return df.withColumn("_w", F.explode(every)).select(*[c for c in df.columns if c != tokens], "_w.*")


def split_at(df: DataFrame, keys: Sequence[str], at: str, stops: Column) -> DataFrame:
    """Islands of consecutive positions once the rows where `stops` holds are gone: (keys, start, end, n)."""
    w = Window.partitionBy(*keys).orderBy(at)
    left = df.filter(~F.coalesce(stops, F.lit(False)))
    found = islands(left, keys, [at], F.col(at) != F.lag(at).over(w) + 1)
    return found.groupBy(*keys, "island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("island")


def best_spans(df: DataFrame, keys: Sequence[str], start: str, end: str, score: str, margin: float = 0.0) -> DataFrame:
    """Spans without overlap, best score first, ties to the earlier and shorter; a span that contains a chosen one
    needs more than `margin` above it to take its place. A document's spans are one group."""
    ship(df.sparkSession)

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_n=rows[end] - rows[start]).sort_values([score, start, "_n"], ascending=[False, True, True])
        taken: list[tuple] = []  # apart from each other, so in order of their starts and of their ends alike
        for at, (a, b, s) in zip(rows.index, rows[[start, end, score]].itertuples(index=False)):
            first = bisect_right(taken, a, key=lambda t: t[1])
            last = bisect_left(taken, b, key=lambda t: t[0])
            hit = taken[first:last]
            if hit and not (a <= hit[0][0] and hit[-1][1] <= b and s > max(t[2] for t in hit) + margin):
                continue
            taken[first : max(first, last)] = [(a, b, s, at)]
        return rows.loc[[t[3] for t in taken]].drop(columns="_n")

    return df.groupBy(*keys).applyInPandas(select, df.schema)


def apply_edits(text: Column, edits: Column) -> Column:
    """Each edit's `old` becomes its `new` at its first place, one after another."""
    def one(t, e):
        at = F.instr(t, e["old"])
        return F.when((at > 0) & (F.length(e["old"]) > 0), F.concat(F.left(t, at - 1), e["new"], F.substr(t, at + F.length(e["old"]), F.length(t)))).otherwise(t)

    return F.aggregate(edits, text, one)


def alias_rewrite(df: DataFrame, id_col: str, tokens: str, aliases: DataFrame, longest: int = 3) -> DataFrame:
    """df with runs of up to `longest` of its tokens (an array) replaced where, put together, they are a key of `aliases`
    (key, value): from left to right, the longest first, no token twice. Of values that share a key the least is taken.
    Runs meet keys by an equi-join, so the aliases may be any number; id_col must be unique and a row without it stays
    as it is."""
    known = aliases.groupBy("key").agg(F.min("value").alias("value"))
    runs = token_windows(df.select(id_col, F.col(tokens).alias("_t")), "_t", longest).withColumn("key", F.array_join("window", ""))
    hits = runs.join(known, "key").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("width")).alias("less"), "value"))).alias("_hits"))

    def step(s, hit):
        new = F.struct(F.concat(s["out"], F.slice(F.col(tokens), s["next"] + 1, hit["at"] - s["next"]), F.array(hit["value"])).alias("out"), (hit["at"] - hit["less"]).alias("next"))
        return F.when(hit["at"] >= s["next"], new).otherwise(s)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"))
    rest = lambda s: F.concat(s["out"], F.slice(F.col(tokens), s["next"] + 1, F.size(tokens) - s["next"]))
    found = df.join(hits, id_col, "left")
    return found.withColumn(tokens, F.when(F.col("_hits").isNull(), F.col(tokens)).otherwise(F.aggregate("_hits", start, step, rest))).select(*df.columns)


def phrase_matches(df: DataFrame, id_col: str, tokens: str, phrases: DataFrame, phrase: str, least: float = 80.0, shortest: int = 2, longest: int = 4) -> DataFrame:
    """(id, at, width, phrase, score): runs of tokens that are a phrase, or whose skeleton is like one's by at least
    `least`; of the runs that begin at a token the best score's, then the longest, then the smaller phrase. Equal runs
    meet by their text, others by the first or the last letter of their skeletons, either of which may be wrong, but
    not both. The package must be on the executors."""
    runs = token_windows(df.select(id_col, F.col(tokens).alias("_t")), "_t", longest, shortest).withColumn("_text", F.array_join("window", " "))
    kinds = runs.select("_text").distinct()
    known = phrases.select(F.col(phrase).alias("phrase")).distinct()
    ends = lambda c: F.explode(F.array_distinct(F.array(F.concat(F.lit("<"), F.left(c, F.lit(1))), F.concat(F.lit(">"), F.right(c, F.lit(1))))))
    left, right = (x.withColumn("_s", consonants(c, merged=True)).withColumn("_e", ends(F.col("_s"))) for x, c in ((kinds, "_text"), (known, "phrase")))
    near = left.join(right.drop("_s"), "_e").select("_text", "phrase").distinct().withColumn("score", skeleton_score(F.col("_text"), F.col("phrase"))).filter(F.col("score") >= least)
    same = kinds.join(known, F.col("_text") == F.col("phrase")).select("_text", "phrase", F.lit(100.0).alias("score"))
    kinds = same.withColumn("k", F.lit(0)).unionAll(near.withColumn("k", F.lit(1)))  # of equal scores, the equal text first
    best = kinds.groupBy("_text").agg(F.min(F.struct((-F.col("score")).alias("s"), "k", "phrase")).alias("x"))
    hits = runs.join(best, "_text").select(id_col, "at", "width", "x.phrase", (-F.col("x.s")).alias("score"))
    first = F.min(F.struct((-F.col("score")).alias("s"), (-F.col("width")).alias("w"), "phrase"))
    return hits.groupBy(id_col, "at").agg(first.alias("x")).select(id_col, "at", (-F.col("x.w")).alias("width"), "x.phrase", (-F.col("x.s")).alias("score"))


def uncovered(flags: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Flags whose index `at` lies in none of the spans [start, end) of the same keys: an anti-join on covered indices."""
    covered = spans.filter(F.col(start) < F.col(end)).select(*keys, F.explode(F.sequence(F.col(start), F.col(end) - 1)).alias(at)).distinct()
    return flags.join(covered, [*keys, at], "left_anti")
