"""Scores of transcripts and corrections: ratios of sums, slices, histograms, threshold selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbamill.functions.distance import cer, word_edits
from verbamill.functions.text import words


def clip_scores(pairs: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Adds edits, ref_words, wer, cer (without spaces)."""
    r, h = words(ref), words(hyp)
    scored = pairs.withColumn("edits", word_edits(r, h).cast("long")).withColumn("ref_words", F.size(r).cast("long")).withColumn("_hyp", F.size(h))
    rate = F.when(F.col("ref_words") == 0, F.when(F.col("_hyp") == 0, 0.0).otherwise(1.0)).otherwise(F.col("edits") / F.col("ref_words"))
    return scored.withColumn("wer", rate).withColumn("cer", cer(ref, hyp)).drop("_hyp")


def corpus_rate(scored: DataFrame, slices: Sequence[str], empty: str = "drop") -> DataFrame:
    """Sum of edits over sum of reference words, by slice. Clips with an empty reference are dropped, or count as a
    reference of one word of their own (empty="mark")."""
    if empty == "drop":
        scored = scored.filter("ref_words > 0")
    else:
        scored = scored.withColumn("edits", F.when(F.col("ref_words") == 0, F.greatest(F.col("edits"), F.lit(1))).otherwise(F.col("edits"))).withColumn("ref_words", F.greatest(F.col("ref_words"), F.lit(1)))
    out = scored.groupBy(*slices).agg(F.count("*").alias("clips"), F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words"))
    return out.withColumn("wer", F.col("edits") / F.col("ref_words"))


def clip_summary(scored: DataFrame, slices: Sequence[str], rate: str = "wer") -> DataFrame:
    c = F.col(rate)
    return scored.groupBy(*slices).agg(F.count("*").alias("clips"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.count_if(c == 0).alias("perfect"), F.count_if(c < 0.10).alias("under_10"), F.count_if(c < 0.25).alias("under_25"))


def micro(found: Column, present: Column) -> Column:
    """Ratio of sums; null when nothing is present."""
    return F.when(F.sum(present) > 0, F.sum(found) / F.sum(present))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and F1; 0 where the denominator is 0."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def rounded(c: Column, digits: int) -> Column:
    """c to so many digits as DuckDB rounds doubles: the scaled double to the nearest whole number, halves away from zero.
    F.round takes the decimal digits of c instead, which are on the other side of some halves (57 / 800 to four)."""
    return F.round(c * 10.0**digits) / 10.0**digits


def threshold_table(scored: DataFrame, score: str, correct: str) -> DataFrame:
    """(score, tp, fp, precision, recall) for every distinct score as a threshold, rows without a score last, below all
    others; recall is not a number where nothing is correct. Sums by score come first, so the running totals pass over
    distinct scores alone, in ranges that are ordered apart."""
    by = scored.groupBy(score).agg(F.sum(F.col(correct).cast("long")).alias("_t"), F.sum((1 - F.col(correct)).cast("long")).alias("_f"))
    # running sums: within blocks of scores, then over the blocks' totals
    by = by.withColumn("_block", F.floor(F.col(score) * 256))
    w = Window.partitionBy("_block").orderBy(F.desc(score))
    inside = by.withColumn("_tp", F.sum("_t").over(w)).withColumn("_fp", F.sum("_f").over(w))
    blocks = by.groupBy("_block").agg(F.sum("_t").alias("bt"), F.sum("_f").alias("bf"))
    above = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("at", F.coalesce(F.sum("bt").over(above), F.lit(0))).withColumn("af", F.coalesce(F.sum("bf").over(above), F.lit(0))).withColumn("all", F.sum("bt").over(Window.partitionBy()))
    met = inside.alias("l").join(blocks.select("_block", "at", "af", "all").alias("r"), F.col("l._block").eqNullSafe(F.col("r._block"))).drop("_block")
    out = met.withColumn("tp", F.col("_tp") + F.col("at")).withColumn("fp", F.col("_fp") + F.col("af"))
    return out.select(score, "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.when(F.col("all") > 0, F.col("tp") / F.col("all")).otherwise(float("nan")).alias("recall"))


def lowest_threshold(table: DataFrame, score: str, least: float) -> DataFrame:
    """The lowest score from which the precision is reached, with its figures; no row if none does."""
    return table.filter(F.col("precision") >= least).agg(F.min_by(F.struct(score, "precision", "recall"), score).alias("x")).filter("x IS NOT NULL").select("x.*")


def roc_auc(scored: DataFrame, score: str, correct: str) -> DataFrame:
    """(auc): the rank-sum statistic, ties halved, from sums by distinct score."""
    by = scored.groupBy(score).agg(F.sum(F.col(correct).cast("long")).alias("p"), F.sum((1 - F.col(correct)).cast("long")).alias("n")).withColumn("_block", F.floor(F.col(score) * 256))
    w = Window.partitionBy("_block").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    inside = by.withColumn("_below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    lower = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = by.groupBy("_block").agg(F.sum("n").alias("bn")).withColumn("under", F.coalesce(F.sum("bn").over(lower), F.lit(0))).select("_block", "under")
    wins = inside.join(blocks, "_block").agg(F.sum(F.col("p") * (F.col("_below") + F.col("under") + F.col("n") / 2)).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return wins.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("auc"))


def calibration_features(phonetic_score: Column, score_gap: Column, model_confidence: Column, candidates: Column, mixed_script: Column, span_length: Column, arabic: Column, retrieval_score: Column, span_tokens: Column, many_words: Column) -> list[Column]:
    """What a confidence is fitted on, scaled to 0 ... 1: scores out of 100, counts capped at 10 candidates, 50 characters
    and 6 tokens, and marks as 0 or 1."""
    capped = lambda c, most: F.least(F.lit(1.0), c / float(most))
    return [
        (phonetic_score / 100.0).alias("phonetic_score"), (score_gap / 100.0).alias("score_gap"), model_confidence.alias("model_confidence"), capped(candidates, 10).alias("candidates"), mixed_script.cast("double").alias("mixed_script"),
        capped(span_length, 50).alias("span_length"), arabic.cast("double").alias("arabic"), retrieval_score.alias("retrieval_score"), capped(span_tokens, 6).alias("span_tokens"), many_words.cast("double").alias("many_words"),
    ]


def calibrated(rows: DataFrame, features: Sequence[str], gold: str, c: float = 1.0) -> DataFrame:
    """rows with `confidence`, the chance that gold is 1 under a logistic regression in which both classes weigh the same,
    with an L2 penalty of 1 / (c n). Null features and labels are not allowed."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n, positive = rows.agg(F.count("*"), F.sum(gold)).first()
    weight = F.when(F.col(gold) == 1, n / (2.0 * max(positive or 0, 1))).otherwise(n / (2.0 * max(n - (positive or 0), 1)))
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows.withColumn("_w", weight))
    model = LogisticRegression(featuresCol="_x", labelCol=gold, weightCol="_w", regParam=1.0 / (c * max(n, 1)), standardization=False).fit(ready)
    return model.transform(ready).withColumn("confidence", F.get(vector_to_array("probability"), 1)).select(*rows.columns, "confidence")
