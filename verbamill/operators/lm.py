"""n-gram language model tables and interpolated Kneser-Ney scores as joins.

A sentence is order - 1 start tokens, its own tokens and an end token; n-grams of every order are runs of that whole
sequence. A word's probability is max(count - d, 0) / total + d * follows / total * the probability one order below,
or that alone where the context was never seen; at the bottom it is the word's share of all contexts that any word
follows. Sentences without tokens teach nothing and have no score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbamill.functions.text import let

START, END = "<s>", "</s>"
DISCOUNT, FLOOR = 0.75, 1e-10


def padded(tokens: Column, order: int) -> Column:
    return F.concat(F.array_repeat(F.lit(START), order - 1), tokens, F.array(F.lit(END)))


def _steps(tokens: str, n: int, order: int) -> Column:
    """(context, word) of every run of n tokens; the context is joined by spaces."""
    step = lambda p, i: F.struct(F.array_join(F.slice(p, i, n - 1), " ").alias("context"), F.get(p, i + n - 2).alias("word"))
    return let(padded(F.col(tokens), order), lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - n + 1), lambda i: step(p, i)))


def ngrams(df: DataFrame, tokens: str, n: int, order: int) -> DataFrame:
    return df.filter(F.size(tokens) > 0).select(F.explode(_steps(tokens, n, order)).alias("g")).select("g.context", "g.word")


def counts(df: DataFrame, tokens: str, order: int) -> DataFrame:
    """(n, context, word, count) for n = 1 ... order."""
    out = None
    for n in range(1, order + 1):
        one = ngrams(df, tokens, n, order).groupBy("context", "word").agg(F.count("*").alias("count")).select(F.lit(n).alias("n"), "context", "word", "count")
        out = one if out is None else out.unionByName(one)
    return out


def continuations(table: DataFrame) -> DataFrame:
    """(word, contexts): in how many distinct contexts of any order above 1 a word stands."""
    return table.filter("n > 1").groupBy("word").agg(F.count("*").alias("contexts"))


def contexts(table: DataFrame) -> DataFrame:
    """(n, context, total, follows)."""
    return table.groupBy("n", "context").agg(F.sum("count").alias("total"), F.count("*").alias("follows"))


def probabilities(asked: DataFrame, table: DataFrame, order: int, discount: float = DISCOUNT) -> DataFrame:
    """Adds p to the distinct (context, word) of `asked`; contexts have order - 1 tokens. One join a table and order."""
    cont, totals = continuations(table), contexts(table)
    # one row of one number
    base = cont.join(F.broadcast(cont.agg(F.sum("contexts").alias("_all")))).select("word", (F.col("contexts") / F.col("_all")).alias("_p"))
    rows = asked.select("context", "word").distinct().join(base, "word", "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))
    for n in range(2, order + 1):
        rows = rows.withColumn("_c", F.substring_index("context", " ", 1 - n))
        seen = table.filter(F.col("n") == n).select(F.col("context").alias("_c"), "word", "count")
        known = totals.filter(F.col("n") == n).select(F.col("context").alias("_c"), "total", "follows")
        rows = rows.join(seen, ["_c", "word"], "left").join(known, "_c", "left")
        p = F.greatest(F.coalesce("count", F.lit(0)) - discount, F.lit(0.0)) / F.col("total") + discount * F.col("follows") / F.col("total") * F.col("_p")
        rows = rows.select("context", "word", F.when(F.col("total").isNull(), F.col("_p")).otherwise(p).alias("_p"))
    return rows.withColumnRenamed("_p", "p")


def known_probabilities(table: DataFrame, order: int, discount: float = DISCOUNT) -> DataFrame:
    """(context, word, p) of every n-gram of the highest order in the table."""
    return probabilities(table.filter(F.col("n") == order), table, order, discount)


def sentence_scores(df: DataFrame, id_col: str, tokens: str, table: DataFrame, order: int) -> DataFrame:
    """(id, words, log10_p, perplexity): the end token counts in log10_p, but not in words, and perplexity is
    10 ^ (-log10_p / words); a probability of nothing is FLOOR."""
    rows = df.filter(F.size(tokens) > 0).select(id_col, F.explode(_steps(tokens, order, order)).alias("g")).select(id_col, "g.context", "g.word")
    scored = rows.join(probabilities(rows, table, order), ["context", "word"]).withColumn("lp", F.log10(F.when(F.col("p") > 0, F.col("p")).otherwise(FLOOR)))
    out = scored.groupBy(id_col).agg((F.count("*") - 1).alias("words"), F.sum("lp").alias("log10_p"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_p") / F.col("words")))
