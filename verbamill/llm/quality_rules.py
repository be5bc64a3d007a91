"""Quality rules of documents and of their hosts, by DataFrame functions alone.

Each text's counts come from arrays within its own row. Failures of the base rule are then summed for each host, the
hosts' rates are shrunk towards a beta prior fitted to all hosts by moments, and the verdicts are joined back.

Words are `[^\\x20\\x09-\\x0D]+`. Null texts have no words and fail the base rule (fewer than 10 words), as do empty
ones. Documents without a host form one host, apart from any that is named. Windows of words are compared by 64-bit
hashes: two different windows of a text of n words are taken for equal with a chance of about n^2 / 2^65. Other
columns, whatever their names, are not read. Repeated rows each give a row, and an empty table gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words in a window, fewest words, most percent of words in repeated windows, and the shrunk failure rate from which
#: a host's other documents go too.
WINDOW, FEWEST, REPEATED, HOST_RATE = 5, 10, 20, 0.6
SPACES, SYMBOLS = r"[ \x09-\x0D]+", r"[#*$%&|<>]"


def repeated_words(found: Column) -> Column:
    """How many words lie in the windows whose positions (from 0, ascending, one or none) are in `found`."""
    return F.when(F.size(found) > 0,
        F.aggregate(F.sequence(F.lit(1), F.size(found)), F.lit(0), lambda s, k: s + F.when(k == F.size(found), WINDOW).otherwise(F.least(F.lit(WINDOW), F.get(found, k) - F.get(found, k - 1)))),
    )


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", "host", "text", F.array_remove(F.split(text, SPACES), "").alias("words"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    # a window is hashed as the array of its words
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda k: F.xxhash64(F.slice("words", k, WINDOW))))
    rows = rows.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"), windows.alias("windows"),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    # only where some hash comes twice are the windows sorted by hash and position, which lays equal ones side by side
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("windows", F.when(twice, F.sort_array(F.transform("windows", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))))
    same = lambda a, b: F.get("windows", a)["h"] == F.get("windows", b)["h"]
    again = F.filter(F.transform("windows", lambda x, k: F.when(F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)), x["k"])), lambda k: k.isNotNull())
    rows = rows.withColumn("again", F.sort_array(again)).drop("windows")
    rows = rows.withColumn("n_repeat_words", F.coalesce(repeated_words(F.col("again")), F.lit(0)).cast("long")).drop("again")
    return rows.withColumn("base_failed", (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))


def host_verdicts(counts: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_failed). The prior has the mean and variance of the hosts' rates:
    strength = mean (1 - mean) / variance - 1, held between 1 and 1000; a single host keeps its own rate."""
    hosts = counts.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = hosts.withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    prior = hosts.agg(F.avg("rate").alias("mean"), F.var_pop("rate").alias("var"))
    mean, var = F.col("mean"), F.col("var")
    strength = F.when(var > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), mean * (1 - mean) / var - 1))).otherwise(1000.0)
    # one row of two numbers
    hosts = hosts.join(F.broadcast(prior.select("mean", strength.alias("strength"))))
    hosts = hosts.withColumn("shrunk_rate", (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength")))
    return hosts.select("host", "n_docs", "n_failed", "shrunk_rate", (F.col("shrunk_rate") >= host_rate).alias("host_failed"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """(id_col, counts, base_failed, host, shrunk_rate, host_failed, kept). A document is kept if it passes the base
    rule and its host does not fail."""
    counts = written(document_counts(docs, id_col, text_col, host_col), "counts")
    hosts = host_verdicts(counts, host_rate)
    joined = counts.alias("c").join(hosts.select(F.col("host").alias("of"), "shrunk_rate", "host_failed").alias("h"), F.col("c.host").eqNullSafe(F.col("h.of")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))
    return joined.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("c.host").alias("host"), "shrunk_rate", "host_failed")
