"""Lexicons: merging with precedence, tiers, aliases, and spelling candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbamill.functions.phonetics import MERGERS, MISSPELLINGS, merger_similarity
from verbamill.functions.text import compact, let, strip_clitic


def first_wins(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several frames, one for each key: that of the earliest frame, and in a frame of the smallest row."""
    all_ = None
    for k, df in enumerate(parts):
        df = df.withColumn("_rank", F.lit(k))
        all_ = df if all_ is None else all_.unionByName(df, allowMissingColumns=True)
    rest = [c for c in all_.columns if c not in (key, "_rank")]
    return all_.groupBy(key).agg(F.min(F.struct("_rank", *rest)).alias("_x")).select(key, *[F.col(f"_x.{c}").alias(c) for c in rest])


def overridden(parts: Sequence[DataFrame], key: str, tier: str) -> DataFrame:
    """Later frames override fields that they have a value for; the tier is the best (least) of all."""
    all_ = None
    for k, df in enumerate(parts):
        df = df.withColumn("_rank", F.lit(k))
        all_ = df if all_ is None else all_.unionByName(df, allowMissingColumns=True)
    rest = [c for c in all_.columns if c not in (key, tier, "_rank")]
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("_rank"), F.col(c))))[c].alias(c)
    return all_.groupBy(key).agg(*[last(c) for c in rest], F.min(tier).alias(tier))


def trimmed(df: DataFrame, tier: str, keep_to: int, term: str, most: int) -> DataFrame:
    """All terms of tiers up to keep_to, then others in order of tier and term up to `most`. What is kept of the others
    is at most `most` rows, which Spark finds as the least of each partition's least."""
    sure, rest = df.filter(F.col(tier) <= keep_to), df.filter(F.col(tier) > keep_to)
    least = rest.orderBy(tier, term).limit(most).withColumn("_at", F.row_number().over(Window.orderBy(tier, term)))
    room = F.greatest(F.lit(most) - F.col("_sure"), F.lit(0))
    # one row of one number
    placed = least.join(F.broadcast(sure.agg(F.count("*").alias("_sure")))).filter(F.col("_at") <= room)
    return sure.unionByName(placed.select(*df.columns))


def merged_aliases(known: DataFrame, new: DataFrame, term: str, alias: str) -> DataFrame:
    """(term, aliases): the known aliases and the new ones, but for those that are a form of any known term."""
    forms = known.select(F.explode(F.concat(F.array(term), F.col("aliases"))).alias(alias)).distinct()
    more = new.join(forms, alias, "left_anti").groupBy(term).agg(F.array_sort(F.collect_set(alias)).alias("_more"))
    return known.join(more, term, "left").select(term, F.array_distinct(F.concat("aliases", F.coalesce("_more", F.array().cast("array<string>")))).alias("aliases"))


def pruned(aliases: Column, most: int = 3) -> Column:
    """Aliases whose compact form is longer than `most`."""
    return F.filter(aliases, lambda a: F.length(compact(a)) > most)


def deletions(word: Column, edits: int = 1) -> Column:
    """The word and all that it gives with one letter deleted (and again, for more edits)."""
    one = lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substr(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    out = F.array(word)
    for _ in range(edits):
        out = F.array_distinct(let(out, lambda x: F.concat(x, F.flatten(F.transform(x, one)))))
    return out


def spelling_candidates(words: DataFrame, word: str, lexicon: DataFrame, term: str, most: int = 1, ratio: tuple = (0.65, 1.35)) -> DataFrame:
    """(word, term, distance): terms within `most` edits, by an equi-join on shared deletions."""
    a = words.select(word, F.explode(deletions(F.col(word), most)).alias("_cut"))
    b = lexicon.select(term, F.explode(deletions(F.col(term), most)).alias("_cut"))
    pairs = a.join(b, "_cut").select(word, term).distinct().filter((F.length(word) / F.length(term)).between(*ratio))
    return pairs.withColumn("distance", F.levenshtein(F.col(word), F.col(term), most)).filter("distance >= 0")


def corrected(words: DataFrame, word: str, lexicon: DataFrame, term: str, short: int = 5, least_short: float = 0.75, least: float = 0.6, stem: int = 3) -> DataFrame:
    """(word, term, confidence): for each word of three letters and more that the lexicon does not know, with or without
    a clitic, the best of: an explicit misspelling's word (0.85, a clitic put back), terms within one edit whose length
    is near, by weighted edits, and terms that a letter read for one that sounds alike makes (1 - half a letter's
    share). Confidences are at least `least_short` of words up to `short` letters, else `least`, and at most 0.95; ties
    go to the smaller term. The package must be on the executors."""
    known = lexicon.select(F.col(term).alias("_known")).distinct()
    open_ = words.select(word).distinct().filter(F.length(word) >= 3).withColumn("_bare", strip_clitic(F.col(word), stem))
    open_ = open_.join(known, F.col(word) == F.col("_known"), "left_anti").join(known, F.col("_bare") == F.col("_known"), "left_anti")
    named = F.create_map(*[F.lit(x) for p in MISSPELLINGS.items() for x in p])
    head = F.left(F.col(word), F.length(word) - F.length("_bare"))
    explicit = open_.filter(F.col("_bare").isin(*MISSPELLINGS)).select(word, F.concat(head, named[F.col("_bare")]).alias(term), F.lit(0.85).alias("confidence"))
    near = spelling_candidates(open_, word, lexicon.select(term).distinct(), term, 1)
    near = near.select(word, term, F.least(F.lit(0.95), merger_similarity(F.col(word), F.col(term))).alias("confidence"))
    one = substitutions(open_, word, {x: list(ys) for x, ys in MERGERS.items()}, lexicon, term).select(word, term, (1 - 0.5 / F.length(word)).alias("confidence"))
    enough = F.col("confidence") >= F.when(F.length(word) <= short, max(least_short, least)).otherwise(least)
    found = explicit.unionAll(near.unionAll(one).filter(enough))
    best = found.groupBy(word).agg(F.min(F.struct((-F.col("confidence")).alias("_c"), term)).alias("_x"))
    return best.select(word, F.col(f"_x.{term}").alias(term), (-F.col("_x._c")).alias("confidence"))


def substitutions(words: DataFrame, word: str, alternatives: dict, lexicon: DataFrame, term: str) -> DataFrame:
    """(word, term): terms that one substitution of a letter by one of its alternatives makes."""
    rows = [(x, y) for x, ys in alternatives.items() for y in ys]
    pairs = words.sparkSession.createDataFrame(rows, "letter string, other string")
    spread = words.select(word, F.posexplode(F.split(F.col(word), "")).alias("at", "letter")).join(F.broadcast(pairs), "letter")
    made = spread.select(word, F.concat(F.left(F.col(word), F.col("at")), F.col("other"), F.substr(F.col(word), F.col("at") + 2, F.length(word))).alias(term))
    return made.join(lexicon.select(term), term, "left_semi").distinct()


def forms(bases: DataFrame, base: str, prefixes: Sequence[str], least: int = 4) -> DataFrame:
    """(form): bases with each of a fixed list of prefixes and without, at least `least` letters long."""
    made = F.explode(F.array(F.col(base), *[F.concat(F.lit(p), F.col(base)) for p in prefixes]))
    return bases.select(made.alias("form")).filter(F.length("form") >= least).distinct()
