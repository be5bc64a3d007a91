"""Queries that merge lexicons and match names, tokens and vectors against them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verbamill.functions import phonetics, python_text
from verbamill.functions.distance import common_prefix, lengths_close, longest_common_substring, similarity
from verbamill.functions.text import alias_key, arabic_consonants, consonants, latin_of, skeleton, vowels, words
from verbamill.operators import joins, lexicon, spans
from verbamill.plans.registry import query
from verbamill.session import ship, table


def names(spark, sf_dir):
    """The catalogue's distinct names: a lexicon of bounded variety."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct()


NAMES = "n AS (SELECT DISTINCT p_name AS term FROM part)"


@query("lexicon_first_wins", "SELECT term, type, tier FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY k, type, tier) AS r FROM (SELECT p_name AS term, p_type AS type, CAST(1 + p_size % 3 AS INTEGER) AS tier, 0 AS k FROM part WHERE p_size > 25 UNION ALL SELECT p_name, p_type, CAST(1 + p_size % 3 AS INTEGER), 1 FROM part WHERE p_size <= 25)) WHERE r = 1")
def lexicon_first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.col("p_type").alias("type"), (1 + F.col("p_size") % 3).cast("int").alias("tier"), "p_size")
    return lexicon.first_wins([rows.filter("p_size > 25").drop("p_size"), rows.filter("p_size <= 25").drop("p_size")], "term")


@query("lexicon_overridden", "SELECT term, coalesce(max(type) FILTER (k = 1), max(type) FILTER (k = 0)) AS type, CAST(min(tier) AS INTEGER) AS tier FROM (SELECT p_name AS term, p_type AS type, 1 + p_size % 3 AS tier, 0 AS k FROM part WHERE p_size > 25 UNION ALL SELECT p_name, p_type, 1 + p_size % 3, 1 FROM part WHERE p_size <= 25) GROUP BY term")
def lexicon_overridden(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.col("p_type").alias("type"), (1 + F.col("p_size") % 3).cast("int").alias("tier"), "p_size")
    return lexicon.overridden([rows.filter("p_size > 25").drop("p_size"), rows.filter("p_size <= 25").drop("p_size")], "term", "tier")


TIERS = "l AS (SELECT p_name AS term, CAST(1 + (min(p_size) + count(*)) % 4 AS INTEGER) AS tier FROM part GROUP BY p_name)"


@query("lexicon_trimmed", f"WITH {TIERS}, x AS (SELECT *, row_number() OVER (ORDER BY tier, term) AS r FROM l WHERE tier > 1) SELECT term, tier FROM l WHERE tier <= 1 UNION ALL SELECT term, tier FROM x WHERE r <= 30 - (SELECT count(*) FROM l WHERE tier <= 1)")
def lexicon_trimmed(spark, sf_dir):
    """The lexicon's target size is the feature: 30 terms, tiers up to 1 all kept, others by tier, then term."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("term")).agg((1 + (F.min("p_size") + F.count("*")) % 4).cast("int").alias("tier"))
    return lexicon.trimmed(rows, "tier", 1, "term", 30)


@query("aliases_merged", "WITH k AS (SELECT p_name AS term, list_sort(list_distinct(list(p_brand))) AS a FROM part GROUP BY 1), w AS (SELECT DISTINCT p_name AS term, p_type AS alias FROM part UNION SELECT p_name, p_brand FROM part), m AS (SELECT term, list_sort(list_distinct(list(alias))) AS more FROM w WHERE alias NOT IN (SELECT unnest(a) FROM k) AND alias NOT IN (SELECT term FROM k) GROUP BY term) SELECT term, array_to_string(list_concat(a, coalesce(more, [])), '|') AS aliases FROM k LEFT JOIN m USING (term)")
def aliases_merged(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumnRenamed("p_name", "term")
    known = rows.groupBy("term").agg(F.array_sort(F.collect_set("p_brand")).alias("aliases"))
    new = rows.select("term", F.explode(F.array("p_type", "p_brand")).alias("alias")).distinct()
    return lexicon.merged_aliases(known, new, "term", "alias").select("term", F.array_join("aliases", "|").alias("aliases"))


@query("aliases_pruned", "SELECT p_partkey, array_to_string(list_filter([p_brand, p_type, CAST(p_size AS VARCHAR)], lambda a: length(regexp_replace(regexp_replace(lower(a), '\\band\\b', '', 'g'), '[\\s\\-_/.,]+', '', 'g')) > 3), '|') AS aliases FROM part")
def aliases_pruned(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(lexicon.pruned(F.array("p_brand", "p_type", F.col("p_size").cast("string"))), "|").alias("aliases"))


@query("similar_names", f"WITH {NAMES}, x AS (SELECT a.term AS term, b.term AS other, round(1 - CAST(levenshtein(a.term, b.term) AS DOUBLE) / greatest(length(a.term), length(b.term)), 6) AS score, levenshtein(a.term, b.term) AS d, greatest(length(a.term), length(b.term)) AS m FROM n a JOIN n b ON a.term <> b.term), y AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY 1 - CAST(d AS DOUBLE) / m DESC, other) AS rank FROM x WHERE 1 - CAST(d AS DOUBLE) / m >= 0.5) SELECT term, other, score, CAST(rank AS INTEGER) AS rank FROM y WHERE rank <= 3")
def similar_names(spark, sf_dir):
    left = names(spark, sf_dir)
    ranked = joins.similar(left, left.select(F.col("term").alias("other")), "term", "other", 0.5, 4, ["term"], [F.col("other")]).filter("term <> other")
    # a term is the best match of its own, so the others' ranks are one too high
    return ranked.select("term", "other", F.round("score", 6).alias("score"), (F.col("rank") - 1).alias("rank"))


@query("best_match_and_gap", f"WITH {NAMES}, x AS (SELECT a.term AS term, b.term AS other, 1 - CAST(levenshtein(a.term, b.term) AS DOUBLE) / greatest(length(a.term), length(b.term)) AS s FROM n a JOIN n b ON a.term <> b.term AND least(length(a.term), length(b.term)) >= 0.5 * greatest(length(a.term), length(b.term))), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY s DESC, other) AS k FROM x) SELECT term, max(other) FILTER (k = 1) AS best, round(max(s) FILTER (k = 1), 6) AS score, round(max(s) FILTER (k = 1) - coalesce(max(s) FILTER (k = 2), 0), 6) AS gap FROM r GROUP BY term")
def best_match_and_gap(spark, sf_dir):
    """The best candidate of each term, and how far the second lies behind."""
    left = names(spark, sf_dir)
    pairs = joins.proportional(left, left.select(F.col("term").alias("other")), "term", "other", 0.5).filter("term <> other").withColumn("s", similarity(F.col("term"), F.col("other")))
    ranked = pairs.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("s"), "other"))).filter("k <= 2")
    first, second = F.max(F.when(F.col("k") == 1, F.col("s"))), F.max(F.when(F.col("k") == 2, F.col("s")))
    return ranked.groupBy("term").agg(F.max(F.when(F.col("k") == 1, F.col("other"))).alias("best"), F.round(first, 6).alias("score"), F.round(first - F.coalesce(second, F.lit(0.0)), 6).alias("gap"))


GRAMS = "unnest(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 3)))"


@query("ngram_cosine", f"""WITH {NAMES}, p AS (SELECT term, ' ' || lower(term) || ' ' AS t FROM n), g AS (SELECT term, gram, count(*) AS c FROM (SELECT term, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM p) GROUP BY ALL),
 w AS (SELECT term, gram, c / sqrt(sum(c * c) OVER (PARTITION BY term)) AS w FROM g) SELECT a.term AS l, b.term AS r, round(sum(a.w * b.w), 6) AS score FROM w a JOIN w b USING (gram) WHERE a.term <> b.term GROUP BY ALL HAVING sum(a.w * b.w) >= 0.3""")
def ngram_cosine(spark, sf_dir):
    left = names(spark, sf_dir)
    return joins.ngram_cosine(left, left, "term", "term", "term", "term", 3, 0.3).filter("l <> r").withColumn("score", F.round("score", 6))


@query("vector_nearest", "SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(s, 5) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 5")
def vector_nearest(spark, sf_dir):
    """The stated queries, every 50th vector, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    found = joins.nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5, "vec_id", "embedding")
    return found.select("query_id", "rank", "id", F.round("score", 5).alias("score"))


@query("skeletons", f"WITH {NAMES} SELECT translate(replace(lower(term), 'x', 'ks'), 'pvcgqaeiouy', 'bfkkk') AS consonants, regexp_replace(translate(lower(term), 'eoy', 'iui'), '[^aiu]', '', 'g') AS vowels, count(*) AS terms FROM n GROUP BY ALL")
def skeletons(spark, sf_dir):
    v = F.regexp_replace(F.translate(F.lower("term"), "eoy", "iui"), "[^aiu]", "")
    return names(spark, sf_dir).groupBy(consonants("term").alias("consonants"), v.alias("vowels")).agg(F.count("*").alias("terms"))


SQUASH = "array_to_string(list_filter(string_split({0}, ''), lambda c, i: i = 1 OR c <> string_split({0}, '')[i - 1]), '')"
SKELETON = "replace(" + SQUASH.format("translate(lower(term), 'pvcaeiouywh', 'bfk@@@@@@@')") + ", '@', '')"


@query("phonetic_groups", f"WITH {NAMES} SELECT {SKELETON} AS skeleton, translate(regexp_replace(lower(term), '[^aiou]', '', 'g'), 'aiou', 'ssss') AS vowel_pattern, list_sort(list(term)) AS terms FROM n GROUP BY 1, 2")
def phonetic_groups(spark, sf_dir):
    """Terms by their skeleton and vowel pattern."""
    return names(spark, sf_dir).groupBy(skeleton("term").alias("skeleton"), vowels("term").alias("vowel_pattern")).agg(F.array_sort(F.collect_set("term")).alias("terms"))


# The catalogue's names as an Arabic speaker might write them, letter for letter.
LATIN_LETTERS, ARABIC_LETTERS = "abcdefghijklmnopqrstuvwxyz", "ابكديفغهيجكلمنوبقرستوفوسيز"
IN_ARABIC = f"translate(lower(term), '{LATIN_LETTERS}', '{ARABIC_LETTERS}')"


def arabic_names(spark, sf_dir):
    return names(spark, sf_dir).withColumn("arabic", F.translate(F.lower("term"), LATIN_LETTERS, ARABIC_LETTERS))


@query("transliterated", f"WITH {NAMES} SELECT term, translate(replace({IN_ARABIC}, 'غ', 'gh'), 'ابكديفهجلمنوقرستز ', 'abkdyfhjlmnwqrstz') AS latin, regexp_replace(translate(replace({IN_ARABIC}, 'غ', 'gh'), 'ابكديفهجلمنوقرستز ', 'abkdyfhjlmnwqrstz'), '[aeiouwh]', '', 'g') AS consonants FROM n")
def transliterated(spark, sf_dir):
    """Arabic spellings back in Latin letters, and their consonants."""
    latin = latin_of("arabic", clitics=False)
    return arabic_names(spark, sf_dir).select("term", latin.alias("latin"), arabic_consonants(latin).alias("consonants"))


AR_SKELETON = SQUASH.format(f"translate(CASE WHEN starts_with({IN_ARABIC}, 'و') AND length(term) >= 6 THEN substr({IN_ARABIC}, 2) ELSE {IN_ARABIC} END, 'ابكديفهجلمنوقرستزغ ', 'abkdyfhjlmnwkrstzg')")
LAT_SKELETON = SQUASH.format("translate(replace(replace(lower(term), 'ph', 'f'), 'ou', 'w'), 'cqvpgx', 'kkfbjk')")


@query("sound_skeletons", f"WITH {NAMES}, k AS (SELECT term, {AR_SKELETON} AS arabic, {LAT_SKELETON} AS latin FROM n) SELECT term, arabic, latin, upper(translate(arabic, 'pvdzg', 'bftsk')) AS classes FROM k")
def sound_skeletons(spark, sf_dir):
    """Names by their sounds in either script, and by sound classes."""
    rows = arabic_names(spark, sf_dir).select("term", phonetics.arabic_skeleton("arabic").alias("arabic"), phonetics.latin_skeleton("term").alias("latin"))
    return rows.withColumn("classes", phonetics.sound_classes(F.col("arabic")))


@query("cross_script_matches")
def cross_script_matches(spark, sf_dir):
    """The two best names for each Arabic spelling, among those that share a consonant of its skeleton's first two."""
    ship(spark)
    rows = arabic_names(spark, sf_dir).withColumn("latin", latin_of("arabic", clitics=False))
    heads = lambda c: F.explode(F.array_distinct(F.split(F.left(c, F.lit(2)), "")))
    left = rows.select("arabic", "latin", heads(arabic_consonants("latin")).alias("h"))
    right = names(spark, sf_dir).select(F.col("term").alias("other"), heads(consonants("term")).alias("h"))
    pairs = left.join(right, "h").select("arabic", "latin", "other").distinct()
    scored = pairs.withColumn("score", phonetics.cross_script_score(F.col("latin"), F.col("other"))).filter("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("arabic").orderBy(F.desc("score"), "other"))).filter("rank <= 2")


@query("merger_corrections")
def merger_corrections(spark, sf_dir):
    """Arabic words with a letter written as one that sounds like it, and what they are corrected to."""
    ship(spark)
    terms = arabic_names(spark, sf_dir).select(F.explode(F.split("arabic", " ")).alias("term")).distinct()
    said = terms.select(F.translate("term", "تسد", "طصض").alias("word")).distinct()
    return lexicon.corrected(said, "word", terms, "term")


@query("string_measures", f"WITH {NAMES} SELECT a.term AS term, b.term AS other, levenshtein(a.term, b.term) AS d FROM n a JOIN n b ON a.term < b.term AND abs(length(a.term) - length(b.term)) <= 1 AND string_split(a.term, ' ')[2] = string_split(b.term, ' ')[2]")
def string_measures(spark, sf_dir):
    left = names(spark, sf_dir)
    pairs = joins.banded(left, left.select(F.col("term").alias("other")), "term", "other", 1).filter("term < other").filter(F.get(F.split("term", " "), 1) == F.get(F.split("other", " "), 1))
    return pairs.select("term", "other", F.levenshtein("term", "other").cast("long").alias("d"))


@query("phonetic_scores")
def phonetic_scores(spark, sf_dir):
    """Jaro-Winkler, blend over sound classes, indel and partial ratios and skeleton scores of the pairs that lengths leave."""
    ship(spark)
    left = names(spark, sf_dir)
    a, b = F.col("term"), F.col("other")
    pairs = joins.banded(left, left.select(F.col("term").alias("other")), "term", "other", 2).filter("term < other").filter(lengths_close(a, b))
    return pairs.select("term", "other", python_text.jaro_winkler(a, b).alias("jaro_winkler"), phonetics.class_similarity(phonetics.sound_classes(phonetics.latin_skeleton(a)), phonetics.sound_classes(phonetics.latin_skeleton(b))).alias("blend"), python_text.indel_ratio(a, b).alias("ratio"),
                        python_text.partial_ratio(a, b).alias("partial"), phonetics.skeleton_score(a, b).alias("skeleton"), longest_common_substring(a, b).alias("shared"), common_prefix(a, b).alias("prefix"))


@query("ranked_candidates", f"""WITH {NAMES}, x AS (SELECT a.term AS term, b.term AS other, 1 - CAST(levenshtein(a.term, b.term) AS DOUBLE) / greatest(length(a.term), length(b.term)) AS s, abs(length(a.term) - length(b.term)) AS gap, CASE WHEN starts_with(b.term, 'red') THEN 0 ELSE 1 END AS kind FROM n a JOIN n b ON a.term <> b.term AND least(length(a.term), length(b.term)) >= 0.5 * greatest(length(a.term), length(b.term)))
 SELECT term, other, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY s DESC, kind, gap, other) AS rank FROM x) WHERE rank <= 2""")
def ranked_candidates(spark, sf_dir):
    """Four keys of order: similarity, preferred kind, difference of lengths, then the term."""
    left = names(spark, sf_dir)
    pairs = joins.proportional(left, left.select(F.col("term").alias("other")), "term", "other", 0.5).filter("term <> other")
    order = [F.desc("s"), F.when(F.col("other").startswith("red"), 0).otherwise(1), F.abs(F.length("term") - F.length("other")), F.col("other")]
    ranked = pairs.withColumn("s", similarity(F.col("term"), F.col("other"))).withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(*order)))
    return ranked.filter("rank <= 2").select("term", "other", "rank")


@query("spelling_candidates", f"WITH {NAMES}, w AS (SELECT DISTINCT replace(term, 'e', '') AS word FROM n) SELECT word, term, CAST(levenshtein(word, term) AS INTEGER) AS distance FROM w JOIN n ON levenshtein(word, term) <= 1 AND CAST(length(word) AS DOUBLE) / length(term) BETWEEN 0.65 AND 1.35")
def spelling_candidates(spark, sf_dir):
    terms = names(spark, sf_dir)
    return lexicon.spelling_candidates(terms.select(F.regexp_replace("term", "e", "").alias("word")).distinct(), "word", terms, "term")


@query("letter_substitutions", f"WITH {NAMES}, w AS (SELECT DISTINCT translate(term, 'b', 'p') AS word FROM n), c AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w) SELECT DISTINCT word, substr(word, 1, i - 1) || 'b' || substr(word, i + 1) AS term FROM c WHERE substr(word, i, 1) = 'p' AND substr(word, 1, i - 1) || 'b' || substr(word, i + 1) IN (SELECT term FROM n)")
def letter_substitutions(spark, sf_dir):
    terms = names(spark, sf_dir)
    return lexicon.substitutions(terms.select(F.translate("term", "b", "p").alias("word")).distinct(), "word", {"p": ["b"]}, terms, "term")


@query("clitic_forms", f"WITH {NAMES}, b AS (SELECT DISTINCT string_split(term, ' ')[1] AS base FROM n), f AS (SELECT unnest([base, 're' || base, 'un' || base]) AS form FROM b) SELECT DISTINCT form FROM f WHERE length(form) >= 4")
def clitic_forms(spark, sf_dir):
    bases = names(spark, sf_dir).select(F.get(F.split("term", " "), 0).alias("base")).distinct()
    return lexicon.forms(bases, "base", ["re", "un"])


@query("alias_rewrite", "SELECT p_partkey, p_type || ' <' || p_name || '> ' || p_brand AS text FROM part")
def alias_rewrite(spark, sf_dir):
    """Runs of up to three words that are a known term once their spaces are gone, rewritten from left to right."""
    terms = names(spark, sf_dir)
    known = terms.select(alias_key("term").alias("key"), F.concat(F.lit("<"), F.col("term"), F.lit(">")).alias("value"))
    rows = table(spark, sf_dir, "part").select("p_partkey", words(F.concat_ws(" ", "p_type", "p_name", "p_brand")).alias("w"))
    return spans.alias_rewrite(rows, "p_partkey", "w", known).select("p_partkey", F.array_join("w", " ").alias("text"))


@query("membership_preferring_exact", "WITH t AS (SELECT DISTINCT p_type AS term FROM part UNION SELECT DISTINCT lower(p_type) FROM part), q AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE lower(p_type) END AS said FROM part) SELECT p_partkey, term FROM (SELECT p_partkey, term, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN term = said THEN 0 ELSE 1 END, term) AS r FROM q JOIN t ON lower(t.term) = lower(q.said)) WHERE r = 1")
def membership_preferring_exact(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    terms = part.select(F.explode(F.array("p_type", F.lower("p_type"))).alias("term")).distinct()
    said = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lower("p_type")).alias("said"))
    both = said.join(terms.withColumn("k", F.lower("term")), F.lower("said") == F.col("k"))
    return both.groupBy("p_partkey").agg(F.min_by("term", F.struct(F.when(F.col("term") == F.col("said"), 0).otherwise(1), F.col("term"))).alias("term"))


@query("exact_then_near", f"WITH {NAMES}, q AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN replace(p_name, 'e', 'i') ELSE p_name END AS said FROM part), e AS (SELECT p_partkey, said, term FROM q JOIN n ON term = said), r AS (SELECT p_partkey, said FROM q WHERE p_partkey NOT IN (SELECT p_partkey FROM e)), m AS (SELECT p_partkey, term, row_number() OVER (PARTITION BY p_partkey ORDER BY levenshtein(said, term), term) AS k FROM r JOIN n ON abs(length(said) - length(term)) <= 2 AND levenshtein(said, term) <= 2) SELECT p_partkey, term, 'exact' AS how FROM e UNION ALL SELECT p_partkey, term, 'near' FROM m WHERE k = 1")
def exact_then_near(spark, sf_dir):
    """Equal terms first; only what is left meets the lexicon by similarity, once for each distinct string."""
    terms = names(spark, sf_dir)
    said = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.regexp_replace("p_name", "e", "i")).otherwise(F.col("p_name")).alias("said"))
    exact = said.join(terms, F.col("said") == F.col("term")).select("p_partkey", "term", F.lit("exact").alias("how"))
    rest = said.join(terms, F.col("said") == F.col("term"), "left_anti")
    near = joins.banded(rest.select("said").distinct(), terms, "said", "term", 2).withColumn("d", F.levenshtein(F.col("said"), F.col("term"), 2)).filter("d >= 0")
    best = near.groupBy("said").agg(F.min_by("term", F.struct("d", "term")).alias("term"))
    return exact.unionAll(rest.join(best, "said").select("p_partkey", "term", F.lit("near").alias("how")))


@query("substring_terms", "WITH t AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS term FROM part), p AS (SELECT p_partkey, p_name, p_type FROM part) SELECT term, count(*) AS hits, CAST(sum((length(p_name) - length(replace(p_name, term, ''))) // length(term)) AS BIGINT) AS occurrences FROM t JOIN p ON contains(p_name, term) GROUP BY term")
def substring_terms(spark, sf_dir):
    """How often each vocabulary term stands in a name: names are counted once each, then weighed by their rows."""
    part = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    terms = part.select(F.get(F.split("p_name", " "), 0).alias("term")).distinct()
    # a term within a name is one of the name's stretches, so that the join is an equality
    cuts = let_cuts(part)
    hits = cuts.join(terms, "term")
    occurs = F.floor((F.length("p_name") - F.length(F.replace(F.col("p_name"), F.col("term"), F.lit("")))) / F.length("term"))
    return hits.groupBy("term").agg(F.sum("n").alias("hits"), F.sum(F.col("n") * occurs).cast("long").alias("occurrences"))


def let_cuts(part):
    starts = part.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("p_name"))))
    cuts = starts.withColumn("k", F.explode(F.sequence(F.lit(1), F.length("p_name") - F.col("i") + 1)))
    return cuts.select("p_name", "n", F.substr("p_name", "i", "k").alias("term")).distinct()


@query("composite_scores")
def composite_scores(spark, sf_dir):
    """Spelling, compact spelling and sound as one score, for the pairs that lengths leave; the three best of a term."""
    ship(spark)
    left = names(spark, sf_dir)
    pairs = joins.proportional(left, left.select(F.col("term").alias("other")), "term", "other", 0.5).filter("term <> other")
    scored = pairs.withColumn("score", phonetics.composite_score(F.col("term"), F.col("other")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "other"))).filter("rank <= 3")
