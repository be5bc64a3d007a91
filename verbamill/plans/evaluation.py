"""Queries that score hypotheses against references."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verbamill.functions import python_text
from verbamill.functions.distance import cer, wer
from verbamill.functions.text import ARABIC, aggressive, basic, script_aware, words
from verbamill.operators import evaluation, gates, joins
from verbamill.plans.registry import query
from verbamill.session import ship, table

EDGES = [0, 0.05, 0.1, 0.25, 0.5, 0.75, 1.0]


def clips(spark, sf_dir):
    """A catalogue as clips: an item's description is the reference, the one after it the hypothesis."""
    part = table(spark, sf_dir, "part")
    told = F.concat_ws(" ", "p_name", "p_type", F.translate("p_brand", "#", " "))
    ref = part.select(F.col("p_partkey").alias("clip_id"), F.col("p_type").alias("category"), F.col("p_size").alias("duration"), told.alias("ref"))
    hyp = part.select((F.col("p_partkey") - 1).alias("clip_id"), told.alias("hyp"))
    return ref.join(hyp, "clip_id")


CLIPS = """clips AS (
  SELECT a.p_partkey AS clip_id, a.p_type AS category, a.p_size AS duration,
    a.p_name || ' ' || a.p_type || ' ' || replace(a.p_brand, '#', ' ') AS ref, b.p_name || ' ' || b.p_type || ' ' || replace(b.p_brand, '#', ' ') AS hyp
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
split_ AS (SELECT *, list_filter(string_split(ref, ' '), lambda x: x <> '') AS r, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS h FROM clips),
known AS (SELECT *, list_distinct(list_concat(r, h)) AS d FROM split_),
scored AS (
  SELECT clip_id, category, duration, ref, hyp, len(r) AS ref_words, len(h) AS hyp_words,
    CAST(levenshtein(list_aggregate(list_transform(r, lambda w: chr(CAST(32 + list_position(d, w) AS INTEGER))), 'string_agg', ''),
      list_aggregate(list_transform(h, lambda w: chr(CAST(32 + list_position(d, w) AS INTEGER))), 'string_agg', '')) AS BIGINT) AS edits,
    CAST(levenshtein(replace(ref, ' ', ''), replace(hyp, ' ', '')) AS DOUBLE) / length(replace(ref, ' ', '')) AS cer,
    CAST(levenshtein(ref, hyp) AS DOUBLE) / length(ref) AS cer_spaces
  FROM known),
rated AS (SELECT *, CAST(edits AS DOUBLE) / ref_words AS wer FROM scored)
"""


@query("corpus_wer_by_category", f"WITH {CLIPS} SELECT category, count(*) AS clips, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(ref_words) AS BIGINT) AS ref_words, CAST(sum(edits) AS DOUBLE) / sum(ref_words) AS wer FROM rated GROUP BY category")
def corpus_wer_by_category(spark, sf_dir):
    return evaluation.corpus_rate(evaluation.clip_scores(clips(spark, sf_dir), "ref", "hyp"), ["category"])


MARKED = """m AS (SELECT category, duration % 7 AS band, CASE WHEN duration % 7 = 0 THEN greatest(CASE WHEN duration % 2 = 0 THEN 0 ELSE hyp_words END, 1) ELSE edits END AS edits, CASE WHEN duration % 7 = 0 THEN 1 ELSE ref_words END AS ref_words FROM rated)"""


@query("corpus_wer_marked_empty", f"WITH {CLIPS}, {MARKED} SELECT category, count(*) AS clips, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(ref_words) AS BIGINT) AS ref_words, CAST(sum(edits) AS DOUBLE) / sum(ref_words) AS wer FROM m GROUP BY category")
def corpus_wer_marked_empty(spark, sf_dir):
    """Clips of which some have an empty reference, and some of those an empty hypothesis as well: an empty reference
    counts as one word that is never met."""
    blank = F.col("duration") % 7 == 0
    rows = clips(spark, sf_dir).withColumn("ref", F.when(blank, "").otherwise(F.col("ref"))).withColumn("hyp", F.when(blank & (F.col("duration") % 2 == 0), "").otherwise(F.col("hyp")))
    return evaluation.corpus_rate(evaluation.clip_scores(rows, "ref", "hyp"), ["category"], "mark")


@query("clip_scores", f"WITH {CLIPS} SELECT clip_id, edits, CAST(ref_words AS BIGINT) AS ref_words, round(wer, 6) AS wer, round(cer, 6) AS cer, round(cer_spaces, 6) AS cer_spaces FROM rated")
def clip_scores(spark, sf_dir):
    scored = evaluation.clip_scores(clips(spark, sf_dir), "ref", "hyp")
    return scored.select("clip_id", "edits", "ref_words", F.round("wer", 6).alias("wer"), F.round("cer", 6).alias("cer"), F.round(cer("ref", "hyp", spaces=True), 6).alias("cer_spaces"))


@query("clip_wer_summary", f"WITH {CLIPS} SELECT category, count(*) AS clips, round(avg(wer), 6) AS mean, round(median(wer), 6) AS median, count(*) FILTER (wer = 0) AS perfect, count(*) FILTER (wer < 0.10) AS under_10, count(*) FILTER (wer < 0.25) AS under_25 FROM rated GROUP BY category")
def clip_wer_summary(spark, sf_dir):
    out = evaluation.clip_summary(evaluation.clip_scores(clips(spark, sf_dir), "ref", "hyp"), ["category"])
    return out.withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


@query("wer_histogram", f"WITH {CLIPS} SELECT CASE WHEN wer <= 0 THEN 1 WHEN wer <= 0.05 THEN 2 WHEN wer <= 0.1 THEN 3 WHEN wer <= 0.25 THEN 4 WHEN wer <= 0.5 THEN 5 WHEN wer <= 0.75 THEN 6 WHEN wer <= 1.0 THEN 7 ELSE 8 END AS bucket, count(*) AS clips FROM rated GROUP BY 1")
def wer_histogram(spark, sf_dir):
    scored = evaluation.clip_scores(clips(spark, sf_dir), "ref", "hyp")
    return scored.groupBy(gates.bucket(F.col("wer"), EDGES).alias("bucket")).agg(F.count("*").alias("clips"))


@query("leaderboard", f"""WITH {CLIPS} SELECT category, duration % 5 AS band, count(*) AS clips, round(avg(wer), 6) AS mean_wer, round(avg(CASE WHEN cer < 0.9 THEN 1 - cer END), 6) AS mean_recall,
 rank() OVER (ORDER BY round(avg(wer), 6), category NULLS LAST, duration % 5 NULLS LAST) AS place FROM rated GROUP BY GROUPING SETS ((category), (category, duration % 5))""")
def leaderboard(spark, sf_dir):
    """Two levels of aggregate, null-skipping means, order with nulls last; the ranked rows are groups, not clips."""
    scored = evaluation.clip_scores(clips(spark, sf_dir), "ref", "hyp").withColumn("band", F.col("duration") % 5)
    recall = F.when(F.col("cer") < 0.9, 1 - F.col("cer"))
    out = scored.groupingSets([[F.col("category")], [F.col("category"), F.col("band")]], "category", "band").agg(F.count("*").alias("clips"), F.round(F.avg("wer"), 6).alias("mean_wer"), F.round(F.avg(recall), 6).alias("mean_recall"))
    return out.withColumn("place", F.rank().over(Window.orderBy("mean_wer", F.asc_nulls_last("category"), F.asc_nulls_last("band"))).cast("long"))


@query("best_and_worst", f"""WITH {CLIPS}, a AS (SELECT 'worst' AS kind, clip_id, round(wer, 6) AS wer FROM rated ORDER BY wer DESC, clip_id LIMIT 10), b AS (SELECT 'best' AS kind, clip_id, round(wer, 6) AS wer FROM rated ORDER BY wer, clip_id LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b""")
def best_and_worst(spark, sf_dir):
    """The report's ten best and ten worst clips."""
    scored = evaluation.clip_scores(clips(spark, sf_dir), "ref", "hyp").select("clip_id", F.col("wer").alias("_w"), F.round("wer", 6).alias("wer"))
    worst = scored.orderBy(F.desc("_w"), "clip_id").limit(10).select(F.lit("worst").alias("kind"), "clip_id", "wer")
    return worst.unionAll(scored.orderBy("_w", "clip_id").limit(10).select(F.lit("best").alias("kind"), "clip_id", "wer"))


@query("nested_filters", f"""WITH {CLIPS}, lv AS (SELECT 'raw' AS level, * FROM rated UNION ALL SELECT 'clean', * FROM rated WHERE abs(hyp_words - ref_words) * 1.0 / ref_words <= 0.25 UNION ALL SELECT 'aligned', * FROM rated WHERE abs(hyp_words - ref_words) * 1.0 / ref_words <= 0.25 AND wer < 1)
 SELECT level, count(*) AS clips, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(ref_words) AS BIGINT) AS ref_words FROM lv GROUP BY level""")
def nested_filters(spark, sf_dir):
    """Raw, clean and aligned clips in one pass: each clip stands at every level that it reaches."""
    scored = evaluation.clip_scores(clips(spark, sf_dir), "ref", "hyp")
    clean = F.abs(F.size(words("hyp")) - F.col("ref_words")) / F.col("ref_words") <= 0.25
    levels = F.array_compact(F.array(F.lit("raw"), F.when(clean, "clean"), F.when(clean & (F.col("wer") < 1), "aligned")))
    return scored.withColumn("level", F.explode(levels)).groupBy("level").agg(F.count("*").alias("clips"), F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words"))


@query("pathologies", f"""WITH {CLIPS}, p AS (SELECT unnest(list_filter([CASE WHEN hyp_words > ref_words THEN 'insertion_heavy' END, CASE WHEN hyp_words < ref_words THEN 'deletion_heavy' END, CASE WHEN ref_words <= 4 THEN 'short_reference' END, CASE WHEN hyp_words = 0 THEN 'empty_prediction' END, CASE WHEN wer > 0 AND lower(regexp_replace(ref, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(hyp, '[^A-Za-z0-9]', '', 'g')) THEN 'spacing_only' END], lambda x: x IS NOT NULL)) AS kind, edits FROM rated)
 SELECT kind, count(*) AS clips, CAST(sum(edits) AS BIGINT) AS edits FROM p GROUP BY kind""")
def pathologies(spark, sf_dir):
    scored = evaluation.clip_scores(clips(spark, sf_dir), "ref", "hyp")
    n = F.size(words("hyp"))
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    kinds = F.array_compact(F.array(
        F.when(n > F.col("ref_words"), "insertion_heavy"), F.when(n < F.col("ref_words"), "deletion_heavy"), F.when(F.col("ref_words") <= 4, "short_reference"),
        F.when(n == 0, "empty_prediction"), F.when((F.col("wer") > 0) & (plain("ref") == plain("hyp")), "spacing_only")))
    return scored.withColumn("kind", F.explode(kinds)).groupBy("kind").agg(F.count("*").alias("clips"), F.sum("edits").alias("edits"))


@query("slices_at_once", f"""WITH {CLIPS}, s AS (SELECT unnest(['category:' || category, 'band:' || (duration % 5), 'brand:' || string_split(ref, ' ')[-1]]) AS slice, edits, ref_words FROM rated) SELECT slice, count(*) AS clips, CAST(sum(edits) AS DOUBLE) / sum(ref_words) AS wer FROM s GROUP BY slice""")
def slices_at_once(spark, sf_dir):
    scored = evaluation.clip_scores(clips(spark, sf_dir), "ref", "hyp")
    names = F.array(F.concat(F.lit("category:"), "category"), F.concat(F.lit("band:"), (F.col("duration") % 5).cast("string")), F.concat(F.lit("brand:"), F.element_at(F.split("ref", " "), -1)))
    out = scored.withColumn("slice", F.explode(names)).groupBy("slice").agg(F.count("*").alias("clips"), F.sum("edits").alias("e"), F.sum("ref_words").alias("r"))
    return out.select("slice", "clips", (F.col("e") / F.col("r")).alias("wer"))


@query("word_operations")
def word_operations(spark, sf_dir):
    """Substitutions, deletions and insertions by category, by backtracing each clip."""
    ship(spark)
    found = clips(spark, sf_dir).withColumn("o", python_text.word_operations(F.col("ref"), F.col("hyp")))
    return found.groupBy("category").agg(*[F.sum(f"o.{x}").alias(x) for x in ("substitutions", "deletions", "insertions")])


@query("document_wer_by_lang")
def document_wer_by_lang(spark, sf_dir):
    """Corpus error rates of whole documents against the document after them, by language."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    ref = docs.select("doc_id", "lang", basic("text").alias("ref"))
    hyp = docs.select((F.col("doc_id") - 1).alias("doc_id"), basic("text").alias("hyp"))
    pairs = ref.join(hyp, "doc_id")
    scored = pairs.select("lang", python_text.long_word_edits(F.col("ref"), F.col("hyp")).alias("edits"), F.size(words("ref")).cast("long").alias("ref_words"))
    return evaluation.corpus_rate(scored, ["lang"])


LADDER = """WITH x AS (SELECT lang, doc_id, text, length(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}_\\s]', '', 'g')) AS k FROM documents),
 y AS (SELECT lang, unnest([{'label': 'basic', 't': 'أ' || lower(coalesce(text, '')) || ' ٣ الكتاب'}, {'label': 'script_aware', 't': 'ا' || lower(coalesce(text, '')) || ' 3 الكتاب'}, {'label': 'aggressive', 't': 'ا' || lower(coalesce(text, '')) || ' 3 كتاب'}]) AS s FROM x),
 z AS (SELECT s.label AS label, lang, list_filter(string_split_regex(regexp_replace(s.t, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS w FROM y)
SELECT label, lang, count(*) AS documents, CAST(sum(len(w)) AS BIGINT) AS words, CAST(sum(len(list_distinct(w))) AS BIGINT) AS distinct_words, CAST(sum(strlen(list_aggregate(w, 'string_agg', ''))) AS BIGINT) AS bytes,
 count(*) FILTER (list_contains(w, '3')) AS with_digit, count(*) FILTER (list_contains(w, 'كتاب')) AS with_bare_noun FROM z GROUP BY ALL"""


@query("normaliser_ladder", LADDER)
def normaliser_ladder(spark, sf_dir):
    """Words of each document, between an Arabic letter, digit and noun that the three normalisers treat apart."""
    text = F.concat(F.lit("أ"), F.coalesce("text", F.lit("")), F.lit(" ٣ الكِتَاب"))
    steps = F.array(*[F.struct(F.lit(n).alias("label"), words(f(text)).alias("w")) for n, f in (("basic", basic), ("script_aware", script_aware), ("aggressive", aggressive))])
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(steps).alias("s")).select("lang", "s.*")
    return rows.groupBy("label", "lang").agg(
        F.count("*").alias("documents"), F.sum(F.size("w").cast("long")).alias("words"), F.sum(F.size(F.array_distinct("w")).cast("long")).alias("distinct_words"),
        F.sum(F.octet_length(F.array_join("w", "")).cast("long")).alias("bytes"), F.count_if(F.array_contains("w", "3")).alias("with_digit"), F.count_if(F.array_contains("w", "كتاب")).alias("with_bare_noun"),
    )


@query("term_recall", """WITH t AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS term FROM part), c AS (SELECT a.p_partkey AS clip_id, a.p_type AS category, a.p_name AS ref, b.p_name AS hyp FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
 f AS (SELECT category, clip_id, count(*) AS present, count(*) FILTER (contains(' ' || hyp || ' ', ' ' || term || ' ')) AS found FROM c JOIN t ON contains(' ' || ref || ' ', ' ' || term || ' ') GROUP BY ALL)
 SELECT category, CAST(sum(present) AS BIGINT) AS present, CAST(sum(found) AS BIGINT) AS found, CAST(sum(found) AS DOUBLE) / sum(present) AS micro_recall, round(avg(CAST(found AS DOUBLE) / present), 6) AS macro_recall FROM f GROUP BY category""")
def term_recall(spark, sf_dir):
    """Recall of vocabulary terms: micro is a ratio of sums, macro a mean over clips that have any. Terms meet clips by
    an equi-join on words, whatever the size of the vocabulary."""
    part = table(spark, sf_dir, "part")
    terms = part.select(F.get(F.split("p_name", " "), 0).alias("term")).distinct()
    pairs = part.select("p_partkey", F.col("p_type").alias("category"), F.array_distinct(words("p_name")).alias("r")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), words("p_name").alias("h")), "p_partkey")
    hits = pairs.select("p_partkey", "category", "h", F.explode("r").alias("term")).join(terms, "term").groupBy("category", "p_partkey").agg(F.count("*").alias("present"), F.count_if(F.array_contains("h", F.col("term"))).alias("found"))
    return hits.groupBy("category").agg(F.sum("present").alias("present"), F.sum("found").alias("found"), evaluation.micro(F.col("found"), F.col("present")).alias("micro_recall"), F.round(F.avg(F.col("found") / F.col("present")), 6).alias("macro_recall"))


SIGNALS = """s AS (SELECT doc_id, coalesce(quality, 0) AS gold, toxic, CASE WHEN regexp_matches(text, '[#*$%&|]') THEN 0 ELSE 1 END AS predicted, lang,
  round(CAST(len(list_distinct(string_split(text, ' '))) AS DOUBLE) / len(string_split(text, ' ')), 4) AS score FROM documents JOIN labels USING (doc_id))"""


def signals(spark, sf_dir):
    """Marks and scores of labelled documents; they are computed before the join, so that no text is shuffled."""
    parts = F.split("text", " ")
    score = evaluation.rounded(F.size(F.array_distinct(parts)) / F.size(parts), 4)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("text").rlike("[#*$%&|]"), 0).otherwise(1).alias("predicted"), score.alias("score"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.coalesce("quality", F.lit(0)).alias("gold"), "toxic"), "doc_id")


@query("stage_precision_recall", f"""WITH {SIGNALS}, c AS (SELECT count(*) FILTER (gold = 1 AND predicted = 1) AS tp, count(*) FILTER (gold = 0 AND predicted = 1) AS fp, count(*) FILTER (gold = 1 AND predicted = 0) AS fn, count(*) FILTER (gold = 0 AND predicted = 0) AS tn, lang FROM s GROUP BY GROUPING SETS ((), (lang)))
 SELECT lang, tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END, 6) AS specificity FROM c""")
def stage_precision_recall(spark, sf_dir):
    g, p = F.col("gold"), F.col("predicted")
    hit = lambda a, b: F.count_if((g == a) & (p == b))
    out = signals(spark, sf_dir).groupingSets([[], [F.col("lang")]], "lang").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    precision, recall, f1 = evaluation.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    out = out.select("*", precision, recall, f1, F.round(F.when(F.col("tn") + F.col("fp") > 0, F.col("tn") / (F.col("tn") + F.col("fp"))), 6).alias("specificity"))
    return out.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


THRESHOLDS = f"""WITH {SIGNALS}, b AS (SELECT score, sum(gold) AS t, sum(1 - gold) AS f FROM s GROUP BY score), r AS (SELECT score, sum(t) OVER (ORDER BY score DESC) AS tp, sum(f) OVER (ORDER BY score DESC) AS fp, sum(t) OVER () AS n FROM b)"""


@query("threshold_table", f"{THRESHOLDS} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, round(CAST(tp AS DOUBLE) / n, 6) AS recall FROM r")
def threshold_table(spark, sf_dir):
    out = evaluation.threshold_table(signals(spark, sf_dir), "score", "gold")
    return out.withColumns({x: evaluation.rounded(F.col(x), 6) for x in ("precision", "recall")})


@query("confidence_thresholds", f"""{THRESHOLDS}, p AS (SELECT score, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / n AS recall FROM r),
 m AS (SELECT kind, min(score) AS score FROM p, (VALUES ('auto', 0.95), ('review', 0.80)) v(kind, least) WHERE precision >= least GROUP BY kind) SELECT kind, score, round(precision, 6) AS precision, round(recall, 6) AS recall FROM m JOIN p USING (score)""")
def confidence_thresholds(spark, sf_dir):
    found = evaluation.threshold_table(signals(spark, sf_dir), "score", "gold")
    pick = lambda kind, least: evaluation.lowest_threshold(found, "score", least).select(F.lit(kind).alias("kind"), "score", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
    return pick("auto", 0.95).unionAll(pick("review", 0.80))


@query("roc_auc", f"WITH {SIGNALS}, b AS (SELECT score, sum(gold) AS p, sum(1 - gold) AS n FROM s GROUP BY score), r AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) SELECT round(CAST(sum(p * (below + n / 2)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) AS auc FROM r")
def roc_auc(spark, sf_dir):
    return evaluation.roc_auc(signals(spark, sf_dir), "score", "gold").select(F.round("auc", 6).alias("auc"))


@query("retrieval_accuracy", """WITH t AS (SELECT DISTINCT p_name AS name FROM part), x AS (SELECT a.name AS q, b.name AS c, row_number() OVER (PARTITION BY a.name ORDER BY levenshtein(a.name, b.name), b.name) AS r FROM t a JOIN t b ON a.name <> b.name AND least(length(a.name), length(b.name)) >= 0.5 * greatest(length(a.name), length(b.name))),
 g AS (SELECT q, max(CASE WHEN r = 1 AND string_split(q, ' ')[2] = string_split(c, ' ')[2] THEN 1 ELSE 0 END) AS top1, max(CASE WHEN r <= 5 AND string_split(q, ' ')[2] = string_split(c, ' ')[2] THEN 1 ELSE 0 END) AS topk FROM x GROUP BY q)
 SELECT count(*) AS cases, round(avg(top1), 6) AS top1_accuracy, round(avg(topk), 6) AS topk_recall, round((avg(top1) + avg(topk)) / 2, 6) AS mean_of_both FROM g""")
def retrieval_accuracy(spark, sf_dir):
    """Is the first, or any of the first five, of a name's neighbours of the same noun? The names are a vocabulary."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("q")).distinct()
    pairs = joins.proportional(names, names.select(F.col("q").alias("c")), "q", "c", 0.5).filter("q <> c")
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.levenshtein("q", "c"), "c")))
    same = F.get(F.split("q", " "), 1) == F.get(F.split("c", " "), 1)
    cases = ranked.groupBy("q").agg(F.max(F.when(same & (F.col("r") == 1), 1).otherwise(0)).alias("a"), F.max(F.when(same & (F.col("r") <= 5), 1).otherwise(0)).alias("b"))
    return cases.agg(F.count("*").alias("cases"), F.round(F.avg("a"), 6).alias("top1_accuracy"), F.round(F.avg("b"), 6).alias("topk_recall"), F.round((F.avg("a") + F.avg("b")) / 2, 6).alias("mean_of_both"))


HARNESS = """h AS (SELECT conv_id, role, count(*) AS turns, count(*) FILTER (length(text) > 200) AS flagged, count(*) FILTER (length(text) > 200 AND role = 'assistant') AS right_, count(*) FILTER (length(text) <= 200 AND role = 'assistant') AS missed FROM conversations GROUP BY ALL)"""


@query("correction_harness", f"""WITH {HARNESS} SELECT role, conv_id % 4 AS fold, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(right_) AS DOUBLE) / greatest(1, sum(flagged)) AS precision, CAST(sum(right_) AS DOUBLE) / greatest(1, sum(right_ + missed)) AS recall, CAST(count(*) FILTER (flagged = 0) AS DOUBLE) / count(*) AS untouched FROM h GROUP BY GROUPING SETS ((), (role), (conv_id % 4))""")
def correction_harness(spark, sf_dir):
    """One wide aggregate over three slicings; denominators are at least 1."""
    talk = table(spark, sf_dir, "conversations")
    long, mine = F.length("text") > 200, F.col("role") == "assistant"
    h = talk.groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.count_if(long).alias("flagged"), F.count_if(long & mine).alias("right"), F.count_if(~long & mine).alias("missed")).withColumn("fold", F.col("conv_id") % 4)
    return h.groupingSets([[], [F.col("role")], [F.col("fold")]], "role", "fold").agg(
        F.sum("turns").alias("turns"), (F.sum("right") / F.greatest(F.lit(1), F.sum("flagged"))).alias("precision"), (F.sum("right") / F.greatest(F.lit(1), F.sum(F.col("right") + F.col("missed")))).alias("recall"), (F.count_if(F.col("flagged") == 0) / F.count("*")).alias("untouched")
    )


FEATURES = ("phonetic_score", "score_gap", "model_confidence", "candidates", "mixed_script", "span_length", "arabic", "retrieval_score", "span_tokens", "many_words")

CALIBRATION = """WITH p AS (SELECT p_partkey, p_name AS span, p_size, p_type, lead(p_name) OVER (ORDER BY p_partkey) AS other FROM part),
 c AS (SELECT *, 100 * (1 - CAST(levenshtein(span, coalesce(other, '')) AS DOUBLE) / greatest(length(span), length(coalesce(other, '')))) AS score FROM p)
SELECT p_partkey, CAST(coalesce(other, '') = span AS INTEGER) AS gold, round(score / 100, 6) AS phonetic_score, round((100 - score) / 100, 6) AS score_gap, p_size / 50.0 AS model_confidence, least(1.0, p_size / 10.0) AS candidates, CAST(0 AS DOUBLE) AS mixed_script,
 least(1.0, length(span) / 50.0) AS span_length, CAST(0 AS DOUBLE) AS arabic, round(score / 100, 6) AS retrieval_score, round(least(1.0, len(string_split(span, ' ')) / 6.0), 6) AS span_tokens, CAST(len(string_split(span, ' ')) > 1 AS DOUBLE) AS many_words FROM c"""


def calibration_rows(spark, sf_dir):
    """Spans (an item's name) against a candidate (the next item's), with the ten scaled and capped features."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("span"), "p_size")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("span").alias("other"))
    rows = part.join(after, "p_partkey", "left").withColumn("other", F.coalesce("other", F.lit("")))
    score = 100 * (1 - F.levenshtein("span", "other") / F.greatest(F.length("span"), F.length("other")))
    has = lambda p: F.col("span").rlike(p)
    tokens = F.size(words("span"))
    found = evaluation.calibration_features(
        phonetic_score=score, score_gap=100 - score, model_confidence=F.col("p_size") / 50.0, candidates=F.col("p_size"), mixed_script=has("[A-Za-z]") & has(ARABIC), span_length=F.length("span"),
        arabic=has(ARABIC), retrieval_score=score / 100, span_tokens=tokens, many_words=tokens > 1,
    )
    return rows.select("p_partkey", (F.col("other") == F.col("span")).cast("int").alias("gold"), *found)


@query("calibration_features", CALIBRATION)
def calibration_features(spark, sf_dir):
    return calibration_rows(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("phonetic_score", "score_gap", "retrieval_score", "span_tokens")})


@query("logistic_calibration")
def logistic_calibration(spark, sf_dir):
    """Class-balanced logistic regression of correctness on the ten features, with an L2 penalty of 1 / (C n)."""
    rows = calibration_rows(spark, sf_dir)
    return evaluation.calibrated(rows, FEATURES, "gold").select("p_partkey", "gold", "confidence")


@query("wer_variants", """SELECT name, value FROM (VALUES ('empty_both', 0.0::DOUBLE), ('empty_ref', 1.0::DOUBLE), ('one_of_four', 0.5::DOUBLE), ('deletion', 0.5::DOUBLE)) t(name, value)""")
def wer_variants(spark, sf_dir):
    """The defined corner values of the word error rate."""
    rows = [("empty_both", "", ""), ("empty_ref", "", "x"), ("one_of_four", "a b c d", "a x c d e"), ("deletion", "a b", "b")]
    return spark.createDataFrame(rows, "name string, r string, h string").select("name", wer("r", "h").alias("value"))
