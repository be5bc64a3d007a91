"""Queries that gate, deduplicate, guard, sample, split and summarise rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verbamill.functions.text import chars_per_second, dedup_key, has_arabic, latin_tokens, resolve, source_name, words
from verbamill.operators import gates, joins, sampling
from verbamill.plans.registry import query
from verbamill.session import table

#: Words a second of read speech: n_words / RATE stands for a duration.
RATE = 2.0
WORDS_SQL = "len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> ''))"


def clips(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", "text", "n_chars", (F.size(words("text")) / RATE).alias("duration"))


def gated(spark, sf_dir):
    c = clips(spark, sf_dir)
    cps = chars_per_second("text", "duration")
    return gates.gate(c, [
        ("too_short", F.col("duration") < 5), ("too_long", F.col("duration") > 300), ("empty_transcript", F.trim(F.coalesce("text", F.lit(""))) == ""),
        ("too_slow", cps < 8), ("too_fast", cps > 14), ("bad_charset", F.coalesce("text", F.lit("")).rlike("[#*$%&|]")),
    ])


GATED = f"""c AS (SELECT doc_id, lang, source, text, n_chars, {WORDS_SQL} / 2.0 AS duration, length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS solid FROM documents),
g AS (SELECT *, CASE WHEN duration < 5 THEN 'too_short' WHEN duration > 300 THEN 'too_long' WHEN trim(coalesce(text, '')) = '' THEN 'empty_transcript' WHEN solid / duration < 8 THEN 'too_slow' WHEN solid / duration > 14 THEN 'too_fast' WHEN regexp_matches(text, '[#*$%&|]') THEN 'bad_charset' END AS reason FROM c)"""


@query("reject_reason_counts", f"WITH {GATED} SELECT source, reason, count(*) AS clips, sum(duration) AS seconds FROM g GROUP BY source, reason")
def reject_reason_counts(spark, sf_dir):
    return gated(spark, sf_dir).groupBy("source", "reason").agg(F.count("*").alias("clips"), F.sum("duration").alias("seconds"))


@query("clean_manifest", f"WITH {GATED} SELECT doc_id, source, round(duration, 3) AS duration, round(solid / duration, 4) AS chars_per_s FROM g WHERE reason IS NULL")
def clean_manifest(spark, sf_dir):
    return gates.accepted(gated(spark, sf_dir)).select("doc_id", "source", F.round("duration", 3).alias("duration"), F.round(chars_per_second("text", "duration"), 4).alias("chars_per_s"))


@query("reject_log", f"WITH {GATED} SELECT doc_id, reason, source, duration FROM g WHERE reason IS NOT NULL")
def reject_log(spark, sf_dir):
    return gates.rejected(gated(spark, sf_dir)).select("doc_id", "reason", "source", "duration")


@query("dedup_first_wins", "SELECT doc_id FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r FROM (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS k FROM documents)) WHERE r = 1 OR k = ''")
def dedup_first_wins(spark, sf_dir):
    """One row for each normalised text, the first by id; rows with an empty key all stay. Keys are hashed, so a text
    is not shuffled, and the first id is a minimum, so a common text is one row for each task."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", dedup_key("text").alias("k"))
    empty = F.col("k") == ""
    groups = keyed.select("doc_id", F.when(~empty, F.sha2("k", 256)).alias("h"), F.when(empty, F.col("doc_id")).alias("own")).groupBy("h", "own").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    times = F.when(F.col("h").isNull(), F.col("n")).otherwise(1).cast("int")
    return groups.select(F.explode(F.array_repeat("doc_id", times)).alias("doc_id"))


RUNS = """list_transform(range(1, len(w) - 11), lambda i: list_aggregate(w[i:i + 11], 'string_agg', ' '))"""


@query("leak_guard_ngrams", f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents),
 b AS (SELECT list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM benchmark),
 k AS (SELECT DISTINCT unnest({RUNS}) AS run FROM b WHERE len(w) >= 12), x AS (SELECT doc_id, unnest({RUNS}) AS run FROM d WHERE len(w) >= 12)
 SELECT DISTINCT doc_id FROM x WHERE run IN (SELECT run FROM k)""")
def leak_guard_ngrams(spark, sf_dir):
    """Documents that share a run of 12 words with a benchmark item."""
    docs, held = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return joins.shared_ngrams(docs, words(F.lower("text")), held, words(F.lower("text")), 12, "doc_id")


@query("leak_guard_ids", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages WHERE page_id IS NOT NULL UNION SELECT item_id FROM benchmark WHERE item_id IS NOT NULL)")
def leak_guard_ids(spark, sf_dir):
    """Rows none of whose ids is an id of any held-out table."""
    docs = table(spark, sf_dir, "documents")
    held = table(spark, sf_dir, "pages").select(F.col("page_id").alias("a"), F.lit(None).cast("long").alias("b")).unionAll(table(spark, sf_dir, "benchmark").select(F.lit(None).cast("long"), "item_id"))
    return joins.leak_guard(docs, F.array("doc_id"), held, F.array("a", "b"), "doc_id").select("doc_id", "source")


@query("leak_signature_overlap", "SELECT count(*) AS overlap FROM (SELECT DISTINCT md5(lower(trim(text))) AS s FROM documents WHERE lang = 'en' AND text IS NOT NULL) a JOIN (SELECT DISTINCT md5(lower(trim(text))) AS s FROM documents WHERE lang <> 'en' AND text IS NOT NULL) b USING (s)")
def leak_signature_overlap(spark, sf_dir):
    """How many text signatures two parts share; a split must give 0."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("lang", F.md5(F.lower(F.trim("text"))).alias("s"))
    a, b = docs.filter("lang = 'en'").select("s").distinct(), docs.filter("lang <> 'en'").select("s").distinct()
    return a.join(b, "s", "left_semi").agg(F.count("*").alias("overlap"))


HASHED = "md5('7' || CAST(doc_id AS VARCHAR))"


@query("stratified_split", f"""SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY {HASHED}, doc_id) <= CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.05, 0)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n FROM documents)""")
def stratified_split(spark, sf_dir):
    return sampling.held_out(table(spark, sf_dir, "documents"), ["source"], 0.05, "7", "doc_id").select("doc_id", "source", "split")


@query("capped_split", f"""SELECT split, lang, count(*) AS clips FROM (SELECT lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {HASHED}, doc_id) <= least(greatest(1, round_even(n * 0.1, 0)), n - 1, 20) THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n FROM documents)) GROUP BY ALL""")
def capped_split(spark, sf_dir):
    """Validation of a tenth of each stratum, at most 20 rows and never all of it."""
    return sampling.held_out(table(spark, sf_dir, "documents"), ["lang"], 0.1, "7", "doc_id", 20).groupBy("split", "lang").agg(F.count("*").alias("clips"))


@query("budget_sample", f"""SELECT doc_id, source, n_chars FROM (SELECT doc_id, source, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY {HASHED}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE n_chars > 0 AND before < 20000""")
def budget_sample(spark, sf_dir):
    return sampling.budget(table(spark, sf_dir, "documents"), ["source"], "n_chars", F.lit(20000), "7", "doc_id").select("doc_id", "source", "n_chars")


@query("carved_share", f"""SELECT doc_id, source FROM (SELECT doc_id, source, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY {HASHED}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n_chars) OVER (PARTITION BY source) * 0.125 AS want FROM documents) WHERE n_chars > 0 AND before < want""")
def carved_share(spark, sf_dir):
    return sampling.carve(table(spark, sf_dir, "documents"), ["source"], "n_chars", 0.125, "7", "doc_id").select("doc_id", "source")


@query("round_robin_draw", f"SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {HASHED}, doc_id) AS turn FROM documents) WHERE turn <= 5")
def round_robin_draw(spark, sf_dir):
    return sampling.round_robin(table(spark, sf_dir, "documents"), "source", "7", "doc_id", 5).select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


@query("priority_top_up", f"SELECT doc_id, source, first_choice, turn FROM (SELECT doc_id, source, lang = 'en' AS first_choice, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, {HASHED}, doc_id) AS turn FROM documents) WHERE turn <= 6")
def priority_top_up(spark, sf_dir):
    return sampling.top_up(table(spark, sf_dir, "documents"), F.col("lang") == "en", "source", "7", "doc_id", 6).select("doc_id", "source", "first_choice", F.col("turn").cast("long").alias("turn"))


@query("interleaved_tiers", f"SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY {HASHED}, doc_id) - 1) // CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END AS round FROM documents")
def interleaved_tiers(spark, sf_dir):
    return sampling.interleaved(table(spark, sf_dir, "documents"), "lang", {"en": 5, "de": 3, "fr": 2, "es": 1}, "7", "doc_id").select("doc_id", "lang", "round")


@query("weighted_mix", f"""WITH t AS (SELECT lang, sum(n_chars) AS have FROM documents GROUP BY lang), w AS (SELECT *, CASE lang WHEN 'en' THEN 200000 WHEN 'de' THEN 100000 WHEN 'fr' THEN 60000 ELSE 40000 END AS want FROM t),
 k AS (SELECT d.lang, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY d.lang ORDER BY {HASHED}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, want, have FROM documents d JOIN w ON w.lang = d.lang)
 SELECT lang, count(*) AS clips, CAST(sum(n_chars) AS BIGINT) AS chars, max(have) < max(want) AS short FROM k WHERE have < want OR (n_chars > 0 AND before < want) GROUP BY lang""")
def weighted_mix(spark, sf_dir):
    """A budget for each bucket; a bucket that has less gives all its rows, those without size too."""
    docs = table(spark, sf_dir, "documents")
    want = F.when(F.col("lang") == "en", 200000).when(F.col("lang") == "de", 100000).when(F.col("lang") == "fr", 60000).otherwise(40000)
    ready = docs.join(docs.groupBy("lang").agg(F.sum("n_chars").alias("have")), "lang").withColumn("short", F.col("have") < want)
    kept = ready.filter("short").unionByName(sampling.budget(ready.filter("NOT short"), ["lang"], "n_chars", want, "7", "doc_id"))
    return kept.groupBy("lang").agg(F.count("*").alias("clips"), F.sum("n_chars").alias("chars"), F.first("short").alias("short"))


@query("capped_draw")
def capped_draw(spark, sf_dir):
    return sampling.capped_draw(table(spark, sf_dir, "documents"), "source", "n_chars", 0.1, "7", "doc_id")


@query("group_split")
def group_split(spark, sf_dir):
    """Whole conversations to train, validation and test by their length, one row for each conversation."""
    talk = table(spark, sf_dir, "conversations").withColumn("source", F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string"))).withColumn("size", F.length("text"))
    return sampling.group_split(talk, "source", "conv_id", "size", {"train": 0.8, "validation": 0.1, "test": 0.1}, "7")


@query("weighted_draws")
def weighted_draws(spark, sf_dir):
    return sampling.weighted_draws(table(spark, sf_dir, "documents"), "n_chars", 1000, "7", "doc_id")


@query("hashed_sample", f"SELECT doc_id FROM documents ORDER BY {HASHED}, doc_id LIMIT 100")
def hashed_sample(spark, sf_dir):
    """A sample of 100 rows without replacement."""
    return table(spark, sf_dir, "documents").orderBy(sampling.shuffled("7", "doc_id"), "doc_id").limit(100).select("doc_id")


@query("speaker_proxy_dedup", f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {HASHED}, doc_id) AS r, (SELECT count(DISTINCT source) FROM documents) AS n FROM documents) WHERE r = 1 OR (n < 40 AND r = 2)")
def speaker_proxy_dedup(spark, sf_dir):
    return sampling.proxy_dedup(table(spark, sf_dir, "documents"), "source", 40, "7", "doc_id").select("doc_id", "source")


@query("hours_rollup", f"SELECT source, lang, count(*) AS rows, count(text) AS text_rows, sum({WORDS_SQL} / 2.0) AS seconds, round(sum({WORDS_SQL} / 2.0) / 3600, 6) AS hours FROM documents GROUP BY ROLLUP (source, lang)")
def hours_rollup(spark, sf_dir):
    c = clips(spark, sf_dir)
    return c.rollup("source", "lang").agg(F.count("*").alias("rows"), F.count("text").alias("text_rows"), F.sum("duration").alias("seconds"), F.round(F.sum("duration") / 3600, 6).alias("hours"))


@query("source_shares", f"SELECT source, count(*) AS clips, sum(n_chars) AS chars, round(100.0 * sum(n_chars) / sum(sum(n_chars)) OVER (), 6) AS percent, count(*) FILTER (n_chars IS NULL) AS missing FROM documents GROUP BY source".replace("sum(n_chars) AS chars", "CAST(sum(n_chars) AS BIGINT) AS chars"))
def source_shares(spark, sf_dir):
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("clips"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars").isNull()).alias("missing"))
    return by.join(F.broadcast(by.agg(F.sum("chars").alias("all")))).select("source", "clips", "chars", F.round(100.0 * F.col("chars") / F.col("all"), 6).alias("percent"), "missing")


@query("split_cube", f"""WITH s AS (SELECT lang, source, n_chars, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY {HASHED}, doc_id) <= CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.05, 0)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM documents))
 SELECT split, lang, count(*) AS clips, CAST(sum(n_chars) AS BIGINT) AS chars FROM s GROUP BY CUBE (split, lang)""")
def split_cube(spark, sf_dir):
    return sampling.held_out(table(spark, sf_dir, "documents"), ["source"], 0.05, "7", "doc_id").cube("split", "lang").agg(F.count("*").alias("clips"), F.sum("n_chars").alias("chars"))


TIER = "CASE WHEN quality = 0 AND toxic = 1 THEN 'REJECT' WHEN quality = 0 THEN 'HARD' WHEN n_chars > 2000 THEN 'HIGH' ELSE 'MEDIUM' END"


@query("tier_contingency", f"SELECT source, count(*) FILTER (tier = 'HIGH') AS high, count(*) FILTER (tier = 'MEDIUM') AS medium, count(*) FILTER (tier = 'HARD') AS hard, count(*) FILTER (tier = 'REJECT') AS reject FROM (SELECT source, {TIER} AS tier FROM documents JOIN labels USING (doc_id)) GROUP BY source")
def tier_contingency(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    bad = F.col("quality") == 0
    tier = gates.ladder(F.col("quality"), [("REJECT", bad & (F.col("toxic") == 1)), ("HARD", bad), ("HIGH", F.col("n_chars") > 2000)], "MEDIUM")
    counted = rows.withColumn("tier", tier).groupBy("source").pivot("tier", ["HIGH", "MEDIUM", "HARD", "REJECT"]).agg(F.count(F.lit(1)))
    return counted.na.fill(0).select("source", *[F.col(t).alias(t.lower()) for t in ("HIGH", "MEDIUM", "HARD", "REJECT")])


@query("code_switch_mining", "SELECT doc_id, source, len(list_filter(regexp_extract_all(text, '[A-Z]{2,}'), lambda x: length(x) >= 3)) AS switched, 1.5 AS weight FROM documents WHERE len(list_filter(regexp_extract_all(text, '[A-Z]{2,}'), lambda x: length(x) >= 3)) >= 2".replace("AS switched", "AS switched").replace("1.5 AS weight", "CAST(1.5 AS DOUBLE) AS weight"))
def code_switch_mining(spark, sf_dir):
    """Rows with several tokens of the other register (here runs of capitals), re-projected with a higher weight."""
    found = F.size(F.filter(F.regexp_extract_all("text", F.lit("[A-Z]{2,}"), 0), lambda w: F.length(w) >= 3)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", "source", found.alias("switched"), F.lit(1.5).alias("weight")).filter("switched >= 2")


@query("script_profile", "SELECT lang, count(*) AS rows, count(*) FILTER (regexp_matches(text, '[؀-ۿ]')) AS arabic, CAST(sum(len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) >= 2 AND lower(x) NOT IN ('the', 'of')))) AS BIGINT) AS latin_tokens FROM documents GROUP BY lang")
def script_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("rows"), F.count_if(has_arabic("text")).alias("arabic"), F.sum(latin_tokens("text", 2, ("the", "of")).cast("long")).alias("latin_tokens"))


@query("hard_examples", "SELECT doc_id, round(rate, 6) AS rate, round(1 + least(rate, 1), 6) AS weight FROM (SELECT doc_id, CAST(length(regexp_replace(text, '[^#*$%&|!]', '', 'g')) AS DOUBLE) / length(text) AS rate FROM documents WHERE length(text) > 0) WHERE rate >= 0.02 ORDER BY rate DESC, doc_id LIMIT 50")
def hard_examples(spark, sf_dir):
    """The worst 50 by error rate, weighted by it."""
    rate = F.length(F.regexp_replace("text", "[^#*$%&|!]", "")) / F.length("text")
    rows = table(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id", rate.alias("r")).filter("r >= 0.02").orderBy(F.desc("r"), "doc_id").limit(50)
    return rows.select("doc_id", F.round("r", 6).alias("rate"), F.round(1 + F.least("r", F.lit(1.0)), 6).alias("weight"))


@query("duration_window", "SELECT source, count(*) AS clips, count(*) FILTER (n_chars < 200) AS short, count(*) FILTER (n_chars > 5000) AS long, count(*) FILTER (n_chars BETWEEN 200 AND 5000) AS kept FROM documents GROUP BY source")
def duration_window(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("clips"), F.count_if(n < 200).alias("short"), F.count_if(n > 5000).alias("long"), F.count_if(n.between(200, 5000)).alias("kept"))


@query("train_only", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(l.toxic = 1, false)")
def train_only(spark, sf_dir):
    """Rows that are not marked for evaluation alone; an absent mark counts as false."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.filter(~F.coalesce(F.col("toxic") == 1, F.lit(False))).select("doc_id")


@query("two_model_tiers", """SELECT tier, count(*) AS clips FROM (SELECT CASE WHEN p.o_totalprice IS NULL OR q.c_acctbal IS NULL THEN 'missing' WHEN p.o_totalprice > 300000 AND q.c_acctbal > 5000 THEN 'high' WHEN p.o_totalprice > 300000 OR q.c_acctbal > 5000 THEN 'medium' ELSE 'low' END AS tier
 FROM customer m LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) p ON p.o_custkey = m.c_custkey LEFT JOIN (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0) q ON q.c_custkey = m.c_custkey) GROUP BY tier""")
def two_model_tiers(spark, sf_dir):
    """A manifest joined to two prediction sets, either of which may lack a row, then an ordered classification."""
    people = table(spark, sf_dir, "customer")
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("a"))
    b = people.filter("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").alias("b"))
    both = people.select("c_custkey").join(a, "c_custkey", "left").join(b, "c_custkey", "left")
    x, y = F.col("a") > 300000, F.col("b") > 5000
    return both.select(gates.ladder(F.col("a"), [("missing", F.col("a").isNull() | F.col("b").isNull()), ("high", x & y), ("medium", x | y)], "low").alias("tier")).groupBy("tier").agg(F.count("*").alias("clips"))


@query("alias_resolution", "SELECT doc_id, coalesce(nullif(trim(source), ''), nullif(trim(lang), '')) AS resolved, 8.0 AS duration FROM documents".replace("8.0 AS", "CAST(8.0 AS DOUBLE) AS"))
def alias_resolution(spark, sf_dir):
    """Logical columns from ordered aliases; those a table lacks are passed over, and a duration falls back to 8."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", resolve(docs.columns, ["dataset", "source", "corpus", "lang"]).alias("resolved"), F.coalesce(resolve(docs.columns, ["duration", "duration_s", "dur"]).cast("double"), F.lit(8.0)).alias("duration"))


@query("page_sources", "SELECT regexp_replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '\\.[A-Za-z0-9]+$', '') AS name, count(*) AS pages FROM pages GROUP BY 1")
def page_sources(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(source_name("url").alias("name")).agg(F.count("*").alias("pages"))


@query("unique_ids", """SELECT page_id, CASE WHEN r > 1 THEN base || '_' || r ELSE base END AS clip FROM (SELECT page_id, base, row_number() OVER (PARTITION BY base ORDER BY page_id) AS r FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS base FROM pages))""")
def unique_ids(spark, sf_dir):
    """Sanitised names with _2, _3 ... in order of arrival where they collide."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_extract("url", "^https?://([^/]+)", 1), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    rows = table(spark, sf_dir, "pages").select("page_id", base.alias("base")).withColumn("r", F.row_number().over(Window.partitionBy("base").orderBy("page_id")))
    return rows.select("page_id", F.when(F.col("r") > 1, F.concat_ws("_", "base", F.col("r").cast("string"))).otherwise(F.col("base")).alias("clip"))


@query("extraction_gate", "SELECT source, reason, count(*) AS clips FROM (SELECT source, CASE WHEN d.doc_id IN (SELECT page_id FROM pages) THEN 'test_leak' WHEN trim(coalesce(text, '')) = '' THEN 'empty_text' WHEN l.quality = 0 THEN 'bad_quality' WHEN n_chars NOT BETWEEN 100 AND 6000 THEN 'duration' ELSE 'kept' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY ALL")
def extraction_gate(spark, sf_dir):
    """The order of checks: leak, empty text, score (an absent one passes), duration."""
    held = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")).distinct().withColumn("leak", F.lit(True))
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").join(held, "doc_id", "left")
    r = gates.reason([("test_leak", F.col("leak")), ("empty_text", F.trim(F.coalesce("text", F.lit(""))) == ""), ("bad_quality", F.col("quality") == 0), ("duration", ~F.col("n_chars").between(100, 6000))])
    return rows.groupBy("source", F.coalesce(r, F.lit("kept")).alias("reason")).agg(F.count("*").alias("clips"))


@query("resume_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_ids(spark, sf_dir):
    """What an earlier run has not done yet."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
