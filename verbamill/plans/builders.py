"""Queries that build evaluation sets, manifests and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbamill.functions import phonetics
from verbamill.functions.text import words
from verbamill.operators import builders, evaluation, gates, joins, lexicon, spans
from verbamill.plans import strategies
from verbamill.plans.evaluation import CLIPS, clips
from verbamill.plans.registry import query
from verbamill.session import scratch, ship, table
from verbamill.streaming import events as streams

SOURCES = """u AS (SELECT p_name AS id, p_name || ' of ' || p_type AS transcript, 0 AS k FROM part UNION ALL SELECT p_type, 'a ' || p_type || ' thing', 1 FROM part
 UNION ALL SELECT lower(p_name), p_brand || ' ' || p_name, 2 FROM part UNION ALL SELECT c_mktsegment, 'for ' || c_mktsegment, 3 FROM customer),
e AS (SELECT id, transcript, k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, transcript) AS r FROM u) WHERE r = 1),
g AS (SELECT 'eval_' || lpad(CAST(row_number() OVER (ORDER BY k, id) - 1 AS VARCHAR), 4, '0') AS eval_id, id, transcript,
  CASE WHEN instr(transcript, 'red') > 0 THEN substr(transcript, 1, instr(transcript, 'red') - 1) || 'crimson' || substr(transcript, instr(transcript, 'red') + 3) ELSE transcript END AS gold FROM e)"""


def eval_set(spark, sf_dir):
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    parts = [
        part.select(F.col("p_name").alias("id"), F.concat("p_name", F.lit(" of "), "p_type").alias("transcript")), part.select(F.col("p_type").alias("id"), F.concat(F.lit("a "), "p_type", F.lit(" thing")).alias("transcript")),
        part.select(F.lower("p_name").alias("id"), F.concat("p_brand", F.lit(" "), "p_name").alias("transcript")), customer.select(F.col("c_mktsegment").alias("id"), F.concat(F.lit("for "), "c_mktsegment").alias("transcript")),
    ]
    ranked = [df.withColumn("k", F.lit(k)) for k, df in enumerate(parts)]
    rows = builders.numbered(lexicon.first_wins(ranked, "id"), ["k"], ["id"])
    edits = F.array(F.struct(F.lit("red").alias("old"), F.lit("crimson").alias("new")))
    gold = spans.apply_edits(F.col("transcript"), edits)
    return rows.select(F.concat(F.lit("eval_"), F.lpad(F.col("nth").cast("string"), 4, "0")).alias("eval_id"), "id", "transcript", gold.alias("gold"))


@query("eval_union", f"WITH {SOURCES} SELECT eval_id, id, transcript, gold FROM g")
def eval_union(spark, sf_dir):
    """Four sources as one set: one row for each id, the earliest source's, renumbered in order of arrival."""
    return eval_set(spark, sf_dir)


@query("eval_union_counts", f"""WITH {SOURCES} SELECT count(*) AS cases, count(*) FILTER (gold <> transcript) AS with_errors, count(*) FILTER (gold = transcript) AS clean, count(*) FILTER (contains(id, ' ')) AS many_words,
 count(*) FILTER (NOT contains(id, ' ')) AS one_word, count(*) FILTER (length(transcript) > 20) AS long FROM g""")
def eval_union_counts(spark, sf_dir):
    changed, spaced = F.col("gold") != F.col("transcript"), F.contains("id", F.lit(" "))
    return eval_set(spark, sf_dir).agg(F.count("*").alias("cases"), F.count_if(changed).alias("with_errors"), F.count_if(~changed).alias("clean"), F.count_if(spaced).alias("many_words"), F.count_if(~spaced).alias("one_word"), F.count_if(F.length("transcript") > 20).alias("long"))


@query("case_categories", """WITH c AS (SELECT conv_id, turn, substr(text, 1, 100 + turn * 40) AS t, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: contains(w, 'ouw')) AS f FROM conversations),
 x AS (SELECT CASE WHEN length(t) > 150 THEN 'long_form' WHEN len(f) = 0 THEN 'clean' WHEN len(list_filter(f, lambda w: lower(w) <> lower(replace(w, 'q', 'k')))) = 0 THEN 'already_correct' WHEN len(f) >= 2 THEN 'multi_drug' ELSE 'drug_normalization' END AS category FROM c)
 SELECT category, count(*) AS cases FROM x GROUP BY 1""")
def case_categories(spark, sf_dir):
    """Turns as cases of the older format, by the first description that holds."""
    flags = F.transform(F.filter(words("text"), lambda w: F.contains(w, F.lit("ouw"))), lambda w: F.struct(w.alias("word"), F.replace(w, F.lit("q"), F.lit("k")).alias("top_candidate")))
    rows = table(spark, sf_dir, "conversations").select(F.substr("text", F.lit(1), 100 + F.col("turn") * 40).alias("t"), flags.alias("f"))
    return rows.groupBy(builders.case_category(F.col("t"), F.col("f")).alias("category")).agg(F.count("*").alias("cases"))


@query("topped_up_categories", "SELECT p_type, p_partkey, p_size <= 45 AS fallback FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size <= 45, p_partkey) AS r FROM part) WHERE r <= 20")
def topped_up_categories(spark, sf_dir):
    """Twenty of each category, large ones first; where they are too few, others."""
    part = table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_size")
    return builders.topped_up(part.filter("p_size > 45"), part.filter("p_size <= 45"), "p_type", 20, ["p_partkey"]).drop("p_size")


@query("aliased_truth", "WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'o' END || c_custkey || '.wav' AS file FROM customer), t AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'b' ELSE 'o' END || c_custkey || '.wav' AS name, c_name AS truth FROM customer WHERE c_acctbal > 0) SELECT file, coalesce(a.truth, b.truth) AS truth FROM f LEFT JOIN t a ON a.name = file LEFT JOIN t b ON b.name = replace(file, 'b', 'o') WHERE coalesce(a.truth, b.truth) IS NOT NULL")
def aliased_truth(spark, sf_dir):
    """Ground truth by file name, then by the name that the file had before; files that neither knows go."""
    customer = table(spark, sf_dir, "customer")
    name = lambda n: F.concat(F.when(F.col("c_custkey") % n == 0, "b").otherwise("o"), F.col("c_custkey").cast("string"), F.lit(".wav"))
    truth = customer.filter("c_acctbal > 0").select(name(5).alias("file"), F.col("c_name").alias("truth"))
    files = customer.select(name(2).alias("file")).join(truth, "file", "left").withColumn("older", F.replace("file", F.lit("b"), F.lit("o")))
    found = files.join(truth.select(F.col("file").alias("older"), F.col("truth").alias("other")), "older", "left")
    return found.select("file", F.coalesce("truth", "other").alias("truth")).filter("truth IS NOT NULL")


@query("indexed_sample", "SELECT i AS row_index, 'row_' || i AS id, conv_id, turn FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, conv_id, turn FROM conversations) ORDER BY md5('seed' || i), i LIMIT 50")
def indexed_sample(spark, sf_dir):
    """Fifty rows in shuffled order (a sampling operator), each with its index in the whole."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("conv_id") / 64).alias("b"))
    rows = builders.numbered(rows, ["b"], ["conv_id", "turn"], "row_index")
    drawn = rows.orderBy(F.md5(F.concat(F.lit("seed"), F.col("row_index").cast("string"))), "row_index").limit(50)
    return drawn.select("row_index", F.concat(F.lit("row_"), F.col("row_index").cast("string")).alias("id"), "conv_id", "turn")


@query("manifest_projection", "SELECT 'doc_' || doc_id AS id, lang AS language, 'documents/' || doc_id || '.wav' AS audio_path, n_chars / 15.0 AS duration_s, md5(coalesce(text, '')) AS transcript, md5(lower(coalesce(text, ''))) AS transcript_normalized FROM documents")
def manifest_projection(spark, sf_dir):
    """Rows of another corpus as a manifest; the raw and the normalised transcript (here their digests) are both kept."""
    text = F.coalesce("text", F.lit(""))
    name = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), name).alias("id"), F.col("lang").alias("language"), F.concat(F.lit("documents/"), name, F.lit(".wav")).alias("audio_path"),
        (F.col("n_chars") / 15.0).alias("duration_s"), F.md5(text).alias("transcript"), F.md5(F.lower(text)).alias("transcript_normalized"),
    )


@query("first_audio", "WITH x AS (SELECT c_custkey, unnest([{'e': 'mp3', 'r': 1, 'ok': c_custkey % 3 = 0}, {'e': 'wav', 'r': 2, 'ok': c_custkey % 2 = 0}, {'e': 'ogg', 'r': 5, 'ok': c_custkey % 7 = 0}]) AS s, c_name FROM customer) SELECT CAST(c_custkey AS VARCHAR) AS id, min(c_name) AS text, 'audio/' || c_custkey || '.' || arg_min(s.e, s.r) AS path FROM x WHERE s.ok GROUP BY c_custkey")
def first_audio(spark, sf_dir):
    """Lines of a transcript file with the first of their audio files, by the order of formats."""
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    lines = customer.select(F.concat(key, F.lit("  "), "c_name").alias("line"))
    kinds = F.array_compact(F.array(*[F.when(F.col("c_custkey") % n == 0, F.lit(e)) for e, n in (("ogg", 7), ("wav", 2), ("mp3", 3), ("txt", 1))]))
    listing = customer.select(F.explode(F.transform(kinds, lambda e: F.concat(F.lit("audio/"), key, F.lit("."), e))).alias("path"))
    return builders.first_audio(lines, "line", listing, "path")


@query("batch_folders", "WITH m AS (SELECT s_nationkey AS batch, min(s_name) AS manifest FROM supplier GROUP BY 1) SELECT c_custkey, batch, manifest FROM customer JOIN m ON batch = c_nationkey WHERE c_name <> '' AND c_custkey IN (SELECT o_custkey FROM orders)")
def batch_folders(spark, sf_dir):
    """One manifest for each batch, the first by name; its rows need a name, a transcript and an existing file."""
    manifest = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("batch")).agg(F.min("s_name").alias("manifest"))
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    rows = table(spark, sf_dir, "customer").filter("c_name <> ''").select("c_custkey", F.col("c_nationkey").alias("batch"))
    return rows.join(manifest, "batch").join(files, "c_custkey", "left_semi").select("c_custkey", "batch", "manifest")


@query("correction_grades", "WITH x AS (SELECT p_partkey, list_filter(string_split(CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name END, ' '), lambda w: w <> '') AS e, lower(p_type || ' ' || replace(p_name, 'red', 'pink') || ' ' || p_brand) AS s FROM part), y AS (SELECT *, len(list_filter(e, lambda t: contains(s, lower(t)))) AS found FROM x) SELECT p_partkey, found, len(e) - found AS missed, CASE WHEN len(e) > 0 THEN CAST(found AS DOUBLE) / len(e) ELSE 1.0 END AS recall FROM y")
def correction_grades(spark, sf_dir):
    """Expected terms looked for in the corrected text and in the corrections."""
    expected = F.when(F.col("p_size") % 9 == 0, F.array().cast("array<string>")).otherwise(words("p_name"))
    made = F.array(F.replace("p_name", F.lit("red"), F.lit("pink")), F.col("p_brand"))
    graded = table(spark, sf_dir, "part").select("p_partkey", builders.graded(expected, F.col("p_type"), made).alias("g"))
    return graded.select("p_partkey", F.size("g.found").cast("long").alias("found"), F.size("g.missed").cast("long").alias("missed"), "g.recall")


@query("sampled_wer", f"WITH {CLIPS}, s AS (SELECT * FROM rated ORDER BY md5('held' || clip_id), clip_id LIMIT 300) SELECT count(*) FILTER (duration % 7 <> 0) AS clips, count(*) FILTER (duration % 7 = 0) AS skipped, CAST(sum(edits) FILTER (duration % 7 <> 0) AS DOUBLE) / sum(ref_words) FILTER (duration % 7 <> 0) AS wer FROM s")
def sampled_wer(spark, sf_dir):
    """Corpus error rate of 300 sampled clips (a sampling operator); those without a reference are counted as skipped."""
    rows = clips(spark, sf_dir).withColumn("ref", F.when(F.col("duration") % 7 == 0, "").otherwise(F.col("ref")))
    drawn = rows.orderBy(F.md5(F.concat(F.lit("held"), F.col("clip_id").cast("string"))), "clip_id").limit(300)
    scored = evaluation.clip_scores(drawn, "ref", "hyp")
    there = F.col("ref_words") > 0
    return scored.agg(F.count_if(there).alias("clips"), F.count_if(~there).alias("skipped"), (F.sum(F.when(there, F.col("edits"))) / F.sum(F.when(there, F.col("ref_words")))).alias("wer"))


@query("model_comparison", f"WITH {CLIPS}, a AS (SELECT category, sum(edits) * 1.0 / sum(ref_words) AS wer FROM rated GROUP BY 1) SELECT category, wer AS wer_one, 1.0 / 1.0 * (SELECT sum(ref_words - 1) * 1.0 / sum(ref_words) FROM rated r WHERE r.category = a.category) AS wer_two, CASE WHEN wer <= (SELECT sum(ref_words - 1) * 1.0 / sum(ref_words) FROM rated r WHERE r.category = a.category) THEN 'one' ELSE 'two' END AS better FROM a")
def model_comparison(spark, sf_dir):
    """Two models over the same clips by the same scorer: the neighbour's text, and the first word alone."""
    rows = clips(spark, sf_dir)
    two = rows.withColumn("hyp", F.get(F.split("ref", " "), 0))
    both = rows.withColumn("model", F.lit("one")).unionByName(two.withColumn("model", F.lit("two")))
    rates = evaluation.corpus_rate(evaluation.clip_scores(both, "ref", "hyp"), ["category", "model"])
    wide = rates.groupBy("category").pivot("model", ["one", "two"]).agg(F.first("wer"))
    return wide.select("category", F.col("one").alias("wer_one"), F.col("two").alias("wer_two"), F.when(F.col("one") <= F.col("two"), "one").otherwise("two").alias("better"))


EDGES = """e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
 UNION ALL SELECT 'c' || c_custkey, 'r' || (c_custkey % 5) FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


@query("category_walk", f"WITH RECURSIVE {EDGES}, w AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT child, depth + 1 FROM w JOIN e ON parent = node WHERE depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node")
def category_walk(spark, sf_dir):
    """A region's nations, customers and orders, three steps deep; customers lead back to regions."""
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    pairs = [
        nation.select(name("r", F.col("n_regionkey")).alias("parent"), name("n", F.col("n_nationkey")).alias("child")), customer.select(name("n", F.col("c_nationkey")).alias("parent"), name("c", F.col("c_custkey")).alias("child")),
        customer.select(name("c", F.col("c_custkey")).alias("parent"), name("r", F.col("c_custkey") % 5).alias("child")), orders.select(name("c", F.col("o_custkey")).alias("parent"), name("o", F.col("o_orderkey")).alias("child")),
    ]
    edges = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).unionByName(pairs[3])
    return builders.reachable(edges, spark.createDataFrame([("r1",)], "node string"), 3)


@query("alias_groups", "WITH g AS (SELECT p_name, min(p_type) AS label, list_distinct(list_concat(list(p_brand), list(p_type))) AS a FROM part GROUP BY 1) SELECT p_name, label, array_to_string(list_sort(list_filter(a, lambda x: x <> label)), '|') AS aliases FROM g")
def alias_groups(spark, sf_dir):
    """Labels with all their other names."""
    rows = table(spark, sf_dir, "part").select("p_name", F.col("p_type").alias("label"), F.explode(F.array("p_brand", "p_type")).alias("alias"))
    return builders.alias_groups(rows, "p_name", "label", "alias").select("p_name", "label", F.array_join("aliases", "|").alias("aliases"))


@query("paged_items", "SELECT c_custkey, c_name, CAST(c_custkey // 50 AS INTEGER) AS page FROM customer")
def paged_items(spark, sf_dir):
    """Items that came as pages of fifty, with one of each page on the next one as well, each taken once."""
    path = scratch(spark, "pages")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.floor(F.col("c_custkey") / 50).cast("int").alias("page"))
    again = customer.filter("c_custkey % 50 = 49").withColumn("page", F.col("page") + 1)
    customer.unionByName(again).groupBy("page").agg(F.collect_list(F.struct("c_custkey", "c_name")).alias("items")).write.json(path)
    return builders.pages_of(spark, path, "c_custkey: bigint, c_name: string")


@query("file_inventory", "WITH r AS (SELECT lang || '/' || source AS folder, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents), c AS (SELECT folder, count(*) AS files FROM r GROUP BY 1 HAVING count(*) >= 5), m AS (SELECT folder, count(n_chars) AS measured, avg(n_chars) AS mean FROM r WHERE r <= 200 GROUP BY 1) SELECT folder, files, measured, round(mean * files, 3) AS total FROM c JOIN m USING (folder)")
def file_inventory(spark, sf_dir):
    """Folders with their files, and their total size estimated from the first 200 of each (an estimator)."""
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("folder"), "n_chars", "doc_id")
    return builders.inventory(files, "folder", "n_chars", "doc_id").withColumn("total", F.round("total", 3))


@query("mixed_passages", """WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '[\\s\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{3000}]+', ' ', 'g')) AS x FROM documents),
 n AS (SELECT doc_id, x, len(list_filter(string_split(x, ' '), lambda w: w <> '')) AS n FROM l),
 s AS (SELECT doc_id, unnest(list_transform(string_split_regex(x, '[.،؛؟!]\\s+'), lambda y: trim(y))) AS x FROM n WHERE n >= 220),
 p AS (SELECT doc_id, x FROM n WHERE n BETWEEN 1 AND 219 UNION ALL SELECT doc_id, x FROM s WHERE len(list_filter(string_split(x, ' '), lambda w: w <> '')) BETWEEN 5 AND 219)
 SELECT doc_id, count(*) AS passages, CAST(sum(length(x)) AS BIGINT) AS chars FROM p GROUP BY doc_id""")
def mixed_passages(spark, sf_dir):
    """Lines of documents: short ones as they stand, long ones by sentences."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    rows = rows.select("doc_id", F.explode(builders.passages("line")).alias("x"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("passages"), F.sum(F.length("x")).cast("long").alias("chars"))


@query("span_boundaries", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN FALSE WHEN 1 THEN TRUE WHEN 2 THEN length(string_split(p_name, ' ')[2]) < 4 WHEN 3 THEN TRUE ELSE TRUE END AS rejected FROM part")
def span_boundaries(spark, sf_dir):
    """Spans that cannot be names: with glue at an end, too short, over the end of a sentence, or an abbreviation."""
    second = F.get(F.split("p_name", " "), 1)
    kind = F.col("p_size") % 5
    said = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.concat(F.lit("the "), "p_name")).when(kind == 2, second).when(kind == 3, F.concat("p_name", F.lit(". Next"))).otherwise("bp")
    return table(spark, sf_dir, "part").select("p_partkey", phonetics.bad_span(said, F.lit(0)).alias("rejected"))


@query("correction_kinds", "SELECT CASE WHEN p_size % 3 < 2 THEN CASE WHEN p_size % 3 = 0 THEN 'arabic_transliteration' ELSE 'arabic_spelling' END ELSE 'english_misspelling' END AS kind, count(*) AS n FROM part GROUP BY 1")
def correction_kinds(spark, sf_dir):
    """Users' corrections by the scripts of either side."""
    kind = F.col("p_size") % 3
    old, new = F.when(kind < 2, "مرد").otherwise(F.col("p_name")), F.when(kind == 1, "مريض").otherwise(F.upper("p_name"))
    return table(spark, sf_dir, "part").groupBy(builders.correction_kind(old, new).alias("kind")).agg(F.count("*").alias("n"))


@query("capped_gate", "SELECT doc_id, lang FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 500) WHERE n_chars >= 100 ORDER BY doc_id LIMIT 120")
def capped_gate(spark, sf_dir):
    """A source that is read no further than 500 rows, of which the first 120 that pass are kept (caps of a stream)."""
    return gates.capped(table(spark, sf_dir, "documents"), ["doc_id"], F.col("n_chars") >= 100, 500, 120).select("doc_id", "lang")


@query("read_until", "SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 400)) WHERE b < 100000")
def read_until(spark, sf_dir):
    """A stream read until 400 rows or 100,000 characters have come (early termination is the feature)."""
    return gates.until(table(spark, sf_dir, "documents"), ["doc_id"], "n_chars", 400, 100_000).select("doc_id")


@query("flags_aligned", "SELECT f.conv_id, f.turn AS word_index, a.role AS aligned, length(f.text) % 7 AS flag FROM conversations f LEFT JOIN conversations a ON a.conv_id = f.conv_id AND a.turn = f.turn AND a.role = 'user'")
def flags_aligned(spark, sf_dir):
    """Flags with the alignment of the same index, where there is one."""
    talk = table(spark, sf_dir, "conversations")
    aligned = talk.filter("role = 'user'").select("conv_id", "turn", F.col("role").alias("aligned"))
    return talk.join(aligned, ["conv_id", "turn"], "left").select("conv_id", F.col("turn").alias("word_index"), "aligned", (F.length("text") % 7).cast("long").alias("flag"))


@query("flags_uncovered", "SELECT conv_id, turn FROM conversations f WHERE NOT EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = f.conv_id AND length(s.text) > 300 AND f.turn >= s.turn AND f.turn < s.turn + 2)")
def flags_uncovered(spark, sf_dir):
    """Turns that lie in no span of two that a long turn begins."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    covering = talk.filter("n > 300").select("conv_id", F.col("turn").alias("start"), (F.col("turn") + 2).alias("end"))
    return spans.uncovered(talk.select("conv_id", "turn"), covering, ["conv_id"], "turn", "start", "end")


@query("phrases_matched", "SELECT p_partkey, 1 AS at, 2 AS width, p_name AS phrase, 100.0::DOUBLE AS score FROM part")
def phrases_matched(spark, sf_dir):
    """Names of two words found in longer texts, exactly or by their skeletons; exact ones win."""
    ship(spark)
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.split(F.concat_ws(" ", "p_type", "p_name", "p_brand"), " ").alias("w"))
    found = spans.phrase_matches(rows, "p_partkey", "w", part.select("p_name").distinct(), "p_name")
    return found.filter("score = 100 AND width = 2 AND at = 1")


@query("traces_closed", "WITH t AS (SELECT conv_id, count(*) AS n, min(turn) AS a, max(turn) AS b, min(turn) FILTER (role = 'assistant') AS e FROM conversations GROUP BY 1) SELECT t.conv_id, count(c.turn) AS events, e IS NOT NULL AS closed, CAST((coalesce(e, b) - a) * 60 AS DOUBLE) AS seconds FROM t LEFT JOIN conversations c ON c.conv_id = t.conv_id AND c.role <> 'assistant' AND c.turn <= coalesce(e, b) GROUP BY t.conv_id, e, a, b")
def traces_closed(spark, sf_dir):
    """Traces up to their sentinel, and how long they took; a turn takes a minute here."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "role", F.timestamp_seconds(F.col("turn") * 60).alias("ts"))
    return streams.closed_traces(talk, "conv_id", "ts", "role", "assistant")


@query("correctors_compared", "SELECT name, p_partkey AS id, CASE name WHEN 'clean' THEN lower(p_name) WHEN 'aliases' THEN p_name ELSE p_name END AS corrected FROM (SELECT DISTINCT min(p_partkey) OVER (PARTITION BY p_name) AS p_partkey, p_name FROM part), (SELECT unnest(['clean', 'spelling', 'aliases']) AS name)")
def correctors_compared(spark, sf_dir):
    """Three correctors of one result over texts that are right: none may change them but in case."""
    ship(spark)
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("id"))
    terms = rows.select(F.explode(F.split("text", " ")).alias("term")).distinct()
    found = None
    for name in ("clean", "spelling", "aliases"):
        one = strategies.corrected(name, rows, terms).select(F.lit(name).alias("name"), "id", "corrected")
        found = one if found is None else found.unionByName(one)
    return found


@query("token_sets_overlap", "SELECT a.conv_id, a.turn, len(list_intersect(list_distinct(string_split(a.text, ' ')), list_distinct(string_split(b.text, ' ')))) >= 3 AS alike FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def token_sets_overlap(spark, sf_dir):
    """Turns that share at least three words with the next."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    after = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return talk.join(after, ["conv_id", "turn"]).select("conv_id", "turn", joins.sets_overlap(F.col("w"), F.col("v"), 3).alias("alike"))


@query("head_manifest", "SELECT doc_id, 'audio/' || source || '/' || doc_id || '.wav' AS audio_path FROM documents ORDER BY doc_id LIMIT 25")
def head_manifest(spark, sf_dir):
    """The first rows of a manifest with their paths resolved (a preview is the feature)."""
    rows = table(spark, sf_dir, "documents").orderBy("doc_id").limit(25)
    return rows.select("doc_id", F.concat(F.lit("audio/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("audio_path"))


@query("correction_pairs", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'context: ' || p_type || chr(10) ELSE '' END || 'correct: ' || replace(p_name, 'e', '') AS input, p_name AS output FROM part WHERE replace(p_name, 'e', '') <> p_name")
def correction_pairs(spark, sf_dir):
    """Corrections as pairs to train on, with a context where there is one; pairs that change nothing go."""
    wrong = F.replace("p_name", F.lit("e"), F.lit(""))
    context = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("context: "), "p_type", F.lit("\n"))).otherwise("")
    return table(spark, sf_dir, "part").filter(wrong != F.col("p_name")).select("p_partkey", F.concat(context, F.lit("correct: "), wrong).alias("input"), F.col("p_name").alias("output"))


@query("guarded_training_rows", "SELECT doc_id, lang FROM documents")
def guarded_training_rows(spark, sf_dir):
    """Training rows through the guards that stop a run: no held-out signature, no blocked source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    held = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("s"))
    apart = joins.asserted_apart(docs, F.concat(F.lit("documents/"), F.col("doc_id").cast("string")), held, F.col("s"))
    return joins.refused(apart, "source", ["blocked"]).select("doc_id", "lang")
