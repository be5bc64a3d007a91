"""Queries over ordered rows: islands, spans, segments, corrections; scans, sinks and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verbamill.functions import python_text, waves
from verbamill.functions.text import chars_per_second, pretty_seconds, words
from verbamill.operators import spans
from verbamill.plans.registry import query
from verbamill.session import scratch, ship, table
from verbamill.sources import manifests, sinks
from verbamill.streaming import events as streams

GAP = "30 minutes"


@query("session_islands", f"SELECT user_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS events, round(min(value), 6) AS least FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL {GAP} THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, island")
def session_islands(spark, sf_dir):
    """Runs of a user's events with gaps of at most 30 minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    far = F.col("ts") > F.lag("ts").over(w) + F.expr(f"INTERVAL {GAP}")
    found = spans.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], far)
    return found.groupBy("user_id", "island").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("events"), F.round(F.min("value"), 6).alias("least")).drop("island")


SPANS = "s AS (SELECT event_id, user_id, event_type, date_diff('second', TIMESTAMP '2024-01-01', ts) AS a, date_diff('second', TIMESTAMP '2024-01-01', ts) + CAST(floor(value * 60) AS BIGINT) AS b, value FROM events)"


def event_spans(spark, sf_dir):
    ts = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '2024-01-01'"), "ts")
    rows = table(spark, sf_dir, "events").withColumn("a", F.floor(ts))
    return rows.select("event_id", "user_id", "event_type", F.col("a").cast("long").alias("a"), (F.col("a") + F.floor(F.col("value") * 60)).cast("long").alias("b"), "value")


@query("overlaps_merged", f"WITH {SPANS.replace(chr(39) + 'second' + chr(39) + ', TIMESTAMP', chr(39) + 'second' + chr(39) + ', TIMESTAMP')}, m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, event_id) AS island FROM m) SELECT user_id, min(a) AS start, max(b) AS \"end\", count(*) AS n FROM i GROUP BY user_id, island")
def overlaps_merged(spark, sf_dir):
    return spans.merged_overlaps(event_spans(spark, sf_dir), ["user_id"], "a", "b", "event_id")


@query("segment_ends", "SELECT event_id, user_id, ts AS start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS \"end\" FROM events QUALIFY lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL")
def segment_ends(spark, sf_dir):
    """A segment ends where the user's next one starts; the last has no end and is dropped."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("start"), F.lead("ts").over(w).alias("end")).filter("end IS NOT NULL")


@query("stops_split", "WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), k AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM e WHERE event_type <> 'error') SELECT user_id, min(i) AS start, max(i) AS \"end\", count(*) AS n FROM k GROUP BY user_id, g")
def stops_split(spark, sf_dir):
    """Each user's events as positions, split where an error stands."""
    rows = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return spans.split_at(rows, ["user_id"], "i", F.col("event_type") == "error")


@query("preferred_rows", "SELECT user_id, hour, event_type, kinds FROM (SELECT user_id, date_trunc('hour', ts) AS hour, event_type, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS r, array_to_string(list_sort(list_distinct(list(event_type) OVER (PARTITION BY user_id, date_trunc('hour', ts)))), '+') AS kinds FROM events) WHERE r = 1")
def preferred_rows(spark, sf_dir):
    """One row of each slot, by preference of kind, with all kinds that the slot had."""
    rows = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    order = F.struct(F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2), F.col("event_id"))
    return rows.groupBy("user_id", "hour").agg(F.min_by("event_type", order).alias("event_type"), F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("kinds"))


@query("spans_selected")
def spans_selected(spark, sf_dir):
    """Each user's spans without overlap, best value first."""
    return spans.best_spans(event_spans(spark, sf_dir), ["user_id"], "a", "b", "value", 5.0)


@query("conversation_context", "SELECT conv_id, turn, role, lag(role) OVER w AS before, length(text) - coalesce(length(lag(text) OVER w), 0) AS growth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def conversation_context(spark, sf_dir):
    """Each turn with the one before it, joined on its index."""
    talk = table(spark, sf_dir, "conversations")
    before = talk.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"), F.length("text").alias("n"))
    return talk.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "before", (F.length("text") - F.coalesce("n", F.lit(0))).cast("long").alias("growth"))


@query("conversation_flattened", "SELECT conv_id, CAST(list_position(l, x) - 1 AS INTEGER) AS turn_index, x['role'] AS speaker FROM (SELECT conv_id, list({'turn': turn, 'role': role} ORDER BY turn) AS l, unnest(list({'turn': turn, 'role': role} ORDER BY turn)) AS x FROM conversations GROUP BY conv_id)")
def conversation_flattened(spark, sf_dir):
    """Each turn with its place in its conversation, whatever gaps the turn numbers have."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")) - 1
    return table(spark, sf_dir, "conversations").select("conv_id", at.alias("turn_index"), F.col("role").alias("speaker"))


@query("turn_differences")
def turn_differences(spark, sf_dir):
    """Blocks of words in which a turn differs from the one before it."""
    ship(spark)
    talk = table(spark, sf_dir, "conversations")
    before = talk.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("old"))
    return talk.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.explode(python_text.diff_blocks(F.col("old"), F.col("text"))).alias("b")).select("conv_id", "turn", "b.*")


EDITED = "CASE WHEN instr({0}, '{1}') > 0 THEN substr({0}, 1, instr({0}, '{1}') - 1) || '{2}' || substr({0}, instr({0}, '{1}') + {3}) ELSE {0} END"


@query("edits_applied", f"SELECT p_partkey, {EDITED.format('t', 'ring', 'band', 4)} AS text FROM (SELECT p_partkey, {EDITED.format('s', 'red', 'crimson', 3)} AS t FROM (SELECT p_partkey, p_brand || ': ' || p_name || ', ' || p_name AS s FROM part))")
def edits_applied(spark, sf_dir):
    """Gold texts: each edit replaces its first place alone, one after another; every name stands twice."""
    edits = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in (("red", "crimson"), ("ring", "band"))])
    text = F.concat("p_brand", F.lit(": "), "p_name", F.lit(", "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", spans.apply_edits(text, edits).alias("text"))


@query("spans_overlap", "SELECT count(*) AS gold, count(*) FILTER (hit) AS found FROM (SELECT o.o_orderkey, bool_or(contains(l.l_linestatus || l.l_returnflag, o.o_orderstatus)) AS hit FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1)")
def spans_overlap(spark, sf_dir):
    """How many of the gold rows have any predicted row that contains them (existential)."""
    gold = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    said = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat("l_linestatus", "l_returnflag").alias("p")).distinct()
    hit = gold.join(said, "o_orderkey").groupBy("o_orderkey").agg(F.bool_or(F.contains("p", "o_orderstatus")).alias("hit"))
    return hit.agg(F.count("*").alias("gold"), F.count_if("hit").alias("found"))


@query("segments_of_files", "SELECT o_orderkey, n, seconds FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS seconds FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def segments_of_files(spark, sf_dir):
    """Segments grouped by their file and joined to the manifest; a file without any stays."""
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("seconds"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(by, "o_orderkey", "left")


@query("valid_intervals", "SELECT l_orderkey, l_linenumber, l_quantity AS start, coalesce(nullif(l_tax * 1000, 0), l_quantity + 5) AS \"end\" FROM lineitem WHERE coalesce(nullif(l_tax * 1000, 0), l_quantity + 5) > l_quantity")
def valid_intervals(spark, sf_dir):
    """An end that is absent is start plus length; intervals that do not run forward go."""
    end = F.coalesce(F.nullif(F.col("l_tax") * 1000, F.lit(0.0)), F.col("l_quantity") + 5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("start"), end.alias("end")).filter("end > start")


@query("peak_levels", "SELECT vec_id, round(20 * log10(greatest(list_max(list_transform(embedding, lambda x: abs(x))), 1e-9)), 4) AS dbfs FROM embeddings WHERE 20 * log10(greatest(list_max(list_transform(embedding, lambda x: abs(x))), 1e-9)) >= -9")
def peak_levels(spark, sf_dir):
    """Peak level of each waveform (here a vector) in decibels, and only the loud ones."""
    peak = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", (20 * F.log10(F.greatest(peak, F.lit(1e-9)))).alias("d")).filter("d >= -9").select("vec_id", F.round("d", 4).alias("dbfs"))


@query("silence_trimmed", "WITH f AS (SELECT vec_id, list_transform(range(0, 57, 8), lambda i: sqrt(list_sum(list_transform(embedding[i + 1:i + 8], lambda x: CAST(x AS DOUBLE) * x)) / 8)) AS rms FROM embeddings), g AS (SELECT vec_id, list_filter(range(0, 8), lambda i: rms[i + 1] >= 0.1) AS loud FROM f) SELECT vec_id, list_min(loud) * 8 AS first, (list_max(loud) + 1) * 8 AS last FROM g WHERE len(loud) > 0")
def silence_trimmed(spark, sf_dir):
    """The stretch from the first to the last frame whose RMS is not silence."""
    frame = lambda i: F.sqrt(F.aggregate(F.slice("embedding", i * 8 + 1, 8), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / 8)
    loud = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: frame(i) >= 0.1)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", loud.alias("loud")).filter(F.size("loud") > 0)
    return rows.select("vec_id", (F.array_min("loud") * 8).cast("long").alias("first"), ((F.array_max("loud") + 1) * 8).cast("long").alias("last"))


@query("augmented", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) * (0.5 + (vec_id % 10) / 10.0))), 5) AS loudness, CAST(ceil(64 / (0.9 + (vec_id % 3) / 10.0)) AS BIGINT) AS length FROM embeddings")
def augmented(spark, sf_dir):
    """Volume and speed changes whose strength comes from the id: total level, and length after the change of speed."""
    gain = 0.5 + (F.col("vec_id") % 10) / 10.0
    level = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")) * gain)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(level, 5).alias("loudness"), F.ceil(64 / (0.9 + (F.col("vec_id") % 3) / 10.0)).cast("long").alias("length"))


WAVES = """x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings WHERE len(embedding) > 0),
w AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms, list_transform(range(len(x)), lambda i: ((vec_id * 31 + i * 17) % 201 - 100) / 100.0) AS n FROM x),
y AS (SELECT vec_id, x, n, rms, sqrt(list_sum(list_transform(n, lambda v: v * v)) / len(n)) AS noise FROM w),
z AS (SELECT vec_id, list_transform(range(1, len(x) + 1), lambda i: x[i] + n[i] * rms / noise / pow(10, (5 + vec_id % 20) / 20.0)) AS noisy,
  list_transform(range(1, len(x) + 1), lambda i: x[i] + CASE WHEN i > 5 THEN 0.5 * x[i - 5] ELSE 0 END + CASE WHEN i > 10 THEN 0.25 * x[i - 10] ELSE 0 END) AS echoed,
  list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i - 1 >= vec_id % 16 AND i - 1 < vec_id % 16 + 8 THEN 0 ELSE x[i] END) AS masked FROM y)"""


@query("waves_disturbed", f"WITH {WAVES} SELECT vec_id, round(list_sum(list_transform(noisy, lambda v: v * v)), 4) AS noisy, round(list_sum(list_transform(echoed, lambda v: v * v)), 4) AS echoed, round(list_sum(list_transform(masked, lambda v: v * v)), 4) AS masked FROM z")
def waves_disturbed(spark, sf_dir):
    """The energy of each waveform with noise at a level below it, with echoes, and with a stretch masked; what comes by
    chance elsewhere comes from the id here."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    noise = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda i: (F.pmod(F.col("vec_id") * 31 + i * 17, F.lit(201)) - 100) / 100.0)
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") > 0).select("vec_id", x.alias("x")).withColumn("n", noise)
    energy = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v), 4)
    return rows.select(
        "vec_id", energy(waves.with_noise(F.col("x"), F.col("n"), (5 + F.col("vec_id") % 20).cast("double"))).alias("noisy"), energy(waves.with_echoes(F.col("x"), 5, (0.5, 0.25))).alias("echoed"),
        energy(waves.masked(F.col("x"), F.col("vec_id") % 16, 8)).alias("masked"),
    )


@query("chunk_packing", "WITH t AS (SELECT conv_id, sum(len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> ''))) AS n FROM conversations GROUP BY conv_id) SELECT conv_id % 8 AS lane, CAST(sum(n) // 256 AS BIGINT) AS blocks, CAST(sum(n) % 256 AS BIGINT) AS dropped FROM t GROUP BY 1")
def chunk_packing(spark, sf_dir):
    """Tokens of a lane put end to end and cut into blocks of 256; what does not fill the last is dropped."""
    n = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 8).alias("lane")).agg(F.sum(F.size(words("text")).cast("long")).alias("n"))
    return n.select("lane", F.floor(F.col("n") / 256).cast("long").alias("blocks"), (F.col("n") % 256).alias("dropped"))


@query("budgeted_terms", "SELECT p_type, string_agg(p_name, ', ' ORDER BY p_retailprice DESC, p_partkey) AS hotwords FROM (SELECT *, sum(length(p_name) + 2) OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS used FROM part) WHERE used <= 700 GROUP BY p_type")
def budgeted_terms(spark, sf_dir):
    """Terms by priority, joined until a budget of characters is used up."""
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    kept = table(spark, sf_dir, "part").withColumn("used", F.sum(F.length("p_name") + 2).over(w)).filter("used <= 700")
    held = F.array_sort(F.collect_list(F.struct((-F.col("p_retailprice")).alias("p"), "p_partkey", "p_name")))
    return kept.groupBy("p_type").agg(F.array_join(F.transform(held, lambda x: x["p_name"]), ", ").alias("hotwords"))


@query("training_targets", "SELECT doc_id, CASE WHEN starts_with(text, 'language ') THEN text ELSE 'language ' || lang || '<asr_text>' || text END AS target, CAST(1.0 AS DOUBLE) AS weight FROM documents WHERE trim(coalesce(text, '')) <> '' AND lang IS NOT NULL")
def training_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter(F.trim(F.coalesce("text", F.lit(""))) != "").filter("lang IS NOT NULL")
    target = F.when(F.col("text").startswith("language "), F.col("text")).otherwise(F.concat(F.lit("language "), "lang", F.lit("<asr_text>"), "text"))
    return rows.select("doc_id", target.alias("target"), F.lit(1.0).alias("weight"))


@query("template_corpus", "WITH t AS (SELECT DISTINCT p_name AS term FROM part), s AS (SELECT term, k, replace(s, '{term}', term) AS line FROM t, (VALUES (0, 'the patient takes {term}'), (1, '{term} was given'), (2, 'no {term} today')) v(k, s)) SELECT line, count(*) AS n FROM (SELECT line, unnest(range(CASE WHEN k = 0 THEN 5 ELSE 3 END)) FROM s) GROUP BY line")
def template_corpus(spark, sf_dir):
    """Lines from templates for each term, repeated by weight."""
    lines = F.array(*[F.struct(F.lit(n).alias("n"), F.replace(F.lit(s), F.lit("{term}"), F.col("term")).alias("line")) for s, n in (("the patient takes {term}", 5), ("{term} was given", 3), ("no {term} today", 3))])
    made = table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct().select(F.explode(lines).alias("x"))
    return made.select("x.line", F.explode(F.sequence(F.lit(1), F.col("x.n"))).alias("k")).groupBy("line").agg(F.count("*").alias("n"))


@query("global_index", "SELECT row_number() OVER (ORDER BY k, id) - 1 AS n, k, id FROM (SELECT 0 AS k, item_id AS id FROM benchmark UNION ALL SELECT 1, page_id FROM pages)")
def global_index(spark, sf_dir):
    """A running index over two splits: each split's own ranks, from where the split before it ends."""
    a, b = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("k"), F.col("item_id").alias("id")), table(spark, sf_dir, "pages").select(F.lit(1).alias("k"), F.col("page_id").alias("id"))
    rows = a.unionAll(b).withColumn("_b", F.floor(F.col("id") / 4096))
    sizes = rows.groupBy("k", "_b").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.sum("c").over(Window.orderBy("k", "_b")) - F.col("c")).drop("c")
    return rows.join(before, ["k", "_b"]).select((F.col("before") + F.row_number().over(Window.partitionBy("k", "_b").orderBy("id")) - 1).cast("long").alias("n"), "k", "id")


@query("speaking_rates", "SELECT conv_id, turn, round(length(regexp_replace(text, '\\s+', '', 'g')) / ((turn + 1) * 10.0), 6) AS rate, printf('%dh %02dm %02ds', (turn + 1) * 610 // 3600, (turn + 1) * 610 % 3600 // 60, (turn + 1) * 610 % 60) AS length FROM conversations")
def speaking_rates(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    return talk.select("conv_id", "turn", F.round(chars_per_second("text", (F.col("turn") + 1) * 10.0), 6).alias("rate"), pretty_seconds((F.col("turn") + 1) * 610).alias("length"))


@query("jsonl_round_trip", "SELECT doc_id, lang, source, n_chars, length(text) AS chars FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Written as JSON Lines and scanned again with a declared schema."""
    path = scratch(spark, "jsonl")
    sinks.jsonl(table(spark, sf_dir, "documents"), path)
    return manifests.jsonl(spark, path, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("chars"))


@query("csv_round_trip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    sinks.csv(table(spark, sf_dir, "customer"), path, ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    return manifests.csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("malformed_lines", "SELECT count(*) FILTER (event_id % 100 <> 0) AS good, count(*) FILTER (event_id % 100 = 0) AS bad FROM events")
def malformed_lines(spark, sf_dir):
    """Every hundredth line is cut short before it is written; the scan counts the lines that do not parse."""
    path = scratch(spark, "lines")
    whole = F.to_json(F.struct("event_id", "event_type"))
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 100 == 0, F.left(whole, F.lit(9))).otherwise(whole).alias("value")).write.text(path)
    # the parsed column is read beside the bad one; alone that one would be all Spark parses
    rows = manifests.jsonl(spark, path, "event_id long, event_type string", "keep").select("event_id", "_bad")
    return rows.agg(F.count_if(F.col("event_id").isNotNull() & F.col("_bad").isNull()).alias("good"), F.count_if(F.col("_bad").isNotNull()).alias("bad"))


@query("split_files", "SELECT lang AS split, count(*) AS rows FROM documents GROUP BY lang")
def split_files(spark, sf_dir):
    """A folder for each split; the partition column comes back from the layout."""
    path = scratch(spark, "splits")
    sinks.splits(table(spark, sf_dir, "documents").withColumnRenamed("lang", "split"), path, "split", "doc_id")
    return spark.read.schema("doc_id long, split string").json(path).groupBy("split").agg(F.count("*").alias("rows"))


@query("event_stream", "SELECT user_id, count(*) AS events FROM events GROUP BY user_id")
def event_stream(spark, sf_dir):
    """The events as a stream of files, sunk once and counted."""
    source, folder = scratch(spark, "events"), scratch(spark, "stream")
    table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("string").alias("ts"), "event_type").write.json(source)
    stream = streams.trace(spark, source, "event_id long, user_id long, ts string, event_type string")
    streams.run_once(stream, f"{folder}/checkpoint", f"{folder}/out")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").groupBy("user_id").agg(F.count("*").alias("events"))


@query("stream_upsert", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def stream_upsert(spark, sf_dir):
    """A dimension that a stream of edits keeps up to date: the latest edit of each key wins."""
    source, folder = scratch(spark, "edits"), scratch(spark, "dimension")
    table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").write.json(source)
    return streams.upserted(streams.trace(spark, source, "user_id long, event_id long, event_type string"), folder, "user_id", "event_id")


TTL = """WITH RECURSIVE e AS (SELECT user_id, event_type, ts, min(event_id) AS event_id FROM events GROUP BY ALL),
nxt AS (SELECT user_id, event_type, ts, min(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 300000001 MICROSECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM e),
held AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY ALL UNION ALL SELECT h.user_id, h.event_type, n.later FROM held h JOIN nxt n ON n.user_id = h.user_id AND n.event_type = h.event_type AND n.ts = h.ts WHERE n.later IS NOT NULL)
SELECT e.event_id, user_id, event_type, ts FROM held JOIN e USING (user_id, event_type, ts)"""


@query("ttl_cache", TTL)
def ttl_cache(spark, sf_dir):
    """The first event of each user and kind within five minutes, over all events that a stream has brought."""
    source, folder = scratch(spark, "requests"), scratch(spark, "cache")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(source)  # milliseconds only by default
    stream = streams.trace(spark, source, "event_id long, user_id long, event_type string, ts timestamp")
    streams.run_once(stream, f"{folder}/checkpoint", f"{folder}/out")
    found = streams.first_within(spark.read.schema(stream.schema).parquet(f"{folder}/out"), ["user_id", "event_type"], "ts", "5 minutes")
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("session_stream", f"SELECT user_id, min(ts) AS start, max(ts) + INTERVAL {GAP} AS \"end\", count(*) AS events FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL {GAP} THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, island")
def session_stream(spark, sf_dir):
    """Sessions with a gap of 30 minutes: those that a stream has closed, and those open at its end."""
    source, folder = scratch(spark, "requests"), scratch(spark, "sessions")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(source)
    stream = streams.trace(spark, source, "user_id long, ts timestamp")
    found = streams.session_windows(stream, "user_id", "ts", GAP, "1 hour")
    streams.run_once(found, f"{folder}/checkpoint", f"{folder}/out")
    arrived = spark.read.schema(stream.schema).json(source)
    out = streams.all_sessions(arrived, spark.read.schema(found.schema).parquet(f"{folder}/out"), "user_id", "ts", GAP)
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


@query("failure_drilldown", "SELECT conv_id, turn, role FROM conversations WHERE length(text) > 400 AND role = 'assistant'")
def failure_drilldown(spark, sf_dir):
    """Reports with nested rows, unnested twice, and the rows that carry the flags; a report is one turn's."""
    raw = F.array(F.struct("turn", "role", (F.length("text") > 400).alias("long")))
    reports = table(spark, sf_dir, "conversations").select("conv_id", F.array(F.struct(F.lit("stage").alias("name"), raw.alias("raw"))).alias("stage_reports"))
    return reports.select("conv_id", F.explode("stage_reports").alias("s")).select("conv_id", F.explode("s.raw").alias("r")).filter("r.long AND r.role = 'assistant'").select("conv_id", "r.turn", "r.role")


@query("registry_selection", "SELECT p_partkey AS slug, p_type AS stage FROM part WHERE (p_size % 7 <> 0 AND p_type = 'SMALL') OR p_partkey IN (7, 14)")
def registry_selection(spark, sf_dir):
    """Catalogue entries of a stage that are not disabled, and those asked for by name, disabled or not."""
    part = table(spark, sf_dir, "part")
    wanted = ((F.col("p_size") % 7 != 0) & (F.col("p_type") == "SMALL")) | F.col("p_partkey").isin(7, 14)
    return part.filter(wanted).select(F.col("p_partkey").alias("slug"), F.col("p_type").alias("stage"))


@query("spelled_codes", "SELECT c_custkey, array_to_string(list_filter(list_transform(regexp_extract_all(lower(s), '\\b[a-z0-9](?:[\\s.\\-]+[a-z0-9]\\b){2,}'), lambda r: regexp_replace(r, '[\\s.\\-]+', '', 'g')), lambda r: length(regexp_replace(r, '[0-9]', '', 'g')) >= 2), ',') AS codes FROM (SELECT c_custkey, 'id ' || substr(c_mktsegment, 1, 1) || ' ' || substr(c_mktsegment, 2, 1) || '-' || (c_custkey % 10) || ' end' AS s FROM customer)")
def spelled_codes(spark, sf_dir):
    from verbamill.functions.text import spelled_codes as codes

    said = F.concat(F.lit("id "), F.substring("c_mktsegment", 1, 1), F.lit(" "), F.substring("c_mktsegment", 2, 1), F.lit("-"), (F.col("c_custkey") % 10).cast("string"), F.lit(" end"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(codes(said), ",").alias("codes"))


ENGLISH = """CASE WHEN p_size < 20 THEN ['one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'][p_size]
 ELSE ['twenty','thirty','forty','fifty'][p_size // 10 - 1] || CASE WHEN p_size % 10 = 0 THEN '' ELSE ' ' || ['one','two','three','four','five','six','seven','eight','nine'][p_size % 10] END END"""


@query("numbers_verbalised", f"SELECT p_partkey, 'take ' || {ENGLISH} || ' milligrams of ' || p_name AS text FROM part")
def numbers_verbalised(spark, sf_dir):
    """Sizes with their unit as words."""
    ship(spark)
    said = F.concat(F.lit("take "), F.col("p_size").cast("string"), F.lit("mg of "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", python_text.verbalised(said, {"mg": "milligrams", "ml": "milliliters"}).alias("text"))


ONES = "['صفر','واحد','اثنان','ثلاثه','اربعه','خمسه','سته','سبعه','ثمانيه','تسعه','عشره','احد عشر','اثنا عشر','ثلاثه عشر','اربعه عشر','خمسه عشر','سته عشر','سبعه عشر','ثمانيه عشر','تسعه عشر']"
TENS = "['عشرون','ثلاثون','اربعون','خمسون']"


@query("arabic_numbers", f"""WITH s AS (SELECT p_partkey, p_size AS n, CASE WHEN p_size < 20 THEN {ONES}[p_size + 1] WHEN p_size % 10 = 0 THEN {TENS}[p_size // 10 - 1] ELSE {ONES}[p_size % 10 + 1] || ' و ' || {TENS}[p_size // 10 - 1] END AS w FROM part)
 SELECT p_partkey, 'خذ ' || w || ' مليغرام الان' AS said, 'خذ ' || CASE WHEN n <= 10 OR n >= 20 THEN CAST(n AS VARCHAR) WHEN n = 11 THEN '11 عشر' WHEN n = 12 THEN 'اثنا عشر' ELSE CAST(n - 10 AS VARCHAR) || ' عشر' END || ' مليغرام الان' AS folded FROM s""")
def arabic_numbers(spark, sf_dir):
    """Doses said in Arabic words, and the words folded back to digits as far as the grammar goes."""
    ship(spark)
    said = F.regexp_replace(python_text.said_in_arabic(F.concat(F.lit("خذ "), F.col("p_size").cast("string"), F.lit("mg الان"))), " +", " ")
    rows = table(spark, sf_dir, "part").select("p_partkey", said.alias("said"))
    return rows.withColumn("folded", python_text.folded_arabic_numbers(F.col("said")))


@query("compounds_joined", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '') ELSE p_name END AS ref, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '') ELSE p_name END AS hyp FROM part")
def compounds_joined(spark, sf_dir):
    """Pairs of texts that differ in where words are split, brought together before they are scored."""
    ship(spark)
    part = table(spark, sf_dir, "part")
    pair = python_text.joined_compounds(F.col("p_name"), F.regexp_replace("p_name", " ", F.when(F.col("p_size") % 2 == 0, "").otherwise(" ")))
    return part.withColumn("x", pair).select("p_partkey", "x.ref", "x.hyp")
