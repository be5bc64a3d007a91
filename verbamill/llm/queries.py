"""The registered queries of this subpackage, each over its whole table, and the SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_topk, fixity, neardup, packing, quality_classifier, quality_rules, secret_scan, token_counts, toxicity
from .common import spread, table, written

#: A document of more tokens than this is over the limit.
TOKEN_LIMIT = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), ids=False)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",))
    return quality_classifier.score(docs, model, metadata=("n_chars",))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), words=4, percent=80)


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the pages, as the records of WARC files, against a second replica. The tables hold one copy only, so
    the other is that copy with known damage: every 61st page's record has another last byte, every 61st is gone."""
    records = fixity.warc_records(table(spark, sf_dir, "pages"))
    other = F.when(F.col("page_id") % 61 == 0, F.concat(F.substring("record", 1, F.length("record") - 5), F.lit("~\r\n\r\n"))).otherwise(F.col("record"))
    kept = F.coalesce(F.col("page_id") % 61 != 1, F.lit(True))
    both = records.select("warc_file", "length", "page_id", fixity.fixed(F.col("record")).alias("sha256"), F.when(kept, fixity.fixed(other)).alias("other"))
    both = written(fixity.placed(both), "replicas")
    return fixity.audit(both.drop("other"), both.filter("other IS NOT NULL").withColumn("sha256", F.col("other")).drop("other"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("segments")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(*columns)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_topk": op2_exact_topk,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_minhash_neardup": op5_minhash_neardup,
    "op6_merkle_fixity": op6_merkle_fixity,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
}

#: The digests, offsets and damage as SQL; the trees only find the same rows without comparing all.
OP6_SQL = """
WITH records AS (
  SELECT page_id, page_id // 1000 AS warc_file, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
placed AS (
  SELECT *, strlen(record) AS length, sum(strlen(record)) OVER (PARTITION BY warc_file ORDER BY page_id) - strlen(record) AS "offset" FROM records)
SELECT CAST(warc_file AS BIGINT) AS warc_file, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, page_id,
  CASE page_id % 61 WHEN 0 THEN 'changed' ELSE 'missing' END AS status, sha256(record) AS expected,
  CASE page_id % 61 WHEN 0 THEN sha256(record[:-6] || '~' || chr(13) || chr(10) || chr(13) || chr(10)) END AS found
FROM placed WHERE page_id % 61 IN (0, 1)
"""

#: Integer inner products of all pairs.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

#: Every pair that shares a shingle, counted; then the smallest id that links reach.
OP5_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
c AS (SELECT md5(array_to_string(list_sort(g), chr(10))) AS k, min(doc_id) AS rep, any_value(g) AS g, any_value(len(g)) AS n FROM s WHERE len(g) > 0 GROUP BY 1),
x AS (SELECT rep, n, unnest(g) AS sh FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.sh = b.sh AND a.rep < b.rep GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (na + nb - common)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT rep AS node, rep AS seen FROM c UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
label AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
member AS (SELECT s.doc_id, c.rep FROM s JOIN c ON md5(array_to_string(list_sort(s.g), chr(10))) = c.k)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(component, n.doc_id) AS component_id, n.doc_id = coalesce(component, n.doc_id) AS kept
FROM n LEFT JOIN member m ON m.doc_id = n.doc_id LEFT JOIN label ON label.node = m.rep
"""

#: The counts by windows as rows, and the hosts' shrunk rates.
OP10_SQL = """
WITH x AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda z: z <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda z: regexp_matches(z, '[^ \\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 3), lambda i: {'i': i, 'g': array_to_string(words[i:i + 4], ' ')})) AS u FROM x WHERE len(words) >= 5),
d AS (SELECT doc_id, u.i AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, u.g) AS n FROM g) WHERE n > 1),
m AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM d) GROUP BY doc_id),
c AS (
  SELECT doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(m.n, 0) AS n_repeat_words FROM x LEFT JOIN m USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f GROUP BY host),
q AS (SELECT avg(k / n) AS mean, var_pop(k / n) AS var FROM h),
r AS (SELECT mean, CASE WHEN var > 0 THEN greatest(1.0, least(1000.0, mean * (1 - mean) / var - 1)) ELSE 1000.0 END AS strength FROM q),
v AS (SELECT host, (k + mean * strength) / (n + strength) >= 0.6 AS failed FROM h, r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT failed AS kept FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""

ORACLE_SQL: dict[str, str] = {"op2_exact_topk": OP2_SQL, "op5_minhash_neardup": OP5_SQL, "op6_merkle_fixity": OP6_SQL, "op10_quality_rules": OP10_SQL}
