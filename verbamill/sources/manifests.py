"""Scans of manifests. Schemas are declared, so no scan is spent on inferring one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = "id string, dataset string, source string, config string, split string, audio_path string, text string, duration_s double, metadata map<string,string>"
SEGMENT = "segment_id string, ground_truth_text string, processed_text string, speaker string, environment string, category string, start_s double, end_s double, duration_s double"
CLEAN = "id string, audio_path string, text string, source_manifest string, source_audio string, raw_text string, duration_s double, trim_start_s double, trim_end_s double, chars_per_s double"
TRAIN = "audio_path string, text string, source string, dialect string, code_switch boolean, eval_only boolean, weight double, duration double, stage int"
EVAL = "id string, category string, audio_path string, duration_s double, language string, transcript string, transcript_normalized string, medical_terms array<string>, source string, tags array<string>"
PREDICTION = "id string, category string, language string, duration_s double, ref string, pred string, wer double, inference_seconds double, rtf double, extra map<string,string>"
LEXICON = "term string, type string, aliases array<string>, priority double, region string"
GOLD = "id string, split string, difficulty string, contains_error boolean, transcript string, lang string, gold_spans array<struct<original_text:string,possible_correction:string,issue_type:string>>"
CORRECTION = "original string, corrected string, context string, timestamp string"


def jsonl(spark: SparkSession, path: str, schema: str, bad: str = "raise") -> DataFrame:
    """JSON Lines; blank lines are skipped. Malformed lines raise, are skipped ("skip") or stay in _bad ("keep")."""
    mode = {"raise": "FAILFAST", "skip": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad]
    reader = spark.read.option("mode", mode)
    if bad == "keep":
        return reader.option("columnNameOfCorruptRecord", "_bad").schema(f"{schema}, _bad string").json(path)
    return reader.schema(schema).json(path)


def with_provenance(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with the file and the line (from 1, blank lines counted) that each row came from; rows that do not
    parse have null fields, blank lines give none. Lines are counted by blocks of files first."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_manifest"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_at", F.monotonically_increasing_id())
    sizes = text.groupBy("_manifest", "_block").agg(F.count("*").alias("_n"))
    before = sizes.select("_manifest", "_block", (F.sum("_n").over(Window.partitionBy("_manifest").orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_manifest", "_block").orderBy("_at"))
    rows = text.join(before, ["_manifest", "_block"]).withColumn("_line_no", (F.col("_before") + inside).cast("long"))
    return rows.filter(F.trim("value") != "").select(F.from_json("value", schema).alias("_j"), "_manifest", "_line_no").select("_j.*", "_manifest", "_line_no")


def any_root(spark: SparkSession, roots: list[str], pattern: str = "*") -> str | None:
    """The first of the folders that has a file below it whose name fits the pattern, at any of three depths."""
    conf = spark._jsc.hadoopConfiguration()
    for root in roots:
        for depth in ("", "*/", "*/*/"):
            glob = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{depth}{pattern}")
            if glob.getFileSystem(conf).globStatus(glob):
                return root
    return None


def eval_set(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An evaluation set: one JSON array or document a file (.json), or JSON Lines (anything else)."""
    return spark.read.option("multiLine", str(path.endswith(".json")).lower()).option("mode", "FAILFAST").schema(schema).json(path)


def documents(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One JSON document a file, a folder for each model, which becomes a column; files that do not parse are skipped."""
    files = spark.read.option("multiLine", "true").option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").schema(schema).json(root)
    return files.withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a byte-order mark in front of it is not part of the first name."""
    fields = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else None
    found = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    found = found.toDF(*[c.lstrip("﻿") for c in found.columns])
    return found if fields is None else found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of text, none of them empty."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")


def keyed_by_stem(df: DataFrame, path: str, order: str) -> DataFrame:
    """One row for each lower-cased file stem, the last by `order`."""
    stem = F.lower(F.regexp_extract(F.col(path), r"([^/]+?)(?:\.[^./]+)?$", 1))
    return df.withColumn("stem", stem).groupBy("stem").agg(F.max_by(F.struct(*df.columns), order).alias("x")).select("stem", "x.*")


def first_root(candidates: DataFrame, listing: DataFrame, path: str, rank: str, keys: list[str]) -> DataFrame:
    """Of each key's candidate paths the first by rank that the listing of files has."""
    return candidates.join(listing.select(path).distinct(), path, "left_semi").groupBy(*keys).agg(F.min_by(path, rank).alias(path))


def subtitles(df: DataFrame, keys: list[str], at: str, line: str) -> DataFrame:
    """Segments of numbered lines of which some are time stamps: (keys, start_s, end_s, text). A segment ends where the
    next begins; the last has no end and is dropped, and so is text before the first stamp."""
    from verbamill.functions.text import timestamp_seconds

    marked = df.withColumn("t", timestamp_seconds(F.trim(F.col(line))))
    w = Window.partitionBy(*keys).orderBy(at)
    marked = marked.withColumn("n", F.count("t").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("n > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t").isNull(), F.struct(at, line)))), lambda x: x[line]), " ")
    grouped = marked.groupBy(*keys, "n").agg(F.max("t").alias("start_s"), text.alias("text"))
    return grouped.withColumn("end_s", F.lead("start_s").over(Window.partitionBy(*keys).orderBy("n"))).filter("end_s IS NOT NULL").select(*keys, "start_s", "end_s", "text")
