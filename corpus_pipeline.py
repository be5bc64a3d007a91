"""From documents to packed training sequences.

STAGES run in order, each on all that the one before it kept; `run` writes each stage's rows as Parquet in the shared
folder and hands the reread table to the next. All but the last return the columns of documents. Null and empty texts
and ids, ties, repeated rows and extra columns are treated as the operators' own docstrings say; a document without
an id is never dropped for a class or a near copy it cannot be matched with. An empty table stays empty.

No SQL expresses the learned stages, so ORACLE_SQL is None; tests/llm compares each stage with a plain version of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbamill.llm import neardup, packing, quality_classifier, secret_scan, toxicity
from verbamill.llm.common import spread, table, written

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    docs, metadata = spread(docs), tuple(c for c in ("n_chars",) if c in docs.columns)
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), metadata=metadata)
    return quality_classifier.keep(docs, model, metadata=metadata)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id. Where that id is repeated, each of its
    texts stays, once: of rows that agree in id and text the least by their other columns."""
    found = neardup.near_duplicates(docs)
    ids = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("times"))
    ids = written(ids.filter("NOT kept OR times > 1"), "decided")
    rest = docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)  # null ids among them
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = docs.join(ids.filter("kept").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id", F.md5("text").alias("version"))
    again = again.agg(F.first("text").alias("text"), F.min(F.struct(F.lit(0), *others)).alias("others"))
    return rest.unionAll(again.select(*[F.col(f"others.{c}").alias(c) if c in others else F.col(c) for c in docs.columns]))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text masked and its length brought up to date."""
    out = secret_scan.mask_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("toxicity", clean), ("near_copies", distinct), ("secrets", masked), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
