"""Labelled rows to learn from: a bounded sample, chosen by a hash of the id, with the texts of those rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Most labelled rows that a model is fitted on.
MOST_LABELLED = 12_000


def fold(of: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, of: int, held_out: int, most: int = MOST_LABELLED, id_col: str = "doc_id", columns: tuple = ("text",)) -> DataFrame:
    """(label, *columns) for at most `most` labelled ids outside the fold that is held out, a row for each: of rows that
    repeat an id, the least by its columns. The ids are sent to the tasks that read the documents, which are read once;
    the sample is a written table."""
    ids = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(of, id_col) != held_out)).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    ids = ids.select(F.col(id_col).alias("of"), "label").orderBy(F.xxhash64("of"), "of").limit(most)
    rows = docs.select(F.col(id_col).alias("of"), *[F.col(c) for c in columns])
    one = rows.join(F.broadcast(ids), "of").groupBy("of", "label").agg(F.min(F.struct(*columns)).alias("row"))
    return written(one.select("label", *[F.col(f"row.{c}").alias(c) for c in columns]), "labelled")
